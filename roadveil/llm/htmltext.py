"""Operator 4: HTML to text by its layout."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript datalist iframe noembed noframes object audio video canvas desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure fieldset hr".split())
LISTS = frozenset("ul ol menu dir".split())
ROWS = frozenset("thead tbody tfoot".split())
#: an end tag that is implied: start tag -> (open elements it closes, elements that stop the search)
CLOSES_P = BLOCK - frozenset("body html li dd dt option optgroup legend summary".split())
SCOPE = frozenset("html body table td th caption button object".split())
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"]) | SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | SCOPE),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tbody": (ROWS | {"tr", "td", "th", "caption"}, frozenset(["table"])),
    "thead": (ROWS | {"tr", "td", "th", "caption"}, frozenset(["table"])),
    "tfoot": (ROWS | {"tr", "td", "th", "caption"}, frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: as in browsers, elements deeper than this are siblings, so that every search of the open elements is short
DEEPEST = 512
HEAD = frozenset("base link meta script style template title noscript head html".split())
#: "<!-->" and "<!--->" are comments, too, and "--!>" ends one
COMMENT_END = re.compile(r"(?<=<!)--+>|--!?>")
#: a column that is wider than this does not push the others apart, so that a text grows with its page alone
WIDEST = 80
NAME = re.compile(r"[A-Za-z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+)?")
DECLARED = re.compile(r"(display|visibility)\s*+:\s*+([a-z-]++)\s*+(!\s*+important)?+", re.I)
BRACE = re.compile(r"[{}]")
WHOLE = re.compile(r"\s*([+-]?[0-9]{1,10})(?![0-9])")
BUTTONS = frozenset("submit button reset".split())
#: selectors that are kept: a tag, classes and an id of one element, without what lies around it
SELECTOR = re.compile(r"(?:\*|[A-Za-z][A-Za-z0-9-]*)?(?:[.#][A-Za-z_-][A-Za-z0-9_-]*)*")
PART = re.compile(r"[.#]?[A-Za-z_-][A-Za-z0-9_-]*")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict
    children: list = field(default_factory=list)  # elements and strings


def tokens(page: str):
    """("text", str), ("start", tag, attributes, closed itself), ("end", tag); one pass, no back-tracking."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = COMMENT_END.search(page, lt + 2)
            at = end.end() if end else size
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?") or closing:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<"
                at = lt + 1
            continue
        tag, at, attributes = name[0].lower(), name.end(), {}
        while (at := BETWEEN.match(page, at).end()) < size and page[at] != ">":
            found = ATTRIBUTE.match(page, at)
            if not found:
                at += 1
                continue
            at, value = found.end(), ""
            if "=" in found[0][len(found[1]) :] and at < size:
                quote = page[at]
                if quote in "\"'":
                    end = page.find(quote, at + 1)
                    end = size if end < 0 else end
                    value, at = page[at + 1 : end], end + 1
                elif quote != ">":
                    end = at
                    while end < size and page[end] not in " \t\n\r\f>":
                        end += 1
                    value, at = page[at:end], end
            attributes.setdefault(found[1].lower(), value)
        if at >= size:
            return  # an unfinished tag is no content
        at += 1
        if closing:
            yield "end", tag
            continue
        yield "start", tag, attributes, page[at - 2] == "/"
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            stop = end.start() if end else size
            if stop > at:
                yield "raw", page[at:stop]
            at = stop
        elif tag == "plaintext":
            yield "raw", page[at:]
            return


def tree(page: str, sheets: list[str] | None = None) -> Element:
    """Elements with the tags that authors may leave out put in; the texts of style elements for screens go to ``sheets``."""
    root = Element("html", {})
    body = Element("body", {})
    stack, head_done = [root], False
    opened: Counter[str] = Counter()  # by tag, so that what isn't open isn't sought

    def push(node):
        stack.append(node)
        opened[node.tag] += 1

    def drop(k):
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def close(tags, stops):
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                drop(k)
                if stack[-1].tag in tags:
                    close(tags, stops)
                return
            if stack[k].tag in stops:
                return

    def into_body():
        nonlocal head_done
        if not head_done:
            head_done = True
            drop(1)
            root.children.append(body)
            push(body)

    for token in tokens(page):
        kind = token[0]
        if kind in ("text", "raw"):
            if not head_done and kind == "text":
                if not token[1].strip():
                    continue
                into_body()
            top = stack[-1]
            if kind == "raw" and top.tag == "style" and sheets is not None and top.attributes.get("media", "").strip().lower() in ("", "all", "screen"):
                sheets.append(token[1])
            if kind == "text" and top.tag in ("table", "tr", *ROWS):
                if not token[1].strip():
                    continue
            top.children.append(html.unescape(token[1]) if kind == "text" or top.tag in ("textarea", "title") else token[1])
        elif kind == "start":
            _, tag, attributes, closed = token
            if tag == "html":
                root.attributes = attributes | root.attributes
                continue
            if tag == "body":
                into_body()
                body.attributes = attributes | body.attributes
                continue
            if not head_done:
                if tag == "head":
                    if len(stack) == 1:
                        push(Element("head", attributes))
                        root.children.append(stack[-1])
                    continue
                if tag not in HEAD and not (len(stack) > 2):
                    into_body()
            if tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", *ROWS):
                stack[-1].children.append(row := Element("tr", {}))
                push(row)
            node = Element(tag, attributes)
            stack[-1].children.append(node)
            if len(stack) < DEEPEST and tag not in VOID and not (closed and tag not in BLOCK and tag not in RAW):
                push(node)
        else:
            tag = token[1]
            if tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif tag == "head":
                if not head_done:
                    drop(1)
            elif tag not in ("html", "body") and opened[tag]:
                stops = ("td", "th", "table") if tag not in ("table", "tr", "td", "th", *ROWS) else ("table",) if tag != "table" else ()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        drop(k)
                        break
                    if stack[k].tag in stops or stack[k].tag == "body":
                        break
    return root


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """``display`` and ``visibility`` of a list of declarations: the last one counts, but for one that is important."""
    told: dict[str, tuple[bool, str]] = {}
    for part in text.split(";"):
        if found := DECLARED.fullmatch(part.strip()):
            name, value, important = found[1].lower(), found[2].lower(), bool(found[3])
            if important or not told.get(name, (False, ""))[0]:
                told[name] = (important, value)
    return told


class Rules:
    """What style elements say of ``display`` and ``visibility``. Rules whose selectors look at other elements, at states or at attributes, and those
    within at-rules, are left out."""

    def __init__(self, sheets: list[str]):
        self.told: dict[frozenset, dict[str, tuple]] = {}  # parts of a selector -> name -> (important, specificity, order, value)
        order = 0
        for sheet in sheets:
            for selectors, body in self.blocks(CSS_COMMENT.sub(" ", sheet)):
                said = declarations(body)
                for selector in selectors.split(",") if said else ():
                    order += 1
                    selector = selector.strip()
                    if not selector or not SELECTOR.fullmatch(selector):
                        continue
                    found = PART.findall(selector)
                    parts = frozenset(p if p[0] in ".#" else p.lower() for p in found)
                    weight = (sum(p[0] == "#" for p in found), sum(p[0] == "." for p in found), sum(p[0] not in ".#" for p in found))
                    mine = self.told.setdefault(parts, {})
                    for name, (important, value) in said.items():
                        mine[name] = max(mine.get(name, (False,)), (important, weight, order, value))
        common = Counter(p for parts in self.told for p in parts)
        self.by_part: dict[str, list[frozenset]] = {}
        for parts in self.told:  # sought by the part that the fewest rules have
            self.by_part.setdefault(min(parts, key=lambda p: (common[p], p), default="*"), []).append(parts)

    @staticmethod
    def blocks(sheet: str):
        """(selectors, body) of the outermost rules in one pass; at-rules are skipped with what they hold."""
        at, size = 0, len(sheet)
        while at < size:
            brace = sheet.find("{", at)
            if brace < 0:
                return
            head = sheet[at:brace].rpartition(";")[2].strip()
            end, depth = brace, 0
            for found in BRACE.finditer(sheet, brace) if head.startswith("@") else ():
                depth += 1 if found[0] == "{" else -1
                end = found.start()
                if not depth:
                    break
            if not head.startswith("@"):
                end = sheet.find("}", brace)
                end = size if end < 0 else end
                yield head, sheet[brace + 1 : end]
            at = end + 1

    def of(self, node: Element) -> dict[str, str]:
        """``display`` and ``visibility`` of an element as rules and its own style have them."""
        best: dict[str, tuple] = {}
        if self.told:
            own = {node.tag, *(f".{c}" for c in node.attributes.get("class", "").split())}
            if name := node.attributes.get("id", "").strip():
                own.add(f"#{name}")
            for part in (*own, "*"):
                for parts in self.by_part.get(part, ()):
                    if parts <= own:
                        for name, said in self.told[parts].items():
                            best[name] = max(best.get(name, (False,)), said)
        if "style" in node.attributes:
            for name, (important, value) in declarations(html.unescape(node.attributes["style"])).items():
                best[name] = max(best.get(name, (False,)), (important, (math.inf,), 0, value))
        return {name: said[-1] for name, said in best.items()}


def hidden(node: Element, said: dict[str, str]) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a):
        return True
    return said["display"] == "none" if "display" in said else "hidden" in a


def visible(said: dict[str, str], before: bool) -> bool:
    """Visibility goes to the children, which may set it anew."""
    return said["visibility"] not in ("hidden", "collapse") if said.get("visibility", "inherit") != "inherit" else before


def whole(text: str | None) -> int | None:
    """A whole number at the beginning of an attribute, as browsers read it; beyond 32 bits, it is none."""
    found = WHOLE.match(text or "")
    return int(found[1]) if found and abs(int(found[1])) < 2**31 else None


class Flow:
    """Lines of one formatting context: inline text, line ends and blank lines between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # line ends due before the next text
        self.pending = False  # a blank is due
        self.mark = ""

    def text(self, text: str, kept: bool) -> None:
        if kept:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.end_line(force=True)
                if line:
                    self.put(line)
            return
        words = BLANKS.sub(" ", text)
        if words == " ":
            self.pending = self.pending or bool(self.inline)
            return
        if words.startswith(" ") or self.pending:
            if self.inline:
                self.put(" ")
            words = words.lstrip(" ")
        self.pending = words.endswith(" ")
        self.put(words.rstrip(" "))

    def put(self, text: str) -> None:
        if not self.inline:
            if self.lines:
                self.lines += [""] * (self.gap - 1 if self.gap > 1 and self.lines[-1] != "" else 0)
            self.gap = 0
            if self.mark:
                self.inline.append(self.mark)
                self.mark = ""
        self.inline.append(text)

    def end_line(self, force: bool = False) -> None:
        if self.inline:
            self.lines.append("".join(self.inline).replace("\xa0", " ").rstrip())
            self.inline = []
        elif force:
            self.lines.append("")
        self.pending = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def add(self, lines: list[str], spaced: bool) -> None:
        """Finished lines of an inner context."""
        self.block(spaced)
        if lines:
            if self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            if self.mark:
                lines = [self.mark + lines[0], *(" " * len(self.mark) + x if x else x for x in lines[1:])]
                self.mark = ""
            self.lines += lines
            self.gap = 2 if spaced else 1

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((k for k, x in enumerate(lines) if x), 0)
        return lines[start:]


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells of (lines, columns, rows) as text columns two blanks apart; below a cell of several rows its columns stay empty. Rows without any text take
    part in that, but give no line."""
    placed, taken = [], {}  # column -> rows still to be left empty
    for row in rows:
        at, cells, after = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, span, deep in row:
            while at in taken:
                at += 1
            cells.append((at, lines, span))
            if deep > 1:
                after.update(dict.fromkeys(range(at, at + span), deep - 1))
            at += span
        taken = after
        if any(lines for lines, _, _ in row):
            placed.append(cells)
    widths: list[int] = []
    for cells in placed:
        for at, lines, span in cells:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = min(WIDEST, max([widths[at], *map(len, lines)]))
    for cells in placed:
        for at, lines, span in cells:
            if span > 1:
                short = min(WIDEST, max([0, *map(len, lines)])) - sum(widths[at : at + span]) - 2 * (span - 1)
                widths[at + span - 1] += max(0, short)
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = []
    for cells in placed:
        for k in range(max([1, *(len(c[1]) for c in cells)])):
            text = ""
            for at, lines, _ in cells:
                if k < len(lines) and lines[k]:
                    text = (text + "  " if len(text) > starts[at] - 2 and text else text.ljust(starts[at])) + lines[k]
            out.append(text)
    return out


def span_of(node: Element, name: str = "colspan") -> int:
    value = node.attributes.get(name, "").strip()
    return min(int(value), 100) if value.isdecimal() and len(value) < 6 and int(value) else 1


def render(page: str) -> str:
    """All visible text of a page, laid out: blocks on lines of their own, blank lines where
    margins stand, list items marked and indented, table cells in aligned columns."""
    flows, kept, shown, lists = [Flow()], [False], [True], []
    tables: list[dict] = []
    sheets: list[str] = []
    work: list = [("visit", tree(page, sheets))]
    rules = Rules(sheets)
    while work:
        what, node = work.pop()
        flow = flows[-1]
        if what == "visit":
            if isinstance(node, str):
                if shown[-1]:
                    flow.text(node, kept[-1])
                continue
            tag, said = node.tag, rules.of(node)
            if hidden(node, said):
                continue
            seen = visible(said, shown[-1])
            if tag == "input":
                if seen and node.attributes.get("type", "").strip().lower() in BUTTONS and (caption := node.attributes.get("value", "").strip()):
                    flow.text(f" {html.unescape(caption)} ", False)
                continue
            if tag == "br":
                flow.end_line(force=True)
                flow.gap = 0
                continue
            if tag == "hr":
                flow.block(True)
                continue
            if tag == "img":
                if seen and (alt := node.attributes.get("alt", "").strip()):
                    flow.text(html.unescape(alt), False)
                continue
            if tag in ("td", "th", "caption", "li", "blockquote", "dd", "table"):
                flow.block(tag in SPACED)
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in LISTS and lists))
            if tag in LISTS:
                down = tag == "ol" and "reversed" in node.attributes
                start = whole(node.attributes.get("start"))
                if start is None:
                    start = sum(isinstance(c, Element) and c.tag == "li" for c in node.children) if down else 1
                lists.append([tag == "ol", start, -1 if down else 1])
            elif tag == "table":
                tables.append({"rows": [], "lines": []})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            if tag in ("td", "th", "caption", "li", "blockquote", "dd"):
                flows.append(Flow())
            kept.append(kept[-1] or tag in ("pre", "textarea", "xmp", "listing", "plaintext"))
            shown.append(seen)
            work.append(("leave", node))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                first = next((c for c in children if isinstance(c, Element) and c.tag == "summary"), None)
                children = [first] if first else []
            if kept[-1] and tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            work += [("visit", c) for c in reversed(children)]
            continue
        tag = node.tag
        kept.pop()
        shown.pop()
        if tag in ("td", "th", "caption", "li", "blockquote", "dd"):
            lines = flows.pop().done()
            outer = flows[-1]
            if tag in ("td", "th") and tables and tables[-1]["rows"]:
                tables[-1]["rows"][-1].append((lines, span_of(node), span_of(node, "rowspan")))
            elif tag == "caption" and tables:
                tables[-1]["lines"] += lines
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    number = whole(node.attributes.get("value"))
                    number = lists[-1][1] if number is None else number
                    mark = f"{number}. "
                    lists[-1][1] = number + lists[-1][2]
                if lines:
                    outer.add([mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])], False)
            else:
                outer.add(["  " + x if x else x for x in lines], tag == "blockquote")
        elif tag == "table":
            made = tables.pop()
            flow.add(made["lines"] + aligned(made["rows"]), True)
        elif tag in LISTS:
            lists.pop()
            flow.block(not lists)
        elif tag in BLOCK:
            flow.block(tag in SPACED)
    return "\n".join(flows[0].done())


@F.arrow_udf(StringType())
def rendered(pages: pa.Array) -> pa.Array:
    return pa.array([render(p.as_py()) if p.is_valid else None for p in pages], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> ``(page_id, text, n_lines)``.

    Null html gives null text and no lines; empty html, or a page with nothing visible, the
    empty text. Unfinished tags and comments at the end are no content; there is no
    recursion, and one pass over the characters, whatever their number. Style elements hide what they say of tags, classes and ids (see ``Rules``). A cell
    reaches over 100 columns or rows at most, so that a text does not outgrow its page. Repeated rows and null ids are kept;
    empty tables give no rows; further columns are ignored.
    """
    found = pages.select(pages["page_id"].alias("page_id"), rendered(pages["html"].cast("string")).alias("text"))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return found.select("page_id", "text", lines.cast("long").alias("n_lines"))
