"""Operator 7: personal data by patterns, and terms that reveal it by co-occurrence."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roadveil.llm.common import staged
from roadveil.llm.recent import release

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local@domain: each @ has the run of local characters before it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind as listed, then by start."""
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def said(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else NOT_DIGIT.sub('', value) if kind != 'ip' else value}"


def free_words(text: str, base):
    """Matches of the words outside of base spans."""
    taken, k = sorted((s, e) for _, s, e in base), 0
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(s < m.end() and m.start() < e for s, e in taken[k : k + len(KINDS) + 1]):
            yield m


FOUND = "doc_id long, key string, n_email long, n_ip long, n_card long, n_phone long, base string, text string, entities array<string>, words array<string>"
#: what every text with a base span has; some without one have it, too
TRACE = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9][ ().0-9-]+[0-9]"


def may_hold(text: Column) -> Column:
    """False only for texts without a base span."""
    return F.coalesce(text.rlike(TRACE), F.lit(False))


def text_key(text: Column) -> Column:
    """128 bits of a text, so that no two texts of a corpus share it."""
    return F.md5(text.cast("binary"))


def detect(docs: DataFrame) -> DataFrame:
    """Patterns over whole texts; where they find something, the text, its entities and all its other words."""

    def run(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        for b in batches:
            rows = []
            for text in b.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                entities = sorted({entity(k, text[s:e]) for k, s, e in spans})
                words = sorted({m[0].lower() for m in free_words(text, spans)}) if spans else []
                rows.append(([sum(s[0] == k for s in spans) for k in KINDS], said(spans), text if spans else None, entities, words))
            counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(KINDS))]
            texts = [pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, *texts, *lists], names=names)
        release()

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(text).alias("key"), F.when(may_hold(text), text).alias("text")).mapInArrow(run, FOUND)


def each_text(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``(row, key, n, text, entities, words)``: each different text with an entity, numbered, ``n`` times in the table."""
    first = [F.first(c).alias(c) for c in ("text", "entities", "words")]
    held = found.filter(F.size("entities") > 0).groupBy("key").agg(F.count("*").alias("n"), *first)
    return staged(spark, held.select(F.monotonically_increasing_id().alias("row"), "*"), "held")


def revealing_terms(spark: SparkSession, docs: DataFrame, texts: DataFrame, alpha: float = 1.5) -> DataFrame:
    """``(row, terms)``: of each of ``texts`` (see ``each_text``) its own words that disclose one of its entities, behind their grades.

    Over all documents: information of an entity ``IC(c) = log2(N / n(c))``, and what a
    term in the same document tells of it, ``PMI(c, t) = log2(N n(c, t) / (n(c) n(t)))``. A term
    is removed if PMI >= IC / alpha, generalised if PMI >= IC / (2 alpha) and over one bit. Counts
    are of whole documents, plain: an entity mentioned once is disclosed by all rare words beside it.

    Entities that are in one text alone have that text's number of copies as n(c) and as n(c, t) of each of its words, so together they
    ask once a word. Only entities of several texts are paired with words and counted.
    """
    total = docs.count()
    named = texts.select("row", "n", F.explode("entities").alias("entity"))
    known = staged(spark, named.join(named.groupBy("entity").agg(F.sum("n").alias("n_c"), F.count("*").alias("texts")), "entity"), "entities")
    alone = texts.join(known.filter("texts = 1").select("row").distinct(), "row")
    pairs = known.filter("texts > 1").select("row", "entity", "n_c").join(texts.select("row", "n", "words"), "row").select("row", "entity", "n_c", "n", F.explode("words").alias("term"))
    joint = staged(spark, pairs.groupBy("entity", "term").agg(F.first("n_c").alias("n_c"), F.sum("n").alias("both")), "joint")
    none = lambda kind: F.lit(None).cast(kind)
    asked = alone.select("row", none("string").alias("entity"), F.explode("words").alias("term"), F.col("n").alias("n_c"), F.col("n").alias("both"))
    asked = asked.unionByName(joint.select(none("long").alias("row"), "entity", "term", "n_c", "both"))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(docs["text"].cast("string")), r"[^\p{L}\p{N}]+"))).alias("term"))
    # counted before the join: a common word then costs it one row
    per_term = words.groupBy("term").agg(F.count("*").alias("n_t"))
    # a word that Spark splits in another way counts where it was seen
    told = asked.join(per_term, "term", "left").withColumn("n_t", F.greatest("both", "n_t"))
    ic = F.log2(F.lit(float(max(1, total))) / F.col("n_c"))
    pmi = F.log2(F.lit(float(max(1, total))) * F.col("both") / (F.col("n_c") * F.col("n_t")))
    grade = F.when(pmi >= ic / alpha, "remove").when((pmi >= ic / (2 * alpha)) & (pmi >= 1), "generalise")
    graded = staged(spark, told.select("row", "entity", "term", grade.alias("grade")).filter(F.col("grade").isNotNull() & (pmi > 0)), "terms")
    # met by entity and term, not by entity alone: a common entity has many texts and many terms
    shared = pairs.select("row", "entity", "term").join(graded.filter("entity IS NOT NULL").select("entity", "term", "grade"), ["entity", "term"])
    each = graded.filter("row IS NOT NULL").select("row", "grade", "term").unionByName(shared.select("row", "grade", "term"))
    return each.groupBy("row").agg(F.array_sort(F.collect_set(F.concat_ws(":", "grade", "term"))).alias("terms"))


def term_spans(text: str, terms, base) -> list[tuple[str, int, int]]:
    """Whole words of the revealing terms, outside of base spans."""
    grades = {}
    for t in terms or ():
        grade, _, term = t.partition(":")
        grades[term] = "remove" if "remove" in (grade, grades.get(term)) else grade
    if not grades:
        return []
    return sorted((f"term_{grade}", m.start(), m.end()) for m in free_words(text, base) if (grade := grades.get(m[0].lower())))


@F.arrow_udf(StringType())
def spans_of_terms(texts: pa.Array, terms: pa.Array) -> pa.Array:
    out = []
    for text, t in zip(texts, terms, strict=True):
        text = text.as_py() or ""
        out.append(said(term_spans(text, t.as_py(), base_spans(text))))
    return pa.array(out, pa.string())


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row a document.

    Null text counts as empty. Very long texts are scanned whole, every pattern in one pass
    over its characters. Repeated rows are each given a row; null ids stay null. Empty
    tables give no rows; further columns are ignored.
    """
    docs = docs.select(docs["doc_id"], docs["text"])
    found = staged(spark, detect(docs), "found")
    texts = each_text(spark, found)
    more = texts.select("row", "key", "text").join(revealing_terms(spark, docs, texts), "row").select("key", spans_of_terms("text", "terms").alias("more"))
    sha = F.sha2(F.col("base").cast("binary"), 256)
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")))
    return found.join(more, "key", "left").select("doc_id", *[f"n_{k}" for k in KINDS], sha.alias("base_sha256"), spans.alias("spans"))


def sanitised(text: str, terms) -> str:
    """Base spans give way to their kind; revealing terms to a class of words, or nothing."""
    base = base_spans(text)
    marks = [(s, e, f"[{k.upper()}]") for k, s, e in base]
    for k, s, e in term_spans(text, terms, base):
        general = "[NUMBER]" if text[s:e].isdigit() else "[NAME]" if text[s].isupper() else "[WORD]"
        marks.append((s, e, "" if k == "term_remove" else general))
    out, end = [], 0
    for s, e, mark in sorted(marks):
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join([*out, text[end:]])


@F.arrow_udf(StringType())
def sanitise_texts(texts: pa.Array, terms: pa.Array) -> pa.Array:
    out = pa.array([None if not x.is_valid else sanitised(x.as_py(), t.as_py()) for x, t in zip(texts, terms, strict=True)], pa.string())
    release()
    return out


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data and revealing terms out of ``text``;
    ``n_chars``, where there is one, follows. Null texts stay null, empty ones empty; repeated rows and null ids stay as they are; texts
    are taken whole; an empty table stays empty."""
    plain, text = docs.select(docs["doc_id"], docs["text"]), docs["text"].cast("string")
    # what is found is read once here, so it goes to its texts without a table between
    texts = each_text(spark, detect(plain.filter(may_hold(plain["text"].cast("string")))))
    terms = texts.select("row", "key").join(revealing_terms(spark, plain, texts), "row").select(F.col("key").alias("roadveil key"), F.col("terms").alias("roadveil terms"))
    # only texts that may hold something move
    joined = docs.filter(may_hold(text)).join(terms, text_key(text) == F.col("roadveil key"), "left")
    joined = joined.withColumn("text", sanitise_texts(text, F.col("roadveil terms")))
    rest = docs.filter(~may_hold(text)).withColumn("text", text)
    joined = rest.unionByName(joined.select(*[F.col(f"`{c}`") for c in docs.columns]))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
