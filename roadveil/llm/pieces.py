"""Operator 3: N-best segmentation into pieces, and back."""

from __future__ import annotations

import gc
import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadveil.llm.common import vocabulary
from roadveil.llm.recent import Recent, gather, release, slices

SPACE = "▁"
RESULT = "n_pieces long, ids_crc32 long, best double, scores array<double>, n_best_crc32 array<long>, restored boolean"
#: a piece's probability falls with its rank as 1 / (FLAT + rank)
FLAT = 300
#: scores are whole multiples of 1 / UNIT, so that sums are exact and don't depend on their order
UNIT = 1 << 20


def log_probability(rank: float, ranks: int) -> float:
    """Of a piece by its merge rank (Zipf with a flat head), all ranks together being 1."""
    whole = math.log((FLAT + ranks) / FLAT)
    return math.floor(-math.log((FLAT + rank) * whole) * UNIT) / UNIT


@dataclass
class PieceModel:
    """Pieces with scores, byte pieces for what no piece spells, and the lattice over them."""

    scores: dict[str, tuple[int, float]] = field(repr=False)
    byte_ids: list[int] = field(repr=False)
    byte_score: float
    spelled: list[bytes] = field(repr=False)
    trie: dict = field(repr=False, default_factory=dict)  # of the pieces from their last character on
    alone: bytes = b""
    marks: bytes = b""

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, byte_ids, spelled = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                spelled.append(b"")
            else:
                ranks[piece] = (i, -model.get_score(i))
                spelled.append(piece.replace(SPACE, " ").encode())
        # pieces that the vocabulary sets apart (runs of blanks) rank behind all others
        most = max((r for _, r in ranks.values() if r < 1e8), default=0.0) + 1
        scores = {p: (i, log_probability(min(r, most), int(most))) for p, (i, r) in ranks.items()}
        # as for any unknown character: below every piece that is in use
        return cls.of(scores, byte_ids, min((w for _, w in scores.values()), default=0.0) - 10, spelled)

    @classmethod
    def of(cls, scores, byte_ids, byte_score, spelled) -> PieceModel:
        used = {c for p in scores if len(p) > 1 for c in p}
        # a segment is a run of blanks and what follows it. Characters in no piece are segments of their own, and
        # a mark that no piece has behind a letter or digit begins one there; none of it is so if a piece has a blank further on
        inner = any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in scores)
        alone = "" if inner else "".join(c for c in "\n\t\r" if c not in used and c not in scores)
        marks = "" if inner else "".join(sorted(set(",.;:!?") - {c for p in scores for x, c in zip(p, p[1:], strict=False) if x.isalnum()}))
        trie: dict = {}  # character -> [trie of the characters before it, ids of the piece that begins here or None, its score]
        for piece, (i, score) in scores.items():
            below, node = trie, None
            for c in reversed(piece):
                node = below.setdefault(c, [{}, None, 0.0])
                below = node[0]
            if node:
                node[1:] = (i,), score
        return cls(scores, byte_ids, byte_score, spelled, trie, b"all" if inner else alone.encode(), marks.encode())

    def arcs(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the pieces that end at ``end``."""
        below, at, out = self.trie, end, []
        while at:
            node = below.get(text[at - 1])
            if node is None:
                break
            at -= 1
            below, ids, weight = node
            if ids:
                out.append((at, ids, weight))
        if text[end - 1] not in self.scores:
            raw = text[end - 1].encode("utf-8", "surrogatepass")
            out.append((end - 1, tuple([self.byte_ids[b] for b in raw]), self.byte_score * len(raw)))
        return out

    def forward(self, text: str) -> list[float]:
        """Viterbi: the best score of every prefix."""
        root, known, ahead = self.trie, self.scores, [0.0]
        for end, last in enumerate(text, 1):
            best, below, at = -math.inf, root, end
            while at:
                node = below.get(text[at - 1])
                if node is None:
                    break
                at -= 1
                below = node[0]
                if node[1] and (total := ahead[at] + node[2]) > best:
                    best = total
            if last not in known:
                best = max(best, ahead[end - 1] + self.byte_score * len(last.encode("utf-8", "surrogatepass")))
            ahead.append(best)
        return ahead

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first.

        Forward Viterbi gives the best score of every prefix. A search from the end
        of the text backwards adds, to the score of the pieces taken, the exact best score of what is
        left: its estimate is never wrong, so complete paths come out in order. Of equal estimates the
        newest goes on, the longest piece first, so that ties cost no more than the paths asked for.
        """
        ahead = self.forward(text)
        # estimate (negative), age (negative), end of what is left, score of the pieces taken, those pieces as a chain
        queue, age, out = [(-ahead[-1], 0, len(text), 0.0, None)], 0, []
        while queue and len(out) < n:
            total, _, end, taken, chain = heapq.heappop(queue)
            if not end:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                out.append((-total, tuple(ids)))
                continue
            for start, piece, weight in self.arcs(text, end):
                age -= 1
                heapq.heappush(queue, (-(ahead[start] + weight + taken), age, start, weight + taken, (piece, chain)))
        return out

    def look_at(self, segments: list[str]) -> tuple[list[bytes], np.ndarray]:
        """For ``Recent``: best ids, best score and how far the second best falls short."""
        ids, figures = [], []
        for s in segments:
            found = self.n_best(s.replace(" ", SPACE), 2)
            ids.append(pack("<%dI" % len(found[0][1]), *found[0][1]))
            figures.append((found[0][0], found[0][0] - found[1][0] if len(found) > 1 else math.inf))
        return ids, np.array(figures, float).reshape(-1, 2)

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All segments of ``texts``, cut at byte positions, and where each text's begin (and the last's end).

        A space stands before every text that is not empty. No piece spans two segments, so the lattice of a text is
        theirs in a row.
        """
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        cut = np.zeros(len(raw) + 1, bool)
        if self.alone != b"all" and len(raw):
            blank = raw == 32
            cut[1:-1] = blank[1:] & ~blank[:-1]
            if self.alone:
                own = np.isin(raw, np.frombuffer(self.alone, np.uint8))
                cut[:-1] |= own
                cut[1:] |= own
            if self.marks:
                plain = np.zeros(256, bool)
                plain[[c for c in range(128) if chr(c).isalnum()]] = True
                cut[1:-1] |= np.isin(raw[1:], np.frombuffer(self.marks, np.uint8)) & plain[raw[:-1]]
        cut[at] = True
        ends = np.flatnonzero(cut)
        if not len(raw):
            ends = ends[:1]
        out = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
        return out, np.searchsorted(ends, at)

    def decode(self, ids) -> bytes:
        """Pieces' bytes in a row, without the space put before the text; ids that are none are left out."""
        spelled, size = self.spelled, len(self.spelled)
        text = b"".join([spelled[i] for i in ids if i is not None and 0 <= i < size])
        return text[1:] if text[:1] == b" " else text


def combine(best: list[list[tuple[float, object]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best choices of one candidate for each of many segments.

    ``best``: each segment's candidates, best first; segments whose second candidate is not among the n - 1
    cheapest changes need not be given. States are taken from a heap in order of their cost, equal ones by the later
    segments' candidates. Gives (cost, {segment: candidate}) with candidate > 0.
    """
    out, queue, seen = [], [(0.0, (0,) * len(best))], set()
    while queue and len(out) < n:
        cost, state = heapq.heappop(queue)
        if state in seen:
            continue
        seen.add(state)
        out.append((cost, {k: c for k, c in enumerate(state) if c}))
        for k, c in enumerate(state):
            if c + 1 < len(best[k]):
                heapq.heappush(queue, (cost + best[k][c][0] - best[k][c + 1][0], (*state[:k], c + 1, *state[k + 1 :])))
    return out


class Segmenter:
    """N-best of whole texts through a bounded memory of segments."""

    def __init__(self, model: PieceModel, n: int, remembered: int = 48 << 20):
        self.model, self.n = model, n
        self.memory = Recent(model.look_at, remembered, figures=2)
        self.paths = lru_cache(maxsize=20_000)(self._paths)
        self.spelled = pa.array(model.spelled, pa.binary())

    def _paths(self, segment: str) -> list[tuple[float, np.ndarray]]:
        return [(w, np.array(ids, "<u4")) for w, ids in self.model.n_best(segment.replace(" ", SPACE), self.n)]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[list[tuple[float, np.ndarray]], bool]]:
        """([(score, ids), ...] best first, whether the best ids give the text again) of every text.

        Segments are searched for their own n best only where a change is cheap enough to
        come among the n best of the text: at the n - 1 smallest gaps.
        """
        for run in whole_slices(texts):
            parts, bounds = self.model.segments(run)
            coded = parts.dictionary_encode()
            rows = self.memory.rows(coded.dictionary)[coded.indices.to_numpy()] if len(parts) else np.empty(0, np.int64)
            ids, starts = gather(self.memory.values, self.memory.starts, rows)
            scores, gaps = self.memory.figures[rows].T
            sums = np.concatenate([[0.0], np.cumsum(scores)])[bounds]
            back = self.spelled.take(pa.array(ids)).fill_null(b"")
            ends = np.frombuffer(back.buffers()[1], np.int32)[: len(back) + 1]
            made = back.buffers()[2].to_pybytes() if len(back) and back.buffers()[2] else b""
            for text, a, b, low, high in zip(run, bounds[:-1].tolist(), bounds[1:].tolist(), sums[:-1], sums[1:], strict=True):
                raw, first, last = text.as_buffer().to_pybytes(), starts[a], starts[b]
                same = made[ends[first] + (last > first) : ends[last]] == raw
                yield self.choose(parts, gaps, ids, starts, a, b, float(high - low)), same

    def choose(self, parts, gaps, ids, starts, a: int, b: int, score: float) -> list[tuple[float, np.ndarray]]:
        best = ids[starts[a] : starts[b]]
        if self.n == 1 or a == b:
            return [(score, best)]
        own = gaps[a:b]
        few = np.argpartition(own, self.n - 2)[: self.n - 1] if b - a >= self.n else np.arange(b - a)
        few = few[np.lexsort((few, own[few]))]
        # among equal gaps the first segments
        few = few if b - a < self.n else self.earliest(own, own[few[-1]])
        few = [a + int(k) for k in few if own[k] < math.inf]
        options = [self.paths(parts[k].as_py()) for k in few]
        out = []
        for cost, changes in combine(options, self.n):
            pieces, at = [], a
            for k, c in sorted((few[k], options[k][c][1]) for k, c in changes.items()):
                pieces += [ids[starts[at] : starts[k]], c]
                at = k + 1
            out.append((score - cost, np.concatenate([*pieces, ids[starts[at] : starts[b]]])))
        return out

    def earliest(self, own: np.ndarray, most: float) -> np.ndarray:
        small, equal = np.flatnonzero(own < most), np.flatnonzero(own == most)
        return np.concatenate([small, equal[: self.n - 1 - len(small)]])


def whole_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of a bounded size; a very long text is a run of its own."""
    for run, groups in slices(texts):
        yield run if len(run) == len(groups) else pa.array(["".join(run.to_pylist())])


@lru_cache(maxsize=1)
def segmenter(path: str, n: int) -> Segmenter:
    """One a worker process, so that its bounded memory serves all tasks."""
    return Segmenter(PieceModel.load(path), n)


def encode(docs: DataFrame, n: int = 3, model_path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> the n best segmentations of every whole text, as digests.

    ``(doc_id, n_pieces, ids_crc32, best, scores, n_best_crc32, restored)``: number and checksum of the best ids, its score, the
    scores and checksums of all n, and whether decoding the best gives the text again.
    Null or empty text: no pieces, score 0, restored. Very long texts are taken whole, a
    segment (blank to blank) at a time. Repeated rows and null ids are kept; an empty table gives no rows;
    further columns are ignored.
    """
    path = model_path or vocabulary("piece_bpe_32k.model")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches):
        segment = segmenter(path, n)
        gc.freeze()  # the trie holds no cycles; walking it time and again costs more than the search
        gc.disable()
        try:
            yield from digests(batches, segment)
        finally:
            gc.enable()
            release()

    def digests(batches, segment):
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
        for b in batches:
            rows = []
            for found, same in segment(b.column(1)):
                crcs = [zlib.crc32(ids.tobytes()) for _, ids in found]
                rows.append((len(found[0][1]), crcs[0], found[0][0], [w for w, _ in found], crcs, same))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id long, {RESULT}")


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """``rows(doc_id, ids array<int>)`` -> ``(doc_id, text)``; null ids give null, ids that no piece has (null,
    negative, too large) are left out."""
    path = model_path or vocabulary("piece_bpe_32k.model")

    def run(batches):
        model = PieceModel.load(path)
        for b in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
