"""Operator 8: cost-balanced packing of token sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from roadveil.llm.common import vocabulary
from roadveil.llm.recent import Recent, gather, per_text, release, slices

CAPACITY = 4096
END_ID = 2
MARKS = (".", ",")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkEncoder:
    """Ids of whole texts, by way of a bounded memory of chunks.

    The tokenizer drops white space, never joins ids across it and lower-cases what is
    not one of its special tokens, so a text's ids are those of its lower-cased chunks
    between ASCII white space, one after the other. A comma or full stop that ends
    a chunk after an ASCII letter has ids of its own, too. Each different chunk of a run of texts is looked up once.
    """

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.marks = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS]
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ending[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.memory = Recent(self.encode, remembered)

    def encode(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Many chunks at a call. A chunk of letters alone is one word, whose last id is the one that
        ends words; other chunks are told apart by the number that the tokenizer gives each."""
        out: list = [b""] * len(chunks)
        words = [k for k, c in enumerate(chunks) if c.isalpha()]
        rest = [k for k, c in enumerate(chunks) if not c.isalpha()]
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([chunks[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(part):
                self.cut(out, part, ids, ends)
            else:  # letters to Python that are none to the tokenizer
                rest += part
        for at in range(0, len(rest), 2048):
            part = rest[at : at + 2048]
            found = self.tokenizer.encode([chunks[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            self.cut(out, part, np.array(found.ids, "<u4"), np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))))
        return out, np.empty((len(out), 0))

    @staticmethod
    def cut(out: list, part: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        blob, ends = ids.tobytes(), (4 * ends).tolist()
        for k, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
            out[k] = blob[a:b]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text with the end id behind."""
        for run, groups in slices(texts):
            lower = pc.if_else(pc.match_substring(run, "<|"), run, pc.ascii_lower(run))
            chunks = pc.ascii_split_whitespace(lower)
            coded = chunks.flatten().dictionary_encode()
            marked = [pc.match_substring_regex(coded.dictionary, f"[a-z][{m}]\\z").to_numpy(zero_copy_only=False) for m in MARKS]
            stems = pc.replace_substring_regex(coded.dictionary, r"([a-z])[.,]\z", r"\1").dictionary_encode()
            rows = self.memory.rows(stems.dictionary)[stems.indices.to_numpy()]
            values, starts = gather(self.memory.values, self.memory.starts, rows)
            for hit, ids in zip(marked, self.marks, strict=True):
                values = np.insert(values, np.repeat(starts[1:][hit], len(ids)), np.tile(ids, int(hit.sum())))
                starts = starts + np.concatenate([[0], np.cumsum(hit * len(ids))])
            ids, ends = gather(values, starts, coded.indices.to_numpy().astype(np.int64))
            parts = ends[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()]
            ends = np.cumsum(per_text(np.diff(parts), groups))
            ids = np.insert(ids, ends, self.end_id).astype("<u4")
            yield from np.split(ids, ends[:-1] + np.arange(1, len(ends)))


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One a worker process, so that its bounded memory serves all tasks."""
    return ChunkEncoder(path)


class Packer:
    """Deals the documents of one task out to sequences, a window of tokens at a time.

    Cost of a piece of n tokens: ``linear * n + quadratic * n * n``. A window of documents
    goes, in descending length, each to the cheapest of the window's sequences that
    has room for it; if none has, the cheapest with any room takes what fits and the rest
    goes on. A window opens only as many sequences as its tokens fill, and what is left
    over moves to the next window. The last tokens of a task (fewer than one sequence)
    make sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, base: int, capacity: int = CAPACITY, window: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 2048):
        self.base, self.capacity, self.window = base, capacity, max(window, capacity)
        self.linear, self.quadratic = linear, quadratic
        self.sequences = 0
        self.waiting: list[tuple] = []  # (doc_id, ids, start, doc_tokens)
        self.tokens = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def piece(self, doc, start: int, length: int, sequence: int, offset: int) -> tuple:
        doc_id, ids, first, total = doc
        cut = ids[4 * (start - first) : 4 * (start - first + length)]
        return doc_id, start, length, zlib.crc32(cut), total, self.base + sequence, offset

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        start = 0
        while total - start >= self.capacity:
            yield self.piece((doc_id, ids, 0, total), start, self.capacity, self.sequences, 0)
            self.sequences += 1
            start += self.capacity
        if start < total:
            self.waiting.append((doc_id, ids[4 * start :], start, total))
            self.tokens += total - start
        if self.tokens >= self.window:
            yield from self.deal()

    def deal(self) -> Iterator[tuple]:
        count = self.tokens // self.capacity
        room = np.full(count, self.capacity, np.int64)
        costs = np.zeros(count)
        docs = sorted(self.waiting, key=lambda d: -len(d[1]))
        left = []
        for doc in docs:
            start, end = doc[2], doc[2] + len(doc[1]) // 4
            while start < end:
                fits = np.where(room >= end - start, costs, np.inf)
                at = int(fits.argmin()) if count else 0
                if not count or np.isinf(fits[at]):
                    open_ = np.where(room > 0, costs, np.inf)
                    at = int(open_.argmin()) if count else 0
                    if not count or np.isinf(open_[at]):
                        left.append((doc[0], doc[1][4 * (start - doc[2]) :], start, doc[3]))
                        break
                n = int(min(room[at], end - start))
                yield self.piece(doc, start, n, self.sequences + at, int(self.capacity - room[at]))
                room[at] -= n
                costs[at] += self.cost(n)
                start += n
        self.sequences += count
        self.waiting, self.tokens = left, sum(len(d[1]) // 4 for d in left)

    def finish(self) -> Iterator[tuple]:
        if self.tokens >= self.capacity:
            yield from self.deal()
        size = room = 0
        for doc in self.waiting:
            start, end = doc[2], doc[2] + len(doc[1]) // 4
            while start < end:
                if not room:
                    size = room = 1 << (self.tokens.bit_length() - 1)
                n = min(room, end - start)
                yield self.piece(doc, start, n, self.sequences, size - room)
                room, self.tokens, start = room - n, self.tokens - n, start + n
                if not room:
                    self.sequences += 1
        self.waiting = []


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, window: int = 1 << 20) -> DataFrame:
    """One row per piece of every document of ``docs(doc_id, text)``.

    Each task packs the rows it reads, so nothing is shuffled and a lost task can be run
    again alone; a sequence's number holds its task's number. Memory is one window of ids.
    Null or empty text: the end id alone. A very long text: cut into full sequences and a
    rest. Null doc_ids stay null, repeated rows are packed as often as they occur, an
    empty table gives no pieces, further columns are ignored.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")

    def run(batches):
        encode = encoder(path)
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, capacity, window)
        names = [p.split()[0] for p in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                rows.extend(packer.add(doc_id, ids.tobytes()))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.finish())
        if rows:
            yield batch(rows)
        release()

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
