"""Operator 12: texts' log-probabilities by a self-attention model over subword ids, beside a count of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadveil.llm import attention
from roadveil.llm.attention import CLASSES, KNOWN, PAD, SIZE, START, SYMBOLS, Attention
from roadveil.llm.common import batches_of, staged, vocabulary
from roadveil.llm.packing import ChunkEncoder
from roadveil.llm.recent import release, slices

#: the word that ends every text; no word between blanks is empty
END = ""
#: words at most that go to every task; all rarer ones are joined
FREQUENT = 100_000
#: ids of texts that are trained on at once, and of a piece of a long text
TAUGHT, PIECE = 1 << 19, 1 << 16
#: rounds of training, each with its learning rate; a training text is in one of them, and between two the tasks' parameters are averaged
RATES = (0.01, 0.01, 0.005, 0.002)
#: whole units of a parameter, so that averages do not depend on an order
UNIT = 1 << 24
#: what a class's ids share by the corpus, weighed against what follows the class before, in tokens
PRIOR = 10.0
BEGIN = 65535
#: bytes of texts that are cut into words at once
RUN_BYTES = 2 << 20
#: bytes of texts' ids that are scored at once
SCORED_BYTES = 1 << 18
#: bytes of words, or pairs of ids, that a task holds before it tells their counts
HELD = 8 << 20
#: a text with its ids; or a word, or a pair of ids (65536 * before + id), and how often it came
READ = "row long, doc_id long, text string, ids binary, word string, pair long, n long"
SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:long>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """Ids with one more than the vocabulary has as the end."""
    from tokenizers import Tokenizer

    return ChunkEncoder(path, Tokenizer.from_file(path).get_vocab_size())


def split_words(run: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts one after the other, A-Z lower-cased, and how many are each text's."""
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(run))
    words, offsets = chunks.flatten(), np.asarray(chunks.offsets) - chunks.offsets[0].as_py()
    full = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(before[offsets])


class Counts:
    """Counts by key of what a task reads, told whenever they outgrow a bound."""

    def __init__(self, name: str, kind: pa.DataType, bound: int = HELD):
        self.name, self.kind, self.bound = name, kind, bound
        self.tables: list[pa.Table] = []
        self.size = 0

    def add(self, keys: pa.Array, counts: pa.Array) -> Iterator[pa.RecordBatch]:
        self.tables.append(pa.table([keys, counts], names=["k", "n"]))
        self.size += self.tables[-1].nbytes
        if self.size > 2 * self.bound:
            self.merge()
            if self.size > self.bound:
                yield from self.tell()

    def merge(self) -> None:
        if self.tables:
            merged = pa.concat_tables(self.tables).group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"]).combine_chunks()
            self.tables, self.size = [merged], merged.nbytes

    def tell(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for table in self.tables:
            for b in table.to_batches(max_chunksize=100_000):
                yield row(b.num_rows, **{self.name: b.column(0), "n": b.column(1)})
        self.tables, self.size = [], 0


READ_KINDS = {"row": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "ids": pa.binary(), "word": pa.string(), "pair": pa.int64(), "n": pa.int64()}


def row(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(size, k) for c, k in READ_KINDS.items()], names=list(READ_KINDS))


def read(path: str):
    """Partition worker: ``doc_id, text, learn`` -> ``READ``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(path), TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        words, pairs = Counts("word", pa.string()), Counts("pair", pa.int64())
        for b in batches:
            texts, learn = b.column(1).fill_null(""), b.column(2)
            kept, count = texts.filter(learn), learn.true_count
            for run, _ in slices(kept, RUN_BYTES):
                counted = pc.value_counts(split_words(run)[0])
                yield from words.add(counted.field(0), counted.field(1))
            if count:
                yield from words.add(pa.array([END]), pa.array([count], pa.int64()))
            ids, found, size = [], [], 0
            for each, taught in zip(encode(texts), learn.to_pylist(), strict=True):
                each = each.astype("<u2")
                ids.append(each.tobytes())
                if taught:
                    found.append(np.concatenate([[BEGIN], each[:-1]]).astype(np.int64) * 65536 + each)
                    size += len(each)
                if found and (size > 1 << 20 or len(ids) == b.num_rows):
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield from pairs.add(pa.array(keys), pa.array(n))
                    found, size = [], 0
            for at in range(0, b.num_rows, 1000):
                part = slice(at, at + 1000)
                yield row(len(ids[part]), row=pa.array(number + np.arange(len(ids[part]))), doc_id=b.column(0)[part], text=texts[part], ids=pa.array(ids[part], pa.binary()))
                number += len(ids[part])
        yield from words.tell()
        yield from pairs.tell()
        release()

    return run


class Vocabulary:
    """What the corpus says of ids: their classes, a class behind an id, an id of a class behind another."""

    def __init__(self, pairs: DataFrame, size: int):
        """``pairs(pair, n)``. The driver gets counts by id; by class before and id; and by the most frequent ids before and behind: as
        many as the vocabulary allows, whatever the corpus."""
        spark = pairs.sparkSession
        by_id = pairs.groupBy((F.col("pair") % 65536).alias("id")).agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(size, np.int64)
        counts[by_id.column(0).to_numpy()] = by_id.column(1).to_numpy()
        self.classes = attention.classes_of(counts)
        #: frequent ids by themselves, others by class
        self.symbols = KNOWN + self.classes.astype(np.int64)
        most = np.argsort(-counts, kind="stable")[: min(KNOWN, np.count_nonzero(counts))]
        self.symbols[most] = np.arange(len(most))
        known = spark.createDataFrame([(i, int(c), int(s)) for i, (c, s) in enumerate(zip(self.classes.tolist(), self.symbols.tolist(), strict=True))] + [(BEGIN, START, KNOWN + START)], "id long, class int, symbol int")
        each = pairs.select((F.col("pair") / 65536).cast("long").alias("before"), (F.col("pair") % 65536).alias("id"), "n").join(F.broadcast(known.toDF("before", "c", "s")), "before")
        before, ids, n = each.groupBy("c", "id").agg(F.sum("n").alias("n")).toArrow().columns
        before, ids, n = before.to_numpy(), ids.to_numpy(), n.to_numpy()
        behind = np.zeros((CLASSES + 2, CLASSES))
        np.add.at(behind, (before, self.classes[ids]), n)
        usual = (behind.sum(0) + 1) / (behind.sum() + CLASSES)
        chance = (behind + PRIOR * usual) / (behind.sum(1, keepdims=True) + PRIOR)
        # ids that occur have a column each, the others of a class share one
        share = (counts + 1) / np.bincount(self.classes, weights=counts + 1, minlength=CLASSES)[self.classes]
        seen = np.flatnonzero(counts)
        self.column = np.full(size, -1, np.int64)
        self.column[seen] = np.arange(len(seen))
        unseen, at = np.unique(self.classes[counts == 0], return_inverse=True)
        self.column[counts == 0] = len(seen) + at
        first = np.concatenate([seen, [np.flatnonzero((counts == 0) & (self.classes == c))[0] for c in unseen]]).astype(np.int64)
        own = np.zeros((CLASSES + 2, len(first)))
        own[before, self.column[ids]] = n
        kind = self.classes[first]
        within = (own + PRIOR * share[first]) / (behind[:, kind] + PRIOR)
        # the same with the id before in place of its class, for frequent ids; what others come to is held back for them
        told = each.filter(F.col("s") < KNOWN).join(F.broadcast(known.toDF("id", "class", "symbol")), "id").groupBy("s", "symbol").agg(F.sum("n").alias("n")).toArrow()
        s, symbol, n = (told.column(i).to_numpy() for i in range(3))
        exact = np.zeros((KNOWN, SYMBOLS))
        exact[s, symbol] = n
        class_of = np.concatenate([self.classes[most], np.full(KNOWN - len(most), PAD), np.arange(CLASSES + 2)]).astype(np.int64)
        near = np.zeros((KNOWN, CLASSES + 2))
        np.add.at(near.T, class_of[:KNOWN], exact[:, :KNOWN].T)
        after = near[:, :CLASSES] + exact[:, KNOWN : KNOWN + CLASSES]
        row = class_of[:KNOWN]
        direct = np.concatenate([(after + PRIOR * chance[row]) / (after.sum(1, keepdims=True) + PRIOR), chance])
        self.direct = np.log(direct).astype(np.float32)
        back = PRIOR / (near + PRIOR)
        pair = np.zeros((KNOWN, KNOWN), np.float32)
        n = len(most)
        pair[:n, :n] = np.log10((exact[:n, :n] + PRIOR * within[row[:n, None], self.column[most][None]]) / (near[:n][:, row[:n]] + PRIOR))
        self.within, self.back, self.pair = np.log10(within).astype(np.float32), np.log10(back).astype(np.float32), pair

    def score(self, model: Attention, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10-probability of every id of texts that lie one after the other: of its class, by the model; of the id in its class, by the corpus."""
        classes, symbols = self.classes[ids], self.symbols[ids]
        found = model.log_probs(classes, symbols, lengths) / math.log(10)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        before, last = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        before[1:], last[1:] = classes[:-1], symbols[:-1]
        before[starts], last[starts] = START, KNOWN + START
        exact = last < KNOWN
        both = exact & (symbols < KNOWN)
        part = self.within[before, self.column[ids]]
        exact &= ~both
        part[exact] += self.back[last[exact], classes[exact]]
        part[both] = self.pair[last[both], symbols[both]]
        return found + part


def trained(read: DataFrame, known: Vocabulary) -> np.ndarray:
    """Parameters after all training texts, dealt by their numbers to as many rounds as ``RATES`` has. In each, every task goes on from the
    same parameters over the texts that it reads; their average, weighed by ids, begins the next."""
    params = Attention(known.direct).params
    # no more than training looks up, one copy a worker for all rounds
    shared = read.sparkSession.sparkContext.broadcast((known.classes, known.symbols, known.direct))
    texts = read.filter(F.col("row").isNotNull() & ~held_out(F.col("doc_id")))

    def learn(rate: float, start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder.cache_clear()  # of an earlier pass; no ids are made here
            classes, symbols, direct = shared.value
            model, count = Attention(direct, start), 0
            for held, fresh in gathered(batches):
                ids = np.concatenate(held)
                model.train(classes[ids], symbols[ids], np.array([len(x) for x in held]), np.array(fresh), rate)
                count += len(ids)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([np.rint(model.params.astype(np.float64) * UNIT).astype(np.int64) * count], pa.list_(pa.int64()))], names=["n", "p"])
            release()

        return run

    for turn, rate in enumerate(RATES):
        told = texts.filter(F.col("row") % len(RATES) == turn).select("ids").mapInArrow(learn(rate, params), "n long, p array<long>")
        with batches_of(read.sparkSession, 1000):
            sums = told.select("n", F.posexplode("p").alias("at", "p")).groupBy("at").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toArrow()
        if sums.num_rows:
            at, p, n = (sums.column(i).to_numpy() for i in range(3))
            params = np.empty(SIZE, np.float32)
            params[at] = p / n / UNIT
    shared.unpersist()
    return params


def gathered(batches: Iterator[pa.RecordBatch], most: int = TAUGHT, piece: int = PIECE) -> Iterator[tuple[list[np.ndarray], list[bool]]]:
    """All ids of the texts, about ``most`` at a time, and which pieces begin a text. Longer texts come in pieces that begin with the last id of the piece before."""
    held, fresh, size = [], [], 0
    for b in batches:
        for x in b.column(0):
            ids = np.frombuffer(x.as_buffer(), "<u2")
            for at in range(0, len(ids), piece):
                held.append(ids[max(0, at - 1) : at + piece])
                fresh.append(at == 0)
                size += len(held[-1])
                if size >= most:
                    yield held, fresh
                    held, fresh, size = [], [], 0
    if held:
        yield held, fresh


def scorer(shared: Broadcast, total: int, distinct: int, end: int):
    """Partition worker: ``row, doc_id, text, ids`` -> ``SCORED``; rare words are told by text, as their counts are not here.
    ``shared`` is a vocabulary, the model's parameters, the frequent words and their counts (behind them 0, of any other), one copy a worker for all its tasks."""
    least = math.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        known, params, frequent, often = shared.value
        model = Attention(known.direct, params)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n_tokens, n_known, base, rare = [], [], [], []
                for texts, groups in slices(b.column(2), RUN_BYTES):
                    words, sizes = split_words(texts)
                    coded = words.dictionary_encode()
                    counts = often[pc.index_in(coded.dictionary, value_set=frequent).fill_null(len(frequent)).to_numpy(zero_copy_only=False)]
                    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    ends = np.cumsum(np.add.reduceat(sizes, np.cumsum(groups) - groups))
                    begins = np.concatenate([[0], ends[:-1]])
                    hit = (counts > 0)[place]
                    sums = np.append(np.where(hit, (np.log10(counts + 1) - least)[place], 0.0), 0.0)
                    base.append(np.where(ends > begins, np.add.reduceat(sums, begins), 0.0) + math.log10(end + 1) - least)
                    n_tokens.append(ends - begins + 1)
                    hits = np.concatenate([[0], np.cumsum(hit)])
                    n_known.append(hits[ends] - hits[begins] + (end > 0))
                    # rare words of every text, each once
                    text = np.repeat(np.arange(len(ends)), ends - begins)
                    odd, n = np.unique(text[~hit] * len(counts) + place[~hit], return_counts=True)
                    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(odd % max(1, len(counts)))), pa.array(n, pa.int64())], names=["word", "n"])
                    rare.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(odd, np.arange(len(ends) + 1) * len(counts)), pa.int32()), pairs))
                scores = np.empty(b.num_rows)
                for first, rows in runs_of(b.column(3)):
                    ids = [np.frombuffer(x, "<u2") for x in rows]
                    lengths = np.array([len(x) for x in ids])
                    each = known.score(model, np.concatenate(ids).astype(np.int64), lengths)
                    scores[first : first + len(rows)] = np.add.reduceat(each, np.cumsum(lengths) - lengths)
                told = [pa.array(np.concatenate(x)) for x in (n_tokens, n_known, base)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *told, pa.array(scores), pa.concat_arrays(rare)], names=[f.split()[0] for f in SCORED.split(", ")])
        release()

    return run


def runs_of(ids: pa.Array, most: int = SCORED_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts' ids, about ``most`` bytes at a time: the first text's number, and theirs."""
    held, first, size = [], 0, 0
    for i, x in enumerate(ids.to_pylist()):
        if held and size + len(x) > most:
            yield first, held
            held, first, size = [], i, 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


def common_words(words: DataFrame, most: int) -> dict[str, int]:
    """The words of the largest counts, as many as ``most`` lets in with all of an equal count; by powers of two parted in eight, so that
    only sums reach the driver before."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, taken = None, 0
    for of, n in sizes:
        if taken + n > most:
            break
        least, taken = of, taken + n
    return {} if least is None else {r[0]: r[1] for r in words.filter(level >= least).collect()}


def score(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    One pass reads the texts and tells their ids and the counts of words and of pairs of ids of all training texts. The model is trained on
    all ids of all training texts, once each. It gives the class of the next id, the corpus's counts the id in
    its class behind the class before; together a probability over all ids and the end of a text. Windows overlap, each id is
    scored in one. Words' counts: at most ``frequent`` words go to the tasks, the others are joined, text by text, so no vocabulary is ever whole
    in one place.

    Null and empty texts are their end alone; a null doc_id counts as a training text; repeated rows each count and are each
    given one; very long texts are scored whole, in bounded slices; an empty table gives none; where nothing is to learn from, counts are zero
    and the model is the untrained one; further columns are ignored. The tokenizer must have fewer than 65,535 ids.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")
    size = encoder(path).end_id + 1
    known_rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("learn", ~held_out(F.col("doc_id")))
    with batches_of(spark, 1000):
        told = staged(spark, known_rows.mapInArrow(read(path), READ), "lm-read")
    words = staged(spark, told.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    known = Vocabulary(staged(spark, told.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "lm-pairs"), size)
    params = trained(told, known)
    total, distinct, end = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    common = common_words(words.filter(F.col("word") != END), frequent)
    texts = told.filter("row IS NOT NULL").select("row", "doc_id", "text", "ids")
    shared = spark.sparkContext.broadcast((known, params, pa.array(list(common), pa.string()), np.array([*common.values(), 0], np.int64)))
    with batches_of(spark, 500):
        found = staged(spark, texts.mapInArrow(scorer(shared, total, distinct, end), SCORED), "lm-scored")
    shared.unpersist()
    odd = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    counted = odd.join(words.withColumnRenamed("n", "c"), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1) - math.log10(total + distinct + 1)
    rest = counted.groupBy("row").agg(F.sum(F.col("n") * log).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more"))
    both = found.drop("rare").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("rest")).alias("base_score"), "score")
