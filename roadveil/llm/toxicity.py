"""Operator 6: toxicity by a chain of linear classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from roadveil.llm.common import staged, unit_hash
from roadveil.llm.recent import Recent, gather, release, slices

CATEGORIES = ("quality", "toxic")
STRIPPED = b".,;:!?\"'()[]"
BUCKETS = 1 << 40
#: bytes from which a word counts as a run without blanks, and of a part of one
LONG, GRAM = 32, 6


def word_features(chunk: bytes) -> tuple[int, ...]:
    """Hashed features of a lower-cased chunk: the word, its beginnings, its ending; of a long run without blanks also
    every ``GRAM`` bytes in it."""
    word = chunk.strip(STRIPPED)
    if not word:
        return ()
    parts = {b"w" + word}
    parts.update(b"p" + word[:n] for n in (4, 5, 6) if len(word) >= n)
    parts.add(b"s" + chunk[-3:])
    if len(word) > LONG:
        parts.update(b"g" + word[k : k + GRAM] for k in range(len(word) - GRAM + 1))
    return tuple(xxhash.xxh64_intdigest(p, 6) % BUCKETS for p in sorted(parts))


def chunks_of(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of every text, cut at all of Unicode's blanks."""
    return pc.utf8_split_whitespace(pc.ascii_lower(texts))


@dataclass
class Chain:
    """Per category: weights of the selected features, of the probabilities of all earlier
    categories, and a constant."""

    categories: tuple[str, ...]
    features: np.ndarray  # hashes, sorted
    weights: np.ndarray  # categories x features
    links: list[np.ndarray]
    constants: list[float]

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """rows x features -> rows x categories, one category after the other."""
        sums = present.astype(float) @ self.weights.T.astype(float)
        out = np.zeros(sums.shape)
        for k in range(len(self.categories)):
            out[:, k] = sigmoid(sums[:, k] + self.constants[k] + out[:, :k] @ self.links[k])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 0.03, steps: int = 600) -> np.ndarray:
    """L2 logistic regression by accelerated gradient descent, ``share`` being the rows' weights; the last weight is the constant."""
    weight = (share / max(1e-12, share.sum())).astype(np.float32)
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    scale = float(((x1 * x1).sum(1) * weight).sum()) / 4 + penalty / max(1, len(x)) + 1e-6
    decay = np.full(x1.shape[1], penalty / max(1, len(x)), np.float32)
    decay[-1] = 0
    w = np.zeros(x1.shape[1], np.float32)
    ahead = w.copy()
    for t in range(steps):
        p = sigmoid(x1 @ ahead)
        step = ahead - (x1.T @ (weight * (p - y)) + decay * ahead) / scale
        ahead = step + t / (t + 3) * (step - w)
        w = step
    return w


def train(categories, features, x, labels, folds, share=None) -> Chain:
    """``labels``: rows x categories, NaN where unknown. Later models see the earlier
    categories' probabilities as they come from models that had not seen the row's fold."""
    seen = np.zeros((len(x), 0), np.float32)
    share = np.ones(len(x)) if share is None else share
    weights, links, constants = [], [], []
    n_folds = int(folds.max()) + 1 if len(folds) else 1
    for k in range(len(categories)):
        y = labels[:, k]
        known = ~np.isnan(y)
        inputs = np.concatenate([x, seen], 1)
        fit = lambda rows: logistic(inputs[rows], y[rows], share[rows])  # noqa: B023, E731
        whole = fit(known)
        out = np.zeros(len(x), np.float32)
        for f in range(n_folds):
            rows = known & (folds != f)
            w = fit(rows) if rows.any() else np.zeros(inputs.shape[1] + 1, np.float32)
            own = folds == f
            out[own] = sigmoid(inputs[own] @ w[:-1] + w[-1])
        weights.append(whole[: x.shape[1]])
        links.append(whole[x.shape[1] : -1].astype(float))
        constants.append(float(whole[-1]))
        seen = np.concatenate([seen, out[:, None]], 1)
    return Chain(tuple(categories), features, np.array(weights), links, constants)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = 6000, selected: int = 768, least_z: float = 6.0, folds: int = 5) -> Chain | None:
    """Train on a bounded sample: up to ``sample`` labelled documents in all, up to half of
    them positive in the last category, chosen by a hash of their id; rows are weighted so that either class counts as among
    all labels. Per category the ``selected`` features whose document shares differ most between its two classes
    are kept, if by at least ``least_z`` standard deviations. None without labels."""
    rows = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)])
    last = f"y{len(categories) - 1}"
    parts = [rows.filter(F.coalesce(F.col(last), F.lit(0.0)) == v).orderBy(unit_hash("id"), "id").limit(sample // 2) for v in (1.0, 0.0)]
    chosen = staged(spark, parts[0].unionByName(parts[1]), "labelled")  # at most ``sample`` rows
    positive = F.coalesce(F.col(last), F.lit(0.0)) == 1.0
    of = lambda rows: tuple(rows.agg(F.count_if(positive), F.count_if(~positive)).first())
    all_of, sample_of = of(rows), of(chosen)

    def features(batches):
        for b in batches:
            found = []
            for chunks in chunks_of(b.column(1)):
                hashes = {h for c in set(chunks.as_py() or ()) for h in word_features(c.encode())}
                found.append(sorted(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "f"])

    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("t"))
    known = texts.join(F.broadcast(chosen.select("id")), "id", "left_semi")
    ids = staged(spark, known.mapInArrow(features, "id long, f array<long>"), "features").join(F.broadcast(chosen), "id")
    totals = ids.agg(F.count("*"), *[F.sum(F.when(F.col(f"y{k}") == v, 1).otherwise(0)) for k in range(len(categories)) for v in (1.0, 0.0)]).first()
    if not totals[0]:
        return None
    counts = ids.select(F.explode("f").alias("h"), *[f"y{k}" for k in range(len(categories))]).groupBy("h").agg(*[F.sum(F.when(F.col(f"y{k}") == v, 1).otherwise(0)).alias(f"n{k}{int(v)}") for k in range(len(categories)) for v in (1.0, 0.0)])
    counts = staged(spark, counts, "counts")
    keep: set[int] = set()
    for k in range(len(categories)):
        n1, n0 = max(1, totals[1 + 2 * k] or 0), max(1, totals[2 + 2 * k] or 0)
        p1, p0 = F.col(f"n{k}1") / n1, F.col(f"n{k}0") / n0
        mean = (F.col(f"n{k}1") + F.col(f"n{k}0") + 1) / (n1 + n0 + 2)
        z = F.abs(p1 - p0) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + F.lit(1e-12))
        top = counts.select("h", z.alias("z")).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "h").limit(selected)
        keep.update(r[0] for r in top.collect())
    columns = np.array(sorted(keep), np.int64)
    held = F.array(*[F.lit(int(h)) for h in columns]) if len(columns) else F.array().cast("array<bigint>")
    data = sorted(ids.select("id", F.array_intersect("f", held).alias("f"), *[f"y{k}" for k in range(len(categories))]).collect(), key=lambda r: (r["id"], r["f"]))
    x = np.zeros((len(data), len(columns)), np.float32)
    for i, r in enumerate(data):
        x[i, np.searchsorted(columns, np.array(r["f"], np.int64))] = 1
    y = np.array([[np.nan if r[f"y{k}"] is None else min(1.0, r[f"y{k}"]) for k in range(len(categories))] for r in data], np.float32)
    fold = np.array([xxhash.xxh32_intdigest(str(r["id"]), 5) % folds for r in data])
    weight = [n / max(1, m) for n, m in zip(all_of, sample_of, strict=True)]
    return train(categories, columns, x, y, fold, np.array([weight[0] if v == 1 else weight[1] for v in y[:, -1]]))


def predictor(chain: Chain | None, categories=CATEGORIES):
    """An Arrow UDF: text -> the probability of every category, in the chain's order."""
    held: dict = {}

    @F.arrow_udf(ArrayType(DoubleType()))
    def predict(texts: pa.Array) -> pa.Array:
        if chain is None:
            return pa.array([[0.0] * len(categories)] * len(texts), pa.list_(pa.float64()))
        if not held:
            column = {int(h): i for i, h in enumerate(chain.features)}
            held["memory"] = Recent(lambda words: ([np.array([column[h] for h in word_features(w.encode()) if h in column], "<u4").tobytes() for w in words], np.empty((len(words), 0))), 16 << 20)
        memory, out = held["memory"], []
        for run, groups in slices(texts):
            words = chunks_of(run)
            coded = words.flatten().dictionary_encode()
            rows = memory.rows(coded.dictionary)[coded.indices.to_numpy()]
            hits, ends = gather(memory.values, memory.starts, rows)
            parts = ends[np.asarray(words.offsets) - words.offsets[0].as_py()]
            owner = np.repeat(np.repeat(np.arange(len(groups)), groups), np.diff(parts))
            for at in range(0, len(groups), 1024):
                a, b = np.searchsorted(owner, [at, at + 1024])
                present = np.zeros((len(groups[at : at + 1024]), len(chain.features)), np.float32)
                present[owner[a:b] - at, hits[a:b]] = 1
                out.append(chain.probabilities(present))
        release()
        found = np.concatenate(out) if out else np.empty((0, len(categories)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(categories)), pa.array(found.ravel()))

    return predict


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories=CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, toxic, p_<category>...)`` for every row of ``docs(doc_id, text)``.

    Whole texts count, each word once, so a very long text costs its length and repeated
    words change nothing. Null or empty text has no features and gets the constants'
    probability. No labelled rows: probability 0 throughout. Repeated rows and null ids are
    kept as they are; further columns are ignored.
    """
    chain = fit(spark, docs, labels, categories)
    p = predictor(chain, categories)(docs["text"].cast("string"))
    scored = docs.select(docs["doc_id"].alias("id"), p.alias("p"))
    last = len(categories) - 1
    return scored.select(F.col("id").alias("doc_id"), (F.col("p")[last] >= threshold).alias("toxic"), *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(categories)])


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories=CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """Rows whose last category is improbable, all columns unchanged: as ``score`` with this threshold, so repeated rows
    and null ids stay or go by their text, null and empty texts by the constants, and all stay without labels."""
    chain = fit(spark, docs, labels, categories)
    return docs.filter(predictor(chain, categories)(docs["text"].cast("string"))[len(categories) - 1] < threshold)
