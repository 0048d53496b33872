"""Operator 5: language identification by a byte convolutional network."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadveil.llm.common import raw_bytes, unit_hash
from roadveil.llm.recent import release

WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Filters of two, three and four bytes over fixed windows, ReLU, max pooling, softmax.

    ``taps[k]`` holds, for tap k of all nine, the response of every byte: a convolution
    over one-hot bytes is a sum of table rows.
    """

    langs: list[str]
    window: int = 256
    filters: int = 8
    taps: np.ndarray = field(default=None, repr=False)  # 9 x 256 x filters
    bias: np.ndarray = field(default=None, repr=False)  # 3 x filters
    dense: np.ndarray = field(default=None, repr=False)  # 3*filters x langs
    shift: np.ndarray = field(default=None, repr=False)

    def start(self, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.3, (sum(WIDTHS), 256, self.filters)).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), self.filters), np.float32)
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * self.filters, len(self.langs))).astype(np.float32)
        self.shift = np.zeros(len(self.langs), np.float32)
        return self

    def respond(self, x: np.ndarray) -> np.ndarray:
        """windows x positions x all filters, before pooling."""
        span = x.shape[1] - max(WIDTHS) + 1
        out, tap = [], 0
        for w, width in enumerate(WIDTHS):
            act = np.repeat(self.bias[w][None, None], len(x), 0).repeat(span, 1)
            for j in range(width):
                act += self.taps[tap + j][x[:, j : j + span]]
            tap += width
            out.append(act)
        return np.concatenate(out, 2)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        params = [self.taps, self.bias, self.dense, self.shift]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        n_filters = len(WIDTHS) * self.filters
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            act = self.respond(xb)
            at = act.argmax(1)
            pooled = np.take_along_axis(act, at[:, None], 1)[:, 0]
            hidden = np.maximum(pooled, 0)
            prob = softmax(hidden @ self.dense + self.shift)
            prob[np.arange(batch), yb] -= 1
            prob /= batch
            back = (prob @ self.dense.T) * (pooled > 0)
            grads = [np.zeros_like(self.taps), np.zeros_like(self.bias), hidden.T @ prob, prob.sum(0)]
            grads[1] += back.sum(0).reshape(self.bias.shape)
            rows, tap = np.arange(batch)[:, None], 0
            for w, width in enumerate(WIDTHS):
                own = slice(w * self.filters, (w + 1) * self.filters)
                for j in range(width):  # only the byte under the largest response learns
                    np.add.at(grads[0][tap + j], (xb[rows, at[:, own] + j], np.arange(self.filters)[None]), back[:, own])
                tap += width
            assert n_filters == hidden.shape[1]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def tables(self):
        """Responses of byte pairs, so that a position costs three look-ups, not nine."""
        t, f = self.taps, self.filters
        pair = lambda a, b: (t[a][:, None] + t[b][None]).reshape(65536, f)
        head = np.concatenate([pair(0, 1) + self.bias[0], pair(2, 3) + self.bias[1], pair(5, 6) + self.bias[2]], 1)
        return np.ascontiguousarray(head), np.ascontiguousarray(t[4]), pair(7, 8)

    def windows(self, text: bytes) -> np.ndarray:
        n = max(1, -(-len(text) // self.window))
        return np.frombuffer(text.ljust(n * self.window, b"\0"), np.uint8).reshape(n, self.window)

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Probabilities of windows, a bounded slice at a time."""
        head, third, last = tables
        f, out = self.filters, np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            span = part.shape[1] - max(WIDTHS) + 1
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            act = head[pairs[:, :span]]
            act[:, :, f : 2 * f] += third[part[:, 2 : 2 + span]]
            act[:, :, 2 * f :] += last[pairs[:, 2 : 2 + span]]
            out[at : at + 256] = softmax(np.maximum(act.max(1), 0) @ self.dense + self.shift)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit(docs: DataFrame, usable: Column, per_lang: int = 500, windows_per_text: int = 4, window: int = 256, most_texts: int = 32_000, most_langs: int = 8000) -> ByteNet | None:
    """Train on a bounded sample: about ``per_lang`` labelled texts of each language (fewer where that makes over ``most_texts``
    in all), chosen by a hash of id and text, ``windows_per_text`` windows each, spread over the whole text. Languages may be as many
    as there are (``most_langs``; then the most frequent). None if nothing is labelled."""
    known = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("t"), docs["lang"].alias("l")).filter(usable & F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_langs).collect()}
    if not counts:
        return None
    quota = min(per_lang, max(1, most_texts // len(counts)))
    share = docs.sparkSession.createDataFrame([(l, min(1.0, quota / n)) for l, n in counts.items()], "l string, share double")
    drawn = known.withColumn("h", unit_hash("id", "t")).join(F.broadcast(share), "l").filter("h < share")
    picked = drawn.orderBy("h", "id").limit(2 * quota * len(counts)).select("id", "t", "l")  # the bound bites where one row is repeated

    def cut(batches):
        net = ByteNet([], window)
        for b in batches:
            ids, windows, langs = [], [], []
            for i, text, lang in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = raw_bytes(text).lower()
                if not has_letter(text):
                    continue
                rows = net.windows(text)
                for k in sorted({int(q) for q in np.linspace(0, max(0, len(rows) - 2), windows_per_text)}):
                    ids.append(i)
                    windows.append(rows[k].tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.binary()), pa.array(langs, pa.string())], names=["id", "w", "l"])

    rows = sorted(picked.select(F.col("id").cast("long"), F.col("t").cast("string"), F.col("l").cast("string")).mapInArrow(cut, "id long, w binary, l string").collect(), key=lambda r: (r[2], r[0] is None, r[0] or 0, bytes(r[1])))
    langs = sorted({r[2] for r in rows})
    if not langs:
        return None
    net = ByteNet(langs, window).start()
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), window)
    y = np.array([langs.index(r[2]) for r in rows])
    # equal weight to every language, whatever its share of the sample
    order = np.argsort(y, kind="stable")
    each = np.bincount(y, minlength=len(langs))
    draw = np.random.default_rng(3).random(max(len(y), 64))
    starts = np.cumsum(each) - each
    lang = np.arange(len(draw)) % len(langs)
    balanced = order[starts[lang] + (draw * each[lang]).astype(np.int64)]
    return net.train(x[balanced], y[balanced])


def predictor(net: ByteNet | None):
    """An Arrow UDF: text -> struct(lang_pred, score), over every window of a whole text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    held: dict = {}

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        if net is not None and "tables" not in held:
            held["tables"] = net.tables()
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        waiting, rows = [], 0

        def flush():
            sizes = [len(w) for _, w in waiting]
            probs = net.predict(np.concatenate([w for _, w in waiting]), held["tables"])
            means = np.add.reduceat(probs.astype(np.float64), np.cumsum([0, *sizes[:-1]]), 0) / np.array(sizes)[:, None]
            for (i, _), p in zip(waiting, means, strict=True):
                k = int(p.argmax())
                langs[i], scores[i] = net.langs[k], float(min(1.0, p[k]))

        for i, text in enumerate(texts):
            text = raw_bytes(text).lower()
            if net is None or not has_letter(text):
                continue
            waiting.append((i, net.windows(text)))
            rows += len(waiting[-1][1])
            if rows >= 4096:
                flush()
                waiting, rows = [], 0
        if waiting:
            flush()
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``(doc_id, held_out, lang_pred, score)``.

    The language, source and id of a row never enter its prediction. Null text or text
    without any letter: ``und``, score 0. Very long texts: all windows, in bounded slices;
    the score is the mean probability of the windows. Ties go to the language first in
    order. No labelled rows: ``und`` throughout. A null doc_id counts as not held out. Repeated rows are each given one; an
    empty table gives none; further columns are ignored.
    """
    out = held_out(F.col("doc_id"))
    net = fit(docs, ~held_out(F.col("id")))
    found = docs.select(docs["doc_id"], docs["text"].cast("string").alias("t")).select("doc_id", out.alias("held_out"), predictor(net)("t").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is told with at least this score, all columns unchanged.

    Null texts and texts without a letter go; repeated rows and null ids stay or go by their text; an empty table stays
    empty. Where nothing is labelled, or there is no column ``lang``, no language can be learned and every row stays.
    """
    usable = ~held_out(F.col("id"))
    net = fit(docs, usable) if "lang" in docs.columns else None
    if net is None:
        return docs
    found = predictor(net)(docs["text"].cast("string"))
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
