"""Language-model scores: word counts by brute force, the model token by token, and what it is worth held out."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from roadveil.llm import attention, lm, queries
from roadveil.llm.common import vocabulary

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def plain_base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def check_base(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(plain_base(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    return [tuple(r) for r in queries.op12_lm_scoring(spark, SF).collect()]


def test_whole_table(spark, scored):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_base(scored, rows)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in scored)


def test_worth_held_out(spark):
    """Over 10,000 texts the model gives held-out texts a higher probability than the words' counts do."""
    out = [r for r in queries.op12_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    model, base = (sum(r[c] for r in out) for c in ("score", "base_score"))
    print("held out, log10 a word:", model / sum(r["n_tokens"] for r in out), base / sum(r["n_tokens"] for r in out))
    assert len(out) > 1000 and model > base


def test_repeats_and_scores_do_not_depend_on_parts(spark, scored):
    again = queries.op12_lm_scoring(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(scored)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_edges(spark, frequent):
    rows = [(1, "One two  two\tTHREE"), (2, None), (3, ""), (None, "one É é"), (7, "one two"), (7, "one two"), (9, "long " * 200_000), (10, "x" * 300_000), (11, "<|endoftext|> a"), (12, " \n ")]
    rows += [(i, "never seen elsewhere" if zlib.crc32(str(i).encode()) % 7 == 2 else "two") for i in range(20, 60)]
    table = spark.createDataFrame([("w", "clash", i, 3, t, "r") for i, t in rows], "word string, row string, doc_id long, n int, text string, runs string")
    check_base(lm.score(spark, table, frequent=frequent).collect(), rows)


def test_nothing_to_learn_from(spark):
    assert lm.score(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.score(spark, spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert tuple(got[0])[:6] == (alone, True, 3, 0, 0, 0.0) and math.isfinite(got[0]["score"])


def plain_model(model, classes, symbols):
    """Token by token: what a window shows of the text before it, one softmax over what is seen, one over the classes."""
    model.tables()
    out = []
    for t in range(len(classes)):
        begin = t - t % attention.STRIDE - attention.CONTEXT
        seen = [(t - s, attention.START if s == 0 else classes[s - 1]) for s in range(max(0, begin), t + 1)]
        now = seen[-1][1]
        heads = []
        for h in range(attention.HEADS):
            w = np.array([model.q[now, h] @ model.k[c, h] + model.near[h, d] for d, c in seen], np.float64)
            w = np.exp(w - w.max())
            heads.append(sum(x * model.v[c, h] for x, (_, c) in zip(w / w.sum(), seen, strict=True)))
        hidden = np.maximum(np.concatenate(heads) @ model.mix + model.skip[now], 0)
        z = (hidden @ model.out + model.direct[symbols[t - 1] if t else attention.KNOWN + attention.START]).astype(np.float64)
        out.append(z[classes[t]] - z.max() - np.log(np.exp(z - z.max()).sum()))
    return np.array(out)


def test_model_token_by_token_and_gradient():
    rng = np.random.default_rng(2)
    direct = rng.normal(0, 1, (attention.SYMBOLS, attention.CLASSES))
    model = attention.Attention(direct)
    model.params[:] = rng.normal(0, 0.3, attention.SIZE)
    lengths = np.array([1, 0, 24, 25, 130, 7])
    classes = rng.integers(0, attention.CLASSES, lengths.sum())
    symbols = np.where(rng.random(len(classes)) < 0.5, rng.integers(0, attention.KNOWN, len(classes)), attention.KNOWN + classes)
    got = model.log_probs(classes, symbols, lengths)
    ends = np.cumsum(lengths)
    want = np.concatenate([plain_model(model, classes[e - n : e], symbols[e - n : e]) for e, n in zip(ends, lengths, strict=True)])
    assert np.allclose(got, want, atol=1e-4)
    inputs, last, targets, begin, _ = attention.windows(classes, symbols, lengths)
    b = begin[:, None]
    seen, before, aim = inputs[b + np.arange(attention.SPAN)], *(x[b + np.arange(attention.CONTEXT, attention.SPAN)] for x in (last, targets))
    grads, loss = model.gradient(seen, before, aim)
    assert abs(loss + want.mean()) < 1e-4
    for i in rng.choice(np.flatnonzero(np.abs(grads) > 3e-4), 25, replace=False).tolist():
        kept, found = model.params[i], []
        for step in (0.02, -0.02):
            model.params[i] = kept + np.float32(step)
            found.append(model.gradient(seen, before, aim)[1])
        model.params[i] = kept
        assert abs((found[0] - found[1]) / 0.04 - grads[i]) < 0.1 * abs(grads[i]) + 3e-5


def test_probabilities_sum_to_one(spark):
    """Over all ids and the end, behind any beginning."""
    size = lm.encoder(vocabulary("word_bpe_49k.json")).end_id + 1
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)): int(n) for a, b, n in zip([lm.BEGIN, *rng.integers(0, 900, 3000)], rng.integers(0, 900, 3001), rng.integers(1, 50, 3001), strict=True)}
    known = lm.Vocabulary(spark.createDataFrame([(a * 65536 + b, n) for (a, b), n in pairs.items()], "pair long, n long"), size)
    model = attention.Attention(known.direct)
    model.params[:] = rng.normal(0, 0.3, attention.SIZE)
    assert (known.symbols[:900] < attention.KNOWN).sum() > 800 and known.symbols[40_000] >= attention.KNOWN
    for start in ([], [5, 7, 40_000], [40_000, 7]):
        ids = np.array([[*start, i] for i in range(size)])
        each = known.score(model, ids.ravel(), np.full(size, len(start) + 1)).reshape(size, -1)[:, -1]
        assert abs((10.0**each).sum() - 1) < 1e-3
