"""The model is trained on every id of every training text."""

import zlib

import numpy as np
import pyarrow as pa

from roadveil.llm import lm
from roadveil.llm.common import vocabulary


def test_pieces_have_every_id_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 900, n).astype("<u2") for n in (1, 7, 10, 11, 95, 0, 300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in part], pa.binary())], names=["ids"]) for part in (texts[:3], texts[3:])]
    got = [(x, f) for held, fresh in lm.gathered(iter(batches), most=40, piece=10) for x, f in zip(held, fresh, strict=True)]
    learnt = [x if f else x[1:] for x, f in got]
    assert np.array_equal(np.concatenate(learnt), np.concatenate(texts))
    assert sum(f for _, f in got) == sum(len(t) > 0 for t in texts) and max(len(x) for x, _ in got) <= 11


def test_every_training_text_has_its_part_in_the_model(spark):
    rng = np.random.default_rng(2)
    size = lm.encoder(vocabulary("word_bpe_49k.json")).end_id + 1
    known = lm.Vocabulary(spark.createDataFrame([(int(a) * 65536 + int(b), 5) for a, b in {(a, b) for a, b in rng.integers(0, 300, (2000, 2)).tolist()}], "pair long, n long"), size)
    rows = [(k, i, bytearray(rng.integers(0, 300, 60).astype("<u2").tobytes())) for k, i in enumerate(range(24))]
    params = lambda some: lm.trained(spark.createDataFrame(some, "row long, doc_id long, ids binary").coalesce(1), known)
    whole = params(rows)
    held = [k for k, i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    taught = [k for k in range(24) if k not in held]
    for k in taught[:3] + held[:1]:
        assert np.array_equal(params([r for r in rows if r[0] != k]), whole) == (k in held)
