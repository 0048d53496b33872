"""What a task of operator 12 holds at once."""

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from roadveil.llm import lm


def test_tables_of_the_corpus_are_shared_and_not_part_of_each_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} of a text {i % 3}") for i in range(12)], "doc_id long, text string")
    sizes, real = [], type(docs).mapInArrow

    def kept(self, func, *more, **named):
        sizes.append(len(cloudpickle.dumps(func)))
        return real(self, func, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    assert lm.score(spark, docs).count() == 12
    assert len(sizes) == 2 + len(lm.RATES) and max(sizes) < 200_000


def test_ids_are_scored_a_bounded_run_at_a_time():
    ids = [np.zeros(n, "<u2").tobytes() for n in (60_000, 60_000, 60_000, 400_000, 5, 60_000)]
    runs = list(lm.runs_of(pa.array(ids, pa.binary())))
    assert [x for _, rows in runs for x in rows] == ids and [f for f, _ in runs] == [0, 2, 3, 4]
    assert all(len(rows) == 1 or sum(map(len, rows)) <= 1 << 18 for _, rows in runs)
