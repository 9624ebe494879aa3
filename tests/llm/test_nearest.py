"""Pairing by nearest time against brute force: nulls, ties, repeats, empty sides, hot entities, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from quillstream import skew
from quillstream.llm import nearest


@pytest.fixture(params=["even", "hot", "hot table"])
def skewed(request, monkeypatch):
    """Every case again with the least of keys taken for hot, in the plan and as a table."""
    if request.param != "even":
        monkeypatch.setattr(skew, "LEAST_ROWS", 2)
    if request.param == "hot table":
        monkeypatch.setattr(skew, "INLINE", 0)
    return request.param


@pytest.mark.parametrize("seed", range(3))
def test_nearest_against_brute_force(spark, skewed, seed):
    rng = random.Random(seed)
    left = [(f"l{i}", rng.choice(["a", "a", "a", "b", None, "zz"]), rng.choice([None, *range(-40, 400)])) for i in range(300)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-40, 400, 3)]), i) for i in range(120)]
    right += right[:10]
    l = spark.createDataFrame(left, "id string, e string, t long").withColumn("s", F.lit("clash")).withColumn("record", F.lit("clash"))
    r = spark.createDataFrame(right, "e string, t long, next_t int")
    got = {x["record"]: x["right_t"] for x in nearest.nearest(l, F.col("e"), F.col("t"), F.col("id"), r, F.col("e"), F.col("t"), tolerance=4, slice_width=rng.choice([4, 16, 64])).collect()}
    want = {}
    for i, e, t in left:
        c = [x for k, x, _ in right if e is not None and k == e and t is not None and x is not None and abs(x - t) <= 4]
        if c:
            want[i] = min(c, key=lambda x: (abs(x - t), x))
    assert got == want


def test_nearest_empty(spark):
    l = spark.createDataFrame([], "id string, e string, t long")
    r = spark.createDataFrame([("a", 1)], "e string, t long")
    args = (F.col("e"), F.col("t"), F.col("id"))
    assert nearest.nearest(l, *args, r, F.col("e"), F.col("t"), 2).count() == 0
    some = spark.createDataFrame([("x", "a", 1)], "id string, e string, t long")
    assert nearest.nearest(some, *args, r.limit(0), F.col("e"), F.col("t"), 2).count() == 0


def test_merge_carries_the_neighbours_over_batches():
    import pyarrow as pa

    rows = [("g", 2, 4, None), ("g", 3, 3, "o"), ("g", 3, 5, None), ("g", 4, 4, "p"), ("g", 6, 6, "q"), ("g", 18, 18, "x"), ("g", 18, 20, None), ("g", 18, 18, "r"), ("h", 6, 6, "s"), ("h", 90, 92, None)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i]], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=list("gptr")) for r in rows]
    for cut in (1, 2, 3, len(rows)):
        joined = [pa.Table.from_batches(batches[a : a + cut]).combine_chunks().to_batches()[0] for a in range(0, len(rows), cut)]
        out = [x for b in nearest._merge(2)(iter(joined)) for x in zip(*b.to_pydict().values(), strict=True)]
        # "x" stands before the right row of its place, which a sorted stream never does; in a batch of its own it can't see it.
        assert [o for o in out if o[0] != "x"] == [("o", 4), ("p", 4), ("q", 5), ("r", 20)], cut
