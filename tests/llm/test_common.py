"""Intermediates and distributed ranks."""

import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellumite.llm import _common


def test_written_and_release(spark):
    before = list(_common._MADE)
    _common._MADE.clear()
    kept = _common.written(spark.range(5), "five")
    path = _common._MADE[-1].removeprefix("file:").replace("//", "/")
    assert kept.count() == 5 and os.path.isdir(path)
    _common.release(spark)
    assert not os.path.exists(path) and not _common._MADE
    _common._MADE.extend(before)


def test_distributed_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, w long").repartition(3)
    got = _common.distributed_rank(df, ["k"], F.col("i") % 7, [F.col("i")], "at", F.col("w")).collect()
    sums = defaultdict(int)
    for k, i, w in sorted(rows, key=lambda r: (r[1] % 7, r[1])):
        mine = next(r for r in got if r["i"] == i)
        assert mine["at"] == sums[k]
        sums[k] += w
    assert got[0].asDict().keys() == {"k", "i", "w", "at"}
