import numpy as np
from pyspark.sql import functions as F

from quillrock.operators.audit import nearest_ranks


def test_nearest_rank_is_exact_in_large_groups(spark):
    n = 6_000_000
    rows = spark.range(n).select(F.lit("g").alias("kind"), (F.col("id") * 7919 % n).cast("double").alias("value"))
    shares = {f"q{k}": q for k, q in enumerate((0.05, 0.3, 0.5, 0.77, 0.95))}
    got = nearest_ranks(rows, "kind", "value", **shares).first()
    assert [got[k] for k in shares] == [float(np.ceil(round(q * n, 6)) - 1) for q in shares.values()]


def test_nearest_rank_of_ties_and_nulls(spark):
    rows = [("a", 1.0)] * 19 + [("a", 5.0), ("a", None), ("b", None), (None, 2.0), (None, 3.0)]
    got = {r.kind: (r.p50, r.p95) for r in nearest_ranks(spark.createDataFrame(rows, "kind string, value double"), "kind", "value", p50=0.5, p95=0.95).collect()}
    assert got == {"a": (1.0, 1.0), "b": (None, None), None: (2.0, 3.0)}
