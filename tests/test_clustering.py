import numpy as np
import pytest

from wavelark.operators.clustering import anchored


def brute(times, window):
    out, anchor, index = {}, None, -1
    for t in sorted(times):
        if anchor is None or t > anchor + window:
            anchor, index = t, index + 1
        out[t] = (anchor, index)
    return out


@pytest.mark.parametrize("span,window,bucket", [(3000, 17, 50), (3000, 120, 50), (400, 3, 40), (100_000, 40, 1000), (3000, 0, 100), (3000, 17, None)])
def test_anchored_clusters_across_buckets(spark, span, window, bucket):
    times = np.random.default_rng(span + window).integers(-span, span, 1500).tolist()
    rows = [(t, i, f"x{i}") for i, t in enumerate(times)]
    got = anchored(spark.createDataFrame(rows, "timestamp long, id long, more string"), window, bucket=bucket).collect()
    want = brute(times, window)
    assert sorted((r.id, r.anchor, r.anchor_index) for r in got) == [(i, *want[t]) for t, i, _ in rows]


def test_anchored_clusters_by_key_and_without_rows(spark):
    times = np.random.default_rng(1).integers(0, 500, 600).tolist()
    rows = [(t, i, i % 3) for i, t in enumerate(times)]
    got = anchored(spark.createDataFrame(rows, "timestamp long, id long, channel int"), 20, keys=["channel"], bucket=64).collect()
    want = [brute([t for t, _, c in rows if c == k], 20) for k in range(3)]
    assert sorted((r.id, r.anchor, r.anchor_index) for r in got) == [(i, *want[c][t]) for t, i, c in rows]
    assert anchored(spark.createDataFrame([], "timestamp long"), 20).collect() == []


def test_a_stretch_without_gaps_is_labelled_by_many_tasks(spark):
    df = spark.range(20_000).selectExpr("id * 3 AS timestamp")
    plan = anchored(df, 10, bucket=3000)
    assert plan.groupBy("anchor").count().where("count <> 4").count() == 0
    assert plan._jdf.queryExecution().executedPlan().toString().count("__b") > 0
