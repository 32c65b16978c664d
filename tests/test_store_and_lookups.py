import datetime
import importlib.metadata as M

import pytest
from pyspark.sql import functions as F

from wavelark.operators import features as FE
from wavelark.operators import intervals as I
from wavelark.plans import store as ST
from wavelark.plans.catalog import Context, Node
from wavelark.plans.reference import ORACLE_SQL, QUERIES
from wavelark.sources.layouts import formats
from wavelark.sources.text import runs_overview, wave_length

from .oracle import compare, connect


@pytest.fixture()
def ctx(spark, tmp_path):
    out = Context(spark, store=str(tmp_path / "store"))
    hits = lambda c, run, inputs, o: c.spark.range(5).select(F.col("id").alias("timestamp"), (F.col("id") * 1000).alias("time"), F.lit(0).alias("board"), (F.col("id") % 2).alias("channel"))
    out.register(Node("hits", hits, save_when="always"), Node("sums", lambda c, run, inputs, o: inputs["hits"].groupBy("channel").count(), ("hits",), save_when="always"))
    return out


def test_entries_and_cleaning(ctx):
    assert ST.entries(ctx).count() == 0
    ctx.get_all("a", ["sums"]), ctx.get("b", "hits")
    found = ST.entries(ctx)
    assert sorted((r.run, r.name, r.complete, r.current) for r in found.collect()) == [("a", "hits", True, True), ("a", "sums", True, True), ("b", "hits", True, True)]
    assert {r.run: r.entries for r in ST.summary(found, "run").collect()} == {"a": 2, "b": 1} and ST.summary(found).first().names == 2
    assert ST.select_entries(found, ["a"], "SUM", 1).count() == 1 and ST.select_entries(found, before_ms=0).count() == 0
    ctx.nodes["sums"].version = "2"
    assert [r.issue for r in ST.diagnose(ST.entries(ctx)).collect()] == ["stale"]
    plan = ST.cleaning_plan(found, 1, "largest")
    assert plan.count() == 1 and ST.cleaning_plan(found, 10**9).count() == 3
    assert ST.clean(ctx, plan)["removed"] is False and ST.entries(ctx).count() == 3
    ST.clean(ctx, plan, dry_run=False)
    assert ST.entries(ctx).count() == 2
    with pytest.raises(ValueError):
        ST.clean(ctx, ctx.spark.createDataFrame([("/nowhere/else", 1)], "path string, bytes long"), dry_run=False)
    with pytest.raises(ValueError):
        ST.cleaning_plan(found, 1, "none")


def test_time_range_and_critical_path(ctx, monkeypatch):
    assert ctx.time_range("a", "hits", 1, 4).count() == 3 and ctx.time_range("a", "hits", 1000, None, "system_ns", "0:1").count() == 2
    ctx.register(Node("side", lambda *x: None), Node("top", lambda *x: None, ("sums", "side")))
    got = ST.critical_path(ctx, "top", seconds={"side": 10.0})
    assert got["path"] == ["side", "top"] and got["seconds"] == 11 and got["total"] == 13 and got["width"] == 2
    monkeypatch.setattr(M, "entry_points", lambda group: [type("P", (), {"load": lambda self: lambda: [Node("found", None)]})()])
    assert ctx.discover() == ["found"] and "found" in ctx.nodes


def test_as_of_brute(spark):
    rows = [(0, 10, 1), (5, 5, 2), (5, 9, 3), (30, 30, 4), (1000, 1001, 5)]
    asked = [-1, 0, 4, 5, 8, 9, 29, 30, 31, 999, 1000, 5000]
    df = spark.createDataFrame(rows, "time long, endtime long, k int").repartition(3)
    for bucket in (1, 7, 10_000):
        got = {r.t: (r.found and r.found.k, r.inside) for r in I.as_of(spark.createDataFrame([(t,) for t in asked], "t long"), df, bucket=bucket).collect()}
        for t in asked:
            last = max((r for r in rows if r[0] <= t), default=None)
            assert got[t] == ((last[2], t < last[1] or t == last[0] == last[1]) if last else (None, False)), (t, bucket)
    assert I.as_of(spark.createDataFrame([(1,)], "t long"), df.limit(0)).first().found is None and I.as_of(spark.createDataFrame([], "t long"), df).count() == 0


def test_as_of_without_times(spark, tmp_path):
    rows = spark.createDataFrame([(None, None, 1), (10, 20, 2)], "time long, endtime long, k int")
    points = spark.createDataFrame([(None,), (5,), (15,)], "t long")
    got = {r.t: (r.found and r.found.k, r.inside) for r in I.as_of(points, rows, bucket=7).collect()}
    assert got == {None: (None, False), 5: (None, False), 15: (2, True)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.when(F.col("event_id") % 7 != 3, F.col("ts"))).write.parquet(f"{tmp_path}/events.parquet")
    assert compare(spark, QUERIES["as_of"], ORACLE_SQL["as_of"], str(tmp_path)) == ""


def test_as_of_ties(spark, tmp_path):
    """Copies of the events at the same instants: the SQL leaves open which of them is found, here the latest end, then the largest id."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).withColumn("event_id", F.col("event_id") + F.col("copy") * 1001).drop("copy")
    copies.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["as_of"](spark, str(tmp_path)).collect()))
    sql = """WITH i AS (SELECT epoch_us(ts) AS time, max(struct_pack(l := event_id % 5, e := event_id)) AS last FROM events GROUP BY 1)
        SELECT event_id, i.last.e, i.time + 1000000 * (1 + i.last.l) > epoch_us(ts) + 1500000 FROM events ASOF LEFT JOIN i ON epoch_us(ts) + 1500000 >= i.time"""
    assert got == sorted(connect(str(tmp_path)).execute(sql).fetchall())


def test_channels_waves_and_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 1, 7)], "board int, channel int, x int")
    assert {k: v.count() for k, v in I.by_channel(df).items()} == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        I.by_channel(df.withColumn("board", F.lit(3)))
    w = spark.createDataFrame([(10, [1, 2, 3], 1.0), (11, [10, 11], 2.0), (12, [99], 0.0)], "record_id long, wave array<int>, baseline double")
    got = {r.record_id: (r.samples, r.mask) for r in FE.record_waves(w, pad_to=3).collect()}
    assert got[11] == ([10, 11, 0], [True, True, False]) and {r.record_id: r.samples for r in FE.record_waves(w, 1, 9, baseline_correct=True).collect()} == {10: [1.0, 2.0], 11: [9.0], 12: []}
    assert FE.record_waves(w, record_ids=spark.createDataFrame([(77,)], "record_id long")).first().samples is None
    assert [r.height for r in FE.preview_features(w, 0, 2).orderBy("record_id").collect()] == [0.0, -8.0, -99.0] and FE.preview_features(w, 5, 9).first().position is None
    hour = spark.createDataFrame([(3_600_000_000_000,), (7_200_000_000_000,)], "time long")
    at = lambda h: datetime.datetime(1970, 1, 1, h, tzinfo=datetime.timezone.utc)
    assert I.between_instants(hour, 0, at(1), at(2)).count() == 1
    for run in ("r1", "r2"):
        raw = tmp_path / run / "RAW"
        raw.mkdir(parents=True)
        (raw / "x_CH3_0.CSV").write_text("0;3;5;0;0;0;0;1;2;3\n0;3;6;0;0;0;0;1;2\n")
    assert sorted((r.run_id, r.file_count, r.channels) for r in runs_overview(spark, str(tmp_path)).collect()) == [("r1", 1, 1), ("r2", 1, 1)]
    assert wave_length(spark.read.text(str(tmp_path / "r1" / "RAW")), formats.get("vx2730")).first()[:] == (2, 3, 2)
