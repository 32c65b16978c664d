import pytest
from pyspark.sql import functions as F

from wavelark.operators import chunks as CH
from wavelark.operators import features as FE
from wavelark.operators import signals as S
from wavelark.plans import store as ST
from wavelark.plans.catalog import Context, Node

TIMES = [0, 10, 20, 20, 20, 30, 40, 500, 510, 510]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, t, 1, 5) for i, t in enumerate(TIMES)], "event_id long, time long, dt int, length int")


def test_ties_stay_together_and_breaks_cut(rows):
    got = CH.chunk_stream(rows, 3, 100, order=("time", "event_id")).orderBy("event_id").collect()
    assert [(r.segment, r.chunk) for r in got] == [(0, 0), (0, 0), (0, 1), (0, 1), (0, 1), (0, 1), (0, 2), (1, 0), (1, 0), (1, 0)]
    assert {(r.segment, r.chunk): (r.main_start, r.main_end) for r in got} == {(0, 0): (0, 20), (0, 1): (20, 40), (0, 2): (40, 45), (1, 0): (500, 515)}
    assert CH.check_chunks(CH.chunk_stream(rows, 3, 100)).count() == len(TIMES)


def test_a_group_of_ties_larger_than_chunks(spark):
    same = spark.createDataFrame([(i, 7, 1, 0) for i in range(10)] + [(10, 8, 1, 0)], "event_id long, time long, dt int, length int")
    got = CH.chunk_stream(same, 3, order=("time", "event_id")).collect()
    assert len(got) == 11 and len({r.chunk for r in got}) == 1 and {(r.main_start, r.main_end) for r in got} == {(7, 9)}


def test_halo_and_functions(rows):
    chunks = CH.chunk_stream(rows, 3, 100, before=10, after=1, order=("time", "event_id"))
    halo = {(r.segment, r.chunk, r.event_id) for r in chunks.where("not is_main").collect()}
    assert halo == {(0, 0, 2), (0, 0, 3), (0, 0, 4), (0, 1, 1), (0, 1, 6), (0, 2, 5)}
    echo = CH.map_chunks(chunks, lambda pdf: pdf[["event_id", "time"]], "event_id long, time long")
    assert sorted(r.event_id for r in echo.collect()) == list(range(10))

    def fails(pdf):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        CH.map_chunks(chunks, fails, "time long").collect()


def test_boundaries_raise_and_ranges_clip(rows):
    chunks = CH.chunk_stream(rows, 3, 100)
    with pytest.raises(Exception, match="outside the main range"):
        CH.check_chunks(chunks.withColumn("main_end", F.lit(15))).count()
    with pytest.raises(Exception, match="outside the main range"):
        CH.check_chunks(chunks.where("segment = 0").withColumn("main_end", F.col("main_end") - 4).where("chunk = 2"), ends=True).count()
    got = CH.stream_range(chunks, 22, 43).collect()
    assert sorted((r.time, r.length) for r in got) == [(22, 3)] * 3 + [(30, 5), (40, 3)]
    assert CH.stream_range(chunks, 100).count() == 3 and CH.stream_range(chunks, None, 20).count() == 2
    with pytest.raises(ValueError):
        CH.chunk_stream(rows, 0)


def test_an_empty_table(rows):
    assert CH.check_chunks(CH.chunk_stream(rows.where("false"), 3, 100, 5, 5)).count() == 0


def test_records_that_are_not_unique_or_unknown(spark):
    r = spark.range(3).withColumnRenamed("id", "record_id")
    assert FE.unique_records(r, r).count() == 3
    with pytest.raises(Exception, match="twice"):
        FE.unique_records(r.union(r)).count()
    with pytest.raises(Exception, match="unknown"):
        FE.unique_records(r, r.limit(2)).count()


def test_preview_keeps_the_order_of_ids(spark):
    r = spark.createDataFrame([(i, 100 - i, float(i), 1.0) for i in range(6)], "record_id long, timestamp long, height double, area double")
    assert [x.record_id for x in FE.preview_filter(r, [4, 1, 4, 9, 3], height=(2, None)).collect()] == [4, 3]
    assert [x.record_id for x in FE.preview_filter(r, height=(2, None), limit=2).collect()] == [5, 4]


def test_a_pool_of_wrong_lengths_fails(spark):
    r = spark.createDataFrame([(0, 0, 0, 3, [1, 2, 3]), (1, 0, 0, 2, [4, 5, 6])], "record_id long, board int, channel int, event_length int, wave array<int>")
    assert S.filtered_pool(r.where("record_id = 0")).first().wave_offset == 0
    with pytest.raises(Exception, match="out of the pool"):
        S.filtered_pool(r).collect()


def test_the_log_and_its_statistics(spark, tmp_path):
    def breaks(*_):
        raise ValueError("broken")

    ctx = Context(spark, store=str(tmp_path))
    ctx.register(Node("a", lambda c, r, i, o: c.spark.range(3), save_when="always"), Node("b", breaks, ("a",)))
    ctx.get("r", "a"), ctx.get("r", "a")
    with pytest.raises(RuntimeError):
        ctx.get("r", "b")
    got = {r.name: r for r in ST.node_statistics(ST.execution_log(ctx)).collect()}
    assert got["a"].calls == 3 and round(got["a"].hit_rate, 3) == 0.667 and got["a"].success_rate == 1 and got["b"].success_rate == 0
    assert "failing" in {r.name: r.reasons for r in ST.bottlenecks(ST.node_statistics(ST.execution_log(ctx))).collect()}["b"]
