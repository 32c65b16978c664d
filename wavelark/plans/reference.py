"""Queries over the driver's tables, each with SQL that says the same.

Surrogates: rows of `embeddings` as waveforms (samples are whole thousandths), rows of `events` as hits
with microseconds for ticks.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeunits as U
from ..functions import waves as W
from ..operators import chunks as CH
from ..operators import clustering as C
from ..operators import features as FE
from ..operators import hits as H
from ..operators import intervals as I
from ..operators import signals as S
from ..sources.layouts import formats
from ..sources.text import bad_lines, parse_lines, preview, run_statistics, wave_length
from ..streaming.streams import clip_to_main, union_streams, with_halo
from . import store as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def sql_round(x: Column, digits: int) -> Column:
    """x to some decimals as the SQL does it: the double times 10^digits, to whole numbers, divided again.

    Spark's own round takes the shortest decimal of x, so 25.92375, a double just below that, goes up.
    """
    x, scale = x.cast("double"), 10.0**digits
    return F.when(F.abs(x * scale) < float("inf"), F.round(x * scale) / scale).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats as doubles of few decimals; whole numbers as longs."""
    return df.select(*[sql_round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint", "bigint") else F.col(f"`{n}`") for n, t in df.dtypes])


# ---- surrogates -------------------------------------------------------------------------------

WAVES_SQL = """w AS (
  SELECT vec_id AS record_id, CAST(label AS BIGINT) AS channel, vec_id % 2 AS board, vec_id * 1000000 AS timestamp, 2 AS dt,
    list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS wave,
    CASE vec_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS polarity FROM embeddings),
v AS (SELECT *, list_sum(wave[1:16]) / 16.0 AS baseline, len(wave) AS event_length FROM w),
p AS (SELECT *, list_transform(wave, lambda x: CASE WHEN polarity = 'positive' THEN x - baseline ELSE baseline - x END) AS s FROM v)"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("record_id"), F.col("label").cast("int").alias("channel"), (F.col("vec_id") % 2).cast("int").alias("board"), (F.col("vec_id") * 1_000_000).alias("timestamp"), F.lit(2).alias("dt"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("wave"))
    polarity = F.when(F.col("record_id") % 3 == 0, "positive").when(F.col("record_id") % 3 == 1, "negative").otherwise("unknown")
    return rows.withColumns({"polarity": polarity, "baseline": W.mean(F.col("wave"), 0, 16), "event_length": F.size("wave")})


def _as_lines(spark: SparkSession, d: str) -> DataFrame:
    """The waveforms as lines of a text format, record_id beside them."""
    cells = [F.col(c).cast("string") for c in ("board", "channel", "timestamp")]
    return waveforms(spark, d).select("record_id", F.concat_ws(";", *cells, F.lit("0;0;0;0"), F.array_join(F.transform("wave", lambda x: x.cast("string")), ";")).alias("value"))


HITS_SQL = """h AS (
  SELECT event_id, epoch_us(ts) AS t, user_id % 8 AS channel, user_id % 2 AS board, value, 1 + event_id % 5 AS len FROM events)"""


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("unix_micros(cast(ts as timestamp))")
    return e.select("event_id", t.alias("timestamp"), (F.col("user_id") % 8).alias("channel"), (F.col("user_id") % 2).alias("board"), F.col("value").alias("area"), F.col("value").alias("height"), F.col("event_id").alias("record_id"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 1 to 5 samples of 1,000,000 ticks."""
    return event_hits(spark, sf_dir).select("event_id", F.col("timestamp").alias("time"), F.lit(1_000_000).alias("dt"), (1 + F.col("event_id") % 5).alias("length"), "channel", "board")


IV_SQL = HITS_SQL + """, iv AS (SELECT event_id, t AS time, 1000000 AS dt, len AS length, t + 1000000 * len AS endtime, channel, board FROM h)"""
SPAN = 20_000_000

# ---- per-record features ----------------------------------------------------------------------


@query("wave_structure", f"WITH {WAVES_SQL} SELECT record_id, board, channel, timestamp, CAST(dt AS BIGINT) AS dt, event_length, CASE WHEN board = 0 AND channel = 2 THEN 'positive' WHEN board = 1 AND channel = 3 THEN 'negative' ELSE 'unknown' END AS polarity, round(baseline, 6) AS baseline FROM v")
def _(spark, d):
    df = FE.structure_waveforms(waveforms(spark, d), 0, 16, 2, {(0, 2): "positive", (1, 3): "negative"})
    return rounded(df.select("record_id", "board", "channel", "timestamp", "dt", "event_length", "polarity", "baseline"))


@query("channel_map", f"WITH {WAVES_SQL} SELECT record_id, CASE WHEN board = 0 AND channel = 2 THEN 20 WHEN board = 1 AND channel = 3 THEN 31 ELSE -1 END AS logical_channel FROM v")
def _(spark, d):
    return rounded(FE.map_channels(waveforms(spark, d), {(0, 2): 20, (1, 3): 31}).select("record_id", "logical_channel"))


@query("text_records", f"WITH {WAVES_SQL} SELECT board, channel, timestamp, len(wave) AS n, round(CAST(list_sum(wave) AS DOUBLE), 3) AS total, round(list_sum(wave[1:40]) / 40.0, 6) AS baseline FROM v")
def _(spark, d):
    lines = _as_lines(spark, d)
    rows = parse_lines(lines, formats.get("vx2730"))
    return rounded(rows.select("board", "channel", "timestamp", F.size("wave").alias("n"), W.total(F.col("wave")).cast("double").alias("total"), "baseline"), 6)


@query("text_bad_lines", f"WITH {WAVES_SQL} SELECT count(*) FILTER (WHERE record_id % 9 = 4) AS bad, count(*) FILTER (WHERE record_id % 9 <> 4) AS good FROM v")
def _(spark, d):
    lines = _as_lines(spark, d).withColumn("value", F.when(F.col("record_id") % 9 == 4, F.concat("value", F.lit(";x"))).otherwise(F.col("value"))).drop("record_id")
    fmt = formats.get("vx2730")
    return bad_lines(lines, fmt).agg(F.count("*").alias("bad")).join(parse_lines(lines, fmt).agg(F.count("*").alias("good")))


@query("text_wave_length", f"WITH {WAVES_SQL} SELECT min(len(wave)) AS shortest, max(len(wave)) AS longest, count(*) AS records FROM v")
def _(spark, d):
    return rounded(wave_length(_as_lines(spark, d), formats.get("vx2730")))


@query("record_preview", f"WITH {WAVES_SQL} SELECT timestamp FROM v WHERE channel = 3 ORDER BY timestamp LIMIT 5 OFFSET 2")
def _(spark, d):
    return rounded(preview(waveforms(spark, d).select("channel", "timestamp", "board", "wave"), 3, 2, 7).select("timestamp"))


@query("united_streams", f"WITH {HITS_SQL} SELECT event_id, channel FROM h WHERE channel < 4 UNION ALL SELECT event_id, NULL FROM h WHERE channel >= 4")
def _(spark, d):
    h = event_hits(spark, d)
    return rounded(union_streams(h.where("channel < 4").select("event_id", "channel"), h.where("channel >= 4").select("event_id")))


_FEATURES = """SELECT record_id, board, channel, timestamp,
  CASE WHEN polarity = 'positive' THEN list_max(wave[41:60]) - baseline ELSE baseline - list_min(wave[41:60]) END AS height,
  CAST(list_max(wave[41:60]) - list_min(wave[41:60]) AS DOUBLE) AS amp, list_sum(s) AS area,
  CAST(list_max(list_transform(range(1, len(wave)), lambda i: abs(wave[i + 1] - wave[i]))) AS DOUBLE) AS max_abs_diff FROM p"""


@query("wave_basic_features", f"WITH {WAVES_SQL}, f AS ({_FEATURES}) SELECT record_id AS event_index, board, channel, timestamp, round(height, 6) AS height, round(amp, 6) AS amp, round(area, 6) AS area, round(max_abs_diff, 6) AS max_abs_diff FROM f")
def _(spark, d):
    return rounded(FE.basic_features(waveforms(spark, d), height_range=(40, 60)))


@query("wave_fixed_baseline", f"WITH {WAVES_SQL} SELECT record_id AS event_index, round(list_sum(list_transform(wave, lambda x: CASE WHEN polarity = 'positive' THEN x - b ELSE b - x END)), 6) AS area FROM (SELECT *, CASE WHEN board = 0 AND channel = 3 THEN 100.0 WHEN board = 1 AND channel = 4 THEN -50.0 ELSE baseline END AS b FROM v)")
def _(spark, d):
    return rounded(FE.basic_features(waveforms(spark, d), fixed_baseline={(0, 3): 100, (1, 4): -50}).select("event_index", "area"))


@query("wave_frame_calibrated", f"""WITH {WAVES_SQL}, f AS ({_FEATURES}), g(board, channel, gain) AS (VALUES (0, 0, 2.5), (1, 1, 4.0), (0, 2, 0.0))
SELECT record_id, f.board, f.channel, timestamp, round(area, 6) AS area, round(height, 6) AS height, round(amp, 6) AS amp, round(max_abs_diff, 6) AS max_abs_diff,
  round(CASE WHEN gain > 0 THEN area / gain ELSE -1 END, 6) AS area_pe, round(CASE WHEN gain > 0 THEN height / gain ELSE -1 END, 6) AS height_pe
FROM f LEFT JOIN g ON f.board = g.board AND f.channel = g.channel""")
def _(spark, d):
    df = FE.record_frame(waveforms(spark, d), gain={(0, 0): 2.5, (1, 1): 4.0, (0, 2): 0.0}, height_range=(40, 60))
    return rounded(df.withColumns({c: F.when(F.isnan(c), -1.0).otherwise(F.col(c)) for c in ("area_pe", "height_pe")}))


@query("wave_signals", f"WITH {WAVES_SQL} SELECT record_id, round(list_sum(list_transform(s, lambda x: -x)), 6) AS total, round(list_min(list_transform(s, lambda x: -x)), 6) AS low, round(list_sum(list_transform(s[6:10], lambda x: -x)), 6) AS part FROM p")
def _(spark, d):
    s = W.normalized(F.col("wave"), F.col("baseline"), F.col("polarity"))
    return rounded(waveforms(spark, d).withColumn("s", s).select("record_id", W.total(F.col("s")).alias("total"), F.array_min("s").alias("low"), W.total(W.window(F.col("s"), 5, 10)).alias("part")))


@query("wave_integral_width", f"""WITH {WAVES_SQL}, x AS (SELECT *, list_transform(s, lambda y: CASE WHEN y > 0 THEN y ELSE 0.0 END) AS c FROM p),
q AS (SELECT *, list_sum(c) AS q_total, list_transform(range(1, len(c) + 1), lambda i: list_sum(c[1:i])) AS cs FROM x),
r AS (SELECT *, CASE WHEN q_total > 0 THEN len(list_filter(cs, lambda y: y < q_total * 0.1)) ELSE 0 END AS lo, CASE WHEN q_total > 0 THEN len(list_filter(cs, lambda y: y < q_total * 0.9)) ELSE 0 END AS hi FROM q)
SELECT record_id AS event_index, board, channel, timestamp, CAST(lo AS DOUBLE) AS t_low_samples, CAST(hi AS DOUBLE) AS t_high_samples, CAST(greatest(hi - lo, 0) AS DOUBLE) AS width_samples, CAST(lo * 2 AS DOUBLE) AS t_low, CAST(hi * 2 AS DOUBLE) AS t_high, CAST(greatest(hi - lo, 0) * 2 AS DOUBLE) AS width, round(q_total, 6) AS q_total FROM r""")
def _(spark, d):
    return rounded(FE.width_integral(waveforms(spark, d)))


@query("wave_record_metrics", f"WITH {WAVES_SQL} SELECT record_id, timestamp, board, channel, round(list_max(s), 6) AS height, round(list_sum(s), 6) AS area, list_position(s, list_max(s)) - 1 AS peak_index, wave[list_position(s, list_max(s))] AS peak_value FROM p")
def _(spark, d):
    return rounded(FE.record_metrics(waveforms(spark, d)))


# ---- detectors --------------------------------------------------------------------------------


@query("wave_find_hits", f"WITH {WAVES_SQL}, f AS (SELECT record_id, list_transform(wave, lambda x: baseline - x > 100) AS f FROM p) SELECT record_id AS event_index, i - 1 AS position FROM (SELECT record_id, unnest(list_filter(range(1, len(f) + 1), lambda i: f[i] AND NOT coalesce(f[i - 1], false))) AS i, f FROM f)".replace("f[i - 1]", "CASE WHEN i > 1 THEN f[i - 1] END"))
def _(spark, d):
    return rounded(H.find_hits(waveforms(spark, d), 100))


_THRESHOLD = """f AS (SELECT *, list_transform(s, lambda x: x >= 120) AS f FROM p),
e AS (SELECT *, list_filter(range(1, len(f) + 1), lambda i: f[i] AND NOT coalesce(CASE WHEN i > 1 THEN f[i - 1] END, false)) AS st, list_filter(range(1, len(f) + 1), lambda i: f[i] AND NOT coalesce(CASE WHEN i < len(f) THEN f[i + 1] END, false)) AS en FROM f),
u AS (SELECT record_id, board, channel, timestamp, dt, s, unnest(st) - 1 AS a, unnest(en) AS b FROM e),
x AS (SELECT *, greatest(a - 2, 0) AS edge_start, least(b + 2, len(s)) AS edge_end FROM u),
y AS (SELECT *, s[edge_start + 1:edge_end] AS g FROM x),
hits AS (SELECT record_id, board, channel, CAST(dt AS BIGINT) AS dt, edge_start, edge_end, edge_start + list_position(g, list_max(g)) - 1 AS position, list_max(g) AS height, list_sum(list_filter(g, lambda z: z > 0)) AS integral, a, b, timestamp AS ts FROM y),
th AS (SELECT position, height, integral, edge_start, edge_end, CAST(edge_end - edge_start AS DOUBLE) AS width, dt, CAST(greatest((position - a) * dt, 0) AS DOUBLE) AS rise_time, CAST(greatest((b - 1 - position) * dt, 0) AS DOUBLE) AS fall_time, ts + position * dt * 1000 AS timestamp, board, channel, record_id FROM hits)"""


@query("wave_threshold_hits", f"WITH {WAVES_SQL}, {_THRESHOLD} SELECT position, round(height, 6) AS height, round(integral, 6) AS integral, edge_start, edge_end, width, dt, rise_time, fall_time, timestamp, board, channel, record_id FROM th")
def _(spark, d):
    return rounded(H.threshold_hits(waveforms(spark, d), 120))


#: More than the hits of any record, for numbers that are its own.
HITS_PER_RECORD = 1 << 20


def _indexed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Threshold hits squeezed together in time, so that gaps and caps bind."""
    h = H.threshold_hits(waveforms(spark, d), 120).withColumn("timestamp", F.floor(F.col("timestamp") / 50))
    nth = F.row_number().over(Window.partitionBy("record_id").orderBy("edge_start", "edge_end"))
    return h.withColumn("hit_index", F.col("record_id") * HITS_PER_RECORD + nth)


_MERGE = _THRESHOLD + """, hx AS (SELECT * EXCLUDE (timestamp), CAST(floor(timestamp / 50) AS BIGINT) AS timestamp, record_id * 1048576 + row_number() OVER (PARTITION BY record_id ORDER BY edge_start, edge_end) AS hit_index FROM th)"""


@query("hit_windows", f"WITH {WAVES_SQL}, {_THRESHOLD} SELECT record_id, position, edge_start, timestamp + (edge_start - position) * dt * 1000 AS abs_start, timestamp + (edge_end - position) * dt * 1000 AS abs_end FROM th")
def _(spark, d):
    return rounded(C.absolute_window(H.threshold_hits(waveforms(spark, d), 120)).select("record_id", "position", "edge_start", "abs_start", "abs_end"))


# ---- time clustering --------------------------------------------------------------------------

_CHAIN = HITS_SQL + f""", s AS (SELECT *, t + len * 1000000 AS e, max(t + len * 1000000) OVER (ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h),
c AS (SELECT *, sum(CASE WHEN m IS NULL OR t > m + {SPAN} THEN 1 ELSE 0 END) OVER (ORDER BY t, event_id) AS k FROM s)"""


@query("chain_events", f"WITH {_CHAIN} SELECT min(t) AS t_min, max(e) AS t_max, count(*) AS n_hits, round(sum(value), 4) AS total FROM c GROUP BY k")
def _(spark, d):
    h = event_hits(spark, d).withColumn("e", F.col("timestamp") + (1 + F.col("event_id") % 5) * 1_000_000)
    g = C.chain(h, "timestamp", "e", SPAN, order=["event_id"], bucket=10**10).groupBy("chain_start")
    return rounded(g.agg(F.min("timestamp").alias("t_min"), F.max("e").alias("t_max"), F.count("*").alias("n_hits"), F.sum("area").alias("total")).drop("chain_start"), 4)


_EVENTS = f"""WITH RECURSIVE {HITS_SQL}, a AS (SELECT min(t) AS anchor FROM h UNION ALL SELECT (SELECT min(t) FROM h WHERE t > a.anchor + {SPAN}) FROM a WHERE a.anchor IS NOT NULL),
g AS (SELECT h.*, x.anchor FROM h ASOF JOIN (SELECT anchor FROM a WHERE anchor IS NOT NULL) x ON h.t >= x.anchor),
ev AS (SELECT anchor, count(*) AS n_hits, list(channel ORDER BY channel, t, event_id) AS channels, list(value ORDER BY channel, t, event_id) AS areas, list(t ORDER BY channel, t, event_id) AS ts, min(t) AS ts_min, max(t) AS ts_max FROM g GROUP BY anchor),
en AS (SELECT *, row_number() OVER (ORDER BY anchor) - 1 AS event_id, ts[1] AS t_min, ts[len(ts)] AS t_max, (ts[len(ts)] - ts[1]) / 1000.0 AS dt_ns FROM ev)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return C.group_events(event_hits(spark, d), SPAN / 1000, bucket=10**11)


@query("anchored_events", f"{_EVENTS} SELECT event_id, t_min, t_max, round(dt_ns, 3) AS dt_ns, n_hits, ts_min, ts_max, array_to_string(channels, ',') AS channels FROM en")
def _(spark, d):
    return rounded(_events(spark, d).select("event_id", "t_min", "t_max", F.col("`dt/ns`").alias("dt_ns"), "n_hits", "ts_min", "ts_max", F.array_join(F.transform("channels", lambda c: c.cast("string")), ",").alias("channels")), 3)


@query("paired_events", f"{_EVENTS} SELECT event_id, n_hits, round(dt_ns, 3) AS delta_t, round(coalesce(areas[1], -1), 4) AS area_ch6, round(coalesce(areas[2], -1), 4) AS area_ch7, round(coalesce(areas[1], -1), 4) AS height_ch6, round(coalesce(areas[2], -1), 4) AS height_ch7 FROM en WHERE dt_ns <= 5000")
def _(spark, d):
    p = C.pair_events(_events(spark, d), 5000)
    names = [f"{k}_ch{c}" for c in (6, 7) for k in ("area", "height")]
    return rounded(p.select("event_id", "n_hits", F.round("delta_t", 3).alias("delta_t"), *[F.when(F.isnan(c), -1.0).otherwise(F.col(c)).alias(c) for c in names]), 4)


@query("coincidence_filter", f"{_EVENTS} SELECT event_id, n_hits FROM en WHERE list_has_all(channels, [1, 2])")
def _(spark, d):
    return rounded(C.contains_channels(_events(spark, d), [1, 2]).select("event_id", "n_hits"))


@query("channel_attributes", f"{_EVENTS} SELECT event_id, round(areas[list_position(channels, 0)], 4) AS ch0, round(areas[list_position(channels, 5)], 4) AS ch5 FROM en WHERE list_contains(channels, 0) AND list_contains(channels, 5)")
def _(spark, d):
    e = C.contains_channels(_events(spark, d), [0, 5])
    return rounded(e.select("event_id", *C.channel_attribute([0, 5])), 4)


@query("filter_by_function", f"{_EVENTS} SELECT event_id FROM en WHERE list_sum(areas) > 150 AND n_hits >= 2")
def _(spark, d):
    return rounded(_events(spark, d).where((W.total(F.col("areas")) > 150) & (F.col("n_hits") >= 2)).select("event_id"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_clusters(_indexed_hits(spark, d), merge_gap_ns=20, max_width_ns=120, bucket=10**6)


_CLUSTERS = f"""WITH RECURSIVE {WAVES_SQL}, {_MERGE},
o AS (SELECT *, timestamp + (edge_start - position) * dt * 1000 AS s0, timestamp + (edge_end - position) * dt * 1000 AS e0 FROM hx),
n AS (SELECT *, row_number() OVER (PARTITION BY board, channel ORDER BY s0, hit_index) AS rn FROM o),
st AS (SELECT board, channel, rn, hit_index, s0 AS cs, e0 AS ce, dt, hit_index AS cluster_first FROM n WHERE rn = 1
  UNION ALL SELECT n.board, n.channel, n.rn, n.hit_index,
    CASE WHEN n.dt = st.dt AND n.s0 - st.ce <= 20000 AND greatest(st.ce, n.e0) - st.cs <= 120000 THEN st.cs ELSE n.s0 END,
    CASE WHEN n.dt = st.dt AND n.s0 - st.ce <= 20000 AND greatest(st.ce, n.e0) - st.cs <= 120000 THEN greatest(st.ce, n.e0) ELSE n.e0 END, n.dt,
    CASE WHEN n.dt = st.dt AND n.s0 - st.ce <= 20000 AND greatest(st.ce, n.e0) - st.cs <= 120000 THEN st.cluster_first ELSE n.hit_index END
  FROM st JOIN n ON n.board = st.board AND n.channel = st.channel AND n.rn = st.rn + 1),
num AS (SELECT cluster_first, row_number() OVER (ORDER BY board, channel, s0, cluster_first) - 1 AS cluster_index FROM (SELECT st.board, st.channel, n.s0, st.cluster_first FROM st JOIN n USING (hit_index) WHERE st.cluster_first = st.hit_index)),
m AS (SELECT st.cluster_first, num.cluster_index, o.* FROM st JOIN num USING (cluster_first) JOIN o USING (hit_index))"""


@query("merge_clusters", f"{_CLUSTERS} SELECT cluster_index, hit_index FROM m")
def _(spark, d):
    return rounded(C.hit_merge_clusters(_clusters(spark, d)))


_MERGED = """a AS (SELECT cluster_index, arg_max(struct_pack(position := position, height := height, timestamp := timestamp, board := board, channel := channel, record_id := record_id), (height, -timestamp, -hit_index)) AS k, sum(integral) AS integral, min(edge_start) AS s1, max(edge_end) AS e1, min(record_id) = max(record_id) AS same, count(*) AS component_count FROM m GROUP BY cluster_index)"""


@query("merged_hits", f"{_CLUSTERS}, {_MERGED} SELECT cluster_index, k.position AS position, round(k.height, 4) AS height, k.timestamp AS timestamp, k.board AS board, k.channel AS channel, k.record_id AS record_id, round(integral, 4) AS integral, CASE WHEN same THEN s1 ELSE -1 END AS sample_start, CASE WHEN same THEN e1 ELSE -1 END AS sample_end, CASE WHEN same THEN e1 - s1 ELSE -1 END AS width, component_count, CAST(coalesce(sum(component_count) OVER (ORDER BY cluster_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS component_offset FROM a")
def _(spark, d):
    return rounded(C.merged_hits(_clusters(spark, d)).drop("dt", "rise_time", "fall_time"), 4)


@query("hit_grouped", f"{_CLUSTERS}, g0 AS (SELECT *, max(e0) OVER (ORDER BY s0, dt, timestamp, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM o), g1 AS (SELECT *, sum(CASE WHEN pm IS NULL OR s0 > pm + 5000 THEN 1 ELSE 0 END) OVER (ORDER BY s0, dt, timestamp, record_id) AS k FROM g0) SELECT row_number() OVER (ORDER BY min(s0)) - 1 AS event_id, min(s0) AS t_min, max(e0) AS t_max, (max(e0) - min(s0)) / 1000.0 AS dt_ns, count(*) AS n_hits, array_to_string(list(record_id ORDER BY board, channel, dt, s0, timestamp, record_id), ',') AS record_ids FROM g1 GROUP BY k")
def _(spark, d):
    g = C.group_hit_windows(C.absolute_window(_indexed_hits(spark, d)), 5, bucket=10**6)
    return rounded(g.select("event_id", "t_min", "t_max", F.col("`dt/ns`").alias("dt_ns"), "n_hits", F.array_join(F.transform("record_ids", lambda x: x.cast("string")), ",").alias("record_ids")))


# ---- intervals --------------------------------------------------------------------------------

T0, T1 = 1_704_100_000_000_000, 1_706_000_000_000_000


@query("time_select_loose", f"WITH {IV_SQL} SELECT event_id FROM iv WHERE endtime > {T0} AND time < {T1}")
def _(spark, d):
    return rounded(I.select_time_range(intervals(spark, d), T0, T1).select("event_id"))


@query("time_select_strict", f"WITH {IV_SQL} SELECT event_id FROM iv WHERE time >= {T0} AND endtime <= {T1}")
def _(spark, d):
    return rounded(I.select_time_range(intervals(spark, d), T0, T1, strict=True).select("event_id"))


@query("time_index_range", f"WITH {IV_SQL} SELECT event_id FROM iv WHERE time >= {T0} AND time < {T1}")
def _(spark, d):
    return rounded(I.time_index(intervals(spark, d), T0, T1).select("event_id"))


@query("time_point", f"WITH {IV_SQL} SELECT event_id FROM (SELECT * FROM iv WHERE time <= (SELECT min(time) + 3600000000 FROM iv) ORDER BY time DESC, endtime DESC LIMIT 1)")
def _(spark, d):
    iv = I.with_endtime(intervals(spark, d)).withColumn("endtime", F.col("endtime") + 10**15)
    t = iv.agg(F.min("time")).first()[0] + 3_600_000_000
    return rounded(I.at_time(iv, t).select("event_id"))


@query("clip_time_range", f"WITH {IV_SQL}, q AS (SELECT *, greatest(CAST(ceil(({T0} + 1500000 - time) / 1000000.0) AS BIGINT), 0) AS a, greatest(CAST(ceil((endtime - {T1}) / 1000000.0) AS BIGINT), 0) AS b FROM iv WHERE endtime > {T0} + 1500000 AND time < {T1}) SELECT event_id, time + a * 1000000 AS time, length - a - b AS length, time + (length - b) * 1000000 AS endtime FROM q WHERE length - a - b > 0")
def _(spark, d):
    return rounded(I.clip(intervals(spark, d), T0 + 1_500_000, T1).select("event_id", "time", "length", "endtime"))


@query("split_by_time", f"WITH {IV_SQL}, o AS (SELECT min(time) AS t0 FROM iv) SELECT event_id, unnest(range(CAST(floor((time - t0) / 3000000.0) AS BIGINT), greatest(CAST(ceil((endtime - t0) / 3000000.0) AS BIGINT) - 1, CAST(floor((time - t0) / 3000000.0) AS BIGINT)) + 1)) AS bin FROM iv, o")
def _(spark, d):
    return rounded(I.split_by_time(intervals(spark, d), 3_000_000).select("event_id", "bin"))


@query("split_by_count", f"WITH {IV_SQL} SELECT event_id, CAST(floor((row_number() OVER (ORDER BY time, event_id) - 1) / 137) AS BIGINT) AS batch FROM iv")
def _(spark, d):
    return rounded(I.split_by_count(intervals(spark, d), 137, ["time", "event_id"]).select("event_id", "batch"))


@query("split_by_breaks", f"WITH {IV_SQL}, l AS (SELECT *, lag(endtime) OVER (ORDER BY time) AS p FROM iv), g AS (SELECT *, sum(CASE WHEN time - p > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY time) AS segment FROM l) SELECT event_id, CAST(segment AS BIGINT) AS segment FROM g")
def _(spark, d):
    return rounded(I.split_by_breaks(intervals(spark, d), 300_000_000).select("event_id", "segment"))


@query("rechunk_to_boundaries", f"WITH {IV_SQL}, b(e) AS (VALUES ({T0}), ({T1}), ({T1} + 1000000000)) SELECT event_id, unnest(range((SELECT count(*) FROM b WHERE e <= time), greatest((SELECT count(*) FROM b WHERE e < endtime), (SELECT count(*) FROM b WHERE e <= time)) + 1)) AS chunk FROM iv")
def _(spark, d):
    return rounded(I.rechunk_to_boundaries(intervals(spark, d), [T0, T1, T1 + 1_000_000_000]).select("event_id", "chunk"))


@query("time_extent", f"WITH {IV_SQL} SELECT min(time) AS start, max(endtime) AS \"end\" FROM iv")
def _(spark, d):
    return rounded(I.time_extent(intervals(spark, d)))


@query("check_monotonic", f"WITH {IV_SQL}, l AS (SELECT event_id, time - lag(time) OVER (ORDER BY event_id) AS d FROM iv) SELECT count(*) FILTER (WHERE d < 0) AS violations, min(event_id) FILTER (WHERE d < 0) AS first_violation, min(d) AS min_step, max(d) AS max_step FROM l")
def _(spark, d):
    return rounded(I.check_monotonic(intervals(spark, d), "event_id"))


@query("check_no_overlap", f"WITH {IV_SQL}, l AS (SELECT lag(endtime) OVER (ORDER BY time) - time AS o FROM iv) SELECT count(*) FILTER (WHERE o > 0) AS overlaps, max(o) FILTER (WHERE o > 0) AS largest FROM l")
def _(spark, d):
    return rounded(I.check_no_overlap(intervals(spark, d)))


@query("check_endtime", f"WITH {IV_SQL} SELECT count(*) FILTER (WHERE event_id % 7 = 0) AS violations, CAST(5 AS BIGINT) AS largest FROM iv")
def _(spark, d):
    df = I.with_endtime(intervals(spark, d)).withColumn("endtime", F.col("endtime") + F.when(F.col("event_id") % 7 == 0, 5).otherwise(0))
    return rounded(I.check_endtime(df, 2))


@query("check_boundaries", f"WITH {IV_SQL} SELECT count(*) FILTER (WHERE time < {T0}) AS before_start, count(*) FILTER (WHERE endtime > {T1}) AS after_end FROM iv")
def _(spark, d):
    return rounded(I.check_boundaries(intervals(spark, d), T0, T1))


@query("check_continuity", f"WITH {IV_SQL}, ch AS (SELECT min(time) AS s, max(endtime) AS e FROM iv GROUP BY time // 3600000000), l AS (SELECT lag(e) OVER (ORDER BY s) AS previous_end, s FROM ch) SELECT previous_end, s AS start, s - previous_end AS gap FROM l WHERE s <> previous_end")
def _(spark, d):
    ch = I.with_endtime(intervals(spark, d)).groupBy(F.floor(F.col("time") / 3_600_000_000).alias("k")).agg(F.min("time").alias("start"), F.max("endtime").alias("end")).drop("k")
    return rounded(I.check_continuity(ch))


@query("records_sort", f"WITH {HITS_SQL} SELECT event_id AS source_id, row_number() OVER (ORDER BY t, board, channel, event_id) - 1 AS record_id FROM h")
def _(spark, d):
    return rounded(I.sort_records(event_hits(spark, d), ("timestamp", "board", "channel", "record_id")).select("source_id", "record_id"))


@query("wave_offsets", f"WITH {WAVES_SQL} SELECT record_id, CAST(coalesce(sum(event_length) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wave_offset FROM v")
def _(spark, d):
    return rounded(S.wave_pool(waveforms(spark, d)).select("record_id", "wave_offset"))


# ---- lookups, units, classification, statistics -----------------------------------------------


@query("s1_s2_classify", f"WITH {HITS_SQL}, k AS (SELECT event_id, value AS area, 100.0 * len AS width_ns FROM h) SELECT event_id, CAST(CASE WHEN width_ns <= 300 AND area <= 60 AND width_ns >= 200 AND area >= 20 THEN 0 WHEN width_ns <= 300 AND area <= 60 THEN 1 WHEN width_ns >= 200 AND area >= 20 THEN 2 ELSE 0 END AS BIGINT) AS label FROM k")
def _(spark, d):
    df = event_hits(spark, d).withColumn("width_ns", (1 + F.col("event_id") % 5) * 100.0)
    return rounded(FE.classify_s1_s2(df, {"width": (None, 300), "area": (None, 60)}, {"width": (200, None), "area": (20, None)}).select("event_id", "label"))


@query("channel_summary", f"WITH {HITS_SQL} SELECT board, channel, count(*) AS records, min(t) AS first_t, max(t) AS last_t, round((max(t) - min(t)) / 1e6, 6) AS duration_s FROM h GROUP BY board, channel")
def _(spark, d):
    return rounded(event_hits(spark, d).groupBy("board", "channel").agg(F.count("*").alias("records"), F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"), ((F.max("timestamp") - F.min("timestamp")) / 1e6).alias("duration_s")))


@query("run_statistics", f"WITH {HITS_SQL}, f AS (SELECT channel, count(*) AS file_count, sum(len) AS bytes FROM h GROUP BY channel, board), g AS (SELECT channel, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY channel) SELECT channel, g.file_count, g.bytes, count(*) AS records, min(t) AS first_ps, max(t) AS last_ps, round((max(t) - min(t)) / 1e12, 6) AS duration_s FROM h JOIN g USING (channel) GROUP BY channel, g.file_count, g.bytes")
def _(spark, d):
    h = event_hits(spark, d)
    files = h.groupBy("channel", "board").agg(F.sum(1 + F.col("event_id") % 5).alias("size"), F.max("timestamp").alias("modified"))
    return rounded(run_statistics(h.withColumnRenamed("channel", "file_channel"), files).drop("first_modified", "last_modified"))


@query("hardware_channels", f"WITH {HITS_SQL} SELECT DISTINCT board, channel FROM h")
def _(spark, d):
    return rounded(event_hits(spark, d).select("board", "channel").distinct())


@query("unit_conversion", f"WITH {HITS_SQL} SELECT event_id, t * 1000000 AS ps, CAST(t * 1000 AS BIGINT) AS ns, t / 1000.0 AS ms, CAST(floor(t / 7) AS BIGINT) AS samples, t - 1704067200000000 AS relative FROM (SELECT event_id, t - 1704067200000000 AS t0, t FROM h)".replace("t * 1000000 AS ps", "t0 * 1000000 AS ps"))
def _(spark, d):
    h = event_hits(spark, d)
    t = F.col("timestamp")
    return h.select("event_id", U.convert_time(t - 1704067200000000, "us", "ps").alias("ps"), U.convert_time(t, "us", "ns").alias("ns"), U.convert_time(t, "us", "ms").alias("ms"), U.time_to_samples(t, F.lit(7)).alias("samples"), U.relative_from_absolute(t * 1000, 1704067200000000000, "us").alias("relative"))


@query("preview_filter", f"WITH {HITS_SQL} SELECT event_id FROM h WHERE channel = 3 AND t BETWEEN {T0} AND {T1} AND value BETWEEN 10 AND 80")
def _(spark, d):
    return rounded(FE.preview_filter(event_hits(spark, d), channel=3, start=T0, end=T1, area=(10, 80)).select("event_id"))


@query("preview_by_ids", f"WITH {HITS_SQL} SELECT event_id FROM h WHERE event_id IN (7, 3, 11, 5, 2) AND value >= 20")
def _(spark, d):
    return rounded(FE.preview_filter(event_hits(spark, d), [7, 3, 11, 3, 5, 2], height=(20, None)).select("event_id"))


@query("largest_entries", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("split_at_time", f"WITH {IV_SQL} SELECT CASE WHEN time < {T1} THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM iv GROUP BY 1")
def _(spark, d):
    a, b = I.split_at(intervals(spark, d), T1)
    return rounded(a.select(F.lit("before").alias("side")).unionByName(b.select(F.lit("after").alias("side"))).groupBy("side").agg(F.count("*").alias("n")))


# ---- chunk streams ------------------------------------------------------------------------------

_CHUNKS = f"""WITH {IV_SQL}, l AS (SELECT *, lag(endtime) OVER (ORDER BY time, event_id) AS p FROM iv),
g AS (SELECT *, CAST(sum(CASE WHEN time - p > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY time, event_id) AS BIGINT) AS segment FROM l),
k AS (SELECT *, (count(*) OVER (PARTITION BY segment ORDER BY time) - 1) // 40 AS chunk FROM g),
s AS (SELECT segment, chunk, min(time) AS main_start, max(endtime) AS e FROM k GROUP BY 1, 2),
r AS (SELECT segment, chunk, main_start, coalesce(lead(main_start) OVER (PARTITION BY segment ORDER BY chunk), max(e) OVER (PARTITION BY segment)) AS main_end FROM s)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return CH.chunk_stream(intervals(spark, d), 40, 300_000_000, 100_000_000, 50_000_000, ("time", "event_id"))


@query("chunk_stream", f"""{_CHUNKS} SELECT event_id, segment, chunk, main_start, main_end, true AS is_main FROM k JOIN r USING (segment, chunk)
UNION ALL SELECT k.event_id, r.segment, r.chunk, r.main_start, r.main_end, false FROM k JOIN r ON k.segment = r.segment WHERE k.time >= r.main_start - 100000000 AND k.time < r.main_start OR k.time >= r.main_end AND k.time < r.main_end + 50000000""")
def _(spark, d):
    return rounded(CH.check_chunks(_chunks(spark, d)).select("event_id", "segment", "chunk", "main_start", "main_end", "is_main"))


@query("chunk_range", f"{_CHUNKS} SELECT segment, chunk, count(*) AS n FROM k JOIN r USING (segment, chunk) WHERE main_end > {T0} AND main_start < {T1} AND length > greatest(ceil(({T0} - time) / 1e6), 0) + greatest(ceil((endtime - {T1}) / 1e6), 0) GROUP BY 1, 2")
def _(spark, d):
    return rounded(CH.stream_range(_chunks(spark, d).where("is_main"), T0, T1).groupBy("segment", "chunk").agg(F.count("*").alias("n")))


@query("chunk_function", f"{_CHUNKS} SELECT segment, chunk, time, coalesce(time - (SELECT max(b.time) FROM k b WHERE b.segment = k.segment AND b.time < k.time AND b.time >= r.main_start - 100000000), -1) AS since FROM k JOIN r USING (segment, chunk) GROUP BY ALL")
def _(spark, d):
    def since(pdf):
        t = pdf["time"].drop_duplicates()
        return t.to_frame().assign(since=t.diff().fillna(-1).astype("int64"))

    return CH.map_chunks(_chunks(spark, d), since, "time long, since long")


@query("check_sorted", f"WITH {IV_SQL}, a AS (SELECT count(*) AS unsorted FROM (SELECT time - lag(time) OVER (ORDER BY event_id) AS d FROM iv) WHERE d < 0), b AS (SELECT count(*) AS overlapping FROM (SELECT time - lag(endtime) OVER (ORDER BY time, event_id) AS d FROM iv) WHERE d < 0) SELECT unsorted, overlapping, unsorted = 0 AND overlapping = 0 AS ok FROM a, b")
def _(spark, d):
    return I.check_sorted(intervals(spark, d), "event_id")


@query("first_occurrences", f"WITH {HITS_SQL} SELECT channel, len, min(event_id) AS event_id FROM h GROUP BY 1, 2")
def _(spark, d):
    return rounded(I.first_occurrences(intervals(spark, d).select("channel", F.col("length").alias("len"), "event_id"), ["channel", "len"], "event_id"))


@query("unique_records", f"WITH {HITS_SQL} SELECT event_id AS record_id FROM h")
def _(spark, d):
    h = event_hits(spark, d)
    return rounded(FE.unique_records(h.select("record_id"), h))


_LOG = f"WITH {HITS_SQL}, g AS (SELECT 'channel ' || channel AS name, len <> 1 AS ok, len = 5 AS hit, value AS seconds FROM h), st AS (SELECT name, count(*) AS calls, avg(CAST(hit AS INT)) AS hit_rate, avg(CAST(ok AS INT)) AS success_rate, sum(seconds) AS seconds, min(seconds) FILTER (WHERE NOT hit) AS least, max(seconds) FILTER (WHERE NOT hit) AS most, avg(seconds) FILTER (WHERE NOT hit) AS mean FROM g GROUP BY 1)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    length = 1 + F.col("event_id") % 5
    return event_hits(spark, d).select(F.concat(F.lit("channel "), F.col("channel")).alias("name"), (length != 1).alias("ok"), (length == 5).alias("hit"), F.col("area").alias("seconds"))


@query("node_statistics", f"{_LOG} SELECT name, calls, round(hit_rate, 4) AS hit_rate, round(success_rate, 4) AS success_rate, round(seconds, 4) AS seconds, round(least, 4) AS least, round(most, 4) AS most, round(mean, 4) AS mean FROM st")
def _(spark, d):
    return rounded(ST.node_statistics(_log(spark, d)), 4)


@query("bottlenecks", f"{_LOG} SELECT name, CASE WHEN seconds > 0.125 * (SELECT sum(seconds) FROM st) THEN 'slow,' ELSE '' END || 'failing,rebuilt' AS reasons FROM st")
def _(spark, d):
    return ST.bottlenecks(ST.node_statistics(_log(spark, d)), 0.125).select("name", "reasons")


# ---- look-ups in time and by record -------------------------------------------------------------


@query("as_of", f"WITH {IV_SQL}, p AS (SELECT event_id AS q, t + 1500000 AS t FROM h) SELECT p.q, i.event_id AS found, CAST(i.endtime > p.t AS BOOLEAN) AS inside FROM p ASOF LEFT JOIN iv i ON p.t >= i.time")
def _(spark, d):
    rows = intervals(spark, d)
    points = event_hits(spark, d).select(F.col("event_id").alias("q"), (F.col("timestamp") + 1_500_000).alias("t"))
    inside = F.when(F.col("found").isNotNull(), F.col("inside"))
    return rounded(I.as_of(points, rows, order=["event_id"]).select("q", F.col("found.event_id").alias("found"), inside.alias("inside")))


@query("time_overlaps", f"WITH {IV_SQL} SELECT count(*) > 0 AS overlaps FROM iv WHERE endtime > {T0} AND time < {T1}")
def _(spark, d):
    return I.overlaps(intervals(spark, d), T0, T1)


@query("between_instants", f"WITH {IV_SQL} SELECT event_id FROM iv WHERE time >= 1704153600000000 AND time < 1704240000000000")
def _(spark, d):
    utc = datetime.timezone.utc
    return rounded(I.between_instants(intervals(spark, d), 0, datetime.datetime(2024, 1, 2, tzinfo=utc), datetime.datetime(2024, 1, 3, tzinfo=utc), 1e-3).select("event_id"))


@query("rechunk", f"WITH {IV_SQL} SELECT event_id, CAST(floor((row_number() OVER (ORDER BY time, event_id) - 1) / 300) AS BIGINT) AS chunk FROM iv")
def _(spark, d):
    return rounded(I.rechunk(intervals(spark, d), 300, ["time", "event_id"]).select("event_id", "chunk"))


@query("halo_chunks", f"WITH {IV_SQL}, c AS (SELECT *, unnest(range(time // 86400000000 - 1, time // 86400000000 + 2)) AS chunk FROM iv) SELECT chunk, count(*) AS rows, count(*) FILTER (WHERE chunk = time // 86400000000) AS main_rows, count(*) FILTER (WHERE endtime > chunk * 86400000000 AND time < (chunk + 1) * 86400000000) AS clipped FROM c WHERE time >= chunk * 86400000000 - 3600000000 AND time < (chunk + 1) * 86400000000 + 3600000000 GROUP BY chunk")
def _(spark, d):
    day, hour = 86_400_000_000, 3_600_000_000
    rows = with_halo(I.with_endtime(intervals(spark, d)), day, hour, hour)
    kept = clip_to_main(rows).groupBy("chunk").agg(F.count("*").alias("clipped"))
    return rounded(rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.count(F.when(F.col("is_main"), 1)).alias("main_rows")).join(kept, "chunk", "left").select("chunk", "rows", "main_rows", F.coalesce("clipped", F.lit(0)).alias("clipped")))


@query("wave_window", f"WITH {WAVES_SQL} SELECT record_id, 20 AS n_samples, 14 AS n_real, round(list_sum(list_transform(wave[51:64], lambda x: x - baseline)), 4) AS total FROM v")
def _(spark, d):
    w = FE.record_waves(waveforms(spark, d), 50, 90, 20, True)
    return rounded(w.select("record_id", F.size("samples").alias("n_samples"), F.size(F.filter("mask", lambda m: m)).alias("n_real"), W.total(F.col("samples")).alias("total")), 4)


@query("wave_preview", f"WITH {WAVES_SQL}, x AS (SELECT record_id, list_transform(wave[41:64], lambda x: baseline - x) AS s FROM v) SELECT record_id, round(list_max(s), 4) AS height, CAST(list_position(s, list_max(s)) + 39 AS BIGINT) AS position, round(list_sum(s), 4) AS charge FROM x")
def _(spark, d):
    return rounded(FE.preview_features(waveforms(spark, d)), 4)


@query("record_length_check", f"WITH {WAVES_SQL} SELECT record_id, len(wave) AS wave_length, CASE WHEN record_id % 11 <> 0 THEN event_length + 1 END AS event_length FROM v WHERE record_id % 11 = 0 OR record_id % 7 = 0")
def _(spark, d):
    w = waveforms(spark, d)
    records = w.where("record_id % 11 <> 0").select("record_id", (F.col("event_length") + (F.col("record_id") % 7 == 0).cast("int")).alias("event_length"))
    return rounded(FE.length_mismatches(w, records))


@query("attach_by_record", f"WITH {WAVES_SQL} SELECT v.record_id, CASE WHEN v.channel < 5 THEN round(v.baseline, 4) END AS baseline FROM v")
def _(spark, d):
    w = waveforms(spark, d)
    return rounded(FE.attach_by_record(w.select("record_id"), w.where("channel < 5"), ["baseline"]), 4)


@query("paired_by_rule", f"{_EVENTS} SELECT event_id, n_hits FROM en WHERE n_hits = 2")
def _(spark, d):
    return rounded(C.pair_events_with(_events(spark, d), lambda e: e.where("n_hits = 2")).select("event_id", "n_hits"))


@query("merged_components", f"{_CLUSTERS} SELECT cluster_index AS merged_index, count(*) AS components, min(hit_index) AS first_hit FROM m GROUP BY 1")
def _(spark, d):
    return rounded(C.merged_components(_clusters(spark, d)).groupBy("merged_index").agg(F.count("*").alias("components"), F.min("hit_index").alias("first_hit")))


@query("merged_windows", f"{_CLUSTERS} SELECT cluster_index, min(s0) AS abs_start, max(e0) AS abs_end FROM m GROUP BY 1 HAVING min(record_id) <> max(record_id)")
def _(spark, d):
    c = _clusters(spark, d)
    merged = C.merged_hits(c)
    return rounded(C.repair_windows(merged, C.merged_components(c), _indexed_hits(spark, d)).where("sample_start < 0").select("cluster_index", "abs_start", "abs_end"))


@query("merge_sorted", f"WITH {HITS_SQL} SELECT event_id, channel FROM h")
def _(spark, d):
    h = event_hits(spark, d)
    return rounded(I.merge_sorted(*[h.where(F.col("channel") == k) for k in range(8)], order=["timestamp", "board", "channel"]).select("event_id", "channel"))


# ---- filters and widths -------------------------------------------------------------------------

# Quadratic least squares over 11 samples x = -5..5: sum of x^2 is 110, of (x^2 - 10)^2 is 858.
_SMOOTH = """sm AS (SELECT *, list_transform(range(0, len(wave)), lambda i: list_sum(list_transform(range(-5, 6), lambda j:
  wave[least(greatest(i - 5, 0), len(wave) - 11) + j + 6] * (1 / 11.0 + (i - least(greatest(i - 5, 0), len(wave) - 11) - 5) * j / 110.0
  + ((i - least(greatest(i - 5, 0), len(wave) - 11) - 5) ** 2 - 10) * (j * j - 10) / 858.0)))) AS y FROM v)"""


@query("wave_savgol", f"WITH {WAVES_SQL}, {_SMOOTH} SELECT record_id, round(list_sum(y), 1) AS total, round(list_max(y), 1) AS top FROM sm")
def _(spark, d):
    return rounded(S.filter_waveforms(waveforms(spark, d)).select("record_id", W.total(F.col("wave")).alias("total"), F.array_max("wave").alias("top")), 1)


@query("filtered_pool", f"WITH {WAVES_SQL}, {_SMOOTH} SELECT record_id, CAST(coalesce(sum(event_length) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wave_offset, round(list_min(y), 1) AS least FROM sm")
def _(spark, d):
    return rounded(S.filtered_pool(waveforms(spark, d)).select("record_id", "wave_offset", F.array_min("wave").alias("least")), 1)


def _crossing(share: float, rising: bool) -> str:
    level, steps = f"peak * {share}", f"list_filter(range(0, position), lambda i: w[i + 1] >= peak * {share})" if rising else f"list_filter(range(position, len(w)), lambda i: w[i + 1] <= peak * {share})"
    first = "0" if rising else "position"
    return f"(SELECT CASE WHEN i IS NULL OR i = {first} OR abs(w[i + 1] - w[i]) < 1e-10 THEN i ELSE i - 1 + ({level} - w[i]) / (w[i + 1] - w[i]) END FROM (SELECT {steps}[1] AS i))"


_WIDTHS = f"""WITH {WAVES_SQL}, {_THRESHOLD}, b AS (SELECT record_id, list_sum(wave[1:50]) / 50.0 AS base, wave FROM v),
j AS (SELECT th.*, list_transform(wave, lambda x: x - base) AS w, wave[position + 1] - base AS peak FROM th JOIN b USING (record_id)),
c AS (SELECT *, {_crossing(0.1, True)} AS rl, {_crossing(0.9, True)} AS rh, {_crossing(0.9, False)} AS fh, {_crossing(0.1, False)} AS fl FROM j WHERE peak > 0),
o AS (SELECT *, coalesce(rh - rl, 0) AS r, coalesce(fl - fh, 0) AS f, coalesce(fl - rl, 0) AS t FROM c)"""


@query("wave_pulse_width", f"{_WIDTHS} SELECT round(r / 0.5, 4) AS rise_time, round(f / 0.5, 4) AS fall_time, round(t / 0.5, 4) AS total_width, round(r, 4) AS rise_time_samples, round(f, 4) AS fall_time_samples, round(t, 4) AS total_width_samples, position AS peak_position, round(peak, 4) AS peak_height, timestamp, board, channel, record_id FROM o")
def _(spark, d):
    w = waveforms(spark, d)
    return rounded(FE.pulse_widths(H.threshold_hits(w, 120), w), 4)


# ---- beyond SQL ---------------------------------------------------------------------------------


@query("wave_peaks")
def _(spark, d):
    return rounded(H.peak_hits(waveforms(spark, d), height=30, prominence=0.7, width=1))


@query("wave_bandpass")
def _(spark, d):
    return rounded(S.filter_waveforms(waveforms(spark, d), "BW", lowcut=0.05, highcut=0.2).select("record_id", W.total(F.col("wave")).alias("total"), F.array_max("wave").alias("top")), 2)
