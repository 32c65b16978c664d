import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.cli import main
from wavelark.operators import hits as H
from wavelark.operators import signals as S
from wavelark.plans.catalog import Context, Node, Option, grid, layers, process_runs
from wavelark.plans.profiles import cpu_default
from wavelark.schemas import SCHEMAS, conform
from wavelark.sinks import content_checksum, export
from wavelark.operators.features import layered_values, map_channels
from wavelark.sources.layouts import distinct_paths, file_groups, formats, raw_files
from wavelark.sources.text import bad_lines, parse_lines, preview, read_run, run_statistics, sniff
from wavelark.sources.v1725 import read_binary
from wavelark.streaming.streams import end_of_stream, run_available, stream_clusters, stream_peaks, union_streams, with_halo


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two channels, twelve events of 128 samples, in two files for channel 0."""
    base = tmp_path_factory.mktemp("daq")
    raw = base / "run1" / "RAW"
    raw.mkdir(parents=True)
    for ch in (0, 1):
        lines = []
        for i in range(12):
            wave = [100] * 128
            wave[30 + i % 4 : 36 + i % 4] = [65] * 6
            lines.append(";".join(map(str, [0, ch, 1_000_000 * i + 100 * ch, 0, 0, 0, 0, *wave])))
        head = ["BOARD;CHANNEL;TIMETAG;A;B;C;D;S0", ";;;"]
        parts = [lines[:7], lines[7:]] if ch == 0 else [lines]
        for k, part in enumerate(parts):
            (raw / f"data_CH{ch}_{k}.CSV").write_text("\n".join((head if k == 0 else []) + part) + "\n")
    (raw / "notes.CSV").write_text("x\n")
    return str(base)


def test_text_run(spark, root):
    files, rows = raw_files(spark, root, "run1"), read_run(spark, root, "run1")
    assert {r.channel: len(r.paths) for r in file_groups(files).collect()} == {0: 2, 1: 1}
    assert rows.count() == 24 and rows.agg(F.min(F.size("wave")), F.max("baseline")).first()[:] == (128, pytest.approx((100 * 34 + 65 * 6) / 40, abs=2))
    stat = {r.channel: r for r in run_statistics(rows, files).collect()}
    assert stat[0].file_count == 2 and stat[1].records == 12 and stat[1].last_ps == 11_000_100
    assert [r.timestamp for r in preview(rows, 0, 2, 4).collect()] == [2_000_000, 3_000_000] and preview(rows, 0, 2_000_000, 3_000_000, "timestamp").count() == 1
    assert sniff(["a,b,c", "1,2,3"]) == (",", 1)
    with pytest.raises(KeyError):
        formats.get("nothing")


def test_binary(spark, tmp_path):
    def event(channels, samples):
        head = bytearray(16)
        mask = sum(1 << c for c in channels)
        head[4], head[11] = mask & 255, mask >> 8
        body = np.array(samples, "<i2").tobytes()
        size = 3 + len(body) // 4
        one = size.to_bytes(3, "little") + bytes([0x40]) + (7).to_bytes(6, "little") + (99).to_bytes(2, "little") + body
        return bytes(head) + one * len(channels)

    (tmp_path / "raw_b7_seg0.bin").write_bytes(event([0, 9], [11, 12, 13, 14]) + event([3], [1, -2]) + event([1], [5, 6])[:-2])
    rows = read_binary(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.board, r.channel, r.timestamp, r.baseline, r.trunc, r.wave) for r in rows] == [(7, 0, 28000, 99.0, True, [11, 12, 13, 14]), (7, 9, 28000, 99.0, True, [11, 12, 13, 14]), (7, 3, 28000, 99.0, True, [1, -2])]


def test_default_chain(spark, root, tmp_path):
    ctx = Context(spark, {"data_root": root, "threshold": 20}, str(tmp_path / "store"))
    ctx.register(*cpu_default())
    assert ctx.plan("df_paired") == ["st_waveforms", "df", "df_events", "df_paired"] and layers(ctx, "df_paired")["df_paired"] == 3
    assert ctx.get("run1", "df_paired").count() == 12 and ctx.needed("run1", "df_paired") == []
    assert ctx.get("run1", "hit_threshold").count() == 24
    assert ctx.clone(threshold=50).needed("run1", "hit_threshold") == ["hit_threshold"]
    for name in ("basic_features", "hit_threshold", "df_events", "waveform_width_integral", "hit_merge_clusters"):
        assert conform(ctx.get("run1", name), name).columns == [f.split()[0].strip("`") for f in SCHEMAS[name].split(", ")]
    assert ctx.get("run1", "hit_merged").count() == 24 and ctx.get("run1", "hit_grouped").count() == 12
    assert ctx.get("run1", "waveform_width").count() >= 0
    assert [df.count() for _, df in grid(ctx, "run1", "hit_threshold", [{"threshold": 20}, {"threshold": 50}])] == [24, 0]
    assert process_runs(ctx, ["run1", "none"], lambda c, r: c.get(r, "df").count())["errors"].keys() == {"none"}
    with pytest.raises(ValueError):
        ctx.register(Node("df", None))
    with pytest.raises(ValueError):
        Option(1, int, most=3).check("x", 4)


def test_cycle_and_errors(spark):
    ctx = Context(spark)
    ctx.register(Node("a", lambda *x: None, ("b",)), Node("b", lambda *x: 1 / 0, ("a",)))
    with pytest.raises(ValueError, match="cycle"):
        ctx.plan("a")
    ctx.register(Node("b", lambda *x: 1 / 0), replace=True)
    with pytest.raises(RuntimeError, match="b failed"):
        ctx.get("r", "a")


def test_cli_and_exports(spark, root, tmp_path):
    out = str(tmp_path / "paired.csv")
    assert main(["--run", "run1", "--data-root", root, "--output", out]) == 0 and spark.read.option("header", True).csv(out).count() == 12
    assert main(["--run", "none", "--data-root", root]) == 1
    df = spark.range(5).withColumn("a", F.array("id"))
    for fmt in ("parquet", "json", "npz", "npy"):
        export(df, str(tmp_path / f"x.{fmt}"))
    assert content_checksum(df) == content_checksum(df.repartition(3)) != content_checksum(df.limit(4))
    with pytest.raises(ValueError):
        export(df, "x.unknown")


def test_peaks_on_known_shapes():
    x = np.array([0, 1, 0, 2, 2, 0, 5, 0, 1, 0.0])
    assert H.local_maxima(x).tolist() == [1, 3, 6, 8]
    p, left, right = H.prominences(x, np.array([1, 3, 6, 8]))
    assert p.tolist() == [1, 2, 5, 1]
    g = 100 * np.exp(-((np.arange(200) - 100) ** 2) / (2 * 10.0**2))
    peak, lo, hi = H.find_peaks(g, height=50, width=4)
    assert peak.tolist() == [100] and hi[0] - lo[0] == pytest.approx(2 * np.sqrt(2 * np.log(2)) * 10, abs=0.05)
    assert H.find_peaks(x, distance=3)[0].tolist() == [3, 6]


def test_filters_on_known_signals():
    t = np.arange(400.0)
    quad = 3 + 0.5 * t - 0.01 * t**2
    assert np.allclose(S.savgol(quad, 11, 2), quad) and S.savgol(quad[:2], 11, 2).tolist() == quad[:2].tolist()
    sections = S.butter_sections(4, 0.05, 0.2, 1.0)

    def gain(f):
        z = np.exp(-2j * np.pi * f * np.arange(3))
        return abs(np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sections]))

    assert gain(0.1) == pytest.approx(1, abs=1e-3) and gain(0.05) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(0.2) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(0.001) < 1e-4
    inside = np.sin(2 * np.pi * 0.1 * t)
    assert np.allclose(S.zero_phase(sections, inside)[60:-60], inside[60:-60], atol=0.01) and np.abs(S.zero_phase(sections, np.full(400, 7.0))).max() < 1e-6
    with pytest.raises(ValueError):
        S.butter_sections(4, 0.1, 0.5, 0.5)


def test_streams(spark, tmp_path):
    wave = [100.0] * 20 + [100 - 40.0 * k for k in (1, 2, 1, 0.5)] + [100.0] * 20
    src = spark.createDataFrame([(wave, 100.0, "negative", 1000 * i, 0, i % 2, i, 2) for i in range(6)], "wave array<double>, baseline double, polarity string, timestamp long, board int, channel int, record_id long, dt int")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run_available(stream_peaks(stream, width=None, height=20), str(tmp_path / "peaks"), str(tmp_path / "c1"))
    from wavelark.operators.hits import peak_hits

    assert spark.read.parquet(str(tmp_path / "peaks")).count() == peak_hits(src, width=None, height=20, height_method="diff").count() > 0
    hits = spark.createDataFrame([(0, 0, t, 1.0 * t, 1.0) for t in (0, 5, 10, 11, 30, 31, 90)], "board int, channel int, timestamp long, height double, area double")
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    source = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "hits"))
    for extra, gap in ((hits.limit(0), None), (end_of_stream(spark, 90, 10, ticks_per_ms=1), None)):
        extra.coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
        run_available(stream_clusters(source, 10, gap, ticks_per_ms=1), str(tmp_path / "ev"), str(tmp_path / "c2"))
    got = sorted((r.t_min, r.t_max, r.n_hits, r.min_height, r.max_height) for r in spark.read.parquet(str(tmp_path / "ev")).collect())
    assert got == [(0, 10, 3, 0.0, 10.0), (11, 11, 1, 11.0, 11.0), (30, 31, 2, 30.0, 31.0), (90, 90, 1, 90.0, 90.0)]
    run_available(stream_clusters(source, 10, 1, ticks_per_ms=1), str(tmp_path / "ev2"), str(tmp_path / "c3"))
    assert sorted((r.t_min, r.t_max, r.n_hits) for r in spark.read.parquet(str(tmp_path / "ev2")).collect()) == [(0, 0, 1), (5, 5, 1), (10, 11, 2), (30, 31, 2), (90, 90, 1)]
    rows = with_halo(spark.createDataFrame([(t,) for t in (0, 9, 10, 19)], "time long"), 10, 1, 2).collect()
    assert sorted((r.chunk, r.time) for r in rows if r.is_main) == [(0, 0), (0, 9), (1, 10), (1, 19)] and {(r.chunk, r.time) for r in rows if not r.is_main} == {(-1, 0), (1, 9), (0, 10), (2, 19)}


def test_one_bad_cell_costs_one_line(spark):
    text = ["BOARD;CHANNEL;TIMETAG", "0;1;10;;;;;5;6;7", "0;1;20;;;;;5;x;7", "0;1;zz;;;;;1", "", "0;2;30;;;;;1;2;"]
    lines, fmt = spark.createDataFrame([(x,) for x in text], "value string"), formats.get("vx2730")
    assert sorted((r.channel, r.wave) for r in parse_lines(lines, fmt).collect()) == [(1, [5, 6, 7]), (2, [1, 2])]
    assert sorted(r.value for r in bad_lines(lines, fmt).collect()) == ["0;1;20;;;;;5;x;7", "0;1;zz;;;;;1"]


def test_layers_of_channel_values_and_maps(spark, root, tmp_path):
    got = layered_values([(0, 0), (0, 1), (1, 0)], {"gain": 1, "polarity": "negative"}, [([(0, 0), (0, 1)], {"gain": 2}), ([(0, 1)], {"gain": 3})], {(0, 0): {"polarity": "positive"}}, {(0, 1): {"gain": 9}})
    assert got == {(0, 0): {"gain": 2, "polarity": "positive"}, (0, 1): {"gain": 9, "polarity": "negative"}, (1, 0): {"gain": 1, "polarity": "negative"}}
    rows = spark.createDataFrame([(0, 0), (0, 1)], "board int, channel int")
    assert sorted((r.channel, r.logical_channel) for r in map_channels(rows, {(0, 1): 7}).collect()) == [(0, -1), (1, 7)]
    ctx = Context(spark, {"data_root": root, "channel_values": {(0, 0): {"polarity": "positive"}}, "run_channel_values": {"run1": {(0, 1): {"polarity": "negative"}}}}, store=str(tmp_path / "store"))
    ctx.register(*cpu_default())
    assert {(r.channel, r.polarity) for r in ctx.get("run1", "st_waveforms").select("channel", "polarity").distinct().collect()} == {(0, "positive"), (1, "negative")}
    assert distinct_paths(["b", "a"], ["a", "c"]) == ["b", "a", "c"]
    both = union_streams(rows, spark.createDataFrame([(5,)], "board int"))
    assert both.count() == 3 and both.columns == ["board", "channel"]


def test_classified_and_filtered_pool_in_the_chain(spark, root, tmp_path):
    ctx = Context(spark, {"data_root": root, "s1_s2": {"s1": {"width": (0, None)}}}, str(tmp_path / "store"))
    ctx.register(*cpu_default())
    rows = ctx.get("run1", "s1_s2")
    assert rows.count() == 24 and {r.label for r in rows.collect()} == {1}
    pool = ctx.get("run1", "wave_pool_filtered").orderBy("record_id").collect()
    assert [r.wave_offset for r in pool] == [128 * k for k in range(24)] and all(len(r.wave) == 128 for r in pool)


def test_changed_files_are_read_anew(spark, tmp_path):
    raw = tmp_path / "r" / "RAW"
    raw.mkdir(parents=True)
    line = ";".join(map(str, [0, 1, 10, 0, 0, 0, 0, *[5] * 50]))
    (raw / "a_CH1_0.CSV").write_text(line + "\n")
    ctx = Context(spark, {"data_root": str(tmp_path)}, store=str(tmp_path / "store"))
    ctx.register(*cpu_default())
    assert ctx.get("r", "st_waveforms").count() == 1
    (raw / "a_CH1_1.CSV").write_text(line + "\n")
    ctx.refresh()
    assert ctx.get("r", "st_waveforms").count() == 2
