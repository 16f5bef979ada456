import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import numeric as N
from cuelattice.operators import audio, detections, enrichment, scenes, schedules, segments, smoothing, subtitles, timeline, tracking
from cuelattice.plans import config
from cuelattice.schemas import detection_rules, validate
from cuelattice.sources import files


def entries(spark, rows):
    """rows: (key, frame, t, (x, y, w, h), text)."""
    made = spark.createDataFrame([(k, f, t, *b, s) for k, f, t, b, s in rows], "k int, frame_index int, t double, x int, y int, w int, h int, text string")
    return made.select("k", "frame_index", "t", G.box(*[F.col(c) for c in "xywh"]).alias("box"), "text")


def test_unpack_leaves_out_what_is_unusable(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    rows = [
        (1, ["你好", "abc", None, "世界", "点"], ["0.9", "0.9", "0.9", "x", "0.1"], [square] * 5),
        (2, ["你好"], ["0.9", "0.8"], [square]),
        (3, None, None, None),
        (4, ["你"], ["0.5"], [[[5.0, 5.0]] * 4]),
    ]
    raw = spark.createDataFrame(rows, "f int, texts array<string>, scores array<string>, polys array<array<array<double>>>")
    got = detections.unpack(raw, 1.0, 1.0, 100, 100, 0.5).collect()
    assert [(r.f, r.text, r.confidence) for r in got] == [(1, "你好", 0.9)]


def test_gap_fill(spark):
    rows = entries(spark, [(1, 0, 0.0, (0, 0, 10, 10), "ab"), (1, 4, 4.0, (8, 2, 20, 10), "cd"), (1, 5, 5.0, (8, 2, 20, 10), "cdef")])
    got = {r.frame_index: r for r in segments.fill_gaps(rows, ["k"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert (got[1].box.x, got[1].box.width, got[1].t, got[1].text, got[1].interpolated) == (2, 12, 1.0, "ab", True)
    assert (got[3].box.x, got[3].box.y) == (6, 2)
    assert not got[4].interpolated


def test_lock_and_average(spark):
    rows = entries(spark, [(1, i, float(i), (x, 0, 10, 10), "a") for i, x in enumerate((100, 102, 99, 140, 140))] + [(2, 0, 0.0, (5, 5, 5, 5), "b")])
    got = smoothing.smooth_locked(rows, ["k"], 3, 0.3).orderBy("k", "frame_index").collect()
    assert [r.box.x for r in got] == [100, 100, 100, 112, 120, 5] and {r.text for r in got} == {"a", "b"}


def test_upper_median_and_steady_sizes(spark):
    rows = entries(spark, [(1, i, 0.0, (i, 0, w, 10), "a") for i, w in enumerate((10, 20, 30, 40))])
    got = segments.representative_boxes(rows, ["k"]).first()
    assert (got.median_width, got.smallest.width, got.middle.width, got.steady) == (30, 10, 30, False)


def test_region_and_cues(spark):
    rows = [("late", 5.0, 7.0, "x", [(100, 200, 50, 30)]), ("early", 1.0, 2.0, "y", [(100, 200, 50, 30)]), ("far", 0.0, 1.0, "z", [(900, 900, 5, 5)]), ("empty", 0.0, 1.0, "ghost", [])]
    made = spark.createDataFrame(rows, "segment_id string, start_time double, end_time double, canonical_text string, b array<struct<x:int,y:int,width:int,height:int>>")
    made = made.select(F.lit(1).alias("v"), "segment_id", "start_time", "end_time", "canonical_text", F.transform("b", lambda b: F.struct(b.alias("box"))).alias("entries"))
    region = G.box(F.lit(0), F.lit(0), F.lit(200), F.lit(300))
    assert {r.segment_id for r in segments.in_region(made, region).collect()} == {"late", "early"}
    assert {r.segment_id for r in segments.in_region(made, None).collect()} == {"late", "early", "far"}
    words = spark.createDataFrame([("early", "Y")], "segment_id string, translated_text string")
    numbered = subtitles.cues(segments.in_region(made, region), ["v"], ["segment_id"], words)
    text = subtitles.srt(numbered, ["v"]).first().srt
    assert text == "1\n00:00:01,000 --> 00:00:02,000\nY\n\n2\n00:00:05,000 --> 00:00:07,000\nx\n"
    assert subtitles.srt(numbered.limit(0), ["v"]).count() == 0


def interpolate(plan, t, window):
    """The value of a schedule, worked out interval by interval."""
    if t <= plan[0][0]:
        return plan[0][2]
    if t >= plan[-1][1]:
        return plan[-1][2]
    i = next(i for i, (a, b, _) in enumerate(plan) if a <= t < b or i == len(plan) - 1)
    a, b, v = plan[i]
    if i and abs(t - a) < window / 2:
        return plan[i - 1][2] + (v - plan[i - 1][2]) * (t - a + window / 2) / window
    if i + 1 < len(plan) and abs(t - b) < window / 2:
        return v + (plan[i + 1][2] - v) * (t - b + window / 2) / window
    return v


def test_schedule_values(spark):
    plan = [(0.0, 10.0, 1.0), (10.0, 20.0, 2.0), (20.0, 30.0, 3.0)]
    times = [10.0, 9.01, 10.99, -1.0, 35.0, 0.0, 5.0, 19.5, 20.5, 29.9, 30.0, 11.0, 9.0]
    frame = spark.createDataFrame([(t,) for t in times], "t double")
    got = {r.t: r.value for r in schedules.sample(frame, schedules.to_table(spark, {"p": plan}), 10.0, 2.0).collect()}
    assert got == {t: pytest.approx(interpolate(plan, t, 2.0)) for t in times}
    assert (got[10.0], got[9.01], got[10.99]) == (pytest.approx(1.5), pytest.approx(1.005), pytest.approx(1.995))


def test_schedules_are_contiguous_and_bounded(spark):
    assert [len(schedules.intervals(d, s)) for d, s in ((30, 10), (25, 10), (10, 2), (5, 30), (0, 10))] == [3, 3, 5, 1, 0]
    clips = spark.createDataFrame([(1, 95.0), (2, 5.0), (3, 0.0), (4, 30.0)], "clip long, duration double")
    for mode in (*schedules.MODES, "other"):
        rows = schedules.drawn(clips, {"a": (0.9, 1.1), "b": (-1.0, 1.0)}, 10.0, mode, seed=1)
        got = sorted(tuple(r) for r in rows.collect())
        assert got == sorted(tuple(r) for r in schedules.drawn(clips.repartition(3), {"a": (0.9, 1.1), "b": (-1.0, 1.0)}, 10.0, mode, seed=1).collect())
        for clip, duration in ((1, 95.0), (2, 5.0), (4, 30.0)):
            for param, low, high in (("a", 0.9, 1.1), ("b", -1.0, 1.0)):
                own = [r[2:] for r in got if r[:2] == (clip, param)]
                assert [(r[1], r[2]) for r in own] == schedules.intervals(duration, 10.0) and all(low <= r[3] <= high for r in own)
        assert not [r for r in got if r[0] == 3] and got != sorted(tuple(r) for r in schedules.drawn(clips, {"a": (0.9, 1.1), "b": (-1.0, 1.0)}, 10.0, mode, seed=2).collect())
    ways = schedules.drift_directions(spark.range(50), 2, "id").collect()
    assert all(0.3 - 1e-9 <= (r.dx**2 + r.dy**2) ** 0.5 <= 1 + 1e-9 for r in ways)
    draws = [r.u for r in spark.range(4000).select(N.uniform(3, "id").alias("u")).collect()]
    assert 0 <= min(draws) < 0.01 and 0.99 < max(draws) < 1 and abs(sum(draws) / 4000 - 0.5) < 0.02


def test_frame_maps(spark):
    clips = spark.createDataFrame([(1, 300), (2, 45), (3, 1)], "clip long, n long")
    plan = schedules.drawn(clips.selectExpr("clip", "n / 30D AS duration"), {"speed": (0.9, 1.1)}, 3.0, "random", seed=4).drop("param")
    moved = sorted(tuple(r) for r in timeline.jitter(plan, 0.05, 4).collect())
    spans = sorted(tuple(r) for r in plan.collect())
    assert len(moved) == len(spans) and moved != spans
    for clip in (1, 2, 3):
        a, b = ([r for r in rows if r[0] == clip] for rows in (spans, moved))
        assert b[0][2] == 0 and b[-1][3] == a[-1][3] and all(x[3] == y[2] for x, y in zip(b, b[1:], strict=False))
        assert all(abs(x[3] - y[3]) <= 0.05 + 1e-9 for x, y in zip(a, b, strict=True))
    wild = sorted(tuple(r) for r in timeline.jitter(plan.where("clip = 1"), 50.0, 4).collect())
    assert all(r[3] - r[2] > 0.0009 for r in wild)  # boundaries never cross
    got = {(r.clip, r.out_idx): r.in_idx for r in timeline.build_map(clips, 30.0, plan, 3.0, 0.05, 0.0, 4).collect()}
    for clip, n in ((1, 300), (2, 45), (3, 1)):
        t, mine = 0.0, [r for r in moved if r[0] == clip]
        for i in range(n):
            t += next((r[4] for r in mine if r[2] <= i / 30 < r[3]), mine[-1][4]) / 30 if i else 0
            assert got[clip, i] == max(0, min(n - 1, round(t * 30)))
    frames = clips.selectExpr("clip", "n", "explode(sequence(0L, n - 1)) AS out_idx")
    again = [(r.clip, r.out_idx) for r in timeline.repeated_places(frames, 20.0, 1).where("repeats").collect()]
    assert again and all((c, i + 1) not in again for c, i in again) and all(0 < i < {1: 299, 2: 44}[c] for c, i in again)
    assert sum(c == 1 for c, _ in again) <= 60 and timeline.repeated_places(frames, 0.1, 1).where("repeats").count() == 0


def test_map_length(spark):
    def fitted(have, n):
        mapped = spark.range(have).select(F.lit(1).alias("k"), F.col("id").alias("out_idx"), F.col("id").alias("in_idx"))
        return [r.in_idx for r in timeline.fit_length(mapped, ["k"], F.lit(n)).orderBy("out_idx").collect()]

    assert fitted(90, 100) == [*range(90), *[89] * 9]
    assert len(fitted(90, 80)) == 80 and len(fitted(90, 90)) == 90 and fitted(0, 5) == []
    for n, have in ((150, 200), (160, 200), (7, 9)):
        assert len(fitted(have, n)) == int(n * 1.01)


def test_scenes(spark):
    cuts = spark.createDataFrame([(1, 30), (1, 300)], "v int, frame_index long")
    totals = spark.createDataFrame([(1, 330), (2, 50), (3, 0)], "v int, n_frames long")
    found = scenes.scenes(cuts, totals, ["v"], 30.0, 5.0)
    got = sorted((r.v, r.start_frame, r.end_frame, r.is_micro) for r in found.collect())
    assert got == [(1, 0, 30, True), (1, 30, 300, False), (1, 300, 330, True), (2, 0, 50, True)]
    shifted = sorted((r.v, r.end_frame, r.start_time) for r in scenes.overlaps(found, ["v"], 0.5).collect())
    assert shifted == [(1, 30, 0.0), (1, 300, 0.75), (1, 330, 9.75), (2, 50, 0.0)]
    for seed in range(4):
        order = scenes.reorder(found, ["v"], seed).orderBy("v", "place").collect()
        assert [(r.v, r.place, r.start_frame) for r in order] == [(1, 1, 300), (1, 2, 30), (1, 3, 0), (2, 1, 0)]


def test_boundaries(spark):
    a, b = [1.0, 0.0, 0.0, 2.0], [0.0, 3.0, 1.0, 0.0]
    frames = spark.createDataFrame([(1, 0, a), (1, 1, a), (1, 2, b)], "v int, f int, h array<double>")
    assert [r.f for r in scenes.boundaries(frames, ["v"], "f", "h", 0.3).collect()] == [2]


def test_one_euro_smooths_and_keeps_constants():
    frames = list(range(30))
    rng = random.Random(1)
    noisy = [(100 + rng.randint(-3, 3), 50, 80 + rng.randint(-3, 3), 20) for _ in frames]
    out = smoothing.smooth_series(frames, noisy, beta=0.0)
    xs = [b[0] for b in out]
    assert max(xs) - min(xs) < max(b[0] for b in noisy) - min(b[0] for b in noisy) and {b[1] for b in out} == {50} and len({b[2] for b in out}) == 1
    assert smoothing.smooth_series([0], [(1, 2, 3, 4)]) == [(1, 2, 3, 4)]
    assert smoothing.one_euro([0, 1, 1], [1.0, 1.0, 1.0]) == [1.0, 1.0, 1.0]


def test_one_euro_over_a_table_is_that_of_each_segment(spark):
    rng = random.Random(2)
    rows = [(k, f, 0.0, (rng.randint(0, 50), 5, 40, 10), "a") for k in range(7) for f in range(1 + 4 * k)]
    got = smoothing.smooth_one_euro(entries(spark, rows), ["k"]).collect()
    for k in range(7):
        own = [r[3] for r in rows if r[0] == k]
        have = [tuple(r.box) for r in sorted(got, key=lambda r: r.frame_index) if r.k == k]
        assert have == smoothing.smooth_series(list(range(len(own))), own)


def follow(frames, **settings):
    """frames: {frame: [(box, text), …]}; the segments as lists of (frame, text)."""
    tracker = tracking.Tracker(tracking.Settings(**settings))
    done = []
    for f, regions in frames.items():
        done += tracker.observe(f, [(float(f), b, t) for b, t in regions])
    return [[(e[0], e[3]) for e in s.entries] for s in done + tracker.finish()]


def test_tracker():
    b = (100, 100, 200, 40)
    assert follow({f: [((100 + f % 2, 100, 200, 40), "你好")] for f in range(10)}) == [[(f, "你好") for f in range(10)]]
    assert len(follow({0: [(b, "ab")], 3: [(b, "ab")]})) == 1  # a gap as long as the patience
    assert len(follow({0: [(b, "ab")], 4: [(b, "ab")]})) == 2
    assert len(follow({0: [(b, "abcd")], 1: [(b, "wxyz")]})) == 2  # one place, other text
    assert len(follow({0: [(b, "abcd")], 1: [((180, 100, 200, 40), "abcd")]}, min_iou=0.9)) == 1  # near enough
    assert len(follow({0: [(b, "abcd")], 1: [((900, 100, 200, 40), "abcd")]})) == 2
    both = follow({0: [(b, "ab"), (b, "ab")], 1: [(b, "ab"), (b, "ab")]})
    assert sorted(map(len, both)) == [2, 2]  # each region and each segment once
    assert follow({0: [(b, "  ")]}) == []
    many = {0: [((i * 300, 0, 10, 10), f"text {i}") for i in range(5)]}
    assert len(follow(many, max_active=3)) == 5
    grown = tracking.Tracker(tracking.Settings())
    for f, t in enumerate(("你", "你好", "你好世")):
        grown.observe(f, [(float(f), b, t)])
    assert "你好世" in [s.canonical for s in grown.finish()]


def test_track_over_a_table(spark):
    rows = [(s, f, f / 10, (10 + f, 10, 50, 20), "你好") for s in (1, 2) for f in (0, 3, 6)]
    made = entries(spark, rows).withColumnRenamed("k", "stream_id")
    got = tracking.track(made, tracking.Settings(stride=3), smooth=False).collect()
    assert len(got) == 14 and {r.segment_id for r in got} == {"seg-000001"}
    assert {r.frame_index for r in got if r.interpolated} == {1, 2, 4, 5}


def test_enrichment_falls_back(spark):
    def provider(texts):
        if "boom" in texts:
            raise RuntimeError("down")
        return ["" if t == "blank" else t.upper() for t in texts][: 1 if "short" in texts else None]

    def fallback(texts):
        if texts[0] == "never":
            raise RuntimeError("no")
        return [f"<{texts[0]}>"]

    no_pause = [].append
    assert [r[1:3] for r in enrichment.translate_batch(["a", "blank"], provider, fallback, 2, no_pause)] == [("A", "translated"), ("<blank>", "translated")]
    assert [r[1:3] for r in enrichment.translate_batch(["boom", "never"], provider, fallback, 2, no_pause)] == [("<boom>", "translated"), ("never", "untranslated")]
    assert [r[1] for r in enrichment.translate_batch(["short", "b"], provider, fallback, 2, no_pause)] == ["<short>", "<b>"]
    assert enrichment.translate_batch(["boom"], provider, None, 1)[0][2:] == ("untranslated", "RuntimeError: down")
    waits = []
    enrichment.translate_batch(["boom"], provider, None, 4, waits.append)
    assert waits == [1.0, 2.0, 4.0]
    rows = spark.createDataFrame([(1, " a "), (2, "a"), (3, "  "), (4, "toolong"), (5, "c")], "i int, text string")
    cache = spark.createDataFrame([("c", "kept", "translated"), ("a", "a", "untranslated")], "norm_text string, translated_text string, status string")
    got = enrichment.enrich(rows, "text", "i", provider, fallback, cache, size=2, max_chars=3).orderBy("i").collect()
    assert [(r.translated_text, r.status) for r in got] == [("A", "translated"), ("A", "translated"), ("  ", "passthrough"), ("toolong", "untranslated"), ("kept", "translated")]


def test_batches_are_numbered_over_all_partitions(spark):
    texts = spark.range(1000).select(F.format_string("t%04d", "id").alias("norm_text"), F.col("id").alias("ord"))
    got = {r.norm_text: (r.batch, r.place) for r in enrichment.batches(texts, 7).collect()}
    assert got == {f"t{i:04d}": (i // 7, i % 7) for i in range(1000)}


def test_validation(spark):
    rows = spark.createDataFrame([(0, 0, 0.5), (1, 5, 2.0), (2, 5, None)], "frame_index int, w int, confidence double")
    rows = rows.select("frame_index", F.lit(1.0).alias("t"), "confidence", G.box(F.lit(0), F.lit(0), F.col("w"), F.lit(5)).alias("box"))
    got = [r.violations for r in validate(rows, detection_rules()).orderBy("frame_index").collect()]
    assert got == [["box size"], ["confidence"], ["confidence"]]
    with pytest.raises(Exception, match="invalid row"):
        validate(rows, detection_rules(), strict=True).collect()


def test_configuration():
    assert config.resolve({})["speed_min"] == 0.99
    assert config.resolve({}, "heavy")["speed_min"] == 0.97
    assert config.resolve({"temporal": {"speed_min": 0.95}, "unknown": 1}, "heavy")["speed_min"] == 0.95
    assert config.resolve({"preset": "light"}, overrides={"speed_min": 0.91})["max_zoom"] == 1.03
    assert config.resolve({"presets": {"light": {"spatial": {"max_zoom": 1.5}}}}, "light")["max_zoom"] == 1.5
    assert config.resolve({"gop": {"enabled": False}})["gop_perturbation_enabled"] is False
    partial = config.resolve({"presets": {"light": {"spatial": {"max_zoom": 1.5}}}}, "light")
    assert (partial["ambience_volume_min_db"], partial["speed_min"]) == (-40.0, 0.99)  # what a file's preset leaves out has its default
    assert config.resolve({})["ambience_volume_min_db"] == -38.0
    for bad in ({"overrides": {"speed_min": 0.5}}, {"overrides": {"nothing": 1}}, {"preset": "odd"}):
        with pytest.raises(config.InvalidConfig):
            config.resolve({}, bad.get("preset"), bad.get("overrides"))
    for name, (low, high) in config.RANGES.items():
        base = config.resolve({})
        assert not config.violations(base | {name: low}) and not config.violations(base | {name: high})
        assert config.violations(base | {name: high + 1}) and config.violations(base | {name: low - 1})
    assert config.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert config.scale_groups({"speed_min": 0.9, "max_zoom": 1.2}, ["temporal"], 0.5) == {"speed_min": 0.95, "max_zoom": 1.2}
    assert 2 <= len(config.select_groups(["audio", "temporal", "spatial"], random.Random(1))) <= 3
    assert config.select_groups(["audio"], random.Random(1)) == ["audio"]
    assert config.apply_in_order({"audio": lambda: None, "temporal": lambda: 1 / 0}, ["audio", "temporal"]) == ["audio"]


def test_subtitle_settings():
    ok = {"renderer": {"font_path": "a.ttf"}}
    plain = config.subtitle_settings(ok)
    assert (plain["tracker.smooth_one_euro_min_cutoff"], plain["translator.backend"], plain["renderer.text_rgb"], plain["performance.ocr_stride"]) == (0.3, "google", (255, 255, 255), 3)
    assert config.subtitle_settings(ok, {"detector": {"confidence_threshold": "0.7", "batch_size": "8"}})["detector.confidence_threshold"] == 0.7
    assert config.subtitle_settings(ok, {"translator": {"llm": {"enabled": True}}})["translator.backend"] == "llm"
    assert config.subtitle_settings(ok, {"tracker": None, "compute_mode": "GPU"})["compute_mode"] == "gpu"
    assert config.subtitle_settings(ok, {"renderer": {"overflow": {"expand_bbox_max_w": 2}}})["renderer.overflow.expand_bbox_max_w"] == 2.0
    for more in ({"detector": {"batch_size": "many"}}, {"performance": {"encoder": "x"}}, {"performance": {"ocr_stride": 11}}, {"renderer": {"overflow": {"expand_bbox_max_w": 0.5}}}, {"renderer": {"shadow_offset": [1]}}, {"detector": {"cpu_threads": None}}):
        with pytest.raises(config.InvalidConfig):
            config.subtitle_settings(ok, more)
    assert config.subtitle_settings(ok, {"detector": {"batch_size": 8}})["detector.batch_size"] == 8
    for bad in ({}, {"renderer": {"font_path": "a", "font_size_min": 100}}, ok | {"tracker": {"smooth_ema_alpha": 0}}, ok | {"inpainter": {"algorithm": "x"}}, {"renderer": {"font_path": "a", "text_rgb": [1, 2, 300]}}):
        with pytest.raises(config.InvalidConfig):
            config.subtitle_settings(bad)


def test_files(spark, tmp_path):
    assert files.load_yaml("") == {} and files.load_yaml("a: 1") == {"a": 1}
    for bad in ("- 1", "a: [", None):
        with pytest.raises(config.InvalidConfig):
            files.load_yaml(bad)
    env = {"KEPT": "1"}
    files.load_dotenv("# no\nexport A='x y'\nB=\"z\"\nKEPT=2\nnone\nC=a=b", env)
    assert env == {"KEPT": "1", "A": "x y", "B": "z", "C": "a=b"}
    assert files.unique_output("v.mp4", []) == "v_translated.mp4"
    assert files.unique_output("v.mp4", ["v_translated.mp4", "v_translated(1).mp4"]) == "v_translated(2).mp4"
    given = files.sparse_overrides(files.parser().parse_args(["-i", "a", "--llm-model", "m", "--confidence", "0.4", "--compute-mode", "GPU", "-v"]))
    assert given == {"input_path": "a", "translator": {"llm": {"model": "m", "enabled": True}, "backend": "llm"}, "detector": {"confidence_threshold": 0.4}, "compute_mode": "gpu"}
    settings = config.subtitle_settings({"renderer": {"font_path": "a.ttf"}, "translator": {"max_chars": 77}}, given)
    assert (settings["detector.confidence_threshold"], settings["translator.backend"], settings["translator.max_chars"], settings["compute_mode"]) == (0.4, "llm", 77, "gpu")
    assert files.sparse_overrides(files.parser().parse_args([])) == {}
    (tmp_path / "in.mp4").write_text("x")
    assert files.path_gate(spark, str(tmp_path / "in.mp4"), str(tmp_path / "out.mp4")) == []
    assert files.path_gate(spark, str(tmp_path / "no.mp4"), str(tmp_path / "nowhere" / "out.mp4")) == ["input is missing", "output folder is missing"]
    videos = spark.createDataFrame([(1, 10, 10, 25.0, 100), (2, 0, 10, 25.0, 100), (3, 10, 10, 1.0, 9999)], "v int, width int, height int, fps double, n_frames int")
    assert [r.problem for r in files.metadata_gate(videos, 7200).orderBy("v").collect()] == [None, "no valid size, rate or length", "too long"]
    srt = spark.createDataFrame([(1, "1\na\n"), (2, "1\nbé\n")], "stream long, srt string")
    files.write_srt(srt, str(tmp_path / "srt"), "stream")
    assert files.verify_output(spark, str(tmp_path / "srt")) == 2
    assert files.read_text(spark, str(tmp_path / "none")) is None
    assert files.or_copy(srt.limit(0), srt).count() == 2
    assert [r.stream for r in files.or_copy(srt.where("stream = 2"), srt).collect()] == [2]
    files.write_ordered(spark.range(500).selectExpr("id % 3 AS k", "id AS f").repartition(7), str(tmp_path / "ordered"), ["k"], "f")
    parts = sorted((tmp_path / "ordered").glob("*.parquet"))
    read = [tuple(r) for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert read == sorted(read) and len(read) == 500


def test_nearest_observed(spark):
    rows = entries(spark, [(1, 4, 4.0, (0, 0, 9, 9), "a"), (1, 8, 10.0, (0, 0, 9, 9), "b"), (2, 3, 3.0, (0, 0, 9, 9), "c")])
    targets = spark.createDataFrame([(1, 0), (1, 4), (1, 6), (1, 7), (1, 20), (2, 3), (3, 1)], "k int, frame_index int")
    got = sorted((r.k, r.frame_index, r.observed_frame, r.t) for r in segments.nearest_observed(targets, rows, ["k"]).collect())
    assert got == [(1, 0, 4, 4.0), (1, 4, 4, 4.0), (1, 6, 4, 7.0), (1, 7, 8, 8.5), (1, 20, 8, 10.0), (2, 3, 3, 3.0)]


def test_suppression(spark):
    rows = entries(spark, [(1, 0, 0.0, (0, 0, 10, 10), "a"), (1, 1, 0.0, (90, 0, 10, 10), "a"), (2, 0, 0.0, (90, 0, 10, 10), "b")])
    region = G.box(F.lit(0), F.lit(0), F.lit(20), F.lit(20))
    got = sorted((r.k, r.frame_index, r.rendered) for r in segments.with_suppression(rows, ["k"], region).collect())
    assert got == [(1, 0, False), (1, 1, False), (2, 0, True)]
    assert segments.with_suppression(rows, ["k"], F.lit(None).cast(G.BOX)).where("rendered").count() == 3


def test_tempo_keeps_a_tone_in_place_of_the_spectrum():
    n, f = 800, 40
    tone = np.round(9000 * np.sin(2 * np.pi * f * np.arange(n) / n)).astype(np.int16)
    for factor in (0.9, 1.1, 0.97, 1.03):
        out = audio.change_tempo(tone, factor)
        assert len(out) == round(n / factor) and abs(np.abs(np.fft.rfft(out)).argmax() - f) == 0
        want = 9000 * np.sin(2 * np.pi * f * np.arange(len(out)) / len(out))
        assert np.abs(out - want).max() < 3
    assert audio.change_tempo(tone, 1.0) is tone and len(audio.change_tempo(tone[:0], 1.1)) == 0


def test_equaliser_raises_its_own_band():
    rate, t = 44100.0, np.arange(44100) / 44100
    flat = {"bass": 0.0, "mid": 0.0, "treble": 0.0}
    for band, (low, high) in audio.BANDS.items():
        f = rate / np.pi * np.arctan(np.sqrt(np.tan(np.pi * low / rate) * np.tan(np.pi * high / rate)))  # where the band is passed unturned
        tone = np.round(3000 * np.sin(2 * np.pi * f * t)).astype(np.int16)
        other = np.round(3000 * np.sin(2 * np.pi * {"bass": 6000.0}.get(band, 30.0) * t)).astype(np.int16)
        up, down, far, same = audio.equalise([tone, tone, other, tone], [flat | {band: 6.0}, flat | {band: -6.0}, flat | {band: 6.0}, flat], rate)
        level = [np.sqrt((x[20000:].astype(float) ** 2).mean()) / np.sqrt((tone[20000:].astype(float) ** 2).mean()) for x in (up, down)]
        assert level == pytest.approx([10 ** (6 / 20), 10 ** (-6 / 20)], rel=0.05)
        assert np.abs(far.astype(int) - other)[20000:].max() < 3000 * 0.15 and (same == tone).all()
    # the filter written out: at its middle it passes all, at its edges half the power
    (b, a), (d, c) = audio.band_sections(250.0, 4000.0, rate)
    for f, power in ((250.0, 0.5), (4000.0, 0.5), (1e-3, 0.0)):
        z = np.exp(-2j * np.pi * f / rate) ** np.arange(3)
        assert abs((b @ z) * (d @ z) / ((a @ z) * (c @ z))) ** 2 == pytest.approx(power, abs=1e-6)
    short = np.ones(5, np.int16)
    assert (audio.equalise([short], [flat | {"mid": 6.0}], rate)[0] == short).all() and audio.band_sections(4000.0, 20000.0, 8000.0) == []


def test_noise_lies_below_the_sound():
    rng = np.random.default_rng(1)
    sound = np.round(5000 * np.sin(np.arange(40_000) / 9)).astype(np.int16)
    noise = audio.with_noise(sound, -20.0, rng).astype(float) - sound
    assert 20 * np.log10(np.sqrt((noise**2).mean()) / np.sqrt((sound.astype(float) ** 2).mean())) == pytest.approx(-20, abs=0.1)
    power = np.abs(np.fft.rfft(audio.pink_noise(1 << 16, rng))) ** 2
    assert power[64:128].sum() == pytest.approx(power[4096:8192].sum(), rel=0.5)  # as much in each octave
    assert len(audio.with_noise(sound[:0], -20.0, rng)) == 0


def test_audio_segments_follow_one_another(spark):
    rows = [(1, 0, [1000] * 400, 1.0, 0.0), (1, 1, [], 1.1, 3.0), (1, 2, None, 1.1, 3.0), (1, 3, [1000] * 400, 0.5, 0.0), (2, 0, [5], 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "clip long, seg_idx long, samples array<int>, tempo double, bass double").withColumns({"mid": F.lit(0.0), "treble": F.lit(0.0), "noise_db": F.lit(-90.0)})
    got = sorted((r.clip, r.seg_idx, r.start, len(r.samples)) for r in audio.concatenated(audio.process(frame, 8000.0, 1)).collect())
    assert got == [(1, 0, 0, 400), (1, 1, 400, 0), (1, 2, 400, 0), (1, 3, 400, 800), (2, 0, 0, 1)]


def test_coverage_of_single_pixels_is_the_area_of_the_union(spark):
    boxes = [(5, 5, 10, 10), (10, 8, 10, 10), (0, 0, 3, 3), (28, 18, 9, 9)]
    rows = spark.createDataFrame([(1, *b) for b in boxes], "stream_id int, x int, y int, w int, h int").select("stream_id", G.box(*[F.col(c) for c in "xywh"]).alias("box"))
    want = {(x, y) for a, b, w, h in boxes for x in range(max(0, a - 2), min(30, a + w + 2)) for y in range(max(0, b - 2), min(20, b + h + 2))}
    assert {(r.cx, r.cy) for r in detections.coverage(rows, 1, 2, 30, 20).collect()} == want
    padded = rows.select(G.padded(F.col("box"), 2, 30, 20).alias("p")).select("p.*").collect()
    assert sorted((p.x, p.y, p.width, p.height) for p in padded) == [(0, 0, 5, 5), (3, 3, 14, 14), (8, 6, 14, 14), (26, 16, 4, 4)]
