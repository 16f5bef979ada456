import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import numeric as N
from cuelattice.functions import text as X
from cuelattice.operators import layout


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(x, y, w, h):
    return G.box(*map(F.lit, (x, y, w, h)))


def test_overlap_distance_and_diagonal(spark):
    a = box(0, 0, 10, 10)
    assert value(spark, G.iou(a, a)) == 1
    assert value(spark, G.iou(a, box(10, 0, 10, 10))) == 0  # touching only
    assert value(spark, G.iou(a, box(5, 0, 10, 10))) == pytest.approx(50 / 150)
    assert value(spark, G.center_distance(a, box(30, 40, 10, 10))) == 50
    assert value(spark, G.diagonal(F.lit(3), F.lit(4))) == 5
    with pytest.raises(Exception, match="positive size"):
        value(spark, G.diagonal(F.lit(0), F.lit(4)))


def test_scale_clip_expand(spark):
    assert value(spark, G.scale(box(10, 10, 100, 50), 1.5)).asDict() == {"x": 15, "y": 15, "width": 150, "height": 75}
    assert value(spark, G.scale(box(0, 0, 1, 1), 0.1)).width == 1
    assert value(spark, G.clip(box(-50, 0, 100, 10), 1920, 1080)).width == 50
    assert value(spark, G.clip(box(1920, 0, 10, 10), 1920, 1080)) is None
    assert value(spark, G.expand(box(10, 10, 10, 10), 1.0, 1.0, 100, 100)) is None
    assert value(spark, G.expand(box(0, 0, 100, 100), 1.5, 1.5, 100, 100)) is None  # no room to grow
    assert value(spark, G.force_expand(box(10, 10, 10, 10), F.lit(20), F.lit(5), 100, 100)).asDict() == {"x": 5, "y": 10, "width": 20, "height": 10}


def test_region_edges_are_inside(spark):
    region = box(10, 20, 30, 40)
    inside = [(10, 20), (40, 60), (10, 60), (40, 20), (25, 30)]
    outside = [(9, 20), (41, 60), (25, 19), (25, 61)]
    assert all(value(spark, G.contains(region, F.lit(x), F.lit(y))) for x, y in inside)
    assert not any(value(spark, G.contains(region, F.lit(x), F.lit(y))) for x, y in outside)


def test_polygon_and_canvas(spark):
    points = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 2), (11, 2), (11, 8), (1, 8))])
    size = [F.lit(v) for v in (2.0, 2.0, 20, 100)]
    assert value(spark, G.polygon_box(points, *size)).asDict() == {"x": 2, "y": 4, "width": 18, "height": 12}
    assert value(spark, G.canvas_to_frame(*[F.lit(v) for v in (30, 30, 10, 10)], F.lit(0.5), F.lit(1920), F.lit(1080))).asDict() == {"x": 20, "y": 20, "width": 40, "height": 40}
    assert value(spark, G.canvas_to_frame(*[F.lit(v) for v in (10, 10, 10, 30)], F.lit(0.5), F.lit(1920), F.lit(1080))) is None


def test_timestamps(spark):
    given_ = {0.0: "00:00:00,000", 1.5: "00:00:01,500", 65.123: "00:01:05,123", 3661.999: "01:01:01,999", -5.0: "00:00:00,000", 36000.0: "10:00:00,000", 360000.0: "100:00:00,000"}
    for seconds, text in given_.items():
        assert value(spark, X.srt_timestamp(F.lit(seconds))) == text


def test_scripts_and_normalizing(spark):
    assert value(spark, X.has_script(F.lit("a你")))
    assert value(spark, X.has_script(F.lit("㐀")))
    assert not value(spark, X.has_script(F.lit("かな abc")))
    assert value(spark, X.normalize(F.lit("　\t a b \n"))) == "a b"


def test_similarity(spark):
    for a, b, want in (("", " ", 1.0), ("", "a", 0.0), ("abc", "abc ", 1.0), ("你好世界", "你好", 0.5)):
        assert value(spark, X.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_numbered_texts(spark):
    assert value(spark, X.numbered(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"
    assert value(spark, X.parse_numbered(F.lit('1. "x"\n\n 2. y \n'), F.lit(2))) == ["x", "y"]
    assert value(spark, X.parse_numbered(F.lit("1. x"), F.lit(2))) is None
    assert value(spark, X.unquote(F.lit("'a'"))) == "a"
    assert value(spark, X.unquote(F.lit("'a\""))) == "'a\""


def wrap(text, n):
    words, lines, line = text.split(), [], ""
    for w in words:
        if line and len(line) + 1 + len(w) > max(1, len(text) // n) and len(lines) < n - 1:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    lines += [line] if line else []
    return lines if len(words) >= n and len(lines) == n else None


def test_wrapping(spark):
    texts = ["", "one", "one two", "a bb ccc dddd eeeee", "the quick brown fox jumps over the lazy dog", "x " * 20]
    for text in texts:
        for n in (2, 3):
            assert value(spark, X.wrap_lines(F.lit(text), n)) == wrap(text, n)


def test_sidecar_paths(spark):
    for path, want in (("/a/b.mp4", "/a/b.srt"), ("/a/b", "/a/b.srt"), ("/a.d/b", "/a.d/b.srt"), ("/a/b.c.mkv", "/a/b.c.srt")):
        assert value(spark, X.srt_path(F.lit(path))) == want


def test_numbers(spark):
    assert value(spark, N.gamma_curve(F.lit(1.0))) == list(range(256))
    assert value(spark, N.shift_hue(F.lit(1.0), F.lit(-10.0))) == 176
    assert value(spark, N.correlation(F.array(*map(F.lit, (1.0, 2.0))), F.array(*map(F.lit, (2.0, 4.0))))) == pytest.approx(1)
    assert value(spark, N.correlation(F.array(*map(F.lit, (1.0, 1.0))), F.array(*map(F.lit, (2.0, 4.0))))) == 1  # constant
    assert value(spark, N.edge_factor(F.lit(0), 8)) == 0
    assert value(spark, N.vignette(F.lit(0), F.lit(0), 320, 240)) == pytest.approx(1)
    assert value(spark, N.extra_gain(F.lit(0.0))) == 0
    assert value(spark, N.scale_intensity(F.lit(10.0), F.lit(0.0), F.lit(20.0), F.lit(0.5))) == 5


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 400), st.integers(1, 100), st.integers(1, 40))
def test_auto_fit_is_the_largest_that_fits(spark, w, h, n):
    style = layout.Style()
    fits = [z for z in range(style.smallest, style.largest + 1) if math.ceil(n * z * style.advance) <= w and math.ceil(z * style.leading) <= h]
    got = value(spark, layout.auto_fit(F.array(F.lit("x" * n)), box(0, 0, w, h), style))
    assert got == (max(fits) if fits else None)


def test_colours_go_through_hue_and_saturation_and_back(spark):
    import colorsys

    from cuelattice.operators import picture

    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    frame = spark.createDataFrame(rows, "r int, g int, b int")
    hsv = frame.select("r", "g", "b", *[c.alias(n) for n, c in zip("hsv", picture.to_hsv(*map(F.col, "rgb")), strict=True)])
    back = hsv.select("*", *[c.alias(n) for n, c in zip(("r2", "g2", "b2"), picture.from_hsv(*map(F.col, "hsv")), strict=True)])
    for x in back.collect():
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert (x.s, x.v) == (round(s * 255), x.v) and min(abs(x.h - h * 180), 180 - abs(x.h - h * 180)) <= 0.5 + 1e-9
        assert all(abs(a - b) <= 5 for a, b in ((x.r, x.r2), (x.g, x.g2), (x.b, x.b2)))
    plain = frame.withColumns({"frame": F.lit(1), "gamma": F.lit(1.0), "contrast": F.lit(1.0), "saturation": F.lit(1.0), "hue": F.lit(0.0)})
    assert sorted((x.r, x.g, x.b) for x in picture.colour_chain(plain, ["frame"]).collect()) == sorted(rows)
    grey = plain.withColumn("saturation", F.lit(0.0))
    assert all(x.r == x.g == x.b for x in picture.colour_chain(grey, ["frame"]).collect())
