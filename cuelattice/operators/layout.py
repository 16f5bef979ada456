"""Layout of a text in a box, given a width model instead of a font."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelattice.functions import geometry as G
from cuelattice.functions import text as X


@dataclass(frozen=True)
class Style:
    """Sizes tried, how wide a character and how high a line is for its size, and what is added."""

    smallest: int = 12
    largest: int = 48
    advance: float = 0.6
    leading: float = 1.2
    stroke: int = 0
    shadow: tuple[int, int] = (0, 0)
    condensed: float = 1.0  # advance of the narrow font for that of the regular one; 1: there is none
    grow: tuple[float, float] = (1.0, 1.0)
    max_lines: int = 1


def line_width(length: Column, size: Column, style: Style, narrow: float = 1.0) -> Column:
    return F.ceil(length * size * (style.advance * narrow)).cast("int") + 2 * style.stroke + max(0, style.shadow[0])


def line_height(size: Column, style: Style) -> Column:
    return F.ceil(size * style.leading).cast("int") + 2 * style.stroke + max(0, style.shadow[1])


def block_size(lines: Column, size: Column, style: Style, narrow: float = 1.0) -> tuple[Column, Column]:
    """Width and height of an array of lines."""
    longest = F.array_max(F.transform(lines, F.length))
    return line_width(longest, size, style, narrow), line_height(size, style) * F.size(lines)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def auto_fit(lines: Column, b: Column, style: Style, narrow: float = 1.0) -> Column:
    """The largest size at which the lines fit the box; null if the smallest does not.

    A binary search, written out as a fold over as many halvings as the range needs.
    """
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(style.largest - style.smallest + 1)))))
    start = F.struct(F.lit(style.smallest).alias("lo"), F.lit(style.largest).alias("hi"))
    known = F.struct(F.array_max(F.transform(lines, F.length)).alias("longest"), F.size(lines).alias("n"), b["width"].alias("width"), b["height"].alias("height"))

    def search(k: Column) -> Column:
        def fits(size: Column) -> Column:
            return (line_width(k["longest"], size, style, narrow) <= k["width"]) & (line_height(size, style) * k["n"] <= k["height"])

        def halve(s: Column, _: Column) -> Column:
            def move(mid: Column) -> Column:
                ok = fits(mid)
                return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid - 1).alias("hi"))

            return F.when(s["lo"] >= s["hi"], s).otherwise(let(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int"), move))

        return F.when(fits(F.lit(style.smallest)), F.aggregate(steps, start, halve, lambda s: s["lo"]))

    return let(known, search)


PLAN = "struct<box:" + G.BOX + ",narrow:boolean,size:int,lines:array<string>>"


def fixed_fit(lines: Column, b: Column, size: Column, style: Style, narrow: float = 1.0) -> Column:
    """The size, if the lines fit the box at it; else null."""
    w, h = block_size(lines, size, style, narrow)
    return F.when(G.fits(w, h, b), size)


def plan(text: Column, b: Column, style: Style, frame_w: int, frame_h: int, fixed: Column | None = None) -> Column:
    """Box, font, size and lines of the first way in which a text fits; null if none does.

    Tried in order, with the regular and then with the narrow font: one line in the box, one
    line in the grown box, then more lines in either, one more as long as that makes the size
    larger. With a fixed size all this is tried at that size first, then a box forced to
    hold one line, or more, of it in the regular font, and only then at any size.
    """

    def option(lines: Column, where: Column, narrow: float, size: Column | None) -> Column:
        def chosen(found: Column) -> Column:
            return F.when(where.isNotNull() & found.isNotNull(), F.struct(where.alias("box"), F.lit(narrow != 1).alias("narrow"), found.alias("size"), lines.alias("lines")).cast(PLAN))

        return let(auto_fit(lines, where, style, narrow) if size is None else fixed_fit(lines, where, size, style, narrow), chosen)

    def improved(s: Column, o: Column) -> Column:
        better = o.isNotNull() & ~s["ended"] & (s["best"].isNull() | (o["size"] > s["best"]["size"]))
        return F.struct(F.when(better, o).otherwise(s["best"]).alias("best"), (s["ended"] | (o.isNotNull() & ~better)).alias("ended"))

    def wrapped_option(where: Column, narrow: float, size: Column | None) -> Callable[[Column], Column]:
        return lambda lines: option(lines, where, narrow, size)

    def cascade(k: Column, size: Column | None) -> list[Column]:
        tried: list[Column] = []
        for narrow in dict.fromkeys((1.0, style.condensed)):
            tried += [option(F.array(k["text"]), k[where], narrow, size) for where in ("own", "grown")]
            for where in ("own", "grown") if style.max_lines >= 2 else ():
                start = F.struct(F.lit(None).cast(PLAN).alias("best"), F.lit(False).alias("ended"))
                tried.append(F.aggregate(F.transform(k["wrapped"], wrapped_option(k[where], narrow, size)), start, improved, lambda s: s["best"]))
        return tried

    def forced(k: Column, size: Column) -> Column:
        def held(lines: Column) -> Column:
            w, h = block_size(lines, size, style)
            return let(G.force_expand(b, w, h, frame_w, frame_h), lambda f: option(lines, f, 1.0, size))

        ways = F.transform(F.concat(F.array(F.array(k["text"])), k["wrapped"]), held)
        return F.get(F.array_compact(ways), F.lit(0))

    def options(k: Column) -> Column:
        at_fixed = [] if fixed is None else [*cascade(k, k["fixed"]), forced(k, k["fixed"])]
        return F.coalesce(*at_fixed, *cascade(k, None))

    wrapped = F.array_compact(F.array(*[X.wrap_lines(text, n) for n in range(2, style.max_lines + 1)])) if style.max_lines >= 2 else F.array().cast("array<array<string>>")
    size = F.lit(None).cast("int") if fixed is None else fixed.cast("int")
    known = F.struct(text.alias("text"), b.alias("own"), G.expand(b, *style.grow, frame_w, frame_h).alias("grown"), wrapped.alias("wrapped"), size.alias("fixed"))
    return let(known, options)
