"""Texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as CJK.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))
_QUOTES = "^([\"'])((?s).*)\\1$"


def has_script(text: Column, ranges: tuple[tuple[int, int], ...] = CJK) -> Column:
    """Whether a text has a code point in one of the ranges."""
    return text.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]")


def normalize(text: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in code points, of the normalized texts; 1 if both are empty."""
    a, b = normalize(a), normalize(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def canonical(text: Column, order: Column) -> Column:
    """Aggregate: the first of the longest normalized texts, as it was written."""
    return F.max_by(text, F.struct(F.length(normalize(text)), -order))


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm of a time, from 0 on, milliseconds rounded half to even."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def unquote(text: Column) -> Column:
    """Without one pair of equal quotation marks around it, and normalized."""
    return normalize(F.regexp_replace(text, _QUOTES, "$2"))


def numbered(texts: Column) -> Column:
    """The texts of an array as lines `1. first`, `2. second`."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def parse_numbered(response: Column, expected: Column) -> Column:
    """The items of a numbered answer, unquoted; null if there are not as many as expected."""
    lines = F.filter(F.transform(F.split(response, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), normalize), lambda x: F.length(x) > 0)
    items = F.transform(lines, lambda x: unquote(F.regexp_replace(x, r"^\d+\.\s+", "")))
    return F.when(F.size(items) == expected, items)


def wrap_lines(text: Column, n_lines: int) -> Column:
    """Words dealt greedily to n_lines lines of about equal length; null if that leaves some empty.

    A line ends before the word with which it would pass the length of the text divided by
    n_lines, except for the last line.
    """
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)
    target = F.greatest(F.lit(1), F.floor(F.length(text) / n_lines).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(s: Column, w: Column) -> Column:
        full = (F.length(s["line"]) > 0) & (F.length(s["line"]) + 1 + F.length(w) > target) & (F.size(s["done"]) < n_lines - 1)
        grown = F.when(F.length(s["line"]) > 0, F.concat(s["line"], F.lit(" "), w)).otherwise(w)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), w.alias("line"))).otherwise(
            F.struct(s["done"].alias("done"), grown.alias("line"))
        )

    lines = F.aggregate(words, start, add, lambda s: F.when(F.length(s["line"]) > 0, F.concat(s["done"], F.array(s["line"]))).otherwise(s["done"]))
    return F.when((F.size(words) >= n_lines) & (F.size(lines) == n_lines), lines)


def confidence(score: Column) -> Column:
    """A score as a number; null where it is none."""
    return score.try_cast("double")


def srt_path(path: Column) -> Column:
    """The path with its extension replaced by .srt, or with .srt added."""
    return F.when(path.rlike(r"[^/]\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", ".srt")).otherwise(F.concat(path, F.lit(".srt")))
