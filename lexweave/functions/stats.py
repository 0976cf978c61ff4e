"""Order statistics and folds. Three medians are kept apart: upper, mid and weighted upper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span's weight in a line's font size is its number of characters within these bounds.
SPAN_WEIGHTS = (1, 100)


def sorted_list(value: Column) -> Column:
    """The finite values of a group in order."""
    return F.sort_array(F.collect_list(F.when(~F.isnan(value.cast("double")), value)))


def upper_median(values: Column) -> Column:
    """The element n / 2 (from 0) of a sorted array; null if it is empty."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def upper_quartile(values: Column) -> Column:
    return F.get(values, F.least(F.floor(F.size(values) * 3 / 4), F.size(values) - 1).cast("int"))


def nearest_rank(values: Column, fraction: float, default: float = 0.0) -> Column:
    """The element at (n - 1) * fraction, rounded to even, of a sorted array."""
    return F.coalesce(F.get(values, F.bround((F.size(values) - 1) * F.lit(fraction)).cast("int")), F.lit(default))


def _weighted(spans: Column) -> Column:
    """Sizes and weights in order of size; superscripts only where nothing else has a size."""
    sized = F.filter(spans, lambda s: s["size"] > 0)
    body = F.filter(sized, lambda s: ~s["superscript"])
    used = F.when(F.size(body) > 0, body).otherwise(sized)
    low, high = SPAN_WEIGHTS
    return F.array_sort(F.transform(used, lambda s: F.struct(s["size"].alias("size"), F.greatest(F.lit(low), F.least(F.lit(high), F.length(s["text"]))).alias("w"))))


def _at_weight(items: Column, target: Column) -> Column:
    """The first size whose running weight is above the target."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("double").alias("size"))

    def step(acc: Column, s: Column) -> Column:
        seen = acc["seen"] + s["w"]
        return F.struct(seen.alias("seen"), F.when(acc["size"].isNull() & (seen > target), s["size"]).otherwise(acc["size"]).alias("size"))

    return F.aggregate(items, start, step, lambda acc: acc["size"])


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, s: acc + s["w"])


def line_font_size(spans: Column) -> Column:
    """Weighted upper median of the span sizes; 0 without sized spans."""
    items = _weighted(spans)
    return F.coalesce(_at_weight(items, F.floor(_total(items) / 2)), F.lit(0.0))


def mid_font_size(spans: Column) -> Column:
    """Weighted median that averages the two middle sizes; 0 without sized spans."""
    items = _weighted(spans)
    total = _total(items)
    low, high = _at_weight(items, F.floor((total - 1) / 2)), _at_weight(items, F.floor(total / 2))
    return F.coalesce((low + high) / 2, F.lit(0.0))


def union_box(box: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return F.struct(F.min(box["x0"]).alias("x0"), F.min(box["y0"]).alias("y0"), F.max(box["x1"]).alias("x1"), F.max(box["y1"]).alias("y1"))


def longest_label_run(values: Column) -> Column:
    """Length of the longest increasing subsequence of labels whose steps are 1 to 3.

    Of the runs that end in one value only the longest counts, so that the fold holds a length for each value.
    """
    empty = F.array().cast("array<struct<v:int,n:int>>")

    def step(acc: Column, v: Column) -> Column:
        before = F.array_max(F.transform(F.filter(acc, lambda p: (v - p["v"]).between(1, 3)), lambda p: p["n"]))
        own = F.array_max(F.transform(F.filter(acc, lambda p: p["v"] == v), lambda p: p["n"]))
        best = F.greatest(F.coalesce(before, F.lit(0)) + 1, F.coalesce(own, F.lit(0)))
        return F.concat(F.filter(acc, lambda p: p["v"] != v), F.array(F.struct(v.cast("int").alias("v"), best.cast("int").alias("n"))))

    return F.coalesce(F.array_max(F.transform(F.aggregate(values, empty, step), lambda p: p["n"])), F.lit(0))
