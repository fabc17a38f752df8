"""Kernels over numeric array columns; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def abs_diff_sum(a: Column, b: Column, kind: str = "double") -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)), kind)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return abs_diff_sum(a, b) / F.size(a)


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test)).cast("bigint")


def mask_counts(a: Column, b: Column, threshold: float) -> Column:
    """Struct of both/only_a/only_b counts of elements at or above the threshold."""
    codes = F.zip_with(
        a, b, lambda x, y: F.when(x >= threshold, 1).otherwise(0) + F.when(y >= threshold, 2).otherwise(0)
    )
    return F.struct(
        count_where(codes, lambda c: c == 3).alias("both"),
        count_where(codes, lambda c: c == 1).alias("only_a"),
        count_where(codes, lambda c: c == 2).alias("only_b"),
    )


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, even where lambdas below read it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def boundary(plane: Column, width: int, threshold: float) -> Column:
    """For each column of a plane the rows, ascending, of its elements at or above the threshold with one below it among their eight neighbours."""
    around = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for y in (-1, 0, 1) for x in (-1, 0, 1) if x or y))

    def on_edge(x: Column, y: Column) -> Column:
        def below(step: Column) -> Column:
            column, at = x + step["x"], x + step["x"] + (y + step["y"]) * width
            return (column >= 0) & (column < width) & (at >= 0) & (at < F.size(plane)) & (F.get(plane, at) < threshold)

        return (F.get(plane, x + y * width) >= threshold) & F.exists(around, below)

    rows = F.sequence(F.lit(0), F.ceil(F.size(plane) / width).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.filter(rows, lambda y: on_edge(x, y)))


def nearest_rows(rows: Column, height: Column) -> Column:
    """For each row of a column with the given, ascending rows the nearest of these; empty if there are none."""
    def end(i: Column) -> Column:
        following = F.get(rows, i + 1)
        return F.when(i < 0, 0).when(following.isNull(), height).otherwise(F.floor((F.get(rows, i) + following) / 2).cast("int") + 1)

    return F.flatten(F.transform(rows, lambda row, i: F.array_repeat(row, end(i) - end(i - 1))))


def mean_least_distance(a: Column, b: Column, width: int, height: Column) -> Column:
    """Mean distance of the cells ``a`` of a plane to the nearest of ``b``, both as in ``boundary``; null if either is empty.

    An exact separable transform: first the nearest row within each column, linear in cells; then, per cell of ``a``, columns by
    growing distance, of which those beyond the least distance so far cost one comparison.
    """
    def least(near: Column, x: Column, y: Column) -> Column:
        def step(best: Column, dx: Column) -> Column:
            def side(column: Column) -> Column:
                dy = (F.get(F.get(near, column), y) - y).cast("bigint")
                return dx * dx + dy * dy

            return F.when(dx * dx >= best, best).otherwise(F.least(best, side((x - dx).cast("int")), side((x + dx).cast("int"))))

        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), F.lit(2**62).cast("bigint"), step)

    def distances(near: Column) -> Column:
        return F.flatten(F.transform(a, lambda rows, x: F.transform(rows, lambda y: F.sqrt(least(near, x, y).cast("double")))))

    filled = lambda cells: F.exists(cells, lambda rows: F.size(rows) > 0)
    mean = bound(bound(F.transform(b, lambda rows: nearest_rows(rows, height)), distances), lambda found: total(found) / F.size(found))
    return F.when(filled(a) & filled(b), mean)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
