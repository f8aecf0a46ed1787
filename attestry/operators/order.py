"""Canonical order, positions, order checks and category domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(name: str, descending: bool = False) -> Column:
    """NULL is the greatest value: last ascending, first descending."""
    c = F.col(f"`{name}`")
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def total_order(columns: Sequence[str], sort: Sequence[tuple[str, bool]] = ()) -> list[Column]:
    """The declared keys, then every other column ascending."""
    keyed = {n for n, _ in sort}
    return [order_key(n, d) for n, d in sort] + [order_key(c) for c in columns if c not in keyed]


def positions(df: DataFrame, order: Sequence[Column], *, name: str = "pos", rows_at_most: int | None = None) -> DataFrame:
    """``df`` with its place (from 1) in the order.

    With ``rows_at_most`` (a bound the caller has, such as a number of groups) one window does it, and a row beyond the bound
    is an error.  Otherwise rows are
    sorted over range partitions, and each partition's offset is the number of rows before it: only one count per
    partition meets in one place.
    """
    if rows_at_most is not None:
        at = F.row_number().over(Window.orderBy(*order)).cast("long")
        return df.withColumn(name, at).withColumn(
            name,
            F.when(F.col(name) <= rows_at_most, F.col(name)).otherwise(F.raise_error(F.lit(f"more than {rows_at_most} rows"))),
        )
    from ..sources.store import stored

    ranked = stored(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranked.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row + 1).drop("__part", "__at", "__before")


def inversions(df: DataFrame, position: str, sort: Sequence[tuple[str, bool]], *, block_rows: int = 1_000_000) -> DataFrame:
    """Rows that stand behind a row they should precede, by neighbours in position order; NULL is the greatest value.

    Positions are dense numbers.  Neighbours are compared inside blocks of positions; of each block, only its first and
    last row meet the next block's, so that no task holds the whole order.
    """
    names = [n for n, _ in sort]
    block = F.floor(F.col(position) / block_rows)

    def worse(now, prev) -> Column:
        out: Column = F.lit(False)
        for name, descending in reversed(list(sort)):
            a, b = now(name), prev(name)
            greater = (b.isNull() & a.isNotNull()) | (b > a)
            less = (a.isNull() & b.isNotNull()) | (b < a)
            out = F.coalesce(less if descending else greater, F.lit(False)) | (a.eqNullSafe(b) & out)
        return out

    inner = Window.partitionBy("__block").orderBy(position)
    rows = df.withColumn("__block", block)
    inside = rows.withColumn(
        "__bad",
        F.lag(F.lit(True)).over(inner).isNotNull() & worse(F.col, lambda n: F.lag(F.col(n)).over(inner)),
    ).filter("__bad").drop("__bad", "__block")
    ends = rows.groupBy("__block").agg(F.min_by(F.struct(*df.columns), position).alias("first"), F.max_by(F.struct(*names), position).alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("__block"))).filter("before is not null")  # two rows of each block
    across = between.filter(worse(lambda n: F.col(f"first.{n}"), lambda n: F.col(f"before.{n}"))).select("first.*")
    return inside.unionByName(across)


def category_domain(df: DataFrame, column: str, position: str) -> DataFrame:
    """``value, rank``: distinct non-null values by first appearance."""
    got = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(position).alias("first"))
    return positions(got, [order_key("first"), order_key("value")], name="rank").select("value", "rank")


def domain_difference(shown: DataFrame, declared: DataFrame) -> DataFrame:
    """``value, side`` for values on one side only (``missing`` from or ``extra`` to the declared domain)."""
    a, b = shown.select("value").distinct().withColumn("s", F.lit(True)), declared.select("value").distinct().withColumn("d", F.lit(True))
    return a.join(b, "value", "full_outer").filter("s is null or d is null").select(
        "value",
        F.when(F.col("s").isNull(), "extra").otherwise("missing").alias("side"),
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``side, n``: how many rows (with repeats) only the ``left`` and only the ``right`` frame has; both have the same columns.

    Copies are counted against each other in one grouping, so that each side is computed once.
    """
    columns = [F.col(f"`{c}`") for c in left.columns]
    both = left.select(F.struct(*columns).alias("row"), F.lit(1).alias("n")).unionByName(right.select(F.struct(*columns).alias("row"), F.lit(-1).alias("n")))
    net = both.groupBy("row").agg(F.sum("n").alias("n"))
    sides = net.filter("n <> 0").groupBy(F.when(F.col("n") > 0, "left").otherwise("right").alias("side"))
    return sides.agg(F.abs(F.sum("n")).alias("n"))
