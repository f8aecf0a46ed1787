"""The check catalogue: names, methods, and result rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import domain_difference, inversions

# Fixed names of the checks that can be reported, by method.
METHODS = {
    "schema_validation": (
        "spec.decode dataset.manifest_available formula.grammar_allowed formula.functions_allowed formula.names_allowed "
        "formula.exponents_bounded"
    ).split(),
    "resource_policy": (
        "resource.file_bytes resource.manifest_columns resource.source_rows resource.source_cells resource.formula_bytes "
        "resource.formula_tokens resource.formula_ast_nodes resource.formula_ast_depth resource.formula_paren_depth "
        "resource.formula_digits resource.formula_identifier_bytes resource.formula_samples resource.formula_intermediate_bits "
        "resource.plotted_cells resource.render_rows"
    ).split(),
    "deterministic_recompute": (
        "dataset.hash_matches_source formula.domain_ordered formula.domain_bounded formula.sample_points_strictly_increasing "
        "formula.values_defined formula.values_bounded formula.hash_matches_source render.float64_fidelity data.charset "
        "data.csv_syntax data.header data.row_width data.numeric_value data.temporal_value transform.group_by_placement "
        "group_by.keys_distinct select.fields_distinct schema.fields_exist filter.value_type sort.fields_distinct "
        "aggregate.output_unique schema.field_types_match sort.field_in_plotted_table encoding.fields_exist_in_plotted_table "
        "encoding.axis_types_match_fields label.quantitative_units_present sort.canonical_order encoding.legend_domain_exact"
    ).split(),
    "construction": (
        "security.no_arbitrary_code formula.points_from_recomputation formula.rounding_unambiguous transform.ops_allowed "
        "transform.filters_declared transform.aggregates_match_recomputation scale.bar_zero"
    ).split(),
}
METHOD_OF = {c: m for m, cs in METHODS.items() for c in cs}
#: Affirmations that hold by how a result is made.
BY_CONSTRUCTION = ("security.no_arbitrary_code", "transform.ops_allowed", "transform.filters_declared", "transform.aggregates_match_recomputation")
SHAPE = "check string, method string, status string, severity string, message string"
# The default ceilings, inclusive.
LIMITS = {
    "file_bytes": 8 << 20,
    "manifest_bytes": 256 << 10,
    "manifest_columns": 1000,
    "source_rows": 100_000,
    "source_cells": 1_000_000,
    "plotted_cells": 1_000_000,
    "render_rows": 10_000,
}


def result(check: str, status: str, message: str) -> tuple:
    if check not in METHOD_OF:
        raise KeyError(f"unknown check {check!r}")
    return check, METHOD_OF[check], status, "error" if status == "fail" else "info", message


def frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), SHAPE)


def counted(df: DataFrame, check: str, bad) -> DataFrame:
    """One result row of a check whose failures are the rows that meet ``bad``."""
    n = df.agg(F.count_if(bad).alias("n"))
    return n.select(
        F.lit(check).alias("check"),
        F.lit(METHOD_OF[check]).alias("method"),
        F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"),
        F.when(F.col("n") > 0, "error").otherwise("info").alias("severity"),
        F.concat(F.col("n").cast("string"), F.lit(" failing")).alias("message"),
    )


def measured(df: DataFrame, check: str, value: Column, most: int) -> DataFrame:
    """One result row of a ceiling: ``value``, an aggregate over ``df``, is at most ``most``."""
    n = df.agg(F.coalesce(value.cast("long"), F.lit(0)).alias("n"))
    over = F.col("n") > most
    message = F.concat(F.col("n").cast("string"), F.lit(f", limit {most}"))
    return n.select(
        F.lit(check).alias("check"),
        F.lit(METHOD_OF[check]).alias("method"),
        F.when(over, "fail").otherwise("pass").alias("status"),
        F.when(over, "error").otherwise("info").alias("severity"),
        message.alias("message"),
    )


def ceilings(source: DataFrame, n_columns: int, plotted: DataFrame, limits: Mapping[str, int] = LIMITS) -> DataFrame:
    """The ceilings on rows, cells and columns of a source and of a plotted result."""
    width = len(plotted.columns)
    of_source = source.agg(F.count("*").alias("n"))
    of_result = plotted.agg(F.count("*").alias("n"))
    n = F.max("n")
    out = [
        measured(of_source, "resource.manifest_columns", F.max(F.lit(n_columns)), limits["manifest_columns"]),
        measured(of_source, "resource.source_rows", n, limits["source_rows"]),
    ]
    out += [
        measured(of_source, "resource.source_cells", n * n_columns, limits["source_cells"]),
        measured(of_result, "resource.plotted_cells", n * width, limits["plotted_cells"]),
    ]
    return reduce(DataFrame.unionByName, [*out, measured(of_result, "resource.render_rows", n, limits["render_rows"])])


def canonical_order(positioned: DataFrame, sort: Sequence[tuple[str, bool]]) -> DataFrame:
    """``sort.canonical_order``: no row of a positioned result stands behind one that it should precede."""
    return counted(inversions(positioned, "pos", sort), "sort.canonical_order", F.lit(True))


def legend_domain(shown: DataFrame, declared: DataFrame) -> DataFrame:
    """``encoding.legend_domain_exact``: the values shown are the values declared."""
    return counted(domain_difference(shown, declared), "encoding.legend_domain_exact", F.lit(True))


def zero_baseline(values: DataFrame, column: str, low: Column) -> DataFrame:
    """``scale.bar_zero``: the axis of bars, which begins at ``low``, holds zero or begins below every value that is less."""
    return counted(values, "scale.bar_zero", F.col(column).isNotNull() & (low > F.least(F.lit(0), F.col(column))))


#: The checks that a formula's sampled points are put to, in the order in which they are reported.
SAMPLED = (
    "formula.sample_points_strictly_increasing formula.values_defined resource.formula_intermediate_bits formula.values_bounded formula.rounding_unambiguous "
    "formula.points_from_recomputation formula.hash_matches_source render.float64_fidelity"
).split()


def formula_results(evaluated: DataFrame, expected: DataFrame, y_limit: str = "1e26") -> DataFrame:
    """``formula_id, place, check, method, status, severity, message``: the checks of each sampled formula.

    Points rise strictly, as decimals and as doubles; values are defined, within bounds, at their scale and faithful as doubles; there
    are as many points as the formula has samples, each once; and the formula is the one that was declared.  ``evaluated`` has
    ``formula_id, i, x, y, status``, ``expected`` ``formula_id, samples, y_scale, own_hash``.
    """
    w = Window.partitionBy("formula_id").orderBy("i")
    rows = evaluated.withColumn("before", F.lag("x").over(w)).join(expected, "formula_id")
    bound = F.lit(y_limit).cast("double")
    lossless = lambda c: (F.abs(F.col(c).cast("double")) < float("inf")) & (F.col(c).cast("double").try_cast("decimal(38,12)") == F.col(c))
    unit = F.pow(F.lit(10).cast("double"), (F.lit(12) - F.col("y_scale")).cast("double")).cast("decimal(13,0)")
    tests = {
        SAMPLED[0]: F.col("before").isNotNull() & (F.col("x") <= F.col("before")),
        SAMPLED[1]: F.col("status") == SAMPLED[1],
        SAMPLED[2]: F.col("status") == SAMPLED[2],
        # a value beyond what 38 digits hold has a status of ok and no decimal
        SAMPLED[3]: (F.col("status") == "ok") & (F.col("y").isNull() | (F.abs(F.col("y").cast("double")) > bound)),
        SAMPLED[4]: F.replace(F.col("y").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)") % unit != 0,
        SAMPLED[7]: (F.col("before").isNotNull() & (F.col("x").cast("double") <= F.col("before").cast("double"))) | ~F.coalesce(
            lossless("x") & F.coalesce(lossless("y"), F.lit(True)),
            F.lit(False),
        ),
    }
    n, whole = F.count(F.lit(1)), F.max("samples")
    once = (n == whole) & (F.min("i") == 0) & (F.max("i") == whole - 1) & (F.count_distinct("i") == n)
    counts = rows.groupBy("formula_id").agg(
        *[F.count_if(bad).alias(check) for check, bad in tests.items()],
        F.when(once, F.lit(0)).otherwise(F.lit(1)).cast("long").alias(SAMPLED[5]),
        F.count_if(~F.col("own_hash")).alias(SAMPLED[6]),
    )
    long = counts.unpivot(["formula_id"], [F.col(f"`{c}`") for c in SAMPLED], "check", "n")
    table = lambda of: F.create_map(*[F.lit(x) for i, c in enumerate(SAMPLED) for x in (c, of(i, c))])[F.col("check")]
    failed = F.col("n") > 0
    return long.select(
        "formula_id",
        table(lambda i, c: i).alias("place"),
        "check",
        table(lambda i, c: METHOD_OF[c]).alias("method"),
        F.when(failed, "fail").otherwise("pass").alias("status"),
        F.when(failed, "error").otherwise("info").alias("severity"),
        F.concat(F.col("n").cast("string"), F.lit(" failing")).alias("message"),
    )


def affirmations(spark: SparkSession) -> DataFrame:
    """What holds by how a result is made, as result rows."""
    return frame(spark, [result(c, "pass", "holds by construction") for c in BY_CONSTRUCTION])


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Results of several stages, with the stage's number."""
    out = None
    for i, f in enumerate(frames):
        f = f.select(F.lit(i).alias("stage"), *f.columns)
        out = f if out is None else out.unionByName(f)
    return out


def verdict(results: DataFrame, *by: str) -> DataFrame:
    """``verified`` where every result passes, with the first failing check."""
    failed = F.col("status") == "fail"
    return results.groupBy(*by).agg(
        (F.count_if(failed) == 0).alias("verified"),
        F.count_if(failed).alias("failed"),
        F.min_by("check", F.when(failed, F.struct("stage", "check"))).alias("first_failing"),
    )
