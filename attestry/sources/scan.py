"""Source identity and the typed, strictly validated CSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import header_line, row_line, tagged
from ..functions.exact import judged, temporal_ok, temporal_value
from ..operators.checks import LIMITS
from ..operators.order import total_order
from ..types import Numeric, TableSchema, Temporal

CORRUPT = "_corrupt"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``name, length, content`` of the files under a path; columns that are not asked for are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")


def identity(found: DataFrame) -> DataFrame:
    """``name, sha256`` of each file's raw bytes."""
    return found.select("name", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def corpus_identity(found: DataFrame) -> DataFrame:
    """``n_files, sha256``: one digest over the (name, content digest) pairs of a data set in many files, by blocks of names."""
    pairs = found.select(F.lit(1).alias("all"), "name", F.sha2("content", 256).alias("h"))
    return identity_by_blocks(pairs, "all").drop("all")


def identity_by_blocks(pairs: DataFrame, by: str) -> DataFrame:
    """``by, n_files, sha256`` of many (name, h) pairs: 4096 blocks by the name's hash are digested first, then their digests."""
    joined = lambda c, f: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), f), ""), 256)
    blocks = pairs.groupBy(by, F.substring(F.sha2("name", 256), 1, 3).alias("block")).agg(
        F.count("*").alias("n"),
        joined(F.struct("name", "h"), lambda x: F.concat(x["name"], F.lit("\u0000"), x["h"], F.lit("\n"))).alias("h"),
    )
    return blocks.groupBy(by).agg(
        F.sum("n").alias("n_files"),
        joined(F.struct("block", "h"), lambda x: F.concat(x["block"], x["h"], F.lit("\n"))).alias("sha256"),
    )


def gates(
    found: DataFrame,
    schema: TableSchema,
    *,
    most_bytes: int = LIMITS["file_bytes"],
    most_rows: int = LIMITS["source_rows"],
    most_cells: int = LIMITS["source_cells"],
) -> DataFrame:
    """``name, check, status`` of every gate that a file's bytes decide.

    Size, charset, header (its parsed first record), syntax (a quoted field that does not end where its field ends), row
    widths (blank lines too), rows and cells.  Gates behind a charset or syntax failure are not judged on what can't be
    read: they pass.
    """
    text = F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n")
    valid = F.is_valid_utf8("content") & (F.coalesce(F.hex(F.substring("content", 1, 3)), F.lit("")) != "EFBBBF")
    # each whole quoted field becomes one sign, so that what is left has neither commas nor line ends in a field
    plain = F.regexp_replace(text, r'(^|[,\n])"(?:[^"]|"")*+"(?=[,\n]|$)', "$1q")
    broken = plain.rlike(r'(^|[,\n])"')
    lines = F.split(plain, "\n", -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    records = F.when((F.size(body) > 0) & (F.element_at(body, -1) == ""), F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    widths = F.transform(records, lambda x: F.when(x == "", 0).otherwise(F.regexp_count(x, F.lit(",")) + 1))
    n = len(schema.names)
    cells = F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)
    first = F.from_csv(
        F.substring_index(text, "\n", 1),
        ", ".join(f"c{i} string" for i in range(n + 1)),
        {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    )
    header = first[f"c{n}"].isNull()
    for i, name in enumerate(schema.names):
        header &= F.coalesce(first[f"c{i}"] == name, F.lit(False))
    readable = valid & ~broken
    tests = {
        "resource.file_bytes": F.col("length") <= most_bytes,
        "data.charset": valid,
        "data.header": ~valid | header,
        "data.csv_syntax": ~valid | ~broken,
        "data.row_width": ~readable | ~F.exists(widths, lambda x: x != n),
        "resource.source_rows": ~readable | (F.size(records) <= most_rows),
        "resource.source_cells": ~readable | (cells <= most_cells),
    }
    results = F.array(*[F.struct(F.lit(check).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for check, ok in tests.items()])
    return found.select("name", F.explode(results).alias("r")).select("name", "r.check", F.when(F.col("r.ok"), "pass").otherwise("fail").alias("status"))


def admitted(spark: SparkSession, path: str, *, most_bytes: int = LIMITS["file_bytes"]) -> DataFrame:
    """``files`` of at most ``most_bytes``: larger ones are left out by their listed length, before any of their bytes is read."""
    return files(spark, path).filter(F.col("length") <= most_bytes)


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """``name, length, sha256`` of the data sets right below one folder: names that a spec may use, and nothing from elsewhere."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(root)
    named = found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))
    return named.filter(F.col("name").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\.csv$"))


def binding(requested: DataFrame, present: DataFrame) -> DataFrame:
    """``id, check`` for every request (``id, name, declared``): null where the data set is there and has the declared digest."""
    joined = requested.join(present.select("name", "sha256"), "name", "left")
    return joined.select("id", F.when(~F.col("sha256").eqNullSafe(F.col("declared")) | F.col("sha256").isNull(), "dataset.hash_matches_source").alias("check"))


def spec_corpus(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``spec_id, corpus, expected, raw, problem``: spec files joined to their index (``name, spec_id, corpus, expected``).

    ``problem`` is ``unindexed`` for a file without an entry and ``missing`` for an entry without a file.
    """
    found = files(spark, path).select("name", F.col("content").cast("string").alias("raw"), F.lit(True).alias("there"))
    joined = index.withColumn("listed", F.lit(True)).join(found, "name", "full_outer")
    problem = F.when(F.col("listed").isNull(), "unindexed").when(F.col("there").isNull(), "missing")
    return joined.select(F.coalesce("spec_id", "name").alias("spec_id"), "corpus", "expected", "raw", problem.alias("problem"))


def raw_csv(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """All cells as text, with the file's name and the corrupt record of rows that are too short or too long."""
    fields = [T.StructField(n, T.StringType()) for n in schema.names]
    shape = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.csv(
        path,
        schema=shape,
        header=True,
        enforceSchema=False,
        multiLine=True,
        escape='"',
        columnNameOfCorruptRecord=CORRUPT,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return df.withColumn("__file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def _numbers(schema: TableSchema) -> dict[str, tuple[str, int]]:
    return {f"__judged_{c.name}": (c.name, c.scale) for c in schema.columns if isinstance(c, Numeric)}


def cell_failures(raw: DataFrame, schema: TableSchema, by: str = "__file") -> DataFrame:
    """``by, check, n``: failing cells and rows, over all columns, whatever a query would read."""
    tests = [F.count_if(F.col(CORRUPT).isNotNull()).alias("data.row_width")] if CORRUPT in raw.columns else []
    raw = judged(raw, _numbers(schema))
    numeric = [F.coalesce(F.col(f"`__judged_{c.name}`.status"), F.lit("ok")) != "ok" for c in schema.columns if isinstance(c, Numeric)]
    temporal = [~F.coalesce(temporal_ok(F.col(c.name), c.granularity), F.lit(True)) for c in schema.columns if isinstance(c, Temporal)]
    for name, bad in (("data.numeric_value", numeric), ("data.temporal_value", temporal)):
        if bad:
            tests.append(sum((F.count_if(b) for b in bad[1:]), F.count_if(bad[0])).alias(name))
    counted = raw.groupBy(by).agg(*tests)
    return counted.unpivot([by], [F.col(f"`{c}`") for c in counted.columns if c != by], "check", "n")


def typed_csv(raw: DataFrame, schema: TableSchema, *, refuse: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The declared columns, typed; the empty cell is NULL.

    A cell that fails its check, or a row of another width, is an error with the check's name wherever it is read;
    ``cell_failures`` counts them all, whatever a query reads.  Without ``refuse`` they become NULL.  ``keep`` names further
    columns of ``raw``.
    """
    out = [F.col(c) for c in keep]
    raw = judged(raw, _numbers(schema))
    width = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    for c in schema.columns:
        text = F.nullif(F.col(f"`{c.name}`"), F.lit(""))
        numeric, temporal = isinstance(c, Numeric), isinstance(c, Temporal)
        value = F.col(f"`__judged_{c.name}`.value") if numeric else temporal_value(text, c.granularity) if temporal else text
        if refuse:
            if numeric or temporal:
                message = F.concat(F.lit(f"data.{'numeric' if numeric else 'temporal'}_value: {c.name} "), text)
                value = F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(message).cast(c.spark))
            value = F.when(~width, value).otherwise(F.raise_error(F.lit(f"data.row_width: expected {len(schema.names)} fields")).cast(c.spark))
        out.append(value.alias(c.name))
    return raw.select(*out)


#: One task reads a CSV file whole, so that a row's place in its partition's run of a file is its place in the file.
_PLACED = "__at"


def in_source_order(spark: SparkSession, path: str, schema: TableSchema) -> DataFrame:
    """``raw_csv`` with ``__file`` (the path) and ``__at``, which grows with a row's place inside its file."""
    raw = raw_csv(spark, path, schema)
    return raw.withColumn("__file", F.col("_metadata.file_path")).withColumn(_PLACED, F.monotonically_increasing_id())


def profile(raw: DataFrame, schema: TableSchema, *, first_rows: int = 3) -> DataFrame:
    """One row: ``identity`` of the declared columns, their ``descriptions``, ``n_rows``, and the ``first`` rows as lines.

    "First" is as the source has them: by file and place (``in_source_order``); rows without places come in canonical order.
    """
    text = [f"{c.name} ({c.descriptor.split(':', 1)[1]}" + (f", unit {c.unit}" if c.unit else "") + ")" for c in schema.columns]
    placed = _PLACED in raw.columns
    typed = typed_csv(raw, schema, keep=("__file", _PLACED) if placed else ())
    total = typed.agg(F.count("*").alias("n_rows"))
    order = [F.col("__file"), F.col(_PLACED)] if placed else total_order(schema.names)
    first = typed.orderBy(*order).limit(first_rows).select(row_line(schema).alias("line"), F.monotonically_increasing_id().alias("at"))
    told = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("first"))
    identity = tagged("manifest", F.lit(header_line(schema)))
    return total.join(told).select(identity.alias("identity"), F.array(*[F.lit(x) for x in text]).alias("descriptions"), "n_rows", "first")  # one row each
