"""Canonical row text, digests and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Numeric, TableSchema, Temporal

VERSION = "1"
ADDRESS = r"^sha256:[0-9a-f]{64}$"


def tagged(domain: str, payload: Column) -> Column:
    """Digest of a payload under its domain, so that digests of different things never meet."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"attestry-{domain}/{VERSION}\n"), payload), 256))


def length_prefixed(*parts: Column) -> Column:
    """Byte strings one after another, each behind its length in eight bytes: no two lists give the same bytes."""
    return F.concat(*[x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary"))])


def strict_base64(text: Column) -> Column:
    """The bytes of a text in canonical base64 (padded, no blanks, no spare bits); null for any other text."""
    shape = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(shape, F.try_to_binary(text, F.lit("base64")))
    return F.when(F.replace(F.replace(F.base64(raw), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")) == text, raw)


def json_string(c: Column) -> Column:
    """A text as a JSON string token."""
    token = F.to_json(F.array(c))
    return token.substr(F.lit(2), F.length(token) - 2)


def cell_token(c: Column, column) -> Column:
    """A cell as its JSON token: fixed-point decimals, ISO dates and times, null."""
    if isinstance(column, Numeric):
        text = c.cast(f"decimal(38,{column.scale})").cast("string")
    elif isinstance(column, Temporal):
        if column.granularity == "date":
            text = json_string(F.date_format(c, "yyyy-MM-dd"))
        else:
            micro = F.date_format(c, "SSSSSS")
            text = json_string(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro == "000000", "").otherwise(F.concat(F.lit("."), micro))))
    else:
        text = json_string(c)
    return F.when(c.isNull(), "null").otherwise(text)


def row_line(schema: TableSchema) -> Column:
    """A row as one compact JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", *[cell_token(F.col(c.name), c) for c in schema.columns]), F.lit("]"))


def header_line(schema: TableSchema) -> str:
    return "[" + ",".join('"' + d + '"' for d in schema.descriptors()) + "]"


def multiset_digest(df: DataFrame, schema: TableSchema, by: Sequence[str] = ()) -> DataFrame:
    """Order-free identity of the rows: their count and the sums of four 32-bit lanes of each row's digest."""
    hashed = df.select(*by, F.sha2(row_line(schema), 256).alias("h"))
    lane = lambda k: F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return hashed.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(lane(k), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"lane{k}") for k in range(4)],
    )


def identity(df: DataFrame, schema: TableSchema) -> DataFrame:
    """``sha256``: one row with an address of a table's contents that depends neither on order nor on files."""
    lanes = multiset_digest(df, schema)
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[f"lane{k}" for k in range(4)])
    return lanes.select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("sha256"))


#: Lines of a block, and blocks of a group, in a table's digest.
BLOCK = 4096


def table_digest(lines: DataFrame, schema: TableSchema, by: Sequence[str] = ()) -> DataFrame:
    """``n_rows, digest`` (behind the columns of ``by``, where given): the digest of header and lines in position order, from ``pos, line``.

    One definition for every size: blocks of BLOCK lines are digested, then groups of BLOCK blocks, and the digest of
    the table is that of its header and its groups' digests, so that no task holds more than one of these lists.
    """

    def joined(order: str, text: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(x[text], F.lit("\n"))), ""), 256)

    blocks = lines.groupBy(*by, F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.count("*").alias("n"), joined("pos", "line").alias("h"))
    groups = blocks.groupBy(*by, F.floor(F.col("block") / BLOCK).alias("group")).agg(F.sum("n").alias("n"), joined("block", "h").alias("h"))
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "h"))), lambda x: x["h"]), "\n")
    return groups.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), _of_table(F.lit(header_line(schema)), hashes).alias("digest"))


def _of_table(header: Column, groups: Column) -> Column:
    return tagged("table", F.concat(header, F.lit("\n"), groups))


def empty_table_digest(schema: TableSchema) -> Column:
    return _of_table(F.lit(header_line(schema)), F.lit(""))


def stored_table_digest(header: Column, body: Column) -> Column:
    """``table_digest`` of a table whose lines are one text, each with its end of line."""
    lines = F.filter(F.split(body, "\n"), lambda x: x != "")
    digest = lambda xs: F.sha2(F.concat(F.array_join(xs, "\n"), F.lit("\n")), 256)
    in_blocks = lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: digest(F.slice(xs, b * BLOCK + 1, BLOCK)))
    )
    return _of_table(header, F.array_join(in_blocks(in_blocks(lines)), "\n"))
