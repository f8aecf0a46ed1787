"""Exact arithmetic and strict text forms as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def half_even_quotient(total: Column, count: Column) -> Column:
    """``total / count`` for integral decimals, rounded once, ties to even; null where the count is 0."""

    def divided(x: Column) -> Column:
        return F.struct(x["t"].alias("t"), x["n"].alias("n"), (x["t"] % x["n"]).cast("decimal(20,0)").alias("r"))

    def quotient(x: Column) -> Column:
        return F.struct(
            x["t"].alias("t"),
            x["n"].alias("n"),
            (F.abs(x["r"]) * 2).cast("decimal(21,0)").alias("twice"),
            ((x["t"] - x["r"]) / x["n"]).cast("decimal(38,0)").alias("q"),
        )

    def rounded(x: Column) -> Column:
        away = (x["twice"] > x["n"]) | ((x["twice"] == x["n"]) & (F.abs(x["q"] % 2) == 1))
        return F.when(away, (x["q"] + F.signum(x["t"]).cast("decimal(1,0)")).cast("decimal(38,0)")).otherwise(x["q"])

    n = F.nullif(count.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    start = F.struct(total.cast("decimal(38,0)").alias("t"), n.alias("n"))
    return _let(start, lambda a: _let(divided(a), lambda b: _let(quotient(b), rounded)))


def mean_half_even(total: Column, count: Column, scale: int) -> Column:
    """Mean at ``scale`` of values whose exact sum is ``total`` (decimal of that scale)."""
    return _unshifted(half_even_quotient(_shifted(total, scale), count), scale)


def _shifted(c: Column, scale: int) -> Column:
    """The unscaled integer of a decimal."""
    if scale == 0:
        return c.cast("decimal(38,0)")
    return F.replace(c.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")


def _unshifted(units: Column, scale: int) -> Column:
    if scale == 0:
        return units.cast("decimal(38,0)")

    def placed(x: Column) -> Column:
        padded = F.lpad(x["text"], F.greatest(F.length(x["text"]), F.lit(scale + 1)), F.lit("0"))
        return _let(padded, lambda p: F.concat(x["sign"], p.substr(F.lit(1), F.length(p) - scale), F.lit("."), F.right(p, F.lit(scale))))

    start = lambda u: F.struct(F.abs(u).cast("string").alias("text"), F.when(u < 0, "-").otherwise("").alias("sign"))
    return _let(units, lambda u: _let(start(u), placed)).cast(f"decimal(38,{scale})")


def half_even(c: Column, scale: int) -> Column:
    """A decimal at ``scale``, ties to even."""
    return F.bround(c, scale).cast(f"decimal(38,{scale})")


_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# what a number's text may hold beside ASCII: decimal digits of all scripts, and blanks around
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_BLANKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def judged(df: DataFrame, cells: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``df`` with a struct for each of ``cells`` (its name -> a text column and the scale of DECIMAL(38, scale)): ``status`` (``ok``,
    ``syntax``, ``magnitude``, ``precision``; null for the empty cell) and ``value``, its decimal where the status is ``ok``.

    Blanks around a number (of any kind), underscores in it and decimal digits of any script are accepted.  Exponents are handled
    by digit counts, never by writing the digits out; magnitude is tested before precision; negative zero is zero.
    The steps are columns of their own that later ones use more than once, so that each is computed once for a cell; most
    cells are plain and need none of them.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    col = lambda o, k: F.col(f"`__{o}_{k}`")

    def cleaned(o: str, c: str, scale: int) -> dict[str, Column]:
        text, whole = F.col(f"`{c}`"), min(38 - scale, 18)
        plain = text.rlike(rf"^[+-]?\d{{1,{whole}}}(\.\d{{0,{scale}}})?$") if whole else F.lit(False)
        ascii_ = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "".join(_DIGITS), "".join(str(unicodedata.decimal(x)) for x in _DIGITS))).otherwise(text)
        body = F.replace(F.trim(ascii_, F.lit(_BLANKS)), F.lit("_"), F.lit(""))
        return {"plain": plain, "body": F.when(text.isNotNull() & (text != "") & ~plain, body)}

    def parted(o: str, c: str, scale: int) -> dict[str, Column]:
        low = F.lower(col(o, "body"))
        mantissa = F.ltrim(F.substring_index(low, "e", 1), F.lit("+-"))
        exponent = F.when(low.contains("e"), F.ltrim(F.substring_index(low, "e", -1), F.lit("+"))).otherwise("")
        return {"shaped": col(o, "body").rlike(_SHAPE), "mantissa": mantissa, "exponent": exponent}

    def counted(o: str, c: str, scale: int) -> dict[str, Column]:
        mantissa, exponent = col(o, "mantissa"), col(o, "exponent")
        dot = F.instr(mantissa, ".")
        long = F.when(exponent.startswith("-"), F.lit(-(10**9))).otherwise(F.lit(10**9)).cast("long")
        ten = F.when(exponent == "", F.lit(0).cast("long")).when(F.length(exponent) > 12, long).otherwise(exponent.try_cast("long"))
        return {"figures": F.replace(mantissa, F.lit("."), F.lit("")), "places": F.when(dot > 0, F.length(mantissa) - dot).otherwise(0) - ten}

    def measured(o: str, c: str, scale: int) -> dict[str, Column]:
        figures, places = col(o, "figures"), col(o, "places")
        significant = F.length(F.ltrim(figures, F.lit("0")))
        trailing = F.length(figures) - F.length(F.rtrim(figures, F.lit("0")))
        status = F.when(~col(o, "shaped"), "syntax").when(significant == 0, "zero").when(significant - 1 - places > 37 - scale, "magnitude")
        return {"status": status.when(places - trailing > scale, "precision").when(col(o, "shaped"), "ok")}

    def struct(o: str, c: str, scale: int) -> Column:
        kind, status = f"decimal(38,{scale})", col(o, "status")
        value = F.when(col(o, "plain"), F.col(f"`{c}`").try_cast(kind)).when(status == "zero", F.lit(0).cast(kind)).when(status == "ok", col(o, "body").try_cast(kind))
        told = F.when(col(o, "plain") | (status == "zero"), "ok").otherwise(status)
        return F.when(F.col(f"`{c}`") != "", F.struct(told.alias("status"), value.alias("value"))).alias(o)

    for stage in (cleaned, parted, counted, measured):
        df = df.withColumns({f"__{o}_{k}": v for o, (c, scale) in cells.items() for k, v in stage(o, c, scale).items()})
    return df.select(*keep, *[struct(o, c, scale) for o, (c, scale) in cells.items()])


_DATE, _TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?$"


def temporal_ok(text: Column, granularity: str) -> Column:
    """Whether a cell is a canonical date or naive datetime; null for the empty cell."""
    shape = text.rlike(_DATE if granularity == "date" else _TIME) & ~text.startswith("0000") & ~text.endswith(".000000")
    parsed = text.try_cast("date" if granularity == "date" else "timestamp_ntz").isNotNull()
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).otherwise(shape & parsed)


def temporal_value(text: Column, granularity: str) -> Column:
    kind = "date" if granularity == "date" else "timestamp_ntz"
    return F.when(temporal_ok(text, granularity), text.try_cast(kind))


def float64_faithful(c: Column, scale: int) -> Column:
    """Whether a decimal survives the way to a finite double and back at its scale; null stays null.  ``c`` is used several times:
    a column that is there already, not an expression."""
    d = c.cast("double")
    finite = F.abs(d) < float("inf")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(finite & (d.try_cast(f"decimal(38,{scale})") == c))


def rate(count: Column, n: Column, digits: int = 4) -> Column:
    """Share rounded to ``digits``, ties to even, 0 where nothing was counted."""
    exact = (count.cast("decimal(18,0)") / F.nullif(n, F.lit(0)).cast("decimal(18,0)")).cast("decimal(38,18)")
    return F.coalesce(F.bround(exact, digits), F.lit(0)).cast("double")
