"""Table schemas: declared, never inferred.

A column is numeric (fixed-scale decimal), temporal (date or naive datetime) or text.  Units and labels are display
metadata; they ride in ``StructField.metadata`` and never enter a digest.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


class CheckError(ValueError):
    """A named check that failed while a plan was built or a source admitted."""

    def __init__(self, check: str, message: str):
        super().__init__(f"{check}: {message}")
        self.check, self.message = check, message


@dataclass(frozen=True)
class Numeric:
    name: str
    scale: int = 0
    unit: str | None = None
    label: str | None = None

    @property
    def descriptor(self) -> str:
        return f"{self.name}:numeric:{self.scale}"

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(38, self.scale)


@dataclass(frozen=True)
class Temporal:
    name: str
    granularity: str = "date"
    label: str | None = None
    unit: None = None

    @property
    def descriptor(self) -> str:
        return f"{self.name}:temporal:{self.granularity}"

    @property
    def spark(self) -> T.DataType:
        return T.DateType() if self.granularity == "date" else T.TimestampNTZType()


@dataclass(frozen=True)
class Text:
    name: str
    label: str | None = None
    unit: None = None

    @property
    def descriptor(self) -> str:
        return f"{self.name}:string"

    @property
    def spark(self) -> T.DataType:
        return T.StringType()


Col = Numeric | Temporal | Text


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[Col, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise CheckError("manifest.columns_distinct", "a column name occurs twice")
        for c in self.columns:
            if not NAME.fullmatch(c.name):
                raise CheckError("manifest.names", f"{c.name!r} is not a field name")
            if isinstance(c, Numeric) and not 0 <= c.scale <= 38:
                raise CheckError("manifest.scale", f"scale {c.scale} is outside 0..38")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Col:
        """Case-sensitive lookup."""
        for c in self.columns:
            if c.name == name:
                return c
        raise CheckError("schema.fields_exist", f"no field {name!r}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True, {k: v for k in ("unit", "label") if (v := getattr(c, k))}) for c in self.columns])

    def descriptors(self) -> list[str]:
        return [c.descriptor for c in self.columns]

    def typed(self, df: DataFrame) -> DataFrame:
        """The declared columns of ``df``, cast at the boundary; doubles become declared decimals here and nowhere else."""
        out: list[Column] = []
        for c in self.columns:
            meta = {k: v for k in ("unit", "label") if (v := getattr(c, k))}
            out.append(F.col(f"`{c.name}`").cast(c.spark).alias(c.name, metadata=meta))
        return df.select(*out)


def _strict_object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise CheckError("manifest.decode", "a key occurs twice")
    return out


def manifest(text: str) -> TableSchema:
    """A schema from its JSON: ``{"columns": [{"name", "type", "scale" | "granularity", "unit", "label"}]}``; unknown keys fail."""
    try:
        doc = json.loads(text, object_pairs_hook=_strict_object)
        if set(doc) != {"columns"}:
            raise CheckError("manifest.decode", "unknown or missing keys")
        out: list[Col] = []
        for c in doc["columns"]:
            kind, rest = c.get("type"), {k: v for k, v in c.items() if k != "type"}
            make = {"numeric": Numeric, "temporal": Temporal, "string": Text}.get(kind)
            if make is None:
                raise CheckError("manifest.decode", f"unknown type {kind!r}")
            out.append(make(**rest))
    except (json.JSONDecodeError, TypeError, AttributeError) as e:
        raise CheckError("manifest.decode", str(e)) from e
    return TableSchema(tuple(out))
