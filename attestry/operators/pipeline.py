"""The closed pipeline: select, filter, group_by + aggregate, sort, over a declared schema.

Every step is checked against the schema as it stands when the step is added; a failed check raises ``CheckError``
with the check's name.  Nothing runs until ``to_df``, which composes one DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from ..functions.exact import mean_half_even
from ..types import NAME, CheckError, Numeric, TableSchema, Temporal
from .order import positions, total_order

COMPARISONS = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
FUNCTIONS = ("sum", "mean", "count", "min", "max")
#: Channel types and the column kinds they admit.
CHANNELS = {"quantitative": {"numeric"}, "temporal": {"temporal"}, "ordinal": {"numeric", "string"}, "nominal": {"numeric", "string"}}
MOST_STEPS, MOST_FIELDS, MOST_KEYS, MOST_LITERAL = 64, 64, 32, 128


@dataclass(frozen=True)
class Measure:
    field: str
    fn: str
    output: str


@dataclass(frozen=True)
class Channel:
    field: str
    type: str


def kind_of(column) -> str:
    return column.descriptor.split(":")[1]


def _distinct(names: Sequence[str], check: str) -> None:
    if len(set(names)) < len(names):
        raise CheckError(check, f"{list(names)} names a field twice")


def checked_literal(column, cmp: str, value) -> bool | str:
    """A literal's canonical text, or the known answer on non-null cells where no cell could hold the value."""
    wrong = lambda m: CheckError("filter.value_type", m)
    if cmp not in COMPARISONS:
        raise CheckError("transform.ops_allowed", f"unknown comparison {cmp!r}")
    if isinstance(value, bool) or not isinstance(value, int | str):
        raise wrong(f"{value!r} is neither an integer nor a text")
    if isinstance(value, int) and not -(2**63) <= value < 2**63 or isinstance(value, str) and len(value) > MOST_LITERAL:
        raise wrong("literal out of bounds")
    if isinstance(column, Numeric):
        try:
            number = Decimal(value)
        except InvalidOperation as e:
            raise wrong(f"{value!r} is not a number") from e
        if not number.is_finite():
            raise wrong(f"{value!r} is not finite")
        sign, digits, exponent = number.as_tuple()
        figures = "".join(map(str, digits)).lstrip("0")
        if not figures:
            return "0"
        if -(exponent + len(figures) - len(figures.rstrip("0"))) > column.scale:
            raise wrong(f"{value!r} has more than {column.scale} decimal places")
        if number.adjusted() > 37 - column.scale:
            above = sign == 0
            return {"eq": False, "ne": True, "lt": above, "le": above, "gt": not above, "ge": not above}[cmp]
        return format(number, "f")
    if not isinstance(value, str):
        raise wrong(f"{column.name} needs a text")
    if isinstance(column, Temporal):
        try:
            parsed = date.fromisoformat(value) if column.granularity == "date" else datetime.fromisoformat(value)
        except ValueError as e:
            raise wrong(f"{value!r} is not an ISO {column.granularity}") from e
        if parsed.isoformat() != value or getattr(parsed, "tzinfo", None) is not None:
            raise wrong(f"{value!r} is not canonical")
    return value


def raw_range(column, cmp: str, value, raw: DataType) -> Column | None:
    """What ``column cmp value`` implies for the float column that the decimal is cast from: a range that Parquet can test.

    A value and its decimal differ by less than one unit of the scale.
    """
    known = checked_literal(column, cmp, value)
    if not isinstance(column, Numeric) or not isinstance(raw, DoubleType | FloatType) or isinstance(known, bool) or cmp == "ne":
        return None
    number = float(known)
    slack = 10.0**-column.scale + abs(number) * 1e-6
    c, out = F.col(f"`{column.name}`"), []
    if cmp in ("eq", "gt", "ge"):
        out.append(c >= number - slack)
    if cmp in ("eq", "lt", "le"):
        out.append(c <= number + slack)
    return out[0] & out[-1]


def literal_condition(column, cmp: str, value, given: Column | None = None) -> Column:
    """``column cmp value`` by exact value; NULL cells drop under every comparison.  ``given`` stands in for the literal."""
    c, known = F.col(column.name), checked_literal(column, cmp, value)
    if given is not None and not isinstance(known, bool):
        return getattr(c, COMPARISONS[cmp])(given.cast(column.spark))
    if isinstance(known, bool):
        return c.isNotNull() & F.lit(known)
    return getattr(c, COMPARISONS[cmp])(F.lit(known).cast(column.spark))


def _measured(m: Measure, i: int, scale: dict[str, int]) -> Column:
    """A measure from the sums, counts and extremes that were aggregated for it."""
    if m.fn == "mean":
        return mean_half_even(F.col(f"__s{i}"), F.col(f"__n{i}"), scale[m.output])
    return {"sum": F.col(f"__s{i}"), "count": F.col(f"__n{i}").cast("decimal(38,0)")}.get(m.fn, F.col(f"__m{i}"))


@dataclass(frozen=True)
class Pipeline:
    source: TableSchema
    schema: TableSchema | None = None
    steps: tuple = ()
    keys: tuple[str, ...] | None = None  # of a group_by that waits for its aggregate
    sorting: tuple[tuple[str, bool], ...] = ()
    lineage: dict | None = None  # plotted column -> source column, or None for a count

    def __post_init__(self) -> None:
        if self.schema is None:
            object.__setattr__(self, "schema", self.source)
            object.__setattr__(self, "lineage", {n: n for n in self.source.names})
        if len(self.steps) > MOST_STEPS:
            raise CheckError("spec.decode", f"more than {MOST_STEPS} steps")

    def _free(self) -> None:
        if self.keys is not None:
            raise CheckError("transform.group_by_placement", "group_by must be followed by an aggregate")

    @staticmethod
    def _bounded(items: Sequence, most: int) -> None:
        if not 1 <= len(items) <= most:
            raise CheckError("spec.decode", f"1 to {most} items are allowed, not {len(items)}")

    def select(self, *fields: str) -> Pipeline:
        self._free()
        self._bounded(fields, MOST_FIELDS)
        _distinct(fields, "select.fields_distinct")
        schema = TableSchema(tuple(self.schema.column(f) for f in fields))
        return replace(self, schema=schema, steps=(*self.steps, ("select", fields)), lineage={f: self.lineage[f] for f in fields})

    def filter(self, field: str, cmp: str, value) -> Pipeline:
        self._free()
        column = self.schema.column(field)
        checked_literal(column, cmp, value)
        return replace(self, steps=(*self.steps, ("filter", (field, cmp, value), column)))

    def group_by(self, *keys: str) -> Pipeline:
        self._free()
        self._bounded(keys, MOST_KEYS)
        _distinct(keys, "group_by.keys_distinct")
        for k in keys:
            self.schema.column(k)
        return replace(self, keys=keys, steps=(*self.steps, ("group_by", keys)))

    def aggregate(self, *measures: tuple[str, str, str] | Measure) -> Pipeline:
        own = tuple(m if isinstance(m, Measure) else Measure(*m) for m in measures)
        self._bounded(own, MOST_KEYS)
        keys = self.keys or ()
        columns = [self.schema.column(k) for k in keys]
        lineage = {k: self.lineage[k] for k in keys}
        for m in own:
            c = self.schema.column(m.field)
            if m.fn not in FUNCTIONS:
                raise CheckError("transform.ops_allowed", f"unknown function {m.fn!r}")
            if m.fn in ("sum", "mean") and not isinstance(c, Numeric):
                raise CheckError("schema.field_types_match", f"{m.fn} needs a numeric field, {m.field} is {kind_of(c)}")
            if not NAME.fullmatch(m.output):
                raise CheckError("spec.decode", f"{m.output!r} is not a field name")
            columns.append(Numeric(m.output, 0) if m.fn == "count" else replace(c, name=m.output))
            lineage[m.output] = None if m.fn == "count" else self.lineage[m.field]
        if len({c.name for c in columns}) < len(columns):
            raise CheckError("aggregate.output_unique", "an output name occurs twice")
        return replace(self, schema=TableSchema(tuple(columns)), keys=None, sorting=(), steps=(*self.steps, ("aggregate", keys, own)), lineage=lineage)

    def sort(self, *by: tuple[str, str]) -> Pipeline:
        self._free()
        self._bounded(by, MOST_KEYS)
        _distinct([f for f, _ in by], "sort.fields_distinct")
        for f, order in by:
            self.schema.column(f)
            if order not in ("ascending", "descending"):
                raise CheckError("spec.decode", f"unknown order {order!r}")
        return replace(self, sorting=tuple((f, order == "descending") for f, order in by), steps=(*self.steps, ("sort", by)))

    def closed(self) -> Pipeline:
        """The finished pipeline: no open group, and the active sort's fields are in the result."""
        self._free()
        for f, _ in self.sorting:
            if f not in self.schema.names:
                raise CheckError("sort.field_in_plotted_table", f"sort field {f!r} is not in the result")
        return self

    def order(self) -> list[Column]:
        """The result's total order: active sort, then every other column."""
        return total_order(self.schema.names, self.sorting)

    def scanned(self, raw: DataFrame) -> DataFrame:
        """``to_df`` over a table whose columns still have their own types: filters on float columns reach its scan as ranges."""
        for step in self.steps:
            if step[0] == "aggregate":
                break
            if step[0] == "filter":
                implied = raw_range(step[2], *step[1][1:], raw.schema[step[2].name].dataType)
                raw = raw if implied is None else raw.filter(implied)
        return self.to_df(self.source.typed(raw))

    def to_df(self, df: DataFrame, *, carry: Sequence[str] = (), given: Mapping[int, Column] | None = None) -> DataFrame:
        """The result's rows (unordered; see ``positions``) over a frame that has the source's columns and types.

        ``carry`` names further columns of ``df`` that all steps keep and group by; ``given`` has columns that stand in for
        the literals of filters, by step.
        """
        self.closed()
        schema = self.source
        for at, step in enumerate(self.steps):
            if step[0] == "select":
                df = df.select(*carry, *step[1])
            elif step[0] == "filter":
                df = df.filter(literal_condition(step[2], *step[1][1:], (given or {}).get(at)))
            elif step[0] == "aggregate":
                _, keys, measures = step
                scale = {m.output: schema.column(m.field).scale for m in measures if isinstance(schema.column(m.field), Numeric)}
                aggs, outs = [], [*[F.col(c) for c in carry], *[F.col(k) for k in keys]]
                for i, m in enumerate(measures):
                    c = F.col(m.field)
                    if m.fn in ("sum", "mean"):
                        aggs.append(F.sum(c).cast(f"decimal(38,{scale[m.output]})").alias(f"__s{i}"))
                    if m.fn in ("mean", "count"):
                        aggs.append(F.count(c).alias(f"__n{i}"))
                    if m.fn in ("min", "max"):
                        aggs.append(getattr(F, m.fn)(c).alias(f"__m{i}"))
                    outs.append(_measured(m, i, scale).alias(m.output))
                by = [*carry, *keys]
                df = (df.groupBy(*by) if by else df).agg(*aggs).select(*outs)
            schema = self._after(schema, step)
        return df

    @staticmethod
    def _after(schema: TableSchema, step: tuple) -> TableSchema:
        if step[0] == "select":
            return TableSchema(tuple(schema.column(f) for f in step[1]))
        if step[0] == "aggregate":
            return TableSchema((
                *(schema.column(k) for k in step[1]),
                *(Numeric(m.output, 0) if m.fn == "count" else replace(schema.column(m.field), name=m.output) for m in step[2]),
            ))
        return schema

    def positioned(self, df: DataFrame, *, rows_at_most: int | None = None) -> DataFrame:
        """The result with ``pos``, its place in the total order."""
        return positions(self.to_df(df), self.order(), rows_at_most=rows_at_most)

    def filters(self) -> list[tuple[str, str, str]]:
        return [(f, cmp, str(v)) for step in self.steps if step[0] == "filter" for f, cmp, v in [step[1]]]

    def encoding_results(self, *channels: Channel) -> list[tuple[str, str, str]]:
        """(check, status, message) of the three encoding checks."""
        out = []
        missing = [c.field for c in channels if c.field not in self.schema.names]
        out.append(("encoding.fields_exist_in_plotted_table", "fail" if missing else "pass", f"absent: {missing}" if missing else "every channel field exists"))
        here = [c for c in channels if c.field in self.schema.names]
        wrong = [c.field for c in here if kind_of(self.schema.column(c.field)) not in CHANNELS.get(c.type, ())]
        out.append(("encoding.axis_types_match_fields", "fail" if wrong else "pass", f"mismatched: {wrong}" if wrong else "every channel type fits its field"))
        bare = [c.field for c in here if c.type == "quantitative" and kind_of(self.schema.column(c.field)) == "numeric" and (s := self.lineage[c.field]) is not None and not self.source.column(s).unit]
        out.append(("label.quantitative_units_present", "fail" if bare else "pass", f"no unit: {bare}" if bare else "every quantity has a unit or is a count"))
        return out

    def axis_title(self, field: str) -> str:
        """Label or name of the source column with its unit; counts have a title of their own."""
        source = self.lineage[field]
        if source is None:
            return "Count of records"
        c = self.source.column(source)
        return f"{c.label or c.name} ({c.unit})" if c.unit else c.label or c.name

    def lineage_rows(self) -> list[tuple[str, str | None]]:
        return [(n, self.lineage[n]) for n in self.schema.names]
