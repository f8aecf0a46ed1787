"""Verification of a spec or of many formulas: staged checks that run, the recomputed result, and a certificate.

A spec's stages are decoding, binding, source, plan, result, encoding and rendering.  Every check of a stage is put to what it
judges and gives a row; the first stage with a failure is the last.  A check that nothing was there to be put to (a legend
where no colour is, cells that no scan counted) gives no row, and a row says ``pass`` only where the test was made; only
the affirmations of the catalogue (``checks.BY_CONSTRUCTION``) hold by how a result is made, and say so by their method.
The result is computed once and stored; its cells are measured by the job that stores it.  Only counts reach the
driver.  A certificate is a row that exists only where every check passes, and its digests, filters and sorts are those of
the spec's own text.
"""

from __future__ import annotations

import platform
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.digests import VERSION, header_line, table_digest, tagged
from ..functions.exact import float64_faithful
from ..sources import canonical
from ..sources.store import stored
from ..types import CheckError, Numeric, TableSchema
from . import checks, formula, specs
from .order import category_domain, domain_difference, inversions
from .pipeline import Channel, Pipeline


def tools() -> dict[str, str]:
    """The versions that a result depends on."""
    return {
        "attestry": __version__,
        "canonical_form": VERSION,
        "pyspark": pyspark.__version__,
        "python": platform.python_version(),
        "unicode": unicodedata.unidata_version,
    }


def manifest_hash(schema: TableSchema) -> Column:
    return tagged("manifest", F.lit(header_line(schema)))


def spec_hash(text: Column) -> Column:
    return tagged("spec", text)


#: The fields of a certificate's record, in the order in which they are encoded.
RECORD = (
    "version string",
    "dataset_hash string",
    "spec_hash string",
    "manifest_hash string",
    "plotted_table_hash string",
    "checks array<struct<id:string,method:string,status:string>>",
    "filters array<struct<field:string,cmp:string,value:string>>",
    "sorts array<struct<field:string,order:string>>",
    "tools map<string,string>",
)
CERTIFICATE = ", ".join(("certificate_id string", *RECORD))
REPORT = f"place int, stage string, {checks.SHAPE}"


@dataclass(frozen=True)
class Source:
    """A dataset that specs can name: ``table`` has the schema's columns and types, ``digest`` is its own (a text, or a frame of
    one row ``sha256``), ``failures`` (``check, n``) what a scan counted of it."""

    schema: TableSchema
    table: DataFrame
    digest: str | DataFrame
    failures: DataFrame | None = None


@dataclass(frozen=True)
class Run:
    """What a verification gives: ``checks`` (place, stage, check, method, status, severity, message), ``result`` (with ``pos``;
    None if a stage before it failed), ``certificate`` (a row or none), and ``passed``."""

    checks: DataFrame
    result: DataFrame | None
    certificate: DataFrame
    passed: bool


@dataclass
class _Report:
    rows: list[tuple] = field(default_factory=list)
    failed: bool = False

    def add(self, stage: str, check: str, bad: int | bool, message: str) -> None:
        self.failed |= bool(bad)
        self.rows.append((len(self.rows), stage, *checks.result(check, "fail" if bad else "pass", message)))

    def most(self, stage: str, check: str, n: int, limit: int) -> None:
        self.add(stage, check, n > limit, f"{n}, limit {limit}")

    def refused(self, stage: str, e: CheckError) -> None:
        self.add(stage, e.check, True, e.message)


def _tools() -> Column:
    return F.create_map(*[F.lit(x) for kv in tools().items() for x in kv])


def _disclosed(rows: Sequence[Sequence[str]], fields: Sequence[str]) -> Column:
    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.array(*[F.struct(*[F.lit(x).alias(f) for x, f in zip(row, fields, strict=True)]) for row in rows]).cast(kind)


def _of(digest: str | DataFrame) -> list[str | None]:
    """The source's own digest; more or fewer than one are not one."""
    return [digest] if isinstance(digest, str) else [r["sha256"] for r in digest.select("sha256").limit(2).collect()]


def _sourced(report: _Report, source: Source, limits: Mapping[str, int]) -> None:
    if source.failures is not None:
        found = {r["check"]: r["n"] for r in source.failures.groupBy("check").agg(F.sum("n").alias("n")).collect()}
        for check in ("data.charset", "data.csv_syntax", "data.header", "data.row_width", "data.numeric_value", "data.temporal_value"):
            n = found.get(check, 0)
            report.add("source", check, n > 0, f"{n} failing")
    n, width = source.table.count(), len(source.schema.columns)
    report.most("source", "resource.source_rows", n, limits["source_rows"])
    report.most("source", "resource.source_cells", n * width, limits["source_cells"])


def _computed(plan: Pipeline, source: Source, channels: Mapping[str, Channel]) -> tuple[DataFrame, dict]:
    """The positioned result, stored, and what the job that stored it counted: rows, and by channel what a double loses and the least value."""
    shown = {k: plan.schema.column(c.field) for k, c in channels.items() if c.field in plan.schema.names}
    drawn = {k: c for k, c in shown.items() if isinstance(c, Numeric) and channels[k].type == "quantitative"}
    measures = [F.count(F.lit(1)).alias("rows")]
    for k, c in drawn.items():
        measures += [F.count_if(~float64_faithful(F.col(c.name), c.scale)).alias(f"lost_{k}"), F.min(c.name).alias(f"least_{k}")]
    seen = Observation("result")
    result = stored(plan.positioned(source.table).observe(seen, *measures))
    return result, seen.get


def _rendered(report: _Report, plan: Pipeline, result: DataFrame, seen: Mapping, mark: str, channels: Mapping[str, Channel], legend: DataFrame | None, baseline: str, limits: Mapping[str, int]) -> None:
    report.most("rendering", "resource.render_rows", seen["rows"], limits["render_rows"])
    if plan.sorting:
        n = inversions(result, "pos", plan.sorting).count()
        report.add("rendering", "sort.canonical_order", n > 0, f"{n} failing")
    if "color" in channels:
        shown = result.select(F.col(channels["color"].field).alias("value")).filter("value is not null")
        n = domain_difference(shown, legend if legend is not None else category_domain(result, channels["color"].field, "pos")).count()
        report.add("rendering", "encoding.legend_domain_exact", n > 0, f"{n} values on one side only")
    if mark == "bar" and "least_y" in seen:
        low = F.lit(baseline).cast("decimal(38,12)")
        least = result.sparkSession.range(1).select(F.lit(seen["least_y"]).alias("least"))
        bad = not checks.zero_baseline(least, "least", low).filter("status = 'fail'").isEmpty()
        report.add("rendering", "scale.bar_zero", bad, f"bars begin at {baseline}, the least value is {seen['least_y']}")
    lost = {k: n for k in channels if (n := seen.get(f"lost_{k}")) is not None}
    if lost:
        report.add("rendering", "render.float64_fidelity", sum(lost.values()), f"{sum(lost.values())} cells that a double does not hold")


def verify(
    spark: SparkSession,
    spec: object,
    sources: Mapping[str, Source],
    *,
    limits: Mapping[str, int] = checks.LIMITS,
    legend: DataFrame | None = None,
    baseline: str = "0",
) -> Run:
    """Verify a spec (its raw text) over the dataset of ``sources`` that it names, recompute its result and certify it.

    ``legend`` (``value``) and ``baseline`` are what a drawing declares: the values of its colours, and where its bars begin;
    by default both are derived from the result.
    """
    report, result = _Report(), None

    def done(certificate: DataFrame | None = None) -> Run:
        made = certificate if certificate is not None else spark.createDataFrame([], CERTIFICATE)
        return Run(spark.createDataFrame(report.rows, REPORT), result, made, not report.failed)

    try:
        doc = specs.decode(spec)
    except CheckError as e:
        report.refused("decode", e)
        return done()
    report.add("decode", "spec.decode", False, "decoded")
    name = doc["dataset"]["name"]
    report.add("binding", "dataset.manifest_available", name not in sources, name)
    if report.failed:
        return done()
    source = sources[name]
    report.most("binding", "resource.manifest_columns", len(source.schema.columns), limits["manifest_columns"])
    own = _of(source.digest)
    report.add("binding", "dataset.hash_matches_source", own != [doc["dataset"]["hash"]], f"declared {doc['dataset']['hash']}")
    if report.failed:
        return done()
    _sourced(report, source, limits)
    if report.failed:
        return done()
    try:
        plan = specs.planned(doc, source.schema)
    except CheckError as e:
        report.refused("plan", e)
        return done()
    for check in specs.plan_checks(doc):
        report.add("plan", check, False, "holds for every step")
    channels = {k: Channel(c["field"], c["type"]) for k, c in doc["encoding"].items()}
    result, seen = _computed(plan, source, channels)
    report.most("result", "resource.plotted_cells", seen["rows"] * len(plan.schema.columns), limits["plotted_cells"])
    for check in checks.BY_CONSTRUCTION:
        declared = check != "transform.filters_declared" or plan.filters() == specs.disclosures(doc)[0]
        report.add("result", check, not declared, "holds by construction")
    if report.failed:
        return done()
    for check, status, message in plan.encoding_results(*channels.values()):
        report.add("encoding", check, status == "fail", message)
    if report.failed:
        return done()
    _rendered(report, plan, result, seen, doc["mark"], channels, legend, baseline, limits)
    if report.failed:
        return done()
    filters, sorts = specs.disclosures(doc)
    listed = F.array(*[F.struct(F.lit(r[2]).alias("id"), F.lit(r[3]).alias("method"), F.lit(r[4]).alias("status")) for r in report.rows])
    record = {
        "version": F.lit(VERSION),
        "dataset_hash": F.lit(own[0]),
        "spec_hash": spec_hash(F.lit(specs.canonical(doc))),
        "manifest_hash": manifest_hash(source.schema),
        "plotted_table_hash": F.col("digest"),
        "checks": listed,
        "filters": _disclosed(filters, ("field", "cmp", "value")),
        "sorts": _disclosed(sorts, ("field", "order")),
        "tools": _tools(),
    }
    table = table_digest(canonical.lines(result, plan.schema), plan.schema).select(*[c.alias(k) for k, c in record.items()])
    return done(table.select(tagged("certificate", F.to_json(F.struct(*record))).alias("certificate_id"), *record))


#: What admission tests of a formula, all of it where it finds nothing.
_ADMITTED = (
    *[f"resource.{k}" for k in formula.LIMITS if k not in ("exponent", "formula_intermediate_bits")],
    *[f"formula.{k}" for k in ("grammar_allowed", "functions_allowed", "names_allowed", "exponents_bounded", "domain_ordered", "domain_bounded")],
)


def certified_formulas(formulas: DataFrame, limits: formula.Limits = formula.LIMITS) -> DataFrame:
    """``formula_id, check, certificate_id, formula_hash, table_hash, n_samples, checks, tools`` of every formula.

    ``check`` is the first that fails, and then there is no certificate.  ``checks`` lists what was tested of each formula:
    what admission tests, then what its sampled points were put to (``checks.formula_results``).  Where ``formulas`` has a
    column ``declared``, a formula whose own hash differs fails.  A formula's samples (as many as the ceiling admits) are
    digested in order.
    """
    admitted = stored(formula.admission(formulas, limits=limits))
    good = formulas.join(admitted.filter("check is null").select("formula_id"), "formula_id")
    values = stored(formula.evaluated(formula.grid(good), good, limits))
    hashes = formula.fingerprints(formulas, admitted).withColumnRenamed("fingerprint", "formula_hash")
    declared = F.col("declared") if "declared" in formulas.columns else F.lit(None).cast("string")
    expected = good.join(hashes, "formula_id").select("formula_id", "samples", "y_scale", (declared.isNull() | (declared == F.col("formula_hash"))).alias("own_hash"))
    found = checks.formula_results(values, expected)
    line = F.concat(F.lit("["), F.col("x").cast("string"), F.lit(","), F.coalesce(F.col("y").cast("string"), F.lit("null")), F.lit("]\n"))
    digested = values.groupBy("formula_id").agg(
        F.count("*").alias("n_samples"),
        tagged(
            "table",
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), ""),
        ).alias("table_hash"),
    )
    entry = F.struct("place", F.col("check").alias("id"), "method", "status")
    sampled = found.groupBy("formula_id").agg(F.array_sort(F.collect_list(entry)).alias("sampled"), F.min_by("check", F.when(F.col("status") == "fail", F.col("place"))).alias("failing"))
    kind = "array<struct<id:string,method:string,status:string>>"
    tested = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(checks.METHOD_OF[c]).alias("method"), F.lit("pass").alias("status")) for c in _ADMITTED]).cast(kind)
    listed = F.concat(tested, F.transform("sampled", lambda x: x.dropFields("place")).cast(kind))
    joined = admitted.join(digested, "formula_id", "left").join(sampled, "formula_id", "left").join(hashes, "formula_id", "left")
    check = F.coalesce("check", "failing")
    record = F.struct("formula_hash", "table_hash", "n_samples", listed.alias("checks"), _tools().alias("tools"))
    out = joined.select("formula_id", check.alias("check"), record.alias("r"))
    fine = F.col("check").isNull()
    return out.select(
        "formula_id",
        "check",
        F.when(fine, tagged("certificate", F.to_json("r"))).alias("certificate_id"),
        *[F.when(fine, F.col(f"r.{c}")).alias(c) for c in ("formula_hash", "table_hash", "n_samples", "checks", "tools")],
    )
