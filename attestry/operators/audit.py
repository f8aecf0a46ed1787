"""Audit of archived certificates against all that the ledger stores with them, and replay of them from the ledger alone.

A plot's bundle is its certificate's record and the blobs that its references name by role: ``source`` (the dataset's bytes),
``manifest``, ``spec`` (canonical), ``table`` (header and canonical lines), ``verdict`` and ``versions``.  Contents are joined
once per role; a source, which may be large and belong to many plots, is looked at where it is stored and only its digest
travels.  Everything is one plan over all plots asked for: an audit is a row for each mismatch, a replay a row for each plot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import json_string, stored_table_digest, tagged
from ..sources import scan
from ..sources.store import stored
from ..types import CheckError, TableSchema, manifest
from . import checks, corpus, verify
from .ledger import Ledger, blobs_of

ROLES = ("manifest", "spec", "table", "verdict", "versions")
RECORD_FIELDS = verify.RECORD
RECORD = ", ".join(RECORD_FIELDS)
_SPEC = "dataset struct<name:string,hash:string>, transform array<struct<op:string,field:string,cmp:string,value:string,by:array<struct<field:string,order:string>>>>"
_MANIFEST = "columns array<struct<name:string,type:string,scale:int,granularity:string,unit:string,label:string>>"
_VERDICT = "verified boolean, layer string, results array<struct<check:string,method:string,status:string>>"
#: Records of a CSV text: line ends inside quotes do not end one.
_CSV_RECORD = r'(?:[^"\n]|"(?:[^"]|"")*")+'


def record_text(fields: dict[str, Column]) -> Column:
    """A certificate's record from its fields, as the bytes that are stored."""
    names = [x.split(" ")[0] for x in RECORD_FIELDS]
    kind = "struct<" + ",".join(x.replace(" ", ":", 1) for x in RECORD_FIELDS) + ">"
    return F.to_json(F.struct(*[fields[n].alias(n) for n in names]).cast(kind))


def bundle_tables(plots: DataFrame) -> dict[str, DataFrame]:
    """A ledger batch from ``plot_id, keyid, record, source`` and a text for each of ROLES."""
    # one scan for all roles: plots are as large as what they hold
    each = lambda *roles: F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col("record" if r == "certificate" else r).alias("content")) for r in roles]))
    long = plots.select("plot_id", each("source", *ROLES))
    address = F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256))
    return {
        "blobs": blobs_of(plots.select(each("source", *ROLES, "certificate")), F.col("content"), F.col("role")),
        "plots": plots.select("plot_id", F.concat(F.lit("sha256:"), F.sha2(F.col("record").cast("binary"), 256)).alias("certificate_digest"), F.lit("certificate").alias("certificate_kind"), "keyid"),
        "plot_references": long.select("plot_id", "role", address.alias("blob_digest"), F.col("role").alias("blob_kind")),
    }


def bundles(book: Ledger, ids: DataFrame | None = None) -> DataFrame:
    """``plot_id, keyid, record, source_digest``, a text for each of ROLES and ``intact``: whether all bytes are there and are what
    their addresses say.  ``ids`` (``plot_id``) are the plots asked for."""
    plots, refs = book.table("plots"), book.table("plot_references")
    if ids is not None:
        plots, refs = plots.join(ids.select("plot_id").distinct(), "plot_id", "left_semi"), refs.join(ids.select("plot_id").distinct(), "plot_id", "left_semi")
    good = (F.col("digest") == F.concat(F.lit("sha256:"), F.sha2("content", 256))) & (F.col("size") == F.octet_length("content"))
    blobs = book.table("blobs").select("digest", "kind", good.alias("good"), F.when(F.col("kind") != "source", F.col("content").cast("string")).alias("text"))
    joined = refs.join(blobs, (F.col("blob_digest") == F.col("digest")) & (F.col("blob_kind") == F.col("kind")), "left")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    whole = F.coalesce(F.min(F.coalesce("good", F.lit(False))), F.lit(False)) & (F.count_distinct("role") == len(ROLES) + 1)
    wide = joined.groupBy("plot_id").agg(of("source", "blob_digest").alias("source_digest"), *[of(r, "text").alias(r) for r in ROLES], whole.alias("whole"))
    own = blobs.select(F.col("digest").alias("certificate_digest"), F.col("kind").alias("certificate_kind"), F.col("good").alias("own"), F.col("text").alias("record"))
    both = plots.join(own, ["certificate_digest", "certificate_kind"], "left").join(wide, "plot_id", "left")
    intact = F.coalesce(F.col("own") & F.col("whole"), F.lit(False)).alias("intact")
    return both.select("plot_id", "keyid", "record", "source_digest", *ROLES, intact)


def manifest_header(text: Column) -> Column:
    """The header line of a manifest's JSON."""
    rest = lambda c: F.when(c["type"] == "numeric", F.concat(F.lit(":"), F.coalesce(c["scale"], F.lit(0)).cast("string"))).when(
        c["type"] == "temporal", F.concat(F.lit(":"), F.coalesce(c["granularity"], F.lit("date")))
    ).otherwise("")
    columns = F.transform(F.from_json(text, _MANIFEST)["columns"], lambda c: json_string(F.concat(c["name"], F.lit(":"), c["type"], rest(c))))
    return F.concat(F.lit("["), F.array_join(columns, ","), F.lit("]"))


def _disclosed(spec: Column) -> tuple[Column, Column]:
    """The filters and active sort keys of a spec's text."""
    steps = spec["transform"]
    last = F.coalesce(F.array_max(F.transform(steps, lambda x, i: F.when(x["op"] == "aggregate", i))), F.lit(-1))
    sorts = F.filter(steps, lambda x, i: (x["op"] == "sort") & (i > last))
    filters = F.transform(F.filter(steps, lambda x: x["op"] == "filter"), lambda x: F.struct(x["field"], x["cmp"], x["value"]))
    return filters, F.coalesce(F.try_element_at(sorts, F.lit(-1))["by"], F.array().cast("array<struct<field:string,order:string>>"))


def bundle_audit(found: DataFrame) -> DataFrame:
    """``plot_id, problem``: each way in which a bundle's parts do not belong together.

    The record's bytes are decoded to its fields and must be what these encode to.  Then its digests are held against the
    stored parts, its filters and sorts against the spec, its checks against the verdict and the catalogue, its tools
    against the versions.
    """
    rows = found.withColumn("r", F.from_json("record", RECORD)).withColumn("s", F.from_json("spec", _SPEC)).withColumn("v", F.from_json("verdict", _VERDICT))
    filters, sorts = _disclosed(F.col("s"))
    body = F.substring("table", F.instr("table", "\n") + 1, F.length("table"))
    same = lambda a, b: F.to_json(F.struct(a.alias("x"))) != F.to_json(F.struct(b.alias("x")))
    listed = F.transform("r.checks", lambda x: F.struct(x["id"].alias("check"), x["method"], x["status"]))
    methods = F.create_map(*[F.lit(x) for kv in checks.METHOD_OF.items() for x in kv])
    tests = {
        "blobs": ~F.col("intact"),
        "record.encoding": ~F.to_json("r").eqNullSafe(F.col("record")),
        "record.address": ~F.col("plot_id").eqNullSafe(tagged("certificate", F.col("record"))),
        "dataset_hash": F.col("r.dataset_hash") != F.col("source_digest"),
        "manifest_hash": F.col("r.manifest_hash") != tagged("manifest", manifest_header(F.col("manifest"))),
        "spec_hash": F.col("r.spec_hash") != tagged("spec", F.col("spec")),
        "plotted_table_hash": F.col("r.plotted_table_hash") != stored_table_digest(F.substring_index("table", "\n", 1), body),
        "spec.dataset": F.col("s.dataset.hash") != F.col("r.dataset_hash"),
        "filters": same(F.col("r.filters"), filters),
        "sorts": same(F.col("r.sorts"), sorts),
        "verdict": ~F.col("v.verified") | (F.col("v.layer") != "verify") | F.exists("v.results", lambda x: x["status"] != "pass"),
        "checks": same(listed, F.col("v.results")),
        "methods": F.exists("r.checks", lambda x: ~methods[x["id"]].eqNullSafe(x["method"])),
        "versions": same(F.array_sort(F.map_entries("r.tools")), F.array_sort(F.map_entries(F.from_json("versions", "map<string,string>")))),
    }
    # a part that is missing or can't be read is a problem of whatever needs it
    problems = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in tests.items()]))
    return rows.select("plot_id", F.explode(problems).alias("problem"))


def archived_rows(sources: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """(typed rows with ``__source``, ``__source`` of those with a bad cell, row or header) of stored CSV texts ``__source, content``.

    Texts are parsed once, for both."""
    records = sources.select("__source", F.posexplode(F.regexp_extract_all(F.col("content").cast("string"), F.lit(_CSV_RECORD), F.lit(0))).alias("at", "text"))
    fields = ", ".join([*(f"`{n}` string" for n in schema.names), f"{scan.CORRUPT} string"])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": scan.CORRUPT}
    cells = F.when(F.col("at") > 0, F.from_csv("text", fields, options))
    parsed = stored(records.select("__source", "at", F.when(F.col("at") == 0, F.col("text")).alias("text"), cells.alias("c")))
    raw = parsed.filter("at > 0").select("__source", "c.*")
    bad = scan.cell_failures(raw, schema, "__source").filter("n > 0").select("__source")
    header = ",".join(schema.names)
    headed = parsed.filter("at = 0").filter(F.rtrim("text", F.lit("\r")) != header).select("__source")
    return scan.typed_csv(raw, schema, refuse=False, keep=("__source",)), bad.unionByName(headed).distinct()


def replay(book: Ledger, trusted: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``plot_id, status, drifted`` of archived plots, from the ledger's tables and today's code only.

    ``untrusted_key``; ``integrity_failed``: bytes are not what they should be, or the bundle does not belong together;
    ``recomputation_failed``: the source or the spec is refused today, or what is computed again differs (``drifted`` names the
    digests); ``drift``: all digests are the same but versions differ; or ``exact``.  Plots are computed together, one job
    for each manifest and shape of spec, however many plots and datasets there are.
    """
    found = stored(bundles(book, ids))
    broken = bundle_audit(found).select("plot_id").distinct().withColumn("broken", F.lit(True))
    known = trusted.select("keyid").distinct().withColumn("known", F.lit(True))
    judged = stored(found.join(known, "keyid", "left").join(broken, "plot_id", "left").withColumn("name", F.get_json_object("spec", "$.dataset.name")))
    good = judged.filter("known and broken is null")
    blobs = book.table("blobs").filter("kind = 'source'").select(F.col("digest").alias("__source"), "content")
    fresh = [found.sparkSession.createDataFrame([], "plot_id string, again string, canonical string")]
    for group in good.select("manifest", "name").distinct().collect():  # manifests, not plots
        own = good.filter((F.col("manifest") == group["manifest"]) & (F.col("name") == group["name"]))
        try:
            schema = manifest(group["manifest"])
        except CheckError:
            continue  # nothing is computed again under a manifest that is refused
        rows, bad = archived_rows(blobs.join(own.select(F.col("source_digest").alias("__source")).distinct(), "__source", "left_semi"), schema)
        rows = stored(rows)
        fine = stored(own.join(bad, own["source_digest"] == bad["__source"], "left_anti").select("plot_id", "spec", "source_digest"))
        admitted = corpus.admission(fine.select(F.col("plot_id").alias("spec_id"), F.col("spec").alias("raw"), F.col("source_digest").alias("source")), {group["name"]: schema})
        admitted = stored(admitted.join(fine.select(F.col("plot_id").alias("spec_id"), "source_digest"), "spec_id"))
        made = corpus.verified_results(admitted, {group["name"]: schema}, lambda name, rows=rows: rows, key="source_digest", ordered=True)
        fresh.append(made.join(admitted.select("spec_id", "canonical"), "spec_id").select(F.col("spec_id").alias("plot_id"), F.col("digest").alias("again"), "canonical"))
    both = judged.withColumn("r", F.from_json("record", RECORD)).join(reduce(DataFrame.unionByName, fresh), "plot_id", "left")
    now = verify.tools()
    hashes = F.array_compact(F.array(
        F.when(F.col("r.plotted_table_hash") != F.col("again"), "plotted_table_hash"),
        F.when(F.col("r.spec_hash") != verify.spec_hash(F.col("canonical")), "spec_hash"),
    ))
    current = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
    names = F.array_sort(F.array_union(F.map_keys("r.tools"), F.map_keys(current)))
    versions = F.filter(names, lambda k: ~F.try_element_at("r.tools", k).eqNullSafe(F.try_element_at(current, k)))
    status = (
        F.when(F.col("known").isNull(), "untrusted_key")
        .when(F.col("broken").isNotNull(), "integrity_failed")
        .when(F.col("again").isNull() | (F.size(hashes) > 0), "recomputation_failed")
        .when(F.size(versions) > 0, "drift")
        .otherwise("exact")
    )
    drifted = F.when(status == "drift", F.array_join(versions, ",")).when((status == "recomputation_failed") & F.col("again").isNotNull(), F.array_join(hashes, ",")).otherwise("")
    return both.select("plot_id", status.alias("status"), drifted.alias("drifted"))
