"""Corpora of pipeline specs: strict admission, plan checks and verification in bulk."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import empty_table_digest, multiset_digest, row_line, table_digest
from ..sources.canonical import lines
from ..sources.store import spread, stored
from ..types import CheckError, TableSchema
from .order import positions
from .pipeline import Channel, Pipeline, checked_literal, kind_of, literal_condition
from .specs import canonical, decode, planned

#: Plans of one shape whose literals are sent to every task; those of more are shuffled with the rows.
FEW = 1 << 16


def admission(specs: DataFrame, schemas: dict[str, TableSchema], hashes: dict[str, str] | None = None) -> DataFrame:
    """``spec_id, stage, check, canonical`` of every spec: the first check that fails and its stage, or NULL.

    Stages: ``decode``, ``binding`` (manifest and declared hash), ``plan``, ``encoding``.  The schemas and hashes are
    the catalogue of datasets that specs can name; without ``hashes`` the column ``source`` of ``specs`` has each one's own.
    Specs are spread over tasks, and equal texts of one Arrow batch are judged once.
    """

    def judge(raw: str | None, source: str | None) -> tuple:
        stage, text = "decode", None
        try:
            doc = decode(raw)
            text, stage = canonical(doc), "binding"
            name = doc["dataset"]["name"]
            if name not in schemas:
                raise CheckError("dataset.manifest_available", name)
            if (hashes.get(name) if hashes is not None else source) != doc["dataset"]["hash"]:
                raise CheckError("dataset.hash_matches_source", name)
            stage = "plan"
            plan = planned(doc, schemas[name])
            stage = "encoding"
            for check, status, message in plan.encoding_results(*[Channel(c["field"], c["type"]) for c in doc["encoding"].values()]):
                if status == "fail":
                    raise CheckError(check, message)
        except CheckError as e:
            return stage, e.check, text
        return None, None, text

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf["raw"], pdf["source"], strict=True))
            told = {pair: judge(*pair) for pair in set(pairs)}
            got = [told[pair] for pair in pairs]
            yield pd.DataFrame({"spec_id": pdf["spec_id"], "stage": [g[0] for g in got], "check": [g[1] for g in got], "canonical": [g[2] for g in got]})

    own = (F.col("source") if hashes is None else F.lit(None)).cast("string").alias("source")
    return spread(specs.select("spec_id", "raw", own), "spec_id").mapInPandas(work, "spec_id string, stage string, check string, canonical string")


def _shape(canonical_text: str, schemas: dict[str, TableSchema]) -> tuple[str, list[str]]:
    """A spec without what its result does not depend on, and with the literals of its first filters taken out."""
    doc = json.loads(canonical_text)
    schema, literals, steps = schemas[doc["dataset"]["name"]], [], []
    for k, op in enumerate(doc["transform"]):
        if op["op"] == "filter" and not any(x["op"] == "aggregate" for x in doc["transform"][:k]):
            known = checked_literal(schema.column(op["field"]), op["cmp"], op["value"])
            if not isinstance(known, bool):  # a literal that no cell can hold stays where it is
                literals.append(known)
                op = {**op, "value": None}
        steps.append(op)
    return json.dumps({"name": doc["dataset"]["name"], "transform": steps}, sort_keys=True), literals


def _identified(df: DataFrame, plan: Pipeline, by: list[str], tables: bool) -> DataFrame:
    """Results' identities by ``by``: multisets, or tables in their order."""
    if not tables:
        return multiset_digest(df, plan.schema, by=by)
    if not by:
        return table_digest(lines(positions(df, plan.order()), plan.schema), plan.schema)
    placed = df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*plan.order())).cast("long"))
    return table_digest(placed.select(*by, "pos", row_line(plan.schema).alias("line")), plan.schema, by=by)


def _of_shape(shape: str, example: list[str], specs: DataFrame, schemas: dict[str, TableSchema], tables: Callable[[str], DataFrame], *, keyed: bool, ordered: bool, few: bool) -> DataFrame:
    """``plan`` with the identities of all specs of one shape, in one job over its dataset."""
    doc = json.loads(shape)
    values = iter(example)
    open_ = [k for k, op in enumerate(doc["transform"]) if op["op"] == "filter" and op["value"] is None]
    for k in open_:
        doc["transform"][k]["value"] = next(values)
    plan = planned(doc, schemas[doc["name"]])
    data = tables(doc["name"]).select(*schemas[doc["name"]].names, *(["__source"] if keyed else []))
    if not open_ and not keyed:
        return _every(_identified(plan.to_df(data), plan, [], ordered), specs)
    given = {k: F.col(f"__l{i}") for i, k in enumerate(open_)}
    literals = specs.select(F.col("plan").alias("__plan"), *([F.col("key").alias("__key")] if keyed else []), *[F.col("literals")[i].alias(f"__l{i}") for i in range(len(open_))])
    meets = [literal_condition(plan.steps[k][2], *plan.steps[k][1][1:], c) for k, c in given.items()]
    meets = reduce(Column.__and__, [*([F.col("__source") == F.col("__key")] if keyed else []), *meets])
    first = next((step for step in plan.steps if step[0] == "aggregate"), None)
    # few literals go to the rows: a shuffle by an equality would deal the rows over as many tasks as it has values
    literals = F.broadcast(literals) if few else literals
    # an aggregate over no rows at all is a row too
    joined = literals.join(data, meets, "left" if first is not None and not first[1] else "inner")
    rest = replace(plan, steps=tuple(step for k, step in enumerate(plan.steps) if k not in given))
    got = _identified(rest.to_df(joined, carry=["__plan"]), plan, ["__plan"], ordered).withColumnRenamed("__plan", "plan")
    none = [F.coalesce(f"lane{k}", F.lit("0")).alias(f"lane{k}") for k in range(4)] if not ordered else [F.coalesce("digest", empty_table_digest(plan.schema)).alias("digest")]
    return specs.select("plan").join(got, "plan", "left").select("plan", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *none)


def _every(one: DataFrame, specs: DataFrame) -> DataFrame:
    """The single row of ``one`` for each of the specs."""
    return specs.select("plan", F.lit(1).alias("__k")).join(F.broadcast(one.withColumn("__k", F.lit(1))), "__k").drop("__k")


def verified_results(
    admitted: DataFrame,
    schemas: dict[str, TableSchema],
    tables: Callable[[str], DataFrame],
    *,
    shapes_at_once: int = 16,
    key: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """``spec_id, n_rows, lane0..3``: the recomputed result's identity for each admitted spec; with ``ordered`` the ``digest`` of
    the table in its order in place of the lanes.

    Specs that differ in spelling, mark or encoding only are computed once.  Specs that differ in the literals of their
    first filters have one shape: their literals are a table, joined to the dataset's rows by the filters (an equality
    makes it a hash join), so that a shape costs one scan however many specs have it.  Only the distinct shapes are on
    the driver, where their plans are made, ``shapes_at_once`` of them in one job.

    ``key`` names a column of ``admitted`` by which a spec's own rows are told apart: ``tables`` then gives many datasets of one name
    in one frame, with the key in ``__source``, and all of them are computed in the shape's one job.
    """
    good = admitted.filter("check is null").select("spec_id", "canonical", (F.col(key) if key else F.lit(None)).cast("string").alias("key"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = {text: _shape(text, schemas) for text in set(pdf["canonical"])}
            made = [told[text] for text in pdf["canonical"]]
            yield pd.DataFrame({"spec_id": pdf["spec_id"], "key": pdf["key"], "shape": [x for x, _ in made], "literals": [x for _, x in made]})

    specs = good.mapInPandas(work, "spec_id string, key string, shape string, literals array<string>")
    specs = stored(specs.withColumn("plan", F.sha2(F.to_json(F.struct("shape", "literals", "key")), 256)))
    plans = stored(specs.groupBy("plan").agg(F.first("shape").alias("shape"), F.first("literals").alias("literals"), F.first("key").alias("key")))
    shapes = plans.groupBy("shape").agg(F.min("literals").alias("example"), F.count("*").alias("n")).orderBy("shape").collect()
    done = [specs.sparkSession.createDataFrame([], "plan string, n_rows long, " + ("digest string" if ordered else "lane0 string, lane1 string, lane2 string, lane3 string"))]
    for at in range(0, len(shapes), shapes_at_once):
        own = [_of_shape(r["shape"], r["example"], plans.filter(F.col("shape") == r["shape"]), schemas, tables, keyed=key is not None, ordered=ordered, few=r["n"] <= FEW) for r in shapes[at : at + shapes_at_once]]
        done.append(stored(reduce(DataFrame.unionByName, own)) if len(shapes) > shapes_at_once else reduce(DataFrame.unionByName, own))
    results = reduce(DataFrame.unionByName, done)
    results = F.broadcast(results) if sum(r["n"] for r in shapes) <= FEW else results
    return specs.select("spec_id", "plan").join(results, "plan").drop("plan")


def lineage(admitted: DataFrame, schemas: dict[str, TableSchema]) -> DataFrame:
    """``spec_id, dataset, field, source, kind`` of every column that an admitted spec plots; ``source`` is null for counts."""

    def plotted(text: str) -> list[tuple]:
        doc = json.loads(text)
        name = doc["dataset"]["name"]
        plan = planned(doc, schemas[name])
        return [(name, field, source, kind_of(plan.schema.column(field))) for field, source in plan.lineage_rows()]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = {text: plotted(text) for text in set(pdf["canonical"])}
            rows = [(spec_id, *row) for spec_id, text in zip(pdf["spec_id"], pdf["canonical"], strict=True) for row in told[text]]
            yield pd.DataFrame(rows, columns=["spec_id", "dataset", "field", "source", "kind"])

    good = admitted.filter("check is null").select("spec_id", "canonical")
    return good.mapInPandas(work, "spec_id string, dataset string, field string, source string, kind string")


def manifests(spark: SparkSession, schemas: dict[str, TableSchema]) -> DataFrame:
    """``dataset, source, unit, label``: a row for each column of the declared data sets."""
    rows = [(name, c.name, c.unit, c.label) for name, schema in schemas.items() for c in schema.columns]
    return spark.createDataFrame(rows, "dataset string, source string, unit string, label string")


def titles(plotted: DataFrame, declared: DataFrame) -> DataFrame:
    """``lineage`` rows with ``title`` (label or name of the source column with its unit; counts have a title of their own) and
    ``unit_missing``, by a join to the manifests."""
    joined = plotted.join(F.broadcast(declared), ["dataset", "source"], "left")
    base = F.coalesce("label", "source")
    title = F.when(F.col("source").isNull(), "Count of records").when(
        F.col("unit").isNotNull(),
        F.concat(base, F.lit(" ("), F.col("unit"), F.lit(")")),
    ).otherwise(base)
    missing = F.col("source").isNotNull() & (F.col("kind") == "numeric") & F.col("unit").isNull()
    return joined.select("spec_id", "dataset", "field", "source", title.alias("title"), missing.alias("unit_missing"))
