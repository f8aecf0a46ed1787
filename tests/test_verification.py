"""Decoding of specs, staged verification, the ledger's rules, audit and replay, on small frames."""

import copy
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestry.functions import digests
from attestry.operators import audit, checks, corpus, formula, ledger, specs, verify
from attestry.types import CheckError, Numeric, TableSchema, Text

SCHEMA = TableSchema((Text("k"), Numeric("v", 2, "USD")))
DOC = {
    "version": "1",
    "dataset": {"name": "d.csv", "hash": "sha256:" + "a" * 64},
    "transform": [
        {"op": "filter", "field": "v", "cmp": "ge", "value": 0},
        {"op": "group_by", "keys": ["k"]},
        {"op": "aggregate", "measures": [{"field": "v", "fn": "sum", "as": "s"}]},
        {"op": "sort", "by": [{"field": "s", "order": "descending"}]},
    ],
    "mark": "bar",
    "encoding": {"x": {"field": "k", "type": "nominal"}, "y": {"field": "s", "type": "quantitative"}, "color": {"field": "k", "type": "nominal"}},
}
SPEC = json.dumps(DOC)


def _step(**op):
    return json.dumps(DOC | {"transform": [op]})


REFUSED = [
    None,
    "",
    "null",
    "[]",
    '"x"',
    "[" * 3000,
    "{" * 3000,
    '{"a":' * 200 + "1" + "}" * 200,
    SPEC.replace('"value": 0', '"value": ' + "9" * 5000),
    SPEC.replace('"value": 0', '"value": 9223372036854775808'),
    SPEC.replace('"value": 0', '"value": 1e2'),
    SPEC.replace('"value": 0', '"value": true'),
    SPEC.replace('"value": 0', '"value": NaN'),
    SPEC.replace('"value": 0', '"value": "' + "x" * 129 + '"'),
    SPEC.replace('"value": 0', r'"value": "\ud800"'),
    SPEC.replace('"k"', '"\ud800"'),
    SPEC + SPEC,
    SPEC + " x",
    b"\xff" + SPEC.encode(),
    "﻿" + SPEC,
    SPEC.replace('"d.csv"', '"../d.csv"'),
    SPEC.replace('"mark": "bar"', '"mark": "bar", "mark": "bar"'),
    json.dumps(DOC | {"transform": [{"op": "select", "fields": ["k"]}] * 65}),
    _step(op=[]),
    _step(op={}),
    _step(op="pivot"),
    _step(op="select", fields=5),
    _step(op="select", fields="ab"),
    _step(op="select", fields=[["a"]]),
    _step(op="select", fields=[]),
    _step(op="select", fields=["a b"]),
    _step(op="select", fields=["k\n"]),
    _step(op="group_by", keys=3),
    _step(op="aggregate", measures=3),
    _step(op="aggregate", measures=[3]),
    _step(op="aggregate", measures=[{"field": "v", "fn": "sum", "as": 3}]),
    _step(op="aggregate", measures=[{"field": "v", "fn": "median", "as": "m"}]),
    _step(op="sort", by=[{"field": ["a"], "order": "ascending"}]),
    _step(op="sort", by=[{"field": "k", "order": "up"}]),
    _step(op="filter", field="v", cmp=["eq"], value=1),
    _step(op="filter", field="v", cmp="eq", value=[1]),
    _step(op="filter", field="v", cmp="eq"),
    json.dumps(DOC | {"encoding": {"x": DOC["encoding"]["x"]}}),
    json.dumps(DOC | {"encoding": []}),
    json.dumps(DOC | {"dataset": "d.csv"}),
    json.dumps(DOC | {"extra": 1}),
]


@pytest.mark.parametrize("raw", REFUSED, ids=range(len(REFUSED)))
def test_every_text_has_an_answer(raw):
    with pytest.raises(CheckError) as e:
        specs.decode(raw)
    assert e.value.check == "spec.decode"


def test_spellings_of_one_spec():
    want = specs.canonical(specs.decode(SPEC))
    for raw in (SPEC.encode(), bytearray(SPEC.encode()), json.dumps(DOC, indent=3), f" \n{SPEC}\t", SPEC.replace('"k"', r'"k"')):
        assert specs.canonical(specs.decode(raw)) == want
    assert specs.decode(_step(op="filter", field="v", cmp="eq", value=-(2**63)))


def test_mutated_specs_raise_nothing_else():
    """Texts, tokens and values at random: decoding and planning give a spec, a plan or a named check."""
    rng = random.Random(11)
    values = [None, True, 0, -1, 2**70, 1.5, "", "k", "v", "1e999999999999999999", "1e-400", "NaN", "٣", "2024-01-01", [], {}, ["k"], {"op": "sort"}, "\x00"]
    outcomes = set()
    for _ in range(6000):
        raw = SPEC
        if rng.random() < 0.5:
            doc = json.loads(raw)
            for _ in range(rng.randrange(1, 4)):
                at = doc
                while isinstance(at, dict | list) and at:
                    key = rng.choice(list(at) if isinstance(at, dict) else range(len(at)))
                    if not isinstance(at[key], dict | list) or not at[key] or rng.random() < 0.25:
                        at[key] = copy.deepcopy(rng.choice(values))
                        break
                    at = at[key]
            raw = json.dumps(doc)
        else:
            for _ in range(rng.randrange(1, 5)):
                i, j = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
                raw = rng.choice([raw[:i] + raw[i + 1 :], raw[:i] + rng.choice('{}[]",:0 \\e') + raw[i:], raw[:i] + raw[j:] if j - i < 20 else raw, raw[:j] + raw[i:j] + raw[j:]])
        try:
            doc = specs.decode(raw)
            assert specs.decode(specs.canonical(doc)) == doc
            specs.planned(doc, SCHEMA)
            outcomes.add(None)
        except CheckError as e:
            outcomes.add(e.check)
    assert {None, "spec.decode", "schema.fields_exist", "filter.value_type"} <= outcomes


def test_bad_specs_are_rows(spark):
    texts = [(str(i), x) for i, x in enumerate(REFUSED) if x is None or isinstance(x, str) and not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    rows = corpus.admission(spark.createDataFrame([*texts, ("good", SPEC)], "spec_id string, raw string"), {"d.csv": SCHEMA}, {"d.csv": DOC["dataset"]["hash"]}).collect()
    assert len(rows) == len(texts) + 1
    assert all((r.stage, r.check) == (("decode", "spec.decode") if r.spec_id != "good" else (None, None)) for r in rows)


@pytest.fixture
def source(spark):
    table = SCHEMA.typed(spark.createDataFrame([("a", 1.0), ("b", 2.5), ("a", 4.0), (None, 3.0), ("c", -1.0)], "k string, v double"))
    return verify.Source(SCHEMA, table, DOC["dataset"]["hash"])


def test_certificate_of_a_spec(spark, source):
    run = verify.verify(spark, SPEC, {"d.csv": source})
    rows = run.checks.orderBy("place").collect()
    assert run.passed and {r.status for r in rows} == {"pass"}
    (c,) = run.certificate.collect()
    assert [x.id for x in c.checks] == [r.check for r in rows]
    assert [tuple(x) for x in c.filters] == [("v", "ge", "0")] and [tuple(x) for x in c.sorts] == [("s", "descending")]
    assert c.spec_hash == spark.range(1).select(verify.spec_hash(F.lit(specs.canonical(DOC)))).first()[0]
    assert [(r.k, r.s) for r in run.result.orderBy("pos").collect()] == [("a", Decimal("5.00")), (None, Decimal("3.00")), ("b", Decimal("2.50"))]
    assert {"encoding.legend_domain_exact", "scale.bar_zero", "sort.canonical_order", "render.float64_fidelity", "filter.value_type"} <= {r.check for r in rows}
    assert not {"data.numeric_value", "select.fields_distinct"} & {r.check for r in rows}  # nothing was there to be put to them


@pytest.mark.parametrize(
    "fault,check,last",
    [
        ("spec", "spec.decode", "decode"),
        ("name", "dataset.manifest_available", "binding"),
        ("digest", "dataset.hash_matches_source", "binding"),
        ("two digests", "dataset.hash_matches_source", "binding"),
        ("no digest", "dataset.hash_matches_source", "binding"),
        ("columns", "resource.manifest_columns", "binding"),
        ("cells", "data.numeric_value", "source"),
        ("rows", "resource.source_rows", "source"),
        ("field", "schema.fields_exist", "plan"),
        ("plotted", "resource.plotted_cells", "result"),
        ("unit", "label.quantitative_units_present", "encoding"),
        ("render", "resource.render_rows", "rendering"),
        ("legend", "encoding.legend_domain_exact", "rendering"),
        ("baseline", "scale.bar_zero", "rendering"),
        ("double", "render.float64_fidelity", "rendering"),
    ],
)
def test_the_first_failing_stage_is_the_last(spark, source, fault, check, last):
    raw, limits, said = SPEC, dict(checks.LIMITS), {}
    own = vars(source) | {}
    sources = {"d.csv": source}
    match fault:
        case "spec":
            raw = SPEC[1:]
        case "name":
            sources = {"e.csv": source}
        case "digest":
            own["digest"] = "sha256:" + "b" * 64
        case "two digests":
            own["digest"] = spark.createDataFrame([(source.digest,)] * 2, "sha256 string")
        case "no digest":
            own["digest"] = spark.createDataFrame([], "sha256 string")
        case "columns":
            limits["manifest_columns"] = 1
        case "cells":
            own["failures"] = spark.createDataFrame([("data.numeric_value", 0), ("data.numeric_value", 2)], "check string, n long")
        case "rows":
            limits["source_rows"] = 4
        case "field":
            raw = SPEC.replace('"keys": ["k"]', '"keys": ["q"]')
        case "plotted":
            limits["plotted_cells"] = 5
        case "unit":
            own["schema"] = TableSchema((Text("k"), Numeric("v", 2)))
        case "render":
            limits["render_rows"] = 2
        case "legend":
            said["legend"] = spark.createDataFrame([("a",), ("z",)], "value string")
        case "baseline":
            said["baseline"] = "0.5"
        case "double":
            own["table"] = source.table.withColumn("v", F.lit("12345678901234567890.11").cast("decimal(38,2)"))
    if fault != "name":
        sources = {"d.csv": verify.Source(**own)}
    run = verify.verify(spark, raw, sources, limits=limits, **said)
    rows = run.checks.orderBy("place").collect()
    assert not run.passed and run.certificate.count() == 0
    assert check in {r.check for r in rows if r.status == "fail"}
    assert {r.stage for r in rows if r.status == "fail"} == {last} == {rows[-1].stage}
    assert set(checks.METHOD_OF) >= {r.check for r in rows}


def test_formulas_that_a_double_does_not_hold(spark):
    rows = [
        (1, "x*12345678901234567890.11", 2, None),
        (2, "x", 2, None),
        (3, "x", 2, "sha256:other"),
        (4, "x*1" + "0" * 31, 0, None),
    ]
    fs = spark.createDataFrame(
        [(i, f, Decimal(0), Decimal(1), 3, 1, y, d) for i, f, y, d in rows],
        "formula_id long, formula string, start decimal(18,6), stop decimal(18,6), samples int, x_scale int, y_scale int, declared string",
    )
    got = {r.formula_id: r for r in verify.certified_formulas(fs).collect()}
    assert {i: r.check for i, r in got.items()} == {1: "render.float64_fidelity", 2: None, 3: "formula.hash_matches_source", 4: "formula.values_bounded"}
    assert all((r.certificate_id is None) == (r.check is not None) for r in got.values())
    own = got[2]
    assert {x.status for x in own.checks} == {"pass"} and [x.id for x in own.checks][-len(checks.SAMPLED) :] == checks.SAMPLED
    right = fs.filter("formula_id = 2").withColumn("declared", F.lit(own.formula_hash))
    assert verify.certified_formulas(right).first().certificate_id == own.certificate_id
    assert formula.LIMITS["formula_samples"] >= 3


def _blobs(spark, *contents):
    return ledger.blobs_of(spark.createDataFrame([(x,) for x in contents], "c string"), F.col("c"), F.lit("text"))


def test_a_batch_that_contradicts_itself(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    keys = spark.createDataFrame([("k", "sha256:1", "a"), ("k", "sha256:2", "a")], ledger.SHAPES["keys"])
    with pytest.raises(ValueError, match="two different rows"):
        book.publish({"blobs": _blobs(spark, "x"), "keys": keys})
    null = spark.createDataFrame([("k", None, "a"), ("k", "null", "a")], ledger.SHAPES["keys"])
    with pytest.raises(ValueError, match="two different rows"):
        book.publish({"keys": null})
    assert {r.table: r.n_rows for r in book.stats().collect()} == dict.fromkeys(ledger.SHAPES, 0)  # nothing of it is stored
    book.publish({"keys": keys.limit(1).unionByName(keys.limit(1))})  # the same row twice is one
    assert book.table("keys").count() == 1
    with pytest.raises(ValueError, match="address or size"):
        book.publish({"blobs": _blobs(spark, "x").withColumn("content", F.lit("y").cast("binary"))})
    with pytest.raises(ValueError, match="different row is stored"):
        book.publish({"keys": keys.filter("public_key_digest = 'sha256:2'")})


def test_publishing_reads_only_the_folders_of_its_keys(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    book = ledger.Ledger(spark, str(tmp_path / "l"), digits=2)
    book.publish({"blobs": _blobs(spark, *[f"text {i}" for i in range(300)])})
    one = _blobs(spark, "text 7").withColumn("prefix", ledger.prefix_of(ledger.KEYS["blobs"], 2)).first()["prefix"]
    plan = book._held("blobs", [one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert one in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert 0 < book._held("blobs", [one]).count() < 20
    book.publish({"blobs": _blobs(spark, "text 7", "text new")})
    assert book.table("blobs").count() == 301


def test_stored_tables_have_the_digest_of_tables(spark, monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 3)
    for n in (0, 1, 3, 4, 9, 10, 30):
        rows = spark.range(1, n + 1).select(F.col("id").alias("pos"), F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")).alias("line"))
        want = digests.table_digest(rows, SCHEMA).first()
        body = "".join(f"[{i}]\n" for i in range(1, n + 1))
        got = spark.range(1).select(digests.stored_table_digest(F.lit(digests.header_line(SCHEMA)), F.lit(body))).first()[0]
        assert (want.n_rows, want.digest) == (n, got)
        if not n:
            assert got == spark.range(1).select(digests.empty_table_digest(SCHEMA)).first()[0]


def test_archived_csv(spark):
    texts = [("good", 'k,v\na,1.00\n"b\n""c""",2\r\n,\n'), ("wide", "k,v\na,1,2\n"), ("short", "k,v\na\n"), ("cell", "k,v\na,x\n"), ("header", "v,k\n1,a\n"), ("none", "k,v\n")]
    rows, bad = audit.archived_rows(spark.createDataFrame(texts, "__source string, content string"), SCHEMA)
    assert {r["__source"] for r in bad.collect()} == {"wide", "short", "cell", "header"}
    good = rows.filter("__source = 'good'").collect()
    assert [(r.k, r.v) for r in good][:2] == [("a", Decimal("1.00")), ('b\n"c"', Decimal("2.00"))] or len(good) == 3
