"""Ledger, replies, formulas, spec corpora and streams on small frames."""

import json
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from attestry.functions import digests, text
from attestry.operators import checks, corpus, formula, ledger, replies
from attestry.sources import scan
from attestry.streaming import streams
from attestry.types import CheckError, Numeric, TableSchema, Text


def blob(spark, *texts):
    return ledger.blobs_of(spark.createDataFrame([(x,) for x in texts], "t string"), F.col("t"), F.lit("raw"))


def test_ledger_publishes_once_and_refuses_changes(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    b = blob(spark, "one", "two", "one")
    digest = {r.content.decode(): r.digest for r in b.collect()}
    keys = spark.createDataFrame([("k1", digest["one"], "raw")], ledger.SHAPES["keys"])
    attempts = spark.createDataFrame(
        [("a1", digest["two"], "raw", "k1", None, "0" * 32, "2024-02-03T04:05:06.000007Z", "propose_spec", 404, "dataset_not_found")],
        ledger.SHAPES["attempts"],
    )
    for _ in range(2):
        book.publish({"blobs": b, "keys": keys, "attempts": attempts})
    assert {r.table: r.n_rows for r in book.stats().collect()} == {
        "blobs": 2,
        "keys": 1,
        "plots": 0,
        "specs": 0,
        "plot_references": 0,
        "attempt_references": 0,
        "attempts": 1,
    }
    lost, damaged = book.audit()
    assert lost.count() == 0 and damaged.count() == 0
    with pytest.raises(ValueError, match="different row"):
        book.publish({"keys": keys.withColumn("public_key_kind", F.lit("other"))})
    with pytest.raises(ValueError, match="quota"):
        book.publish({"blobs": blob(spark, "x" * 100)}, quota=50)
    book.publish({"attempts": spark.createDataFrame(
        [("a2", "sha256:none", "raw", "k9", "p9", "x", "y", "propose_spec", 200, "verified")],
        ledger.SHAPES["attempts"],
    )})
    assert {(r.attempt_id, r.rule) for r in book.attempt_violations().collect()} == {
        ("a2", "nonce_format"),
        ("a2", "time_format"),
        ("a2", "roles_match_outcome"),
    }
    assert book.blob(digest["one"], "raw").first().content == b"one" and book.roles("p9").count() == 0
    assert sorted(r.source for r in book.audit()[0].collect()) == ["attempts.envelope_digest", "attempts.keyid", "attempts.plot_id"]


def test_blob_integrity(spark):
    b = blob(spark, "one").withColumn("size", F.lit(9).cast("long")).withColumn("content", F.lit(b"other"))
    assert {r.problem for r in ledger.blob_integrity(b).collect()} == {"digest", "size"}


def test_audit_documents_hide_content(spark):
    b = blob(spark, "one")
    refs = b.select(F.lit("a").alias("attempt_id"), F.lit("r").alias("role"), F.col("digest").alias("blob_digest"), F.col("kind").alias("blob_kind"))
    a = spark.createDataFrame([("a",), ("b",)], "attempt_id string")
    hidden = {r.attempt_id: r.artifacts for r in ledger.audit_documents(a, refs, b).collect()}
    assert hidden["a"][0].content is None and hidden["b"] is None
    assert ledger.audit_documents(a, refs, b, reveal=True).filter("attempt_id = 'a'").first().artifacts[0].content == '"one"'
    odd = spark.createDataFrame([(b"a\x1b[2J\n\x7f\xc2\x9b\"",), (b"\xff\x00",)], "c binary").select(text.safe_bytes(F.col("c")).alias("t"))
    assert [r.t for r in odd.collect()] == ['"a\\u001B[2J\\n\\u007f\\u009b\\""', "/wA="]


def test_rates_and_buckets(spark):
    d = spark.createDataFrame(
        [
            ("a", True, "verified", "other", True, True, True),
            ("a", True, "schema", "empty", False, False, False),
            ("b", False, "off_request", None, None, None, None),
        ],
        "category string, ok boolean, bucket string, shape string, json_valid boolean, json_object boolean, defenced_valid boolean",
    )
    got = {(r.scope, r.category): r for r in replies.tallies(d).collect()}
    assert got["all", None].n == 2 and got["all", None].off_request == 1 and got["category", "a"].verified_rate == 0.5 and got["category", "b"].verified_rate == 0.0


def test_guard_touches_last_assistant_only(spark):
    chart = "```\nimport plotly\n```"
    m = spark.createDataFrame(
        [(1, 0, "user", chart), (1, 1, "assistant", chart), (2, 0, "assistant", chart), (2, 1, "user", chart), (3, 0, "assistant", "hi")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r.conv_id, r.turn): r.text == replies.NOTICE for r in replies.guard_last(m).collect()}
    assert got == {(1, 0): False, (1, 1): True, (2, 0): False, (2, 1): False, (3, 0): False}


def test_formula_grammar():
    p = formula.parse
    assert formula.printed(p("-x**2 + 03*x - .5".replace(".5", "0.5"))) == "(- (+ (neg (pow x 2)) (* 3 x)) 1/2)"
    assert formula.value(p("2 * -x ** -2"), {"x": Fraction(4)}) == Fraction(-1, 8)
    for bad, check in {
        "a": "formula.names_allowed",
        "sin(x)": "formula.functions_allowed",
        "x**2**3": "formula.grammar_allowed",
        "1.": "formula.grammar_allowed",
        ".5": "formula.grammar_allowed",
        "1e3": "formula.grammar_allowed",
        "x**x": "formula.grammar_allowed",
        "x**1.5": "formula.grammar_allowed",
        "x**--2": "formula.grammar_allowed",
        "x if x else x": "formula.grammar_allowed",
        "x//2": "formula.grammar_allowed",
        "": "formula.grammar_allowed",
        "abs(x, x)": "formula.grammar_allowed",
        "x**99": "formula.exponents_bounded",
        "(" * 40 + "x" + ")" * 40: "resource.formula_paren_depth",
        "1" * 99: "resource.formula_digits",
        "x+" * 600 + "x": "resource.formula_bytes",
    }.items():
        with pytest.raises(formula.Refused) as e:
            p(bad)
        assert e.value.check == check, bad


def test_formula_tables(spark):
    fs = spark.createDataFrame(
        [
            (1, "1/(1 + x*x)", Decimal("-1"), Decimal("1"), 5, 1, 3),
            (2, "1/x", Decimal("-1"), Decimal("1"), 3, 0, 2),
            (3, "abs(x)", Decimal("0"), Decimal("1"), 4, 2, 1),
        ],
        "formula_id long, formula string, start decimal(18,6), stop decimal(18,6), samples int, x_scale int, y_scale int",
    )
    got = {(r.formula_id, r.i): (r.x, r.y, r.status) for r in formula.evaluated(formula.grid(fs), fs).collect()}
    for (f, i), (x, y, s) in got.items():
        _, _, a, b, n, xs, ys = next(r for r in fs.collect() if r.formula_id == f)
        wx = Fraction(round((Fraction(a) + Fraction(i, n - 1) * (Fraction(b) - Fraction(a))) * 10**xs), 10**xs)
        assert Fraction(x) == wx
        if f == 2 and wx == 0:
            assert s == "formula.values_defined" and y is None
        else:
            wy = {1: lambda v: 1 / (1 + v * v), 2: lambda v: 1 / v, 3: abs}[f](wx)
            assert Fraction(y) == Fraction(round(wy * 10**ys), 10**ys) and s == "ok"
    assert formula.collisions(formula.grid(fs.withColumn("x_scale", F.lit(0)).filter("formula_id = 3"))).count() == 2


SPEC = '{"version":"1","dataset":{"name":"d.csv","hash":"sha256:%s"},"transform":[{"op":"group_by","keys":["k"]},{"op":"aggregate","measures":[{"field":"v","fn":"sum","as":"s"}]}],"mark":"bar","encoding":{"x":{"field":"k","type":"nominal"},"y":{"field":"s","type":"quantitative"}}}' % ("a" * 64)
SCHEMA = TableSchema((Text("k"), Numeric("v", 2, "USD")))


def test_spec_decoding():
    assert corpus.canonical(corpus.decode(SPEC)) == corpus.canonical(corpus.decode(SPEC.replace(",", " , ")))
    for bad in (
        SPEC[:-1],
        SPEC.replace('"mark":"bar"', '"mark":"pie"'),
        SPEC.replace('"op":"group_by"', '"op":"pivot"'),
        SPEC.replace('"keys":["k"]', '"keys":["k"],"n":1'),
        SPEC.replace('"keys":["k"]', '"keys":[null]'),
        SPEC.replace('"keys":["k"]', '"keys":[1.5]'),
        SPEC.replace('"mark":"bar"', '"mark":"bar","mark":"bar"'),
        SPEC.replace("d.csv", "../d.csv"),
    ):
        with pytest.raises(CheckError) as e:
            corpus.decode(bad)
        assert e.value.check == "spec.decode"


def test_bulk_verification(spark):
    specs = spark.createDataFrame(
        [("good", SPEC), ("hash", SPEC.replace("aaaa", "bbbb")), ("field", SPEC.replace('"field":"v"', '"field":"w"'))],
        "spec_id string, raw string",
    )
    admitted = corpus.admission(specs, {"d.csv": SCHEMA}, {"d.csv": "sha256:" + "a" * 64})
    assert {r.spec_id: r.check for r in admitted.collect()} == {"good": None, "hash": "dataset.hash_matches_source", "field": "schema.fields_exist"}
    data = SCHEMA.typed(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double"))
    assert [(r.spec_id, r.n_rows) for r in corpus.verified_results(admitted, {"d.csv": SCHEMA}, lambda n: data).collect()] == [("good", 2)]


def test_bulk_verification_of_shapes(spark):
    """Each spec by the shared job equals the spec on its own, for filters of every kind, empty results and no keys."""
    data = SCHEMA.typed(spark.createDataFrame([(k, float(v)) for v, k in enumerate("abcabcabz")] + [("n", None)], "k string, v double"))
    plain = json.loads(SPEC)
    specs = []
    for where in (
        [],
        [("k", "eq", "a")],
        [("k", "eq", "b")],
        [("k", "eq", "none")],
        [("v", "ge", 3)],
        [("v", "ge", 100)],
        [("k", "ne", "a"), ("v", "lt", "7.5")],
        [("v", "lt", "1e40")],
        [("k", "eq", "c"), ("v", "le", 5)],
    ):
        for keys in (True, False):
            ops = [{"op": "filter", "field": f, "cmp": c, "value": v} for f, c, v in where]
            tail = plain["transform"] if keys else [{
                "op": "aggregate",
                "measures": [{"field": "v", "fn": "sum", "as": "s"}, {"field": "k", "fn": "count", "as": "k"}],
            }]
            doc = {**plain, "transform": ops + tail}
            specs.append((f"s{len(specs)}", json.dumps(doc)))
    schemas, hashes = {"d.csv": SCHEMA}, {"d.csv": "sha256:" + "a" * 64}
    admitted = corpus.admission(spark.createDataFrame(specs, "spec_id string, raw string"), schemas, hashes).withColumn("check", F.lit(None).cast("string"))
    for at_once in (16, 2):
        got = {r.spec_id: tuple(r)[1:] for r in corpus.verified_results(admitted, schemas, lambda n: data, shapes_at_once=at_once).collect()}
        for name, raw in specs:
            plan = corpus.planned(corpus.decode(raw), SCHEMA)
            assert got[name] == tuple(digests.multiset_digest(plan.to_df(data), plan.schema).first()), raw


def test_formula_columns_compile_where_they_fit(spark):
    rows = [(Decimal("1.25"), Decimal("0.50")), (Decimal("-3.10"), None), (Decimal("99.99"), Decimal("0.05")), (Decimal("0.00"), Decimal("-0.01"))]
    df = spark.createDataFrame(rows, "p decimal(6,2), d decimal(4,2)")
    for text, scale in {"p*(1 - d)": 4, "-p**2 + abs(d)*0.125": 2, "(p + d)**0": 1, "p*d + 1": 0, "p**9": 3, "1/(p + 1)": 5, "p**-1": 2}.items():
        plan = formula.formula_column(df, text, {"p": "p", "d": "d"}, scale)
        tree = formula.parse(text, frozenset("pd"))
        for r in plan.collect():
            if r.d is None:
                assert (r.value, r.status) == (None, "null")
                continue
            try:
                want = formula.quantised(formula.value(tree, {"p": Fraction(r.p), "d": Fraction(r.d)}), scale)
            except formula.Refused as e:
                assert (r.value, r.status) == (None, e.check)
                continue
            assert r.status == "ok" and Fraction(r.value) == Fraction(want, 10**scale), text


def test_formula_limits_are_a_parameter():
    for text, key in {
        "1+1": "formula_bytes",
        "x+1": "formula_tokens",
        "((x))": "formula_paren_depth",
        "123": "formula_digits",
        "-x": "formula_ast_nodes",
        "--x": "formula_ast_depth",
    }.items():
        low = {**formula.LIMITS, key: 1}
        with pytest.raises(formula.Refused) as e:
            formula.parse(text, limits=low)
        assert e.value.check == f"resource.{key}"
    assert formula.parse("x+" + " " * 509 + "1") and formula.parse("1" * 32)
    for text in ("x+" + " " * 510 + "1", "1" * 33):
        with pytest.raises(formula.Refused):
            formula.parse(text)


def test_datasets_of_one_folder(spark, tmp_path):
    for name, content in {"a.csv": "x", "b.txt": "y", ".h.csv": "z", "c d.csv": "w"}.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.csv").write_text("v")
    present = scan.datasets(spark, str(tmp_path))
    assert [r.name for r in present.collect()] == ["a.csv"]
    digest = present.first().sha256
    asked = spark.createDataFrame(
        [(1, "a.csv", digest), (2, "a.csv", "sha256:0"), (3, "../a.csv", digest), (4, "e.csv", digest), (5, "a.csv", None)],
        "id long, name string, declared string",
    )
    assert {r.id: r.check is None for r in scan.binding(asked, present).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_spec_corpus_and_index(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(name)
    index = spark.createDataFrame(
        [("a.json", "a", "good", "accept"), ("c.json", "c", "bad", "reject")],
        "name string, spec_id string, corpus string, expected string",
    )
    got = {(r.spec_id, r.raw, r.problem) for r in scan.spec_corpus(spark, str(tmp_path), index).collect()}
    assert got == {("a", "a.json", None), ("b.json", "b.json", "unindexed"), ("c", None, "missing")}


def test_check_rows_of_order_domain_and_formulas(spark):
    placed = spark.createDataFrame([(1, 5), (2, 4)], "pos long, v int")
    status = lambda df: [r.status for r in df.collect()]
    assert status(checks.canonical_order(placed, [("v", False)])) == ["fail"] and status(checks.canonical_order(placed, [("v", True)])) == ["pass"]
    a, b = (spark.createDataFrame([(x,) for x in xs], "value string") for xs in ("ab", "abc"))
    assert status(checks.legend_domain(a, b)) == ["fail"] and status(checks.legend_domain(a, a)) == ["pass"]
    assert status(checks.zero_baseline(placed, "v", F.lit(0))) == ["pass"] and status(checks.zero_baseline(placed, "v", F.lit(3))) == ["fail"]
    rows = [
        (1, 0, Decimal(0), Decimal(1), "ok"),
        (1, 1, Decimal("0.000000000001"), Decimal(2), "ok"),
        (1, 2, Decimal("0.000000000001"), None, "formula.values_defined"),
        (1, 3, Decimal(9), Decimal("10000000000000000000000000.000000000001"), "ok"),
    ]
    rows += [(2, 0, Decimal(0), Decimal("0.5"), "ok"), (2, 1, Decimal(1), None, "ok"), (2, 1, Decimal(2), Decimal(1), "resource.formula_intermediate_bits")]
    df = spark.createDataFrame(rows, "formula_id long, i int, x decimal(38,12), y decimal(38,12), status string")
    expected = spark.createDataFrame([(1, 4, 12, True), (2, 3, 0, False)], "formula_id long, samples int, y_scale int, own_hash boolean")
    got = {(r.formula_id, r.check): (r.place, r.status, r.message) for r in checks.formula_results(df, expected, "1e24").collect()}
    bad = {
        (1, "formula.sample_points_strictly_increasing"): 1,
        (1, "formula.values_defined"): 1,
        (1, "formula.values_bounded"): 1,
        (1, "render.float64_fidelity"): 2,
        (2, "resource.formula_intermediate_bits"): 1,
        (2, "formula.values_bounded"): 1,
        (2, "formula.rounding_unambiguous"): 1,
        (2, "formula.points_from_recomputation"): 1,
        (2, "formula.hash_matches_source"): 3,
    }
    assert got == {(f, c): (i, "fail" if (f, c) in bad else "pass", f"{bad.get((f, c), 0)} failing") for f in (1, 2) for i, c in enumerate(checks.SAMPLED)}


def bucket_brute(rows, rate, burst):
    """Admission with fractions of a token, one event after another."""
    held, out = {}, []
    for user, us, event in sorted(rows):
        tokens, last = held.get(user, (Fraction(burst), us))
        tokens = min(Fraction(burst), tokens + Fraction(max(0, us - last) * rate, 60_000_000))
        ok = tokens >= 1
        held[user] = (tokens - ok, max(last, us))
        out.append((user, event, ok))
    return sorted(out)


def test_token_bucket_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).orderBy("ts", "event_id").coalesce(1)
    df.write.parquet(str(tmp_path / "e"))
    batch = streams.token_bucket(df, "user_id", "ts", "event_id", rate=30, burst=3)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    streamed = streams.drained(streams.token_bucket_stream(stream, "user_id", "ts", "event_id", rate=30, burst=3))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.collect()))
    assert 0 < batch.filter("admitted").count() < 120
    plain = [(r.user_id, int(r.us), r.event_id) for r in df.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").collect()]
    assert sorted(map(tuple, batch.collect())) == bucket_brute(plain, 30, 3)
