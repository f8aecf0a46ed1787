"""Rules of types, exact functions, pipelines, canonical form and checks on small frames."""

import hashlib
import random
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from attestry.functions import digests, exact, text
from attestry.operators import checks, order
from attestry.operators.pipeline import Channel, Pipeline
from attestry.sources import canonical, scan
from attestry.types import CheckError, Numeric, TableSchema, Temporal, Text, manifest

S = TableSchema((Text("k"), Numeric("v", 2, "USD", "Value"), Temporal("d", "date")))


def frame(spark, rows):
    return S.typed(spark.createDataFrame(rows, "k string, v string, d string"))


def test_numeric_status_against_decimal(spark):
    def want(x: str, scale: int):
        if x == "":
            return None
        try:
            v = Decimal(x)
        except InvalidOperation:
            return "syntax"
        if not v.is_finite():
            return "syntax"
        if v and v.adjusted() > 37 - scale:
            return "magnitude"
        return "precision" if v and v != 0 and -v.normalize().as_tuple().exponent > scale else "ok"

    cells = [
        "",
        "0",
        "-0",
        "1.5",
        "1.50",
        ".5",
        "5.",
        "+12",
        " 12 ",
        "1_000",
        "\t1.00\n",
        "1.00\u00a0",
        "\u2003 7 \x1f",
        "_1",
        "1__0",
        "_",
        "\u0661\u0662",
        "\u0663.\uff15e\u0661",
        "1 0",
        "\u00b2",
        "NaN",
        "-Infinity",
        "1e2",
        "1.25e1",
        "125e-2",
        "1e37",
        "1e38",
        "9" * 38,
        "9" * 39,
        "abc",
        "NaN",
        "Infinity",
        "1.2.3",
        "e5",
        "0e999999999999",
        "1e-40",
        "1e99999999999999",
        "01",
        "-1e-2",
        "0.010",
    ]
    for scale in (0, 1, 2, 5, 38):
        got = exact.judged(spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string"), {"j": ("c", scale)}).collect()
        assert {cells[r.i]: r.j and r.j.status for r in got} == {c: want(c, scale) for c in cells}
        assert all(r.j.value == Decimal(cells[r.i]) for r in got if r.j and r.j.status == "ok")
    (none,) = exact.judged(spark.createDataFrame([(None,)], "c string"), {"j": ("c", 2)}).collect()
    assert none.j is None


def test_cells_are_judged_once(spark):
    """Each step is a column of the plan: the shape test stands in it once for each cell."""
    df = exact.judged(spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit(" ")).alias("c")), {"j": ("c", 2)})
    plan = df.select("j.status", "j.value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(\d+\.?\d*|\.\d+)") == 1


def test_mean_half_even(spark):
    rng = random.Random(5)
    groups = {g: [Decimal(rng.randint(-(10**rng.randint(1, 12)), 10**12)) / 100 for _ in range(rng.randint(1, 8))] for g in range(60)} | {
        100: [Decimal("0.01"), Decimal("0.02")],
        101: [Decimal("0.03"), Decimal("0.04")],
        102: [Decimal("-0.01"), Decimal("-0.02")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v decimal(38,2)")
    out = df.groupBy("g").agg(
        F.sum("v").cast("decimal(38,2)").alias("s"),
        F.count("v").alias("n"),
    ).select("g", exact.mean_half_even(F.col("s"), F.col("n"), 2).alias("m")).collect()
    for r in out:
        assert r.m == Decimal(round(Fraction(sum(groups[r.g])) / len(groups[r.g]) * 100)) / 100


def test_temporal_cells(spark):
    cells = ["2024-01-31", "2024-1-1", "20240101", "2024-02-30", "0000-01-01", ""]
    got = [r.o for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(exact.temporal_ok(F.col("c"), "date").alias("o")).collect()]
    assert got == [True, False, False, False, False, None]
    cells = [
        "2024-01-31T01:02:03",
        "2024-01-31T01:02:03.000000",
        "2024-01-31T01:02:03.000001",
        "2024-01-31T01:02",
        "2024-01-31T01:02:03Z",
        "2024-01-31 01:02:03",
    ]
    got = [r.o for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(exact.temporal_ok(F.col("c"), "datetime").alias("o")).collect()]
    assert got == [True, False, True, False, False, False]


@pytest.mark.parametrize(
    ("check", "build"),
    [
        ("schema.fields_exist", lambda p: p.select("nope")),
        ("select.fields_distinct", lambda p: p.select("k", "k")),
        ("group_by.keys_distinct", lambda p: p.group_by("k", "k")),
        ("sort.fields_distinct", lambda p: p.sort(("k", "ascending"), ("k", "descending"))),
        ("transform.group_by_placement", lambda p: p.group_by("k").filter("v", "eq", 1)),
        ("transform.group_by_placement", lambda p: p.group_by("k").closed()),
        ("filter.value_type", lambda p: p.filter("v", "eq", "1.005")),
        ("filter.value_type", lambda p: p.filter("v", "eq", "abc")),
        ("filter.value_type", lambda p: p.filter("k", "eq", 1)),
        ("filter.value_type", lambda p: p.filter("d", "eq", "2024-1-1")),
        ("filter.value_type", lambda p: p.filter("v", "eq", True)),
        ("aggregate.output_unique", lambda p: p.group_by("k").aggregate(("v", "sum", "k"))),
        ("schema.field_types_match", lambda p: p.aggregate(("k", "sum", "s"))),
        ("sort.field_in_plotted_table", lambda p: p.sort(("v", "ascending")).select("k").closed()),
        ("transform.ops_allowed", lambda p: p.aggregate(("v", "median", "m"))),
        ("transform.ops_allowed", lambda p: p.filter("v", "like", 1)),
        ("spec.decode", lambda p: p.select()),
    ],
)
def test_plan_checks(check, build):
    with pytest.raises(CheckError) as e:
        build(Pipeline(S))
    assert e.value.check == check


def test_filters_and_nulls(spark):
    df = frame(spark, [("a", "1", None), ("b", "2", None), ("c", "3", None), ("z", None, None)])
    keys = lambda cmp, v: sorted(r.k for r in Pipeline(S).filter("v", cmp, v).to_df(df).collect())
    assert keys("eq", 2) == ["b"] and keys("ne", 2) == ["a", "c"] and keys("lt", "2.0") == ["a"] and keys("le", "2e0") == ["a", "b"] and keys("gt", 2) == ["c"] and keys("ge", 2) == ["b", "c"]
    assert keys("lt", "1e60") == ["a", "b", "c"] and keys("eq", "1e60") == [] and keys("ge", "-1e60") == ["a", "b", "c"]


def test_aggregates(spark):
    df = frame(spark, [("a", "10", "2024-01-01"), ("a", None, None), ("a", "20", "2023-01-01"), (None, "5", None), ("n", None, None)])
    p = Pipeline(S).group_by("k").aggregate(("v", "sum", "s"), ("v", "mean", "m"), ("v", "count", "c"), ("d", "min", "d0"))
    got = {r.k: (r.s, r.m, r.c) for r in p.to_df(df).collect()}
    assert got == {"a": (30, 15, 2), None: (5, 5, 1), "n": (None, None, 0)}
    whole = Pipeline(S).filter("v", "gt", 100).aggregate(("v", "sum", "s"), ("v", "count", "c")).to_df(df).collect()
    assert [(r.s, r.c) for r in whole] == [(None, 0)]


def test_lineage_units_titles():
    p = Pipeline(S).group_by("k").aggregate(("v", "sum", "v"), ("v", "count", "n")).group_by("k").aggregate(("v", "max", "v"), ("n", "max", "n"))
    assert p.lineage == {"k": "k", "v": "v", "n": None}
    assert p.axis_title("v") == "Value (USD)" and p.axis_title("n") == "Count of records"
    results = dict((c, s) for c, s, _ in p.encoding_results(Channel("k", "temporal"), Channel("v", "quantitative"), Channel("gone", "nominal")))
    assert results == {"encoding.fields_exist_in_plotted_table": "fail", "encoding.axis_types_match_fields": "fail", "label.quantitative_units_present": "pass"}
    bare = Pipeline(TableSchema((Numeric("x"),)))
    assert bare.encoding_results(Channel("x", "quantitative"))[2][1] == "fail"


def test_total_order_and_digests_do_not_depend_on_partitions(spark):
    rows = [("a", "1", None), ("b", None, "2024-01-01"), (None, "2", None), ("a", "1", None), ('q"\n', "-0.5", None)]
    p = Pipeline(S).sort(("v", "descending"))
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = frame(spark, rows).repartition(seed + 1)
        placed = p.positioned(df, rows_at_most=None if seed else 100)
        ls = [r.line for r in canonical.lines(placed, p.schema).orderBy("pos").collect()]
        m = digests.multiset_digest(df, p.schema).first()
        d = digests.table_digest(canonical.lines(placed, p.schema), p.schema).first()
        seen.add((tuple(ls), tuple(m), tuple(d)))
    assert len(seen) == 1
    assert ls[0] == '["b",null,"2024-01-01"]' and ls[-1] == '["q\\"\\n",-0.50,null]'


def test_canonical_file_round_trip(spark, tmp_path):
    df = frame(spark, [("a", "1", "2024-01-01"), (None, None, None), ("[x,y]", "3.1", None)])
    placed = Pipeline(S).positioned(df, rows_at_most=10)
    canonical.write(placed, S, str(tmp_path / "t"))
    back = canonical.read(spark, str(tmp_path / "t"), S)
    assert back.filter("not faithful").count() == 0
    assert sorted(map(tuple, back.select(*S.names).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_digest_has_one_definition(spark):
    lines = spark.range(9000).select((F.col("id") + 1).alias("pos"), F.col("id").cast("string").alias("line"))
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (0, 1, 4096, 4097, 9000):
        blocks = [h("".join(f"{i}\n" for i in range(a, min(n, a + 4096)))) for a in range(0, n, 4096)]
        groups = [h("".join(f"{x}\n" for x in blocks))] if blocks else []
        got = digests.table_digest(lines.filter(F.col("pos") <= n).repartition(3), TableSchema((Numeric("x"),))).first()
        assert (got.n_rows, got.digest) == (n, "sha256:" + h('attestry-table/1\n["x:numeric:0"]\n' + "\n".join(groups)))


def test_positions_hold_their_bound(spark):
    with pytest.raises(Exception, match="more than 3 rows"):
        order.positions(spark.range(4), [order.order_key("id")], rows_at_most=3).collect()


def test_raw_ranges_keep_exact_answers(spark):
    schema = TableSchema((Numeric("v", 2),))
    df = spark.createDataFrame([(x,) for x in (0.994, 0.995, 0.9949999, 1.0, 1.004, 1.005, 1.0051, -1.005, 1e15 + 0.3, None)], "v double")
    for cmp in ("eq", "ne", "lt", "le", "gt", "ge"):
        for value in ("1", "-1", "1.01", "1e15", "1e40"):
            p = Pipeline(schema).filter("v", cmp, value)
            assert sorted(p.scanned(df).collect()) == sorted(p.to_df(schema.typed(df)).collect()), (cmp, value)


def test_inversions_and_domains(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 6), (4, None), (5, 1)], "pos long, v int")
    assert [r.pos for r in order.inversions(df, "pos", [("v", False)]).orderBy("pos").collect()] == [3, 5]
    assert [r.pos for r in order.inversions(df, "pos", [("v", False)], block_rows=2).orderBy("pos").collect()] == [3, 5]
    assert [r.pos for r in order.inversions(df, "pos", [("v", True)]).orderBy("pos").collect()] == [2, 4]
    shown, declared = spark.createDataFrame([("a",), ("b",)], "value string"), spark.createDataFrame([("b",), ("c",)], "value string")
    assert sorted(map(tuple, order.domain_difference(shown, declared).collect())) == [("a", "missing"), ("c", "extra")]


def test_manifest_is_strict():
    good = '{"columns":[{"name":"a","type":"numeric","scale":2,"unit":"USD"},{"name":"b","type":"string"}]}'
    assert manifest(good).descriptors() == ["a:numeric:2", "b:string"]
    for bad in (
        '{"columns":[{"name":"a","type":"float"}]}',
        '{"columns":[{"name":"a","type":"string"},{"name":"a","type":"string"}]}',
        '{"columns":[],"x":1}',
        '{"columns":[{"name":"a","type":"string","size":1}]}',
        '{"columns":[],"columns":[]}',
        "[",
        '{"columns":[{"name":"1a","type":"string"}]}',
    ):
        with pytest.raises(CheckError):
            manifest(bad)


def test_csv_gates(spark, tmp_path):
    schema = TableSchema((Text("a"), Numeric("b", 1)))
    files = {
        "good": b'a,b\nx,1.5\n"q,""r\n",\n',
        "bom": b"\xef\xbb\xbfa,b\nx,1\n",
        "bad_utf8": b"a,b\n\xff,1\n",
        "header": b"b,a\nx,1\n",
        "one_field": b'"a,b"\nx,1\n',
        "quoted": b'"a","b"\n"x\n1",1\n',
        "short": b"a,b\nx\n",
        "long": b"a,b\nx,1,2\n",
        "open": b'a,b\n"x,1\n',
        "after": b'a,b\n"x"y,1\n',
        "blank": b"a,b\nx,1\n\ny,2\n",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    got = {(r.name, r.check) for r in scan.gates(scan.files(spark, str(tmp_path)), schema).filter("status = 'fail'").collect()}
    want = {
        "bom": "charset",
        "bad_utf8": "charset",
        "header": "header",
        "one_field": "header",
        "short": "row_width",
        "long": "row_width",
        "open": "csv_syntax",
        "after": "csv_syntax",
        "blank": "row_width",
    }
    # a record of one field, "a,b", is another header, and its rows are then wider than it: only the schema counts
    assert got == {(f"{n}.csv", f"data.{c}") for n, c in want.items()}
    few = scan.gates(scan.files(spark, str(tmp_path)), schema, most_bytes=4, most_rows=0, most_cells=1).filter("name = 'good.csv' and status = 'fail'")
    assert {r.check for r in few.collect()} == {"resource.file_bytes", "resource.source_rows", "resource.source_cells"}
    assert scan.admitted(spark, str(tmp_path), most_bytes=10).count() < len(files)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.csv").write_bytes(b"a,b\nx,1.55\ny\nz,1,2\nk,abc\n,\n")
    raw = scan.raw_csv(spark, str(tmp_path / "w"), schema)
    assert {r["check"]: r["n"] for r in scan.cell_failures(raw, schema).collect()} == {"data.row_width": 2, "data.numeric_value": 2}
    for bad in ("numeric_value", "row_width"):
        with pytest.raises(Exception, match=f"data.{bad}"):
            scan.typed_csv(raw.filter(F.col(scan.CORRUPT).isNull() if bad == "numeric_value" else F.col(scan.CORRUPT).isNotNull()), schema).collect()
    assert scan.typed_csv(raw, schema, refuse=False).count() == 5
    ok = scan.typed_csv(scan.raw_csv(spark, str(tmp_path / "good.csv"), schema), schema).collect()
    assert sorted(map(tuple, ok), key=str) == sorted([("x", Decimal("1.5")), ('q,"r\n', None)], key=str)
    assert scan.identity(scan.files(spark, str(tmp_path / "w"))).first().sha256.startswith("sha256:")
    assert scan.corpus_identity(scan.files(spark, str(tmp_path / "w"))).first().n_files == 1


def test_check_rows(spark):
    with pytest.raises(KeyError):
        checks.result("no.such", "pass", "")
    a = checks.frame(spark, [checks.result("data.header", "pass", ""), checks.result("data.charset", "fail", "")])
    b = checks.counted(spark.range(3), "data.row_width", F.col("id") > 1)
    v = checks.verdict(checks.union_of([b, a])).first()
    assert not v.verified and v.failed == 2 and v.first_failing == "data.row_width"


def test_reply_text(spark):
    rows = ["", "  ", '{"a":1}', "```json\n{\"a\": 1}\n```", "[1]", "x", "{bad"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = [tuple(r) for r in df.orderBy("i").select(
        text.reply_shape(F.col("r")),
        text.is_json_object(F.col("r")),
        text.is_json(text.defenced(F.col("r"))),
    ).collect()]
    assert got == [
        ("empty", False, False),
        ("empty", False, False),
        ("bare_object", True, True),
        ("fenced", False, True),
        ("other", False, True),
        ("other", False, False),
        ("bare_object", False, False),
    ]


def test_chart_signals(spark):
    rows = {
        "plain matplotlib words": [],
        "```python\nplt . plot(x)\n```": ["matplotlib"],
        "```\nimport altair\n": ["altair"],
        "<SVG >": ["svg"],
        "```mermaid x\n```": ["mermaid"],
        '{"mark":"bar","encoding":{},"data":1}': ["vega-lite"],
        '{"mark":"bar","encoding":{}}': [],
        "see data:image/png;base64,AA": ["data-image"],
        "```json\n{\"$schema\":\"https://vega.github.io/schema/vega-lite/v5.json\"}\n```": ["vega-lite"],
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.s for r in df.select("t", text.chart_signals(F.col("t")).alias("s")).collect()} == rows
