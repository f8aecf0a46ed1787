import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from attestry.llm import mixing, queries

from ..comparing import spark_rows, sql_rows
from .helpers import NASTY, documents, empty

def _cycle():
    return F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("place") % 3 + 1).cast("int"))


def _sized(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _against_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))
    out = queries.op11_mixing(spark, str(tmp_path))
    cols, want = sql_rows(con, queries.SQL["op11_mixing"])
    assert sorted(out.columns) == cols
    assert spark_rows(out) == want
    return out.collect()


def test_mix_is_as_in_sql(spark, tmp_path):
    """Null and repeated ids, rows, texts and sources, sources without words, one source with most rows."""
    rng = random.Random(5)
    rows = [(i % 7 or None, x, f"s{i % 3}") for i, x in enumerate(NASTY)] + [(None, "a b c", None)] * 4 + [(9, "", "empty"), (9, None, "empty")]
    rows += [(rng.randrange(200), "w " * rng.choice([0, 1, 3, 50, 400]), rng.choice(["hot"] * 5 + ["é", "z", "Z", "", None])) for _ in range(400)]
    got = _against_sql(spark, [(*r, 1, "x") for r in rows], tmp_path)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert target <= 2 * size
        assert abs(sum(taken) - target) <= 1 + max(Counter(rows).values())  # an edge of equal rows is rounded down for each


def test_excess_is_shared_until_none_is_above(spark):
    """A chain of clamps: each round's excess lifts another source above its size."""
    sizes, weights = [1, 2, 5, 12, 30, 80], [9, 8, 7, 6, 5, 4]
    held = spark.createDataFrame([(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight long")
    got = {r["source"]: r for r in mixing.targets(held, budget=(1, 1), epochs=1).collect()}
    assert [got[f"s{i}"]["target"] for i in range(6)] == [float(n) for n in sizes]
    got = {r["source"]: r["target"] for r in mixing.targets(held, budget=(1, 2), epochs=1).collect()}
    caps, share = dict(zip(got, sizes, strict=True)), {}
    open_ = {f"s{i}": w for i, w in enumerate(weights)}
    while True:
        level = (65 - sum(share.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > caps[s]]
        if not over:
            break
        for s in over:
            share[s] = float(caps[s])
            del open_[s]
    share |= {s: level * w for s, w in open_.items()}
    assert all(abs(got[s] - share[s]) < 1e-9 for s in got)
    none = mixing.targets(held.withColumn("weight", F.lit(None).cast("long")), budget=(1, 1), epochs=1).collect()
    assert all(r["target"] == 0 and r["whole"] == 0 and r["rest"] == 0 for r in none)


def test_repeated_rows_have_the_words_taken(spark):
    docs = documents(spark, [x for x in NASTY] + [f"{'w ' * i}end." for i in range(60)])
    mixed = mixing.mix(docs, _cycle())
    want = {r["doc_id"]: (r["size"], r["taken"]) for r in mixed.collect()}
    rows = mixing.repeated(docs, mixed)
    assert rows.columns == [*[c for c in docs.columns if c != "text"], "text", "repetition"]
    taken = Counter()
    for r in rows.collect():
        taken[r["doc_id"]] += _sized(r["text"])
    assert {k: n for k, (_, n) in want.items() if n} == dict(taken)
    assert any(0 < n % max(1, size) for size, n in want.values())
    again = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs.repartition(7), _cycle()).collect()}
    assert again == want
    other = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs, _cycle(), seed=1).collect()}
    assert other != want


def test_nothing_to_mix(spark):
    assert mixing.mix(empty(spark), _cycle()).collect() == []
    lone = mixing.mix(documents(spark, [None, ""]), _cycle()).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in lone] == [(0, 0.0, 0)] * 2
