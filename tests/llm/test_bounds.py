"""What reaches a task or the driver is bounded whatever the rows are: empty texts, wide columns, equal rows, one id."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import chunks, common, decontaminate, langid, linedup, quality, topk, toxicity

from .helpers import NASTY, documents


class _Partition:
    @staticmethod
    def get():
        return _Partition()

    @staticmethod
    def partitionId():
        return 0


def _sizes(monkeypatch, batches, limit):
    monkeypatch.setattr(chunks, "TaskContext", _Partition)
    held = []
    monkeypatch.setattr(chunks, "_pack", lambda rows: held.append(sum(r.num_rows for r in rows)) or b"")
    list(chunks._chunked(limit)(iter(batches)))
    return held


def test_empty_texts_fill_chunks(monkeypatch):
    rows = 1_000_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([""] * rows)], names=["id", "text"])
    got = _sizes(monkeypatch, [batch], 1 << 20)
    assert sum(got) == rows and max(got) * chunks.ROW_BYTES <= 1 << 20


def test_other_columns_count_for_chunks(monkeypatch):
    wide = [pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(["x"] * 50), pa.array(["y" * 10_000] * 50)], names=["id", "text", "c0"]) for _ in range(20)]
    got = _sizes(monkeypatch, wide, 1 << 18)
    assert sum(got) == 1000 and max(got) <= 27


def test_equal_benchmark_rows_are_one(spark):
    text = "one two three four five six seven eight nine ten eleven"
    items = spark.range(50_000).select(F.lit("a").alias("item_id"), F.lit(text).alias("text"))
    docs = documents(spark, [f"x {text} y", "clean"])
    got = {r.doc_id: (r.items, [tuple(h) for h in r.hits]) for r in decontaminate.find_contamination(docs, items, part_bytes=1000).collect()}
    assert got == {0: (["a"], [(1, 12)]), 1: ([], [])}


def test_parts_of_the_benchmark_have_a_bound(spark):
    items = spark.range(3000).select(F.col("id").cast("string").alias("item_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"))
    parts = decontaminate._parts(items, 20_000)
    bins = parts[-1][1]
    sizes = {r["bin"]: r["n"] for r in items.groupBy(decontaminate._bin(bins).alias("bin")).agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 64).alias("n")).collect()}
    assert [lo for lo, _ in parts] == [0, *[hi for _, hi in parts[:-1]]]
    assert all(sum(sizes.get(k, 0) for k in range(lo, hi)) <= 20_000 for lo, hi in parts if hi - lo > 1)


def test_samples_are_bounded_whatever_repeats(spark):
    one = spark.range(20_000).select(F.lit(1).alias("k"))
    many = spark.range(20_000).select(F.col("id").alias("k"))
    assert common.sampled(one, 500, "k").count() <= 500
    assert 300 <= common.sampled(many, 500, "k").count() <= 500
    assert common.sampled(many, 20_000, "k").count() == 20_000


@pytest.mark.parametrize("ids", [[7] * 400, [None] * 400])
def test_one_id_on_all_rows(spark, ids, monkeypatch):
    docs = documents(spark, [f"{'der die das' if i % 2 else 'the of and'} {i} word. You are an idiot." for i in range(400)], ids=ids)
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    learn = quality.Model.learn
    monkeypatch.setattr(quality.Model, "learn", lambda self, sequences, marks: seen.append(len(sequences)) or (learn(self, sequences, marks) if len(set(marks)) > 1 else None))
    quality.fit(docs, labels, sample=50)
    assert seen[-1] <= 50
    toxicity.fit(docs, labels, sample=50)
    model = langid.fit(docs, sample_per_language=20)
    assert sorted(model.languages) == ["de", "en"]
    assert langid.fit(docs, languages_at_most=1).languages in (["de"], ["en"])
    vectors = spark.range(300).select(F.lit(1).cast("long").alias("vec_id"), F.array(*[F.lit(0.5)] * 4).alias("embedding"))
    monkeypatch.setattr(topk, "SAMPLE", 40)
    assert topk.top_k(vectors, F.col("vec_id") == 1, k=2).count() == 600


def test_equal_vectors_are_few_candidates(spark, monkeypatch):
    """Thousands of equal rows answer each other and all else as before, and k + 1 of them reach the shards."""
    rows = [(1, [0.5, 0.25])] * 3000 + [(2, [0.5, 0.25])] * 2 + [(3, [1.0, -1.0]), (4, None), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    cells = topk._in_cells
    monkeypatch.setattr(topk, "_in_cells", lambda own, splits: seen.append(own.count()) or cells(own, splits))
    got = topk.top_k(vectors, F.col("vec_id") != 1, k=3)
    assert seen == [4 + 2 + 1]
    answers = {}
    for r in got.collect():
        answers.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    both = 128 * 128 + 64 * 64
    assert sorted(answers[2]) == sorted([(i, 1, both) for i in (1, 2, 3)] * 2)
    assert sorted(answers[3]) == [(i, 1, 256 * 128 - 256 * 64) for i in (1, 2, 3)]
    alone = topk.top_k(vectors.filter("vec_id = 1"), F.lit(True), k=3)
    assert alone.count() == 9000 and {r["vec_id"] for r in alone.select("vec_id").distinct().collect()} == {1}


def test_rounds_have_one_python_step_a_stage_without_pandas(spark, monkeypatch):
    """Workers of a second step in a stage, and what they import, stay in an executor's memory."""
    plans = []
    for module in (chunks, linedup):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, *path, real=real: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *path))
    assert linedup.without_repeated_lines(documents(spark, NASTY)).count() == len(NASTY)
    assert len(plans) > 4 and not [x for x in plans if "InPandas" in x]
    assert "FlatMapCoGroupsInArrow" in plans[-1] and "MapInArrow" not in plans[-1]
