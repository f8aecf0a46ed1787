"""Work that has to spread over tasks, whatever files the rows come from."""

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.operators import audit, corpus, formula, ledger, verify
from attestry.plans import catalogue

from .comparing import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


def tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_admission_spreads_one_partition_of_specs(spark):
    one = catalogue._specs(spark, SF).coalesce(1)
    got = corpus.admission(one, catalogue._SCHEMAS, catalogue._HASHES)
    assert got.rdd.getNumPartitions() == tasks(spark) > 1
    # equal texts are judged once, and all of their rows are told
    bad = one.limit(1).select(F.lit(None).cast("string").alias("spec_id"), F.lit(None).cast("string").alias("raw"))
    twice = one.select("spec_id", "raw").unionByName(one.select(F.concat(F.lit("again "), "spec_id").alias("spec_id"), "raw")).unionByName(bad).unionByName(bad)
    rows = corpus.admission(twice, catalogue._SCHEMAS, catalogue._HASHES).groupBy("check").count().collect()
    want = got.groupBy("check").count().collect()
    assert {r["check"]: r["count"] for r in rows} == {r["check"]: 2 * r["count"] + 2 * (r["check"] == "spec.decode") for r in want}


def counted(spark, monkeypatch, module, name):
    """An accumulator of the rows that a function of a module works out, each time that it does."""
    rows, real = spark.sparkContext.accumulator(0), getattr(module, name)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    def wrapped(*args, **kwargs):
        got = real(*args, **kwargs)
        return got.mapInArrow(count, got.schema)

    monkeypatch.setattr(module, name, wrapped)
    return rows


def test_replay_admits_each_spec_twice_only(spark, monkeypatch):
    """Once for what is archived and once for today."""
    judged = counted(spark, monkeypatch, corpus, "admission")
    n = catalogue.QUERIES["replay_recomputed"](spark, SF).count()
    assert judged.value == 2 * n


def test_a_replayed_ledger_admits_each_sound_plot_once(spark, monkeypatch):
    judged = counted(spark, monkeypatch, corpus, "admission")
    plots = catalogue.QUERIES["ledger_replay"](spark, SF).collect()
    assert judged.value == sum((2 * r.g + r.j) % 11 not in (1, 2) and r.g % 7 != 3 for r in plots)


def test_a_batch_of_bundles_reads_its_plots_once(spark):
    """However many roles a plot's contents have."""
    plots = spark.createDataFrame([("p", "k", "r", "s", "m", "q", "t", "v", "w")], ", ".join(f"{c} string" for c in ("plot_id", "keyid", "record", "source", "manifest", "spec", "table", "verdict", "versions")))
    batch = audit.bundle_tables(plots)
    for name, n in (("blobs", 7), ("plot_references", 6), ("plots", 1)):
        assert batch[name]._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
        assert batch[name].count() == n
    assert {(r.kind, bytes(r.content)) for r in batch["blobs"].collect()} == {("certificate", b"r"), ("source", b"s"), ("manifest", b"m"), ("spec", b"q"), ("table", b"t"), ("verdict", b"v"), ("versions", b"w")}


def test_few_literals_go_to_the_rows(spark):
    """An equality of five values does not deal the orders over five tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["bulk_verify_corpus"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "Join" in x and ("o_orderpriority" in x or "__l0" in x)]
    assert joins and all("Broadcast" in x for x in joins), plan


def test_many_literals_have_the_same_results(spark, monkeypatch):
    few = {tuple(r) for r in catalogue.QUERIES["bulk_verify_corpus"](spark, SF).collect()}
    monkeypatch.setattr(corpus, "FEW", 0)
    assert {tuple(r) for r in catalogue.QUERIES["bulk_verify_corpus"](spark, SF).collect()} == few


def test_titles_spread(spark):
    assert catalogue.QUERIES["axis_titles"](spark, SF).rdd.getNumPartitions() == tasks(spark)


def test_formulas_are_admitted_once_in_many_tasks(spark, monkeypatch):
    fs = catalogue._odd_formulas(spark, SF).coalesce(1)
    n = fs.count()
    plan = formula.admission(fs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(formula_id" in plan.split("MapInPandas", 1)[1].split("Project", 1)[0], plan
    judged = counted(spark, monkeypatch, formula, "admission")
    assert verify.certified_formulas(fs).count() == n == judged.value


@pytest.mark.parametrize("rows", [
    [(1, "one", "en"), (2, "one", "de"), (3, "two", "de"), (4, "two", "fr"), (5, None, "de"), (6, "three", None)],
    [(1, "one", "en"), (2, None, "en"), (3, "two", "de")],
    [(1, "one", "de"), (2, None, "de"), (3, None, None), (4, "one", "de")],
])
def test_new_blobs_are_those_of_the_sql(spark, tmp_path, rows):
    """Contents that are stored under another kind are not new; nulls are told as NOT IN tells them."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(catalogue.ledger_new_blobs(spark, str(tmp_path))) == sql_rows(db, catalogue.SQL["ledger_new_blobs"])[1]


def test_contents_are_not_shuffled_again_for_each_check(spark, tmp_path):
    """Bytes shuffled while a batch is published: its contents once for all checks, and twice for the write (the anti join deals
    them again where all blobs are of one kind)."""
    texts = spark.range(0, 2000, 1, 2).select(F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f" {k}")), 512) for k in range(40)]).alias("t"))
    size = texts.agg(F.sum(F.length("t"))).first()[0]
    status = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = status.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    book = ledger.Ledger(spark, str(tmp_path / "l"))
    book.publish({"blobs": ledger.blobs_of(texts, F.col("t"), F.lit("raw"))})
    assert shuffled() - before < 3.3 * size
    assert book.table("blobs").count() == 2000
