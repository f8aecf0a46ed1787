"""The token bucket at pauses, null keys and times; repeats of attempts over batches; chart JSON by keys."""

import random

from pyspark.sql import functions as F

from attestry.functions.text import chart_signals
from attestry.streaming import streams


def _brute(rows, rate, burst):
    out, state = [], {}
    for key, us, event in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        ok, state[key] = streams._admit(us, state.get(key), rate, burst)
        out.append((key, event, ok))
    return out + [(key, event, None) for key, us, event in rows if us is None]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, us long, event_id long")
    return df.select("user_id", F.timestamp_micros("us").alias("ts"), "event_id")


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_one_hot_key_spreads_at_its_pauses(spark):
    """60 000 events of one key in bursts with pauses, over many ranges; then nobody's events, and events without a time."""
    rng, us, rows = random.Random(3), 10**15, []
    for i in range(60_000):
        us += rng.choice([0, 1, 10**5, 10**6]) if i % 37 else 90 * 10**6
        rows.append((5, us, i))
    rows += [(None, 10**15 + i * 10**6, 10**6 + i) for i in range(300)] + [(5, None, -1), (None, None, -2)]
    df = _frame(spark, rows)
    got = streams.token_bucket(df, "user_id", "ts", "event_id", rate=2, burst=3, rows_a_part=2000)
    assert _sorted(got.collect()) == _sorted(_brute(rows, 2, 3))
    timed = df.filter("ts is not null").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("event"))
    spans = streams._spans(timed, 90 * 10**6, 2000).groupBy("key", "span").agg(F.count("*").alias("n")).collect()
    assert len([r for r in spans if r.key == 5]) == 60_000 // 37 + 1 and max(r.n for r in spans if r.key == 5) <= 37


def test_bucket_without_pauses_and_without_rows(spark):
    rows = [(k, 10**15 + i, k * 1000 + i) for k in (1, 2) for i in range(500)]
    got = streams.token_bucket(_frame(spark, rows), "user_id", "ts", "event_id", rate=60, burst=10, rows_a_part=100)
    assert _sorted(got.collect()) == _sorted(_brute(rows, 60, 10))
    assert streams.token_bucket(_frame(spark, rows).limit(0), "user_id", "ts", "event_id").count() == 0


def test_stream_takes_null_keys_and_times(spark, tmp_path):
    rows = [(k, None if i == 7 else 10**15 + i * 10**5, (k or 0) * 1000 + i) for k in (None, 1) for i in range(20)]
    df = _frame(spark, rows).coalesce(1)
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    got = streams.drained(streams.token_bucket_stream(stream, "user_id", "ts", "event_id", rate=30, burst=3))
    assert _sorted(got.collect()) == _sorted(_brute(rows, 30, 3)) == _sorted(streams.token_bucket(df, "user_id", "ts", "event_id", rate=30, burst=3).collect())


def test_repeats_are_reported_and_a_restart_changes_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([(f"a{i}", f"x{n}") for i in (n, n, n + 1, 9)], "attempt_id string, body string").coalesce(1).write.mode("append").parquet(source)
    shape = "attempt_id string, body string"

    def run():
        streams.attempts_and_repeats(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source), "attempt_id", path)
        return {name: sorted((r.attempt_id, r.body, r.batch) for r in spark.read.parquet(f"{path}/{name}").collect()) for name in ("kept", "repeats")}

    first = run()
    assert [x[0] for x in first["kept"]] == ["a0", "a1", "a2", "a3", "a9"] and len(first["repeats"]) == 7
    assert run() == first  # nothing is new
    for f in (tmp_path / "out" / "state" / "commits").glob("*2*"):
        f.unlink()  # as if it were killed before the last batch was committed
    assert run() == first


def test_chart_json_by_its_keys(spark):
    cases = {
        '{"mark":null,"encoding":{},"data":null}': True,
        '{"mark":"bar","encoding":{"x":{}},"layer":[]}': True,
        '{"mark":"bar","encoding":"{x}","data":{}}': False,
        '{"mark":"bar","encoding":null,"data":{}}': False,
        '{"mark":"bar","encoding":{}}': False,
        '{"encoding":{},"data":1}': False,
        '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json"}': True,
        '{"$schema":5}': False,
        '[{"mark":"bar","encoding":{},"data":{}}]': False,
        '"mark"': False,
    }
    df = spark.createDataFrame([(x,) for x in cases], "c string")
    assert {r.c: "vega-lite" in r.s for r in df.select("c", chart_signals(F.col("c")).alias("s")).collect()} == cases
