"""Structured Streaming counterparts; each agrees with a batch query over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import chart_signals
from ..sources.store import fresh_path, stored

#: Credit of one token, in microseconds of a minute's refill.
TOKEN = 60_000_000


def _admit(us: int, state: tuple[int, int] | None, rate: int, burst: int) -> tuple[bool, tuple[int, int]]:
    """One event against its key's bucket: integer credit, refilled by elapsed time, capped, spent when a token is there."""
    cap = burst * TOKEN
    credit, last = state if state is not None else (cap, us)
    credit = min(cap, credit + max(0, us - last) * rate)
    last = max(last, us)
    return (True, (credit - TOKEN, last)) if credit >= TOKEN else (False, (credit, last))


def _spans(rows: DataFrame, full_us: int, rows_a_part: int) -> DataFrame:
    """``rows`` with ``span``: the stretches of a key's events, in order, before each of which its bucket is certainly full.

    A bucket is full whatever came before when nothing came for as long as it takes to fill it.  Events are sorted over
    ranges; only the last event of each range meets the next range's first, and only the ranges' numbers of cuts are
    added up in one place, so that a key with any number of events spreads over tasks at its pauses.
    """
    order = [F.asc_nulls_first("key"), F.asc("us"), F.asc("event")]
    parts = max(1, -(-rows.count() // rows_a_part))
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    ends = placed.groupBy("part").agg(F.max_by(F.struct("key", "us"), "at").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))  # a row for each range
    w = Window.partitionBy("part").orderBy("at")
    seen = placed.join(ends, "part").withColumn("before", F.coalesce(F.lag(F.struct("key", "us")).over(w), F.col("end")))
    cut = F.col("before").isNull() | ~F.col("before.key").eqNullSafe(F.col("key")) | (F.col("us") - F.col("before.us") >= full_us)
    seen = seen.withColumn("cut", F.when(cut, 1).otherwise(0).cast("long"))
    counts = seen.groupBy("part").agg(F.sum("cut").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each range
    return seen.join(starts, "part").withColumn("span", F.col("start") + F.sum("cut").over(w)).select("key", "us", "event", "span")


def token_bucket(events: DataFrame, key: str, ts: str, event: str, *, rate: int = 120, burst: int = 120, rows_a_part: int = 1 << 18) -> DataFrame:
    """``key, event, admitted``: admission at ``rate`` a minute with bursts of ``burst``, in (time, event) order per key.

    A key's events are taken apart where its bucket is certainly full (``_spans``); a task holds one span's credit, not its
    rows.  Rows without a key share one bucket; a row without a time is reported with ``admitted`` null and spends nothing.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event).cast("long").alias("event"))
    untimed = rows.filter("us is null").select("key", "event", F.lit(None).cast("boolean").alias("admitted"))
    spans = _spans(rows.filter("us is not null"), -(-burst * TOKEN // rate), rows_a_part)
    shape = pa.schema([("key", pa.int64()), ("event", pa.int64()), ("admitted", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for span, us in zip(batch.column("span").to_pylist(), batch.column("us").to_pylist(), strict=True):
                if span != now:
                    now, state = span, None
                ok, state = _admit(us, state, rate, burst)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event"), pa.array(out, pa.bool_())], schema=shape)

    admitted = spans.repartition("span").sortWithinPartitions("span", "us", "event").mapInArrow(work, "key long, event long, admitted boolean")
    return admitted.unionByName(untimed)


def token_bucket_stream(events: DataFrame, key: str, ts: str, event: str, *, rate: int = 120, burst: int = 120) -> DataFrame:
    """The same over a stream: the state of a key is its credit and time; a micro-batch is taken in (time, event) order."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event).cast("long").alias("event"))

    def work(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["us", "event"])
        out = []
        for us in pdf["us"]:
            if pd.isna(us):
                out.append(None)
                continue
            ok, held = _admit(int(us), held, rate, burst)
            out.append(ok)
        if held is not None:
            state.update(held)
        yield pd.DataFrame({"key": pdf["key"].astype("Int64"), "event": pdf["event"].astype("Int64"), "admitted": pd.array(out, "boolean")})

    return rows.groupBy("key").applyInPandasWithState(
        work,
        "key long, event long, admitted boolean",
        "credit long, last long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def distinct_attempts(stream: DataFrame, key: str, ts: str, *, delay: str = "10 minutes") -> DataFrame:
    """The stream's rows with repeats of a key inside the watermark dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def attempts_and_repeats(stream: DataFrame, key: str, path: str) -> None:
    """Drain a stream of attempts into two tables below ``path``: ``kept`` has the first row of each key, ``repeats`` every further
    one with the batch that brought it.

    Each batch's rows go to files named by the batch, which a batch that is run again replaces, so that a stream that is
    killed and started again (with its checkpoint below the same path) leaves the same two tables.  A batch is held
    against the keys of the batches before it only.
    """
    spark = stream.sparkSession

    def publish(batch: DataFrame, number: int) -> None:
        known = batch.select(key).limit(0)
        if number:
            shape = T.StructType([*batch.schema, T.StructField("batch", T.LongType())])
            known = spark.read.schema(shape).parquet(f"{path}/kept").filter(F.col("batch") < number).select(key)
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in batch.columns if c != key]))
        rows = batch.join(known.distinct().withColumn("__known", F.lit(True)), key, "left").withColumn("__rank", rank)
        rows = stored(rows.withColumn("__new", F.col("__known").isNull() & (F.col("__rank") == 1)))
        for name, mine in (("repeats", rows.filter("not __new")), ("kept", rows.filter("__new"))):
            mine.drop("__known", "__rank", "__new").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(publish).start().awaitTermination()


def guarded(stream: DataFrame, text: str) -> DataFrame:
    """Messages with their chart signals; stateless."""
    return stream.withColumn("signals", chart_signals(F.col(text)))


def running_counts(stream: DataFrame, *by: str, flags: dict) -> DataFrame:
    """Running counts of rows and of the conditions in ``flags`` per group."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there now.

    Appended rows go to files; in complete mode each micro-batch replaces the last.
    """
    spark = stream.sparkSession
    path = fresh_path(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", f"{path}/rows").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
