"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlops.functions.text import private_ip
from crawlops.functions.urls import url_normalize
from crawlops.operators.merge import clean_items, merge_contacts, scope
from crawlops.operators.proxies import sized
from crawlops.operators.reports import hourly_aggregates
from crawlops.plans.alerts import EVERYWHERE, RULES, Rule
from crawlops.session import scratch
from crawlops.sources.sinks import refresh_snapshot
from crawlops.streaming.state import Breaker, Heartbeat, Held, Measures, Sticky
from crawlops.streaming.store import Run, Store, merge_into

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_events(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None, bytes_per_trigger: int = 8 << 30
) -> DataFrame:
    """Append-only event files of a folder or glob; the event time becomes a timestamp with zone, as watermarks need one.

    The size of a micro-batch bounds what a state handler sees of one key at a time.
    """
    limit = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", bytes_per_trigger)
    found = spark.readStream.schema(schema).option(*limit).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, store the output in the shared folder and read it back."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    started = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(
    stream: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None], mode: str, begin: Callable[[str], None] | None = None
) -> str:
    """Process what is there through ``handle(batch, batch_id, folder)``, after ``begin(folder)``; gives the folder."""
    base = scratch(stream.sparkSession, name)
    if begin:
        begin(f"{base}/out")
    started = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda batch, i: handle(batch, i, f"{base}/out"))
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return f"{base}/out"


def with_state(grouped, processor, schema: str, time_mode: str = "EventTime", event_time: str = "") -> DataFrame:
    """Rows of a state machine; ``event_time`` names the output column that a later state machine goes by."""
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode, eventTimeColumnName=event_time
    )


def settled(stream: DataFrame) -> DataFrame:
    """The rows of a stream with a watermark on ``ts``, each one as soon as the watermark has passed it.

    A state machine behind it sees late rows in their place, so its result does not depend on how the
    stream is split.  Rows wait in the state under all their columns, so no key gathers them.
    """
    counted = stream.groupBy(*stream.columns).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return counted.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n")


def _us(ts: str = "ts") -> Column:
    return F.unix_micros(ts)


def stream_unseen(stream: DataFrame, ttl: str | None = None) -> DataFrame:
    """First sight of a normalised URL per job scope; ever, or with ``ttl`` since it was last let through.

    Without a limit the state holds every URL, on disk with a RocksDB store, and the result does
    not depend on how the stream is split.
    """
    keys = ["scope", "normalized_url"]
    keyed = stream.select("ts", scope().alias("scope"), url_normalize("url").alias("normalized_url"))
    return keyed.dropDuplicates(keys) if ttl is None else keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def stream_rates(stream: DataFrame, keys: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and rates per second in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    n = F.count(F.lit(1))
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(1_000_000.0)
    counted = stream.withWatermark("ts", delay).groupBy(window, *keys).agg(n.alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n",
        F.round(F.col("n") / seconds, 9).alias("rate"),
    )


def stream_proxy_hourly(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    hourly = stream.withWatermark("ts", delay).groupBy("proxy_id", F.window("ts", "1 hour")).agg(*hourly_aggregates())
    return hourly.select(
        "proxy_id", F.to_date("window.start").alias("date"), F.hour("window.start").alias("hour"),
        *[c for c in hourly.columns if c not in ("proxy_id", "window")],
    )


def stream_counters(stream: DataFrame, name: str, amount: Column) -> DataFrame:
    """Running counters by name: every micro-batch stores the changed totals under its own number."""
    totals = stream.groupBy(F.col(name).alias("name")).agg(F.sum(amount).alias("total"))

    def store(batch: DataFrame, i: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={i}")

    folder = run_batches(totals, "counters", store, "update")
    written = stream.sparkSession.read.parquet(folder)
    return written.groupBy("name").agg(F.max_by("total", "batch").alias("total"))


def watermarked(stream: DataFrame, delay: str | None) -> DataFrame:
    """The stream with a watermark; without ``delay`` it has one already."""
    return stream if delay is None else stream.withWatermark("ts", delay)


def stream_breaker(
    results: DataFrame, max_failures: int = 5, cooldown_seconds: int = 600, delay: str | None = "10 minutes"
) -> DataFrame:
    """Breaker state of the proxy at every result; behind ``settled`` late results count in their place."""
    rows = watermarked(results, delay).select("event_id", "proxy_id", "ts", _us().alias("us"), "success")
    return with_state(
        rows.groupBy("proxy_id"), Breaker(max_failures, cooldown_seconds * 1_000_000),
        "event_id bigint, proxy_id bigint, failures bigint, allowed boolean, open_until_us bigint",
    )


def stream_sticky(requests: DataFrame, indexed: DataFrame, ttl: int = 300, seed: int = 0, delay: str | None = "10 minutes") -> DataFrame:
    """Proxy of every request; a job keeps its proxy for ``ttl`` seconds from the draw."""
    job = F.coalesce("job_id", F.lit(0)).alias("job_id")
    rows = watermarked(requests, delay).select("event_id", job, "ts", _us().alias("us"))
    n = indexed.count()
    drawn = with_state(
        rows.groupBy("job_id"), Sticky(ttl * 1_000_000, max(n, 1), seed),
        "event_id bigint, job_id bigint, block_us bigint, _index bigint",
    )
    return drawn.join(sized(indexed.select("_index", "proxy"), n), "_index").select("event_id", "block_us", "proxy")


def stream_heartbeat(beats: DataFrame, limit_seconds: int = 300, delay: str | None = "1 minute") -> DataFrame:
    """Silences of workers; ``beats`` has event_id, worker and ts."""
    rows = watermarked(beats, delay).select("event_id", "worker", "ts", _us().alias("us"))
    found = with_state(
        rows.groupBy("worker"), Heartbeat(limit_seconds * 1_000_000), "worker bigint, last_us bigint, silent_us bigint"
    )
    return found.select("worker", F.timestamp_micros("last_us").alias("last_beat"), F.timestamp_micros("silent_us").alias("silent_at"))


SAMPLE_KINDS = ("last", "last_public", "age")


def stream_alerts(samples: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pending and firing rows of rules on single samples (last value or age), judged at every sample.

    Rules over windows or several series need steps: ``plans.alerts`` judges them in batch, and
    a rule over a rate can read the output of ``stream_rates`` as its samples.
    """
    other = sorted({r.kind for r in rules} - set(SAMPLE_KINDS))
    if other:
        raise ValueError(f"not judged at single samples: {', '.join(other)}")
    rows = [(r.metrics[0], r.name, r.kind, r.op, float(r.threshold), r.hold) for r in rules]
    table = samples.sparkSession.createDataFrame(rows, "metric string, alert string, kind string, op string, threshold double, hold bigint")
    kind, limit = F.col("kind"), F.col("threshold")
    value = F.when(kind == "age", F.unix_seconds(F.col("ts").cast("timestamp")) - F.col("value")).otherwise(F.col("value"))
    cond = F.when(F.col("op") == ">", value > limit).when(F.col("op") == "<", value < limit).otherwise(value == limit)
    shown = (kind != "last_public") | ~private_ip("instance")
    judged = samples.join(F.broadcast(table), "metric").where(shown).select(
        "alert", "instance", "event_id", _us().alias("us"), cond.alias("cond"), "hold"
    )
    held = with_state(
        judged.groupBy("alert", "instance"), Held(),
        "alert string, instance string, event_id bigint, us bigint, since_us bigint, state string", "None",
    )
    return held.select(
        "alert", "instance", "event_id", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("since_us").alias("active_since"), "state"
    )


OVERALL = ("mean", "ratio")  # kinds that are judged over all instances


def stream_rules(samples: DataFrame, step: int = 300, rules: list[Rule] = RULES, delay: str = "10 minutes") -> DataFrame:
    """Pending and firing rows of all rules at every step that the watermark has closed, as ``plans.alerts.sustained`` gives them.

    Three operators in one stream: the measures of each series per step, with growth in windows and
    resets; what a rule makes of all series it reads at a step, combined before the shuffle; and the
    time that its condition has held.  Samples wait until the watermark has passed them, so late ones count
    and any split into micro-batches gives the same rows.
    """
    by_metric: dict[str, list[tuple]] = {}
    for r in rules:
        kind = r.kind.removesuffix("_on_grid")
        for part, metric in enumerate(r.metrics):
            by_metric.setdefault(metric, []).append((r.name, kind, r.window, part, kind != r.kind, kind in OVERALL))
    known = samples.withWatermark("ts", delay).where(F.col("metric").isin(sorted(by_metric)) & F.col("value").isNotNull())
    rows = settled(known.select("metric", "instance", "event_id", "ts", "value")).withColumn("us", _us())
    series = with_state(
        rows.groupBy("metric", "instance"), Measures(step * 1_000_000, by_metric, EVERYWHERE),
        "alert string, instance string, part int, ts timestamp, value double", event_time="ts",
    )
    table = samples.sparkSession.createDataFrame(
        [(r.name, r.severity, r.kind.removesuffix("_on_grid"), r.op, float(r.threshold), r.hold) for r in rules],
        "alert string, severity string, kind string, op string, threshold double, hold bigint",
    )
    of_part = [F.when(F.col("part") == i, F.col("value")) for i in (0, 1)]
    at_step = series.groupBy("alert", "instance", "ts").agg(
        F.avg("value").alias("mean"), F.max("value").alias("one"),
        F.try_divide(F.sum(of_part[0]), F.sum(of_part[1])).alias("ratio"), F.try_divide(F.max(of_part[0]), F.max(of_part[1])).alias("free"),
    )
    kind, limit, measure = F.col("kind"), F.col("threshold"), F.col("measure")
    found = F.when(kind == "mean", F.col("mean")).when(kind == "ratio", F.col("ratio")).when(kind == "used", (1 - F.col("free")) * 100)
    public = (kind != "last_public") | ~private_ip("instance")
    judged = at_step.join(F.broadcast(table), "alert").where(public).withColumn("measure", F.round(found.otherwise(F.col("one")), 6))
    cond = F.when(F.col("op") == ">", measure > limit).when(F.col("op") == "<", measure < limit).otherwise(measure == limit)
    rows = judged.where(measure.isNotNull()).select("alert", "severity", "instance", "ts", _us().alias("us"), "measure", cond.alias("cond"), "hold")
    held = with_state(
        rows.groupBy("alert", "instance"), Held(("us",), ("severity", "measure")),
        "alert string, instance string, severity string, measure double, us bigint, since_us bigint, state string",
    )
    return held.select(
        "alert", "severity", "instance", F.timestamp_micros("us").alias("ts"), "measure", F.timestamp_micros("since_us").alias("active_since"), "state"
    )


# Fixed value: requests per second that a domain gets without a limit of its own.
DOMAIN_RPS = 2.0


def rate_violations(
    stream: DataFrame, limits: DataFrame, seconds: int = 1, delay: str = "10 minutes", key: str = "proxy_id", default: float | None = None
) -> DataFrame:
    """Windows with more requests per second than a proxy or domain may get; ``limits`` has the key and rps_max.

    Keys without a limit have the default, or none.
    """
    counted = stream.withWatermark("ts", delay).groupBy(key, F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n"))
    limited = counted.join(limits, key, "inner" if default is None else "left")
    if default is not None:
        limited = limited.withColumn("rps_max", F.coalesce("rps_max", F.lit(default)))
    return limited.where(F.col("n") > F.col("rps_max") * seconds).select(key, F.col("window.start").alias("window_start"), "n", "rps_max")


def contact_store(contacts: DataFrame, folder: str) -> tuple[Store, DataFrame]:
    """Live contacts as a stored table by e-mail, and the others, which no item changes: deleted ones and those without e-mail."""
    spark, live = contacts.sparkSession, F.col("deleted_at").isNull() & F.col("email").isNotNull()
    store = Store(spark, f"{folder}/live", "email")
    store.write(-1, contacts.where(live))
    contacts.where(~live).write.mode("overwrite").parquet(f"{folder}/rest")
    return store, spark.read.schema(contacts.schema).parquet(f"{folder}/rest")


def merge_items(store: Store, change: int, items: DataFrame, as_of) -> list[Run]:
    """Clean items and merge the valid ones into stored contacts; only the contacts they touch are written.

    Cleaning is most of the work: the items are dealt out before, however few files they come in.
    """
    valid = clean_items(items.repartition("item_id")).where("verdict = 'valid'").drop("verdict")
    return merge_into(store, change, valid, lambda rows, new: merge_contacts(rows, new, as_of).drop("action", "items"))


def stream_ingest(items: DataFrame, base: DataFrame, as_of) -> DataFrame:
    """Contacts after a stream of items, merged batch by batch into a stored table.

    A micro-batch writes the contacts that it touches as a run of the table under its own number; a
    repeated batch replaces its own run.
    """
    made: list[DataFrame] = []

    def begin(folder: str) -> None:
        shape = merge_contacts(base, clean_items(base_items(items)).where("verdict = 'valid'").drop("verdict"), as_of)
        made.append(contact_store(shape.drop("action", "items"), folder)[1])

    def store(batch: DataFrame, i: int, folder: str) -> None:
        merge_items(Store(batch.sparkSession, f"{folder}/live", "email"), i, batch, as_of)

    folder = run_batches(items, "contacts", store, "append", begin)
    return Store(items.sparkSession, f"{folder}/live", "email").read().unionByName(made[0], allowMissingColumns=True)


def base_items(items: DataFrame) -> DataFrame:
    """No items, of the stream's columns: merging them gives a stored table all columns of later versions."""
    return items.sparkSession.createDataFrame([], items.schema)


def stream_refresh(contacts: DataFrame, as_of, since: Column) -> str:
    """Summary per country and theme, refreshed as a snapshot after every micro-batch; gives the snapshot folder."""
    summary = contacts.where("deleted_at IS NULL AND country IS NOT NULL").groupBy("country", "theme").agg(
        F.count(F.lit(1)).alias("total_contacts"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_contacts"),
        F.count_if(F.coalesce(F.col("created_at") >= since, F.lit(False))).alias("recent_contacts"),
        F.max("created_at").alias("last_contact_date"),
    )
    return run_batches(summary, "summary", lambda batch, i, folder: refresh_snapshot(batch, folder, as_of, i) and None, "complete")
