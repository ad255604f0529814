"""Streams cut into many micro-batches give what one batch gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crawlops.catalog import load
from crawlops.catalog.streams import state_store
from crawlops.fixtures import SQL
from crawlops.plans import alerts
from crawlops.schemas import EVENTS
from crawlops.streaming import jobs as streams
from crawlops.streaming import state
from tests.conftest import SMALL, rows

DAY = 86_400


@pytest.fixture(scope="module")
def days(spark, tables, tmp_path_factory):
    """The events in four files in time order."""
    folder = tmp_path_factory.mktemp("days")
    for i in range(4):
        part = tables.events.where(F.floor((F.dayofmonth("ts") - 1) / 8) == i)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, days, name=None):
    found = streams.stream_events(spark, days, EVENTS, 1)
    return spark.sql(SQL[name], events=found) if name else found


def test_breaker(spark, days):
    with state_store(spark):
        cut = streams.run_available(streams.stream_breaker(stream(spark, days, "proxy_results"), 2, 4 * DAY, "0 seconds"), "t")
    assert rows(cut) == rows(load().QUERIES["stream_breaker"](spark, SMALL))


def test_sticky(spark, days, tables):
    from crawlops.fixtures import AS_OF
    from crawlops.operators import proxies

    pool = proxies.indexed_proxies(tables.proxies, AS_OF)
    with state_store(spark):
        cut = streams.run_available(streams.stream_sticky(stream(spark, days, "proxy_results"), pool, DAY, 1), "t")
    whole = proxies.assign_sticky(tables.proxy_results.select("event_id", "ts", "job_id"), pool, DAY, 1)
    assert rows(cut, "event_id", "block_us", "proxy") == rows(whole, "event_id", "block_us", "proxy")


def test_heartbeat_reports_each_silence_once(spark, days):
    beats = stream(spark, days).select("event_id", F.col("user_id").alias("worker"), "ts")
    with state_store(spark):
        cut = streams.run_available(streams.stream_heartbeat(beats, DAY), "t")
    assert rows(cut.select("worker", F.col("last_beat").cast("timestamp_ntz"))) == rows(
        load().QUERIES["stream_heartbeat"](spark, SMALL).select("worker", "last_beat")
    )


def test_held_alerts(spark, days):
    gauges = [r for r in alerts.RULES if r.kind in streams.SAMPLE_KINDS]
    with state_store(spark):
        cut = streams.run_available(streams.stream_alerts(stream(spark, days, "samples"), gauges), "t")
    cols = ("alert", "event_id", "state")
    assert rows(cut, *cols) == rows(load().QUERIES["stream_alerts"](spark, SMALL), *cols)


def test_counters(spark, days):
    cut = streams.stream_counters(stream(spark, days), "event_type", F.col("user_id"))
    assert rows(cut) == rows(load().QUERIES["stream_counters"](spark, SMALL))


def test_hourly_closed_windows(spark, days):
    cut = streams.run_available(streams.stream_proxy_hourly(stream(spark, days, "proxy_results")), "t")
    assert rows(cut) == rows(load().QUERIES["stream_proxy_hourly"](spark, SMALL))


def test_rules_over_windows_are_refused_at_single_samples(spark, days):
    with pytest.raises(ValueError, match="busy"):
        streams.stream_alerts(stream(spark, days, "samples"), alerts.RULES)


SAMPLE = "event_id bigint, ts timestamp, metric string, instance string, value double"


def busy_day():
    """Samples every few minutes of all metrics from three instances: resets, silences, rows at the ends of steps."""
    import random

    dice, out = random.Random(8), []
    metrics = sorted({m for r in alerts.RULES for m in r.metrics})
    for k, metric in enumerate(metrics):
        for instance in ("n0", "n1", "10.0.0.7", "8.8.8.8"):
            value, t = 0.0, 1_704_067_200 + 60 * k
            while t < 1_704_067_200 + 9 * 3600:
                quiet = 3 * 3600 < t - 1_704_067_200 < 6 * 3600
                value = {
                    "up": float(dice.random() < 0.3), "db_up": float(dice.random() < 0.3), "mem_available": dice.choice([20.0, 50.0, 900.0]),
                    "mem_total": 1000.0, "disk_available": 90.0, "disk_total": 1000.0, "job_start_time": t - 5000.0, "worker_heartbeat": t - 400.0,
                    "proxy_success_rate": dice.choice([0.1, 0.5, 0.9]), "worker_memory_bytes": 2e9 + dice.randrange(9) - 1, "db_size_bytes": value + 1e8, "proxies_active": float(dice.randrange(14)),
                    "contacts_extracted": value + (0 if quiet else dice.choice([0, 0, 4000])), "jobs_done": value + (0 if quiet else dice.randrange(4)),
                }.get(metric, 0.0 if dice.random() < 0.02 else value + dice.randrange(4000))
                out.append((len(out), t, metric, instance, value))
                t += dice.choice([30, 60, 120, 300, 300, 900]) + (dice.random() < 0.03) * 7200
    return out


def judged(spark, made, order, files, folder, delay):
    """Rows of the stream over the samples, cut into files by ``order``."""
    rows_ = sorted(made, key=order)
    size = -(-len(rows_) // files)
    for i in range(files):
        part = spark.createDataFrame(rows_[i * size : (i + 1) * size], "event_id bigint, s bigint, metric string, instance string, value double")
        part.select("event_id", F.timestamp_seconds("s").alias("ts"), "metric", "instance", "value").coalesce(1).write.mode("append").parquet(folder)
    found = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(folder)
    with state_store(spark):
        return streams.run_available(streams.stream_rules(found, 300, delay=delay), "t")


def test_all_rules_at_any_split_as_in_batch(spark, tmp_path):
    import random

    made, dice = busy_day(), random.Random(2)
    late = {r[0]: r[1] + dice.randrange(3000) for r in made}
    cols = ("alert", "severity", "instance", "ts", "measure", "active_since", "state")
    one = rows(judged(spark, made, lambda r: r[0], 1, f"{tmp_path}/one", "1 hour"), *cols)
    many = rows(judged(spark, made, lambda r: late[r[0]], 7, f"{tmp_path}/many", "1 hour"), *cols)
    samples = spark.createDataFrame(made, "event_id bigint, s bigint, metric string, instance string, value double")
    samples = samples.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    whole = alerts.sustained(alerts.evaluate(alerts.cut(alerts.by_step(samples, 300)), 300), ["alert", "instance"], F.col("hold"))
    upto = samples.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("upto")).first()[0]
    batch = rows(whole.where(F.col("ts") < F.lit(upto)).withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "active_since")}), *cols)
    assert one == many == batch
    assert {r[0] for r in batch} == {r.name for r in alerts.RULES}


class Store(dict):
    """Map state of one key."""

    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


def test_crowded_keys_come_in_bounded_pieces(monkeypatch):
    dice = np.random.default_rng(1)
    monkeypatch.setattr(state, "PIECE", 5_000)
    monkeypatch.setattr(state, "MARKS", 50)
    whole = pd.DataFrame({"us": dice.integers(0, 400, 60_000) ** 2, "event_id": dice.permutation(60_000), "x": dice.random(60_000)})
    held = Store()
    pieces = list(state.in_order(iter([whole[i : i + 700] for i in range(0, 60_000, 700)]), held))
    assert max(map(len, pieces)) < 2.2 * 5_000 and held.most > 10 and not held
    pd.testing.assert_frame_equal(pd.concat(pieces, ignore_index=True), whole.sort_values(["us", "event_id"], ignore_index=True))
    assert list(state.in_order(iter([]), held)) == []
    assert [len(p) for p in state.in_order(iter([whole[:10], whole[:0]]), held)] == [10]


def test_state_machines_of_a_crowded_key(spark, tmp_path, monkeypatch):
    """One key holds nearly all rows of a batch: small pieces give what one piece gives."""
    dice = np.random.default_rng(2)
    made = [(i, 1_704_067_200 + int(s), 0 if i % 50 else i, bool(dice.random() < 0.6)) for i, s in enumerate(dice.integers(0, 90_000, 6_000))]
    table = spark.createDataFrame(made, "event_id bigint, s bigint, k bigint, success boolean")
    table.select("event_id", F.timestamp_seconds("s").alias("ts"), F.col("k").alias("proxy_id"), F.col("k").alias("job_id"),
                 F.col("k").alias("worker"), "success").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = "event_id bigint, ts timestamp, proxy_id bigint, job_id bigint, worker bigint, success boolean"
    pool = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "_index bigint, proxy string")
    found = []
    for piece in (100_000, 300):
        monkeypatch.setattr(state, "PIECE", piece)
        monkeypatch.setattr(state, "MARKS", 20)
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        with state_store(spark):
            found.append([
                rows(streams.run_available(s, "t"))
                for s in (streams.stream_breaker(events, 3, 600), streams.stream_sticky(events, pool, 700), streams.stream_heartbeat(events, 60))
            ])
    assert found[0] == found[1] and all(len(f) > 100 for f in found[0])


def test_late_rows_find_their_place(spark, tmp_path):
    """Settled rows: a state machine behind them gives the same for every split."""
    import random

    dice = random.Random(3)
    made = [(i, 1_704_067_200 + 40 * i, i % 3, dice.random() < 0.5) for i in range(900)]
    late = {r[0]: r[1] + dice.randrange(1500) for r in made}
    found = []
    for name, files, order in (("one", 1, lambda r: r[1]), ("many", 6, lambda r: late[r[0]])):
        ordered = sorted(made, key=order)
        for i in range(files):
            part = spark.createDataFrame(ordered[i * 900 // files : (i + 1) * 900 // files], "event_id bigint, s bigint, proxy_id bigint, success boolean")
            part.select("event_id", F.timestamp_seconds("s").alias("ts"), "proxy_id", "success").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        events = spark.readStream.schema("event_id bigint, ts timestamp, proxy_id bigint, success boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        with state_store(spark):
            waiting = streams.settled(events.withWatermark("ts", "30 minutes"))
            found.append(rows(streams.run_available(streams.stream_breaker(waiting, 3, 600, None), "t")))
    assert found[0] == found[1] and len(found[0]) > 800


def test_private_addresses_raise_no_alert(spark, tmp_path):
    times = [(i, 1000 * (i + 1), "dashboard_requests", ip, 500.0) for i, ip in enumerate(["10.0.0.1", "8.8.8.8"])]
    made = spark.createDataFrame(times, "event_id bigint, s bigint, metric string, instance string, value double")
    made.select("event_id", F.timestamp_seconds("s").alias("ts"), "metric", "instance", "value").write.parquet(f"{tmp_path}/in")
    found = spark.readStream.schema("event_id bigint, ts timestamp, metric string, instance string, value double").parquet(f"{tmp_path}/in")
    with state_store(spark):
        out = streams.run_available(streams.stream_alerts(found, [r for r in alerts.RULES if r.kind == "last_public"]), "t")
    assert rows(out, "instance") == [("8.8.8.8",)]


def test_seen_does_not_depend_on_batches(spark, days):
    with state_store(spark):
        cut = streams.run_available(streams.stream_unseen(stream(spark, days, "proxy_results")), "t")
    cols = ("scope", "normalized_url")
    assert rows(cut, *cols) == rows(load().QUERIES["stream_seen"](spark, SMALL), *cols)


def test_contacts_of_many_batches_equal_one(spark, tables, tmp_path):
    from crawlops.catalog.joins import stored
    from crawlops.fixtures import JOBS_AS_OF

    for i in range(3):
        tables.contact_items.where(F.col("item_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/items")
    whole = spark.readStream.schema(tables.contact_items.schema).parquet(f"{tmp_path}/items")
    parts = spark.readStream.schema(tables.contact_items.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/items")
    cols = ("email", "name", "created_at", "updated_at", "deleted_at", "id")
    one = rows(streams.stream_ingest(whole, stored(tables), JOBS_AS_OF), *cols)
    assert one == rows(streams.stream_ingest(parts, stored(tables), JOBS_AS_OF), *cols) and len(one) > 100


def test_seen_forgets_after_the_time_limit(spark, days):
    cut = streams.run_available(streams.stream_unseen(stream(spark, days, "proxy_results"), "1 day"), "t")
    keys = cut.select("scope", "normalized_url")
    assert keys.count() > keys.distinct().count()
    kept = streams.run_available(streams.stream_unseen(stream(spark, days, "proxy_results"), "60 days"), "t")
    assert kept.count() == keys.distinct().count()
