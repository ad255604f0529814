"""Proxy pool: eligibility, ranking, assignment and state after a result log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlops.operators.filters import EPOCH
from crawlops.operators.skew import HOT_ROWS, Pieces, cut_hot, done, running
from crawlops.session import at, cut, micros


def eligible_proxies(df: DataFrame, as_of) -> DataFrame:
    """Active proxies out of cooldown whose breaker lets requests through.

    A proxy without breaker status passes only when its retry time is over.
    """
    now = at(as_of)
    return df.where(
        F.col("active")
        & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") < now))
        & ((F.col("circuit_breaker_status") != "open") | (F.col("circuit_breaker_next_attempt") < now))
    )


def eligible_simple(df: DataFrame, as_of, max_failures: int = 5) -> DataFrame:
    return df.where(
        F.col("active")
        & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") < at(as_of)))
        & (F.coalesce("consecutive_failures", F.lit(0)) < max_failures)
    )


def breaker_rank() -> Column:
    status = F.col("circuit_breaker_status")
    return F.when(status == "closed", 1).when(status == "half_open", 2).otherwise(3)


def _last_use() -> Column:
    return F.coalesce("last_used_at", at(EPOCH))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the given order, without one task seeing all rows.

    The rows are range-sorted and stored with their part and place in it; the
    place is then shifted by the sizes of the parts before.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1  # the low bits count within the part
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(ranged.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes = parts.groupBy("_part").agg(F.max("_place").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_part", "_place", "_offset")
    )


def full_order() -> list[Column]:
    return [
        breaker_rank(), F.col("priority").asc_nulls_last(), F.coalesce("success_rate", F.lit(1.0)).desc(),
        F.coalesce("average_latency_ms", "response_time_ms", F.lit(1000)).asc(), _last_use().asc(), F.col("id"),
    ]


def simple_order() -> list[Column]:
    return [
        F.col("priority").asc_nulls_last(), F.coalesce("success_rate", F.lit(1.0)).desc(),
        F.coalesce("response_time_ms", F.lit(0)).asc(), _last_use().asc(), F.col("id"),
    ]


def doc_order() -> list[Column]:
    return [
        F.col("priority").asc_nulls_last(), F.col("response_time_ms").asc_nulls_last(),
        F.col("success_rate").desc_nulls_first(), F.col("id"),
    ]


def rank_proxies(df: DataFrame, as_of) -> DataFrame:
    """Eligible proxies with their place in the selection order."""
    return numbered(eligible_proxies(df, as_of), full_order(), "rank")


def rank_simple(df: DataFrame, as_of, max_failures: int = 5) -> DataFrame:
    return numbered(eligible_simple(df, as_of, max_failures), simple_order(), "rank")


def rank_doc(df: DataFrame) -> DataFrame:
    return numbered(df.where("active"), doc_order(), "rank")


def top_proxies(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.where(F.col("active") & F.col("success_rate").isNotNull())
        .orderBy(F.col("success_rate").desc(), F.col("average_latency_ms").asc_nulls_last(), "id")
        .limit(n)
    )


def problem_proxies(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.where(F.col("active") & ((F.col("consecutive_failures") >= 3) | (F.col("circuit_breaker_status") != "closed")))
        .orderBy(F.col("consecutive_failures").desc_nulls_first(), F.col("last_failure_at").desc_nulls_first(), "id")
        .limit(n)
    )


def proxy_uri(scheme, host, port, username, password) -> Column:
    """Connection URI with credentials when there is a user name."""
    login = F.when(
        F.coalesce(username, F.lit("")) != "", F.concat(username, F.lit(":"), F.coalesce(password, F.lit("")), F.lit("@"))
    ).otherwise("")
    return F.concat(F.coalesce(scheme, F.lit("http")), F.lit("://"), login, host, F.lit(":"), port.cast("string"))


def proxy_client(scheme, host, port, username, password) -> Column:
    """Browser client settings: server address, and the login when there is one."""
    server = F.concat(F.coalesce(scheme, F.lit("http")), F.lit("://"), host, F.lit(":"), port.cast("string"))
    named = F.coalesce(username, F.lit("")) != ""
    return F.struct(
        server.alias("server"),
        F.when(named, username).alias("username"),
        F.when(named, F.coalesce(password, F.lit(""))).alias("password"),
    )


def mask_proxies(df: DataFrame) -> DataFrame:
    login = F.when(F.col("username").isNotNull(), F.concat("username", F.lit(":***@"))).otherwise("")
    return df.select(
        "id", "active", F.when(F.col("active"), "🟢").otherwise("🔴").alias("status_icon"),
        F.concat("scheme", F.lit("://"), login, "host", F.lit(":"), F.col("port").cast("string")).alias("proxy_url"),
        "created_at",
    ).orderBy(F.col("active").desc(), F.col("created_at").desc(), "id")


def touch(df: DataFrame, uses: DataFrame, counter: str, as_of) -> DataFrame:
    """Add the uses of each id to ``counter`` and stamp the rows that were used."""
    n = uses.groupBy("id").agg(F.count(F.lit(1)).alias("_uses"))
    used = F.col("_uses").isNotNull()
    return (
        df.join(n, "id", "left")
        .withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_uses", F.lit(0)))
        .withColumn("last_used_at", F.when(used, at(as_of)).otherwise(F.col("last_used_at")))
        .drop("_uses")
    )


def probe_update(proxies: DataFrame, probes: DataFrame, expected: int = 5) -> DataFrame:
    """Mean time of successful probes and their share of the expected ones; no success, no change."""
    ok = F.col("success")
    found = (
        probes.groupBy(F.col("proxy_id").alias("id"))
        .agg(F.count_if(ok).alias("_ok"), F.avg(F.when(ok, F.col("response_time_ms"))).alias("_ms"))
        .where("_ok > 0")
    )
    return (
        proxies.join(found, "id", "left")
        .withColumn("response_time_ms", F.coalesce(F.round("_ms", 3), F.col("response_time_ms").cast("double")))
        .withColumn("success_rate", F.coalesce(F.col("_ok") / F.lit(float(expected)), F.col("success_rate")))
        .drop("_ok", "_ms")
    )


def stored(df: DataFrame, name: str) -> Column:
    """A column that older tables may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast("timestamp_ntz")


def _with_runs(pieces: Pieces) -> Pieces:
    """Add ``failure_run`` and the number of the result within its proxy."""
    failed = F.when(F.col("success"), 0).otherwise(1)
    pieces = running(pieces, sums={"_fails": failed, "_nth": F.lit(1)})
    pieces = running(pieces, maxes={"_cleared": F.when(F.col("success"), F.col("_fails"))})
    run = F.col("_fails") - F.coalesce("_cleared", F.lit(0))
    pieces.df = pieces.df.withColumn("failure_run", run).drop("_fails", "_cleared")
    return pieces


def failure_runs(results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failures in a row at every result of a proxy; a success ends the run."""
    return done(_with_runs(cut_hot(results, ["proxy_id"], ["ts", "event_id"], hot_rows)).df).drop("_nth")


def apply_results(
    proxies: DataFrame, results: DataFrame, max_failures: int = 5, cooldown_seconds: int = 300, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Proxy rows after a result log.

    Every update reads the row as it was before the result: the success rate
    therefore lags one result behind, and a cooldown starts with the failure
    after the run has reached the limit.
    """
    order = F.struct("ts", "event_id")
    ok = F.col("success")
    runs = _with_runs(cut_hot(results, ["proxy_id"], ["ts", "event_id"], hot_rows))
    # a run that reaches back to the first result extends the stored one
    begins_log = F.col("failure_run") == F.col("_nth")
    known = (
        done(runs.df)
        .withColumn("_unbroken", ~ok & begins_log)
        .groupBy("proxy_id")
        .agg(
            F.count_if(ok).alias("_ok"),
            F.count_if(~ok).alias("_failed"),
            F.max(F.when(ok, F.col("ts"))).alias("_last_ok"),
            F.max(F.when(~ok, F.col("ts"))).alias("_last_failed"),
            F.max_by(F.when(ok, F.lit(1)).otherwise(0), order).alias("_last_was_ok"),
            F.max_by(F.col("failure_run"), order).alias("_run"),
            F.max_by(F.col("_unbroken"), order).alias("_run_from_start"),
            F.max_by(F.col("response_time_ms"), F.when(ok & F.col("response_time_ms").isNotNull(), order)).alias("_ms"),
            F.max(F.when(~ok & ~F.col("_unbroken") & (F.col("failure_run") > max_failures), F.col("ts"))).alias("_cool_1"),
            F.max(F.when(F.col("_unbroken"), F.struct("failure_run", "ts"))).alias("_head"),
        )
        .withColumnRenamed("proxy_id", "id")
    )
    old_run = F.coalesce("consecutive_failures", F.lit(0))
    stored_ok, total = F.coalesce("successful_requests", F.lit(0)), F.col("total_requests")
    ok_before_last = stored_ok + F.col("_ok") - F.col("_last_was_ok")
    rate = F.when(total > 0, ok_before_last / total).otherwise(F.when(F.col("_last_was_ok") == 1, 1.0).otherwise(0.5))
    # the last failure of the leading run already saw old_run + failure_run - 1 failures
    cool_head = F.when(old_run + F.col("_head.failure_run") - 1 >= max_failures, F.col("_head.ts"))
    cool_at = F.greatest("_cool_1", cool_head)
    seen = F.col("_run").isNotNull()
    return proxies.join(known, "id", "left").select(
        *[c for c in proxies.columns if c not in
          ("successful_requests", "failed_requests", "consecutive_failures", "success_rate", "response_time_ms",
           "cooldown_until", "last_success_at", "last_failure_at")],
        (stored_ok + F.coalesce("_ok", F.lit(0))).alias("successful_requests"),
        (F.coalesce("failed_requests", F.lit(0)) + F.coalesce("_failed", F.lit(0))).alias("failed_requests"),
        F.when(seen, F.col("_run") + F.when(F.col("_run_from_start"), old_run).otherwise(0))
        .otherwise(F.col("consecutive_failures")).alias("consecutive_failures"),
        F.when(seen, F.round(rate, 6)).otherwise(F.col("success_rate")).alias("success_rate"),
        F.coalesce("_ms", "response_time_ms").alias("response_time_ms"),
        F.coalesce(cool_at + F.make_dt_interval(secs=F.lit(cooldown_seconds)), "cooldown_until").alias("cooldown_until"),
        F.coalesce("_last_ok", stored(proxies, "last_success_at")).alias("last_success_at"),
        F.coalesce("_last_failed", "last_failure_at").alias("last_failure_at"),
    )


# ---------------------------------------------------------------- assignment


def draw(*parts: Column | str, seed: int = 0) -> Column:
    """Repeatable uniform integer below 2**32 from the given columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


BROADCAST_ROWS = 200_000


def indexed_proxies(proxies: DataFrame, as_of, order: list[Column] | None = None) -> DataFrame:
    """Eligible proxies with their index from 0 in selection order."""
    ranked = numbered(eligible_proxies(proxies, as_of), order or full_order(), "_rank")
    label = F.col("label") if "label" in proxies.columns else F.lit(None).cast("string")
    return ranked.select(
        F.col("id").alias("proxy"), (F.col("_rank") - 1).alias("_index"), label.alias("label"), "host", "success_rate", "response_time_ms"
    )


def _pool_size(indexed: DataFrame) -> int:
    return indexed.count()


def sized(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; a larger one takes the usual join."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def _by_index(requests: DataFrame, indexed: DataFrame, index: Column, n: int) -> DataFrame:
    """Requests spread evenly over the ``n`` pool indexes, so the join on the index is even too."""
    pool = sized(indexed.select("_index", "proxy"), n)  # empty pool, no assignment
    return requests.withColumn("_index", index).join(pool, "_index").drop("_index")


def assign_round_robin(requests: DataFrame, indexed: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Request number i takes the proxy at (start + i) modulo the pool size."""
    n = _pool_size(indexed)
    turn = numbered(requests, [F.col(c) for c in order], "_turn")
    return _by_index(turn, indexed, F.pmod(F.col("_turn") + start, F.lit(max(n, 1))), n).drop("_turn")


def assign_random(requests: DataFrame, indexed: DataFrame, key: str, seed: int = 0) -> DataFrame:
    n = _pool_size(indexed)
    return _by_index(requests, indexed, F.pmod(draw(key, seed=seed), F.lit(max(n, 1))), n)


def assign_weighted(
    requests: DataFrame, indexed: DataFrame, key: str, weights: dict[str, float] | None = None, seed: int = 0
) -> DataFrame:
    """Proxies are drawn in proportion to their weight: by label, or by host without one, else the default.

    The weights are laid end to end over the draw range; range and draws are cut
    into as many cells as there are proxies, and the join runs on the cell.
    """
    weights = weights or {}
    default = float(weights.get("default", 1.0))
    weight = F.lit(default)
    name = F.coalesce(F.nullif("label", F.lit("")), "host") if "label" in indexed.columns else F.col("host")
    for named, value in weights.items():
        if named != "default":
            weight = F.when(name == named, F.lit(float(value))).otherwise(weight)
    spans = running_total(indexed.withColumn("_w", weight), "_w")
    n, total = spans.agg(F.count(F.lit(1)), F.max("_upto")).first()
    if not total:  # nothing has weight: the last proxy serves all
        return requests.withColumn("_index", F.lit((n or 0) - 1).cast("long")).join(
            F.broadcast(indexed.select("_index", "proxy")), "_index"
        ).drop("_index")
    cell = lambda pick: F.least(F.floor(pick / F.lit(total) * F.lit(n)), F.lit(n - 1))
    spans = spans.where("_w > 0").select(
        "proxy", "_after", "_upto", F.explode(F.sequence(cell(F.col("_after")), cell(F.col("_upto")))).alias("_cell")
    )
    picks = requests.withColumn("_pick", draw(key, seed=seed) / F.lit(2.0**32) * F.lit(total))
    picks = picks.withColumn("_cell", cell(F.col("_pick")))
    return (
        picks.join(sized(spans, n), "_cell")
        .where((F.col("_after") <= F.col("_pick")) & (F.col("_pick") < F.col("_upto")))
        .drop("_cell", "_pick", "_after", "_upto")
    )


def running_total(indexed: DataFrame, weight: str, block: int = 4096) -> DataFrame:
    """Running sum by index: inside blocks of indexes, then over the block sums."""
    df = indexed.withColumn("_block", F.floor(F.col("_index") / block))
    sums = df.groupBy("_block").agg(F.sum(weight).alias("_s"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4096 proxies
    sums = sums.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_base") + F.sum(weight).over(inside)
    return df.join(sums, "_block").withColumn("_upto", upto).withColumn("_after", F.col("_upto") - F.col(weight)).drop("_block", "_base")


def assign_best(requests: DataFrame, proxies: DataFrame, as_of, max_failures: int = 5) -> DataFrame:
    """Every request takes the usable proxy with the best success rate, then the fastest."""
    best = (
        eligible_simple(proxies, as_of, max_failures)
        .orderBy(
            F.coalesce("success_rate", F.lit(0.5)).desc(), F.coalesce("response_time_ms", F.lit(1000)).asc(), *simple_order()
        )
        .limit(1)
        .select("id")
    )
    return requests.withColumn("proxy", best.scalar()).where(F.col("proxy").isNotNull())


def assign_first(requests: DataFrame, proxies: DataFrame, as_of, max_failures: int = 5) -> DataFrame:
    """Any other mode: the first proxy in selection order."""
    first = eligible_simple(proxies, as_of, max_failures).orderBy(*simple_order()).limit(1).select("id")
    return requests.withColumn("proxy", first.scalar()).where(F.col("proxy").isNotNull())


def sticky_blocks(requests: DataFrame, ttl: int = 300) -> DataFrame:
    """Start of the sticky block each request falls into.

    A block opens with the first request of a job and lasts ``ttl`` seconds from
    there; the next request after that opens another one.  Requests without job
    share one.  Block starts form a chain: each start leads to the first request
    at or after its end.  A pause of ``ttl`` or more always opens a block, which
    gives many independent chains; a chain is followed with jumps that double in
    every round.
    """
    span = ttl * 1_000_000
    requests = requests.withColumns({"_job": F.coalesce("job_id", F.lit(0)), "_us": micros("ts")})
    times = requests.groupBy("_job", "_us").agg(F.min("ts").alias("_ts"))
    pieces = running(cut_hot(times, ["_job"], ["_ts"]), previous={"_prev": F.col("_us")})
    opens = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= span)
    nodes = cut(done(pieces.df).select("_job", "_us", opens.alias("_opens")))

    # next request at or after the end: smallest node time seen so far when walking back in time
    none = F.lit(None).cast("long")
    probes = nodes.select("_job", (F.col("_us") + span).alias("_t"), none.alias("_node"), F.col("_us").alias("_from"))
    marks = nodes.select("_job", F.col("_us").alias("_t"), F.col("_us").alias("_node"), none.alias("_from"))
    both = marks.unionByName(probes).withColumns(
        {"_back": F.timestamp_micros(-F.col("_t")), "_kind": F.when(F.col("_from").isNull(), 0).otherwise(1)}
    )
    walked = running(cut_hot(both, ["_job"], ["_back", "_kind"]), maxes={"_nearest": -F.col("_node")})
    jumps = done(walked.df).where("_from IS NOT NULL").select("_job", F.col("_from").alias("_us"), (-F.col("_nearest")).alias("_to"))

    starts = nodes.where("_opens").select("_job", "_us")
    # a start whose jump leads to an opening node needs no following: that node is a start already
    jumps = cut(
        jumps.where(F.col("_to").isNotNull()).join(starts.withColumnRenamed("_us", "_to"), ["_job", "_to"], "left_anti")
    )
    reached, known = starts, starts.count()
    while not jumps.isEmpty():
        step = reached.join(jumps, ["_job", "_us"]).select("_job", F.col("_to").alias("_us"))
        reached = cut(reached.unionByName(step).distinct())
        before, known = known, reached.count()
        if known == before:
            break
        onward = jumps.select("_job", F.col("_us").alias("_to"), F.col("_to").alias("_far"))
        jumps = cut(jumps.join(onward, ["_job", "_to"]).select("_job", "_us", F.col("_far").alias("_to")))

    tagged = requests.join(reached.withColumn("_start", F.col("_us")), ["_job", "_us"], "left")
    walked = running(cut_hot(tagged, ["_job"], ["ts", "event_id"]), maxes={"block_us": F.col("_start")})
    return done(walked.df).drop("_us", "_start")


def assign_sticky(requests: DataFrame, indexed: DataFrame, ttl: int = 300, seed: int = 0) -> DataFrame:
    """All requests of a job in one block share the proxy drawn for the block."""
    n = _pool_size(indexed)
    blocks = sticky_blocks(requests, ttl)
    return _by_index(blocks, indexed, F.pmod(draw("_job", "block_us", seed=seed), F.lit(max(n, 1))), n).drop("_job")


def parse_proxy_lines(df: DataFrame, *keep: str) -> DataFrame:
    """Proxy lines: host:port, host:port:user:pass, scheme://host:port and scheme://user:pass@host:port."""
    line = F.trim(F.col("value"))
    shape = r"^(?:([A-Za-z0-9]+)://(?:([^:@/\s]+):([^@/\s]*)@)?)?([^:@/\s]+):([0-9]{1,5})(?::([^:@/\s]+):([^@/\s]*))?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(line, shape, i), F.lit(""))

    port = part(5).cast("int")
    scheme = F.lower(F.coalesce(part(1), F.lit("http")))
    tail_login_only = part(1).isNull() | part(6).isNull()
    valid = part(4).isNotNull() & port.between(1, 65535) & scheme.isin("http", "https", "socks5") & tail_login_only
    return df.select(
        *keep, line.alias("line"), scheme.alias("scheme"), part(4).alias("host"), port.alias("port"),
        F.coalesce(part(2), part(6)).alias("username"), F.coalesce(part(3), part(7)).alias("password"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
