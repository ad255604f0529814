"""A table that grows by runs holds what a plain dictionary holds, and rewrites little."""

import random

from pyspark.sql import functions as F

from crawlops.fixtures import JOBS_AS_OF
from crawlops.operators.merge import clean_items, merge_contacts
from crawlops.streaming import jobs as streams
from crawlops.streaming.store import Store, merge_into
from tests.conftest import rows

ROW = "email string, n bigint, note string"


def change(spark, pairs):
    return spark.createDataFrame([(k, v, f"note {v}") for k, v in pairs.items()], ROW)


def added(old, new):
    """New rows of the touched keys: their numbers add up."""
    joined = new.alias("n").join(old.alias("o"), "email", "left")
    return joined.select("email", (F.col("n.n") + F.coalesce("o.n", F.lit(0))).alias("n"), "n.note")


def held(store, upto=None):
    return {r["email"]: r["n"] for r in store.read(upto).collect()}


def test_small_changes_write_little(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "email", 500)
    wanted = {f"a{i}@x.org": i for i in range(20_000)}
    first = store.write(-1, change(spark, wanted))
    assert [(r.rows, r.buckets) for r in first] == [(20_000, 64)]
    some = {f"a{i}@x.org": 1 for i in range(0, 20_000, 100)}
    made = merge_into(store, 0, change(spark, some), added)
    assert [(r.rows, r.buckets) for r in made] == [(200, 1)] and first[0] in store.cover()
    for k in some:
        wanted[k] += 1
    assert held(store) == wanted
    assert merge_into(store, 0, change(spark, some), added) == made and held(store) == wanted  # the same change again
    few = spark.createDataFrame([("a7@x.org",), ("none",)], "email string")
    assert [r["n"] for r in store.read(keys=few).collect()] == [7]
    plan = store.read(keys=few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan  # the other buckets are not read


def test_many_changes(spark, tmp_path):
    dice = random.Random(4)
    store, wanted, past, written = Store(spark, str(tmp_path / "t"), "email", 40), {}, {}, 0
    for i in range(-1, 24):
        size = 60 if i % 7 else 0
        new = {f"k{dice.randrange(900)}": dice.randrange(9) for _ in range(size)}
        before = held(store, i - 1) if i >= 0 else {}
        assert before == wanted
        made = store.write(i, change(spark, new)) if i < 0 else merge_into(store, i, change(spark, new), added)
        if i == 9:  # the attempt is lost after it has written, and made again
            made = merge_into(store, i, change(spark, new), added)
        for k, v in new.items():
            wanted[k] = wanted.get(k, 0) + v
        written += sum(r.rows for r in made)
        past[i] = dict(wanted)
        assert held(store) == wanted
        assert len(store.cover()) <= 8
    assert held(store, 22) == past[22]
    assert written < 6 * 24 * 60  # each row some times over
    assert len(store.runs()) <= len(store.cover()) + 8 and max(r.buckets for r in store.cover()) >= 8


def test_stored_contacts_as_merged_ones(spark, tables, tmp_path):
    from crawlops.catalog.joins import stored

    items, base = tables.contact_items, stored(tables)
    store, rest = streams.contact_store(base, str(tmp_path / "c"))
    assert streams.merge_items(store, 0, items.limit(0), JOBS_AS_OF) == []
    streams.merge_items(store, 1, items, JOBS_AS_OF)
    valid = clean_items(items).where("verdict = 'valid'").drop("verdict")
    whole = merge_contacts(base, valid, JOBS_AS_OF).drop("action", "items")
    found = store.read().unionByName(rest, allowMissingColumns=True)
    assert rows(found.select(*whole.columns), *whole.columns) == rows(whole, *whole.columns) and rest.count() > 0


def above(plan, mark):
    """Nodes over the first line with ``mark`` in a printed plan."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*(0123456789)")), []
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if here < depth:
            found.append(line.strip(" :+-*"))
            depth = here
    return found


def test_stored_tables_are_not_moved(spark, tables):
    from crawlops.catalog.joins import stored
    from crawlops.operators.stored import dealt_as, save_bucketed

    base = save_bucketed(stored(tables), ["email"], 8, "t")
    items = clean_items(tables.contact_items).where("verdict = 'valid'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_contacts(base, dealt_as(items, ["email"], 8), JOBS_AS_OF)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    over = above(plan, "Bucketed: true")
    assert any("SortMergeJoin" in n or "ShuffledHashJoin" in n for n in over) and not any("Exchange" in n for n in over), plan


def test_views_write_touched_groups_only(spark, tmp_path):
    from crawlops.streaming import views

    view = views.View(["g"], {"n": F.lit(1), "total": F.col("v")}, {"top": F.col("v")})
    schema = "id bigint, g string, v bigint"
    store, dice = Store(spark, str(tmp_path / "v"), "_key"), random.Random(5)
    now = {i: (dice.choice("abcdefgh") if i % 9 else None, dice.randrange(100)) for i in range(200)}
    asked = []

    def frame(table):
        return spark.createDataFrame([(i, g, v) for i, (g, v) in table.items()], schema)

    def rows_of(groups):
        wanted = {r["g"] for r in groups.collect()}
        asked.append(wanted)
        return frame({i: r for i, r in now.items() if r[0] in wanted})

    views.apply_changes(store, -1, view, views.signed(frame({}), frame(now)), rows_of)
    for change in range(6):
        before, groups = dict(now), set(dice.sample([None, *"abcdefghxy"], 2))
        for i in [i for i in now if now[i][0] in groups and dice.random() < 0.5]:
            now.pop(i)
        now |= {1000 * (change + 1) + i: (dice.choice(sorted(groups, key=str)), dice.randrange(120)) for i in range(3 * (change % 2))}
        old, new = {i: r for i, r in before.items() if now.get(i) != r}, {i: r for i, r in now.items() if before.get(i) != r}
        made = views.apply_changes(store, change, view, views.signed(frame(old), frame(new)), rows_of)
        touched = {r[0] for r in [*old.values(), *new.values()]}
        assert not made or made[0].rows == len(touched)
        found = {(r["g"], r["n"], r["total"], r["top"]) for r in views.read_view(store, view).collect()}
        assert found == {
            (g, sum(r[0] == g for r in now.values()), sum(r[1] for r in now.values() if r[0] == g), max(r[1] for r in now.values() if r[0] == g))
            for g in {r[0] for r in now.values()}
        }
    assert asked and all(len(w) <= 2 for w in asked)


def test_items_are_dealt_out_before_they_are_cleaned(tables, monkeypatch):
    """Orders of one file would be cleaned by one task."""
    seen = []
    monkeypatch.setattr(streams, "merge_into", lambda store, change, changed, merge: seen.append(changed))
    streams.merge_items(None, 0, tables.contact_items.coalesce(1), "2024-01-01 00:00:00")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [item_id" in plan and seen[0].count() > 0
