"""Posting lists against scans, and days that go as folders."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crawlops.operators import dayparts, filters, textindex
from crawlops.operators.textindex import TextIndex, grams_of, words_of
from tests.conftest import rows

FIELDS = ["name", "email", "org"]


@pytest.fixture(scope="module")
def contacts(tables):
    odd = [(9001, None, None, None), (9002, "", "", ""), (9003, "Ünï Çødé", "A_B%c@x.org", "50% off"), (9004, "ab", "bc", "cd")]
    extra = tables.spark.createDataFrame(odd, "id bigint, name string, email string, org string")
    return tables.contacts.select("id", *FIELDS).unionByName(extra).cache()


def test_words_as_by_scan(spark, contacts, tmp_path):
    index = TextIndex(spark, str(tmp_path / "w"), buckets=16).build(contacts, words_of(["name", "org", "email"]))
    for words in (["consulting"], ["CONSULTING", "nation_3"], ["nothing"], ["consulting", "nothing"], ["ünï", "çødé"], ["a_b", "c@x.org"]):
        assert rows(textindex.text_search(contacts, index, words), "id") == rows(filters.text_search(contacts, words), "id")
    plan = index.holding(["consulting", "nation_3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    with pytest.raises(ValueError):
        index.holding([])


def test_parts_of_words_as_by_scan(spark, contacts, tmp_path):
    index = TextIndex(spark, str(tmp_path / "g")).build(contacts, grams_of(FIELDS))
    dice, texts = random.Random(3), [t for r in contacts.collect() for t in r[1:] if t]
    needles = ["GMAIL", "a", "ab", "abc", "%mail%", "ada_auto", "50% off", "50\\% o", "Ü", "ÜNÏ", "ï ç", "zzzz", "b%c@", "d\x00a"]
    for text in dice.sample(texts, 10):
        at = dice.randrange(len(text))
        needles.append(text[at : at + dice.randrange(1, 9)].upper())
    for needle in needles:
        for literal in (False, True):
            asked = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else needle
            hit = F.lit(False)
            for c in FIELDS:
                hit = hit | F.coalesce(F.col(c).ilike(f"%{asked}%"), F.lit(False))
            assert rows(textindex.may_contain(contacts, index, needle, literal).where(hit), "id") == rows(contacts.where(hit), "id"), needle


def test_rows_are_dealt_out_before_their_terms(spark, tmp_path):
    """However few files the rows come in, every part makes terms of its own."""
    some = spark.range(25_000).coalesce(1).select("id", F.format_string("name %d", "id").alias("name"))
    index = TextIndex(spark, str(tmp_path / "d"), buckets=16).build(some, grams_of(["name"]))
    one = spark.read.parquet(index.folder).where("bucket = 3")
    assert one.select(F.input_file_name()).distinct().count() == 3
    assert rows(textindex.may_contain(some, index, "E 1234"), "id") == rows(some.where("name LIKE '%e 1234%'"), "id")


def test_expired_days_go_as_folders(spark, tmp_path):
    folder = str(tmp_path / "logs")
    log = spark.range(0, 960).select("id", (F.lit("2024-01-01 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("ts"))
    log = log.unionByName(spark.createDataFrame([(5000,)], "id bigint").withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    dayparts.store_days(log, "ts", folder)

    def files():
        return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}

    before = files()
    as_of = "2024-01-31 10:00:00"
    done = dayparts.expire_days(spark, folder, "ts", 10, as_of)
    assert done["dropped"] == [f"2024-01-{d:02d}" for d in range(1, 21)] and done["rewritten"] == ["2024-01-21"]
    wanted = rows(filters.retain(log, "ts", 10, as_of))
    assert rows(dayparts.read_days(spark, folder)) == wanted and len(wanted) < 960 - 480
    kept = {f: t for f, t in before.items() if f[4:14] > "2024-01-21"}
    assert kept and kept.items() <= files().items()
    after = files()
    assert dayparts.expire_days(spark, folder, "ts", 10, as_of) == {"dropped": [], "rewritten": []} and files() == after
    assert dayparts.expire_days(spark, folder, "ts", 9, "2024-01-30 23:45:00") ["dropped"] == ["2024-01-21"]
