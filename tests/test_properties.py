"""Merges: repeated and split batches, rule cases, and independence from partitioning."""

import datetime as dt

from pyspark.sql import functions as F

from crawlops.fixtures import JOBS_AS_OF
from crawlops.operators import jobs, merge, quality, reports
from crawlops.plans import extract
from crawlops.sources import readers, sinks
from tests.conftest import rows

CONTACT = "id bigint, name string, org string, email string, deleted_at timestamp_ntz, created_at timestamp_ntz"
ITEM = "item_id bigint, seen_at timestamp_ntz, query_id bigint, name string, org string, email string, phone string, country string, url string"
T0 = dt.datetime(2024, 1, 1)
FIELDS = ("email", "name", "org", "phone", "country", "url", "query_id")


def empty_base(spark):
    return spark.createDataFrame([], CONTACT)


def valid(items):
    return merge.clean_items(items).where("verdict = 'valid'")


def test_repeated_batch_changes_nothing(spark, tables):
    items = valid(tables.contact_items)
    once = merge.merge_contacts(empty_base(spark), items, JOBS_AS_OF).drop("action", "items")
    twice = merge.merge_contacts(once, items, JOBS_AS_OF)
    assert rows(once, *FIELDS) == rows(twice, *FIELDS)


def test_split_batch_equals_one_batch(spark, tables):
    items = valid(tables.contact_items)
    middle = "1995-01-01"
    first = merge.merge_contacts(empty_base(spark), items.where(f"seen_at < '{middle}'"), JOBS_AS_OF).drop("action", "items")
    split = merge.merge_contacts(first, items.where(f"seen_at >= '{middle}'"), JOBS_AS_OF)
    assert rows(split, *FIELDS) == rows(merge.merge_contacts(empty_base(spark), items, JOBS_AS_OF), *FIELDS)


def test_partitioning_does_not_matter(tables):
    items = valid(tables.contact_items)
    assert rows(merge.fold_items(items.repartition(7, "item_id"))) == rows(merge.fold_items(items.coalesce(1)))


def test_merge_rules(spark):
    base = spark.createDataFrame(
        [(1, "Ada Low", "Org A", "a@acme.org", None, T0), (2, "Old", "Org B", "b@acme.org", T0, T0)], CONTACT
    )
    items = spark.createDataFrame(
        [
            (1, T0, 7, "Ada Two", None, "A@acme.org", None, None, "bad"),
            (2, T0, 8, "Ada Longer", "", "a@acme.org", "12 34", "France", "http://x.org/1"),
            (3, T0, 9, "New Bob", None, "b@acme.org", None, None, None),
            (4, T0, 9, None, None, "noname@acme.org", None, None, None),
            (5, T0, 9, None, None, "jean.dupont@acme.org", None, None, None),
        ],
        ITEM,
    )
    out = {(r.email, r.deleted_at is None): r for r in merge.merge_contacts(base, valid(items), JOBS_AS_OF).collect()}
    a = out["a@acme.org", True]
    assert (a.name, a.org, a.phone, a.country, a.url, a.query_id, a.action) == ("Ada Longer", "Org A", "12 34", "France", "http://x.org/1", 8, "update")
    assert out["b@acme.org", True].action == "insert"
    assert out["b@acme.org", False].name == "Old"
    assert ("noname@acme.org", True) not in out
    assert out["jean.dupont@acme.org", True].name == "Jean Dupont"


def test_equal_length_keeps_the_old_name(spark):
    base = spark.createDataFrame([(1, "Abc", None, "a@acme.org", None, T0)], CONTACT)
    items = spark.createDataFrame([(1, T0, 1, "Xyz", None, "a@acme.org", None, None, None)], ITEM)
    assert merge.merge_contacts(base, valid(items), JOBS_AS_OF).first().name == "Abc"


def test_outcomes_add_up(spark, tables):
    out = reports.item_outcomes(extract.classify_items(empty_base(spark), tables.contact_items).withColumn("spider", F.lit("s"))).first()
    assert out.items_processed == out.items_saved + out.items_duplicates + out.items_invalid
    assert out.items_saved == valid(tables.contact_items).select("email").distinct().count()


def test_transition_cases(spark):
    queue = spark.createDataFrame(
        [(i, "in_progress", n, 3, None, 0, None, None) for i, n in enumerate([0, 1, 3, 0])],
        "id bigint, status string, retry_count int, max_retries int, last_error string, contacts_extracted int, next_retry_at timestamp_ntz, updated_at timestamp_ntz",
    )
    outcomes = spark.createDataFrame(
        [(0, True, None, 5, 4), (1, False, "boom", 5, 0), (2, False, "boom", 5, 0), (3, False, "Timeout after", 5, 0)],
        "id bigint, success boolean, error string, seconds int, contacts int",
    )
    out = jobs.transition(queue, outcomes, "2024-01-01 00:00:00").orderBy("id").collect()
    assert [r.status for r in out] == ["done", "pending", "failed", "failed"]
    assert [r.retry_count for r in out] == [0, 2, 4, 1]
    literal = jobs.transition(queue, outcomes, "2024-01-01 00:00:00", as_written=True).orderBy("id").collect()
    assert [r.retry_count for r in literal] == [0, 1, 4, 1]


def test_no_active_proxy_no_jobs(spark, tables):
    forms = spark.createDataFrame([(1, "https://a.org", "law")], "form_id int, urls string, keywords string")
    assert jobs.expand_jobs(forms, None, tables.proxies, JOBS_AS_OF).count() == 1
    assert jobs.expand_jobs(forms, None, tables.proxies.where("false"), JOBS_AS_OF).isEmpty()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "lang.json").write_text(
        '{"language_markers": {"fr": ["le ", "la "]}, "keywords": {"fr": {"law": ["avocat"]}}, '
        '"specialization_keywords": {"law": {"fr": ["visa"]}}, "quality_indicators": {"high": ["member"]}, "exclusion_patterns": {"generic": ["bot"]}}'
    )
    dims = readers.load_lang_dims(spark, str(tmp_path / "lang.json"))
    assert rows(dims, "kind", "lang", "term_group", "term", "ord") == sorted(
        [
            ("marker", "fr", None, "le ", 0), ("marker", "fr", None, "la ", 1), ("theme", "fr", "law", "avocat", 0),
            ("specialisation", "fr", "law", "visa", 0), ("quality", None, "high", "member", 0), ("exclusion", None, "generic", "bot", 0),
        ],
        key=repr,
    )
    assert readers.markers_of(dims) == {"fr": ["le ", "la "]}
    assert readers.load_lang_dims(spark).count() == 50
    (tmp_path / "countries.json").write_text('{"countries": ["Italy", "France", "Italy"]}')
    assert [r.country for r in readers.load_countries(spark, str(tmp_path / "countries.json")).collect()] == ["France", "Italy"]
    (tmp_path / "rules.json").write_text('{"contains": {"zeta": "z", "alpha": "a"}}')
    assert readers.load_error_rules(spark, str(tmp_path / "rules.json")) == [("zeta", "z"), ("alpha", "a")]
    (tmp_path / "copy.txt").write_text("1\ta\\tb\\\\n\tt\n2\t\\N\tf\n\\.\n")
    from pyspark.sql.types import StructType

    table = readers.read_copy(spark, str(tmp_path / "copy.txt"), StructType.fromDDL("id int, name string, ok boolean"))
    assert rows(table, "id", "name", "ok") == [(1, "a\tb\\n", True), (2, None, False)]
    path = str(tmp_path / "snap")
    for n in (1, 2):
        sinks.refresh_snapshot(spark.range(n), path, JOBS_AS_OF, n)
    assert sinks.read_snapshot(spark, path).count() == 2


def test_missing_tables(spark):
    spark.range(1).createOrReplaceTempView("present_table")
    actual = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")
    assert [r.name for r in reports.missing_tables(actual, ["present_table", "absent_table"]).collect()] == ["absent_table"]
    spark.catalog.dropTempView("present_table")


def test_evolve_and_orphans(spark):
    df = quality.evolve(spark.range(2), [("id", "bigint", 0), ("tag", "string", "x")])
    assert df.columns == ["id", "tag"]
    assert df.first().tag == "x"
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "cid int, pid int")
    assert [r.cid for r in quality.dq_orphans(child, spark.range(5), "pid", "id").collect()] == [2]
