"""The corpus pipeline, stage by stage."""

import pytest

import corpus_pipeline
from crawlops.llm.secret_scan import scanner
from tests.conftest import SMALL
from tests.llm.conftest import ODD
from tests.llm.test_classes import plain_classes, plain_print
from tests.llm.test_tokens import check_pieces

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert list(STAGES) == ["toxicity", "near_dedup", "secrets", "packing"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage stored, from the given documents."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SMALL).write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    return kept


def test_each_stage_on_its_input(spark, tables):
    docs, clean, single, blank, pieces = tables
    assert docs.columns == clean.columns == single.columns == blank.columns
    assert 0 < clean.count() < docs.count() and clean.exceptAll(docs).count() == 0
    own = [(r["doc_id"], plain_print(r["text"])) for r in clean.collect()]
    wanted = sorted(i for i, _, low in plain_classes(own) if i == low)
    assert sorted(r["doc_id"] for r in single.collect()) == wanted and single.exceptAll(clean).count() == 0
    scan = scanner(corpus_pipeline.BYTE_RANKS, corpus_pipeline.public_tokenizers.PATTERN)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r for r in blank.collect()}
    assert set(before) == set(after)
    for doc, text in before.items():
        assert not scan(after[doc]["text"]) and after[doc]["n_chars"] == len(after[doc]["text"])
        assert scan(text) or after[doc]["text"] == text
    check_pieces(pieces.collect(), [(r["doc_id"], r["text"]) for r in after.values()])


def test_run_gives_the_last_stage(spark, tables):
    found = corpus_pipeline.run(spark, SMALL)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert found.select(names).exceptAll(tables[-1].select(names)).count() == 0 and found.count() == tables[-1].count()


def test_odd_rows(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
        kept = stage(spark, odd, SMALL)
        if name != "packing":
            assert kept.columns == odd.columns
    assert STAGES["toxicity"](spark, odd, SMALL).count() == len(ODD)
    single = STAGES["near_dedup"](spark, odd, SMALL)
    classes = {low if low is not None else p for _, p, low in plain_classes([(r[0], plain_print(r[1])) for r in ODD])}
    assert single.count() == len(classes) and single.where("doc_id = 5").count() == 1
    blank = STAGES["secrets"](spark, odd, SMALL)
    assert blank.where("text is null").count() == 2 and blank.where("text like '%9b0b3c6a%'").count() == 0
