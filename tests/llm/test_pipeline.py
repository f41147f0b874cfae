"""Every stage against a plain version on the small sample, odd rows, extra columns."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as P
from wiretrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    good = rows[1]
    rows += [
        (5000, good[1], *good[2:]), (5001, "Start of a text, then " + item + " and on it goes as before.", "en", "s", 99), (5002, None, None, None, None), (5003, "", "en", "s", 0),
        (None, good[1], "en", None, 3), (5004, good[1] + " token=abcdefgh12345678 tail", "en", "s", 7), (5004, good[1] + " token=abcdefgh12345678 tail", "en", "s", 7),
    ]
    return spark.createDataFrame(rows, table.schema)


def test_stages(spark, docs):
    assert [n for n, _ in P.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "tokens"]
    quality = P.quality_stage(spark, docs, SF)
    good = {r.doc_id for r in quality.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((k in good) == (v == 1) for k, v in labels.items()) >= 0.95 * len(labels)

    near = P.near_copy_stage(spark, docs, SF)
    kept = near.collect()
    assert len({r.text for r in kept}) == len(kept) and {5000, 5004} - {r.doc_id for r in kept} and None in {r.doc_id for r in kept}

    clean = P.benchmark_stage(spark, docs, SF)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert 5001 in gone and 5003 not in gone and 5002 not in gone

    masked = {(r.doc_id, r.text) for r in P.secret_stage(spark, docs, SF).collect()}
    by = dict(masked)
    assert by[5004].endswith(" [secret] tail") and by[5002] is None and by[5003] == ""
    assert P.secret_stage(spark, docs, SF).count() == docs.count()
    for stage in (quality, near, clean, P.secret_stage(spark, docs, SF)):
        assert stage.columns == docs.columns

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(r.doc_id), lib.encode(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in P.token_stage(spark, docs, SF).collect()) == want


def test_extra_columns_and_empty(spark, docs):
    wide = docs.selectExpr("*", "1 AS secrets", "2 AS score", "'x' AS stat_upper", "3 AS bad", "4 AS _id", "5 AS doc")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_benchmark_items_take_only_their_own_rows(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item, "en", "s", 1), (None, "a clean text of seven words here", "en", "s", 1), (8, item, "en", "s", 1), (8, "another clean text", "en", "s", 1), (8, None, "en", "s", 0), (9, item, "en", "s", 1)]
    kept = P.benchmark_stage(spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, ((k, t) for k, t, *_ in rows if t != item)))


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < 200


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
