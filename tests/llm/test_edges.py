"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import bpe, decontaminate, html_extract, language_id, perplexity, secrets, sharding, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, sig string, _h int, key int, position string, group_id int, _row int, __gone_key int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil many purple turnips near a frozen harbour under pale moonlight and sing"
EXTRA = ("x", "y", 1, 2, "z", 3, 4, 5)


def rows():
    long = " ".join(f"{PROSE} {i}" for i in range(3000))
    texts = [None, "", " ", "!!! ???", "a", PROSE, PROSE, PROSE.upper(), long, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", "é" * 40]
    out = [(i, t, "en", "s0", 1, *EXTRA) for i, t in enumerate(texts)]
    out += [(None, PROSE, None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA), (5, PROSE, "en", "s0", 1, *EXTRA), (5, PROSE, "en", "s0", 1, *EXTRA), (20, PROSE + " extra", None, "s1", None, *EXTRA)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, empty):
    assert suffix_dedup.repeats(empty).count() == 0
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs, length=10, anchor=5).collect()}
    assert set(got) >= {5, 6, 7, 20} and None not in got and not {0, 1, 2, 3, 4} & set(got)
    assert got[6].start_word == 0 and got[6].n_words == len(PROSE.split())


def test_perplexity(docs, empty):
    assert perplexity.accepted(empty).count() == 0
    judged = {(r.doc_id, r.perplexity): r.keep for r in perplexity.judge(docs).collect()}
    assert len([k for k in judged if k[1] is None]) == 3  # null, empty and the null row
    assert not any(keep for (_, p), keep in judged.items() if p is None)
    assert all(keep for (i, p), keep in judged.items() if i in (5, 6, 20))


def test_bpe(docs, empty):
    assert bpe.encode(empty).count() == 0
    got = bpe.encode(docs).collect()
    assert len(got) == len(rows()) and all(r.round_trip for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (0, 1)] == [0, 0]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[0] == "" and back[5] == PROSE and back[8] == rows()[8][1]


def test_secrets(docs, empty):
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    (found,) = secrets.scan(docs).collect()
    assert found.doc_id == 9 and found.secret.startswith("0641")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r.doc_id: r.text for r in clean.collect()}[9] == 'token = "[SECRET]"'


def test_toxicity(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, None), (6, None, 1), (6, 1, 0), (None, 1, 1), (99, 1, 1)], none.schema)
    assert toxicity.toxic(docs, none).count() == 0 and toxicity.toxic(empty, some).count() == 0
    found = {r.doc_id for r in toxicity.toxic(docs, some, min_df=1, prior=0.5).collect()}
    assert not found & {0, 1, 2, 3}


def test_simhash(docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {5, 6, 7, 20} <= set(got) and not {0, 1, 2, 3, None} & set(got)
    assert {got[i].group_id for i in (5, 6, 7, 20)} == {5} and [i for i in got if got[i].keep] == [5]


def test_sharding(docs, empty):
    assert sharding.shard(empty).count() == 0
    out = sharding.shard(docs, shards=3)
    assert sorted(r.position for r in out.collect()) == list(range(len(rows())))
    assert set(out.columns) == {*docs.columns, "shard"} and {r.shard for r in out.collect()} == {0, 1, 2}
    assert out.groupBy("_id", "_row").count().count() == 1


def test_language(docs, empty, spark):
    assert language_id.identify(language_id.document_evidence(empty), ["doc_id"]).count() == 0
    kept = [r.doc_id for r in language_id.identify(language_id.document_evidence(docs), ["doc_id"]).collect()]
    assert {5, 6, 7, 8, 20, None} <= set(kept) and not {0, 1, 2, 3} & set(kept)
    undeclared = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(language_id.document_evidence(undeclared), ["doc_id"]).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "é" * 40), (5, PROSE)], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in (5, 6, 7, 8, 20) for i in (1, 5)} | {(10, 4)}


def test_html(spark):
    schema = "page_id long, url string, html string, host string, removed int"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    pages = [(1, None, None, "h", 1), (2, "http://a.example/1", "", "h", 1), (None, "nonsense", "<p>one<p>two", "h", 1), (3, "http://a.example/2", "<div>" * 3000 + "deep", "h", 1), (3, "http://a.example/2", "<b>open <i>tags", "h", 1), (4, "http://a.example/3", "a < b & c > d <", "h", 1)]
    got = {(r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(pages, schema)).collect()}
    assert got == {(1, ""), (2, ""), (None, "one\ntwo"), (3, "deep"), (3, "open tags"), (4, "a < b & c > d <")}


def test_stages(spark, docs, empty, tmp_path):
    items = spark.createDataFrame([(1, "seven wizards quietly boil many purple turnips near a frozen harbour")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, empty):
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= table.count()
            if name != "bpe":
                assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert kept.count((5, PROSE)) == 1 and (None, PROSE) not in kept and (6, PROSE) not in kept
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).where("doc_id = 5").count() == 0


def test_stages_judge_rows_not_ids(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60))
    item, a, b, c = (prose() for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(3, a), (5, a), (5, b), (7, item), (7, c), (None, item), (None, a), (None, "lonely " + prose()), (8, b + " tail"), (9, c), (9, c)]
    table = spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in rows], SCHEMA)
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_dedup(spark, table, str(tmp_path)).collect())
    assert kept == sorted((str(i), t) for i, t in [(3, a), (8, b + " tail"), (7, item), (9, c), rows[7]])
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, table, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(str(x) for x in rows if item not in x[1])


def test_language_stage_keeps_rare_languages(spark, tmp_path):
    english, french = "the and with from this house which they were near old river again".split(), "le chat dort sous une chaise dans notre maison bleue".split()
    rows = [(i, " ".join(random.Random(i).choices(english, k=30)), "en", "s", 1, *EXTRA) for i in range(100)] + [(200 + i, " ".join(random.Random(i).choices(french, k=30)), "fr", "s", 1, *EXTRA) for i in range(4)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(r[0], r[2]) for r in rows]


def test_language_stage_drops_rejected_documents_without_a_language(spark, docs, tmp_path):
    more = spark.createDataFrame([(30, "", None, "s0", 0, *EXTRA), (31, "\x01\x02\x03\x04\x05\x06\x07" * 40, None, "s0", 280, *EXTRA), (32, None, None, None, None, *EXTRA), (None, "", None, None, 0, *EXTRA)], SCHEMA)
    table = docs.unionByName(more)
    want = language_id.identify(language_id.document_evidence(table), ["doc_id"])
    out = corpus_pipeline.language(spark, table, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in want.collect())
    assert not {30, 31, 32} & {r.doc_id for r in out} and {5, 20} <= {r.doc_id for r in out}
    assert all(r.text and r.lang for r in out)
