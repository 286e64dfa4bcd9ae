"""The pipeline's stages against brute force, and its result as a whole."""

import os
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docspark.llm import bpe, simhash
from docspark.llm.common import BATCH_BYTES, arrow_map, written

from .test_brute_force import brute_containment


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents, and the rows after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs.collect()))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "bpe"]
    for _, rows in stages[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    sizes = [len(rows) for _, rows in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] == sizes[5] > 0.5 * sizes[0]


def test_language_stage(stages):
    before, after = ({r.doc_id: r for r in stages[i][1]} for i in (0, 1))
    assert set(after) <= set(before) and all(after[i].text == before[i].text for i in after)
    assert len(after) >= 0.98 * len(before)
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.95 * len(after)


def test_dedup_stage(stages):
    before, after = stages[1][1], {r.doc_id for r in stages[2][1]}
    sig, mins, count = simhash.signatures_of(pa.array([r.text for r in before]))
    agree = int(np.ceil((0.35 + 0.65 / 256) * simhash.MINIMA))
    near = (np.bitwise_count(sig[:, None] ^ sig[None, :]) <= 10) & ((mins[:, None] == mins[None]).sum(axis=2) >= agree) & (count > 0)[:, None] & (count > 0)[None]
    np.fill_diagonal(near, False)
    kept = np.array([r.doc_id in after for r in before])
    assert not near[np.ix_(kept, kept)].any()  # no near duplicates are left
    assert all(near[i].any() for i in np.flatnonzero(~kept))  # and nothing else has gone
    reached = {i for i in np.flatnonzero(kept)}
    while True:
        more = reached | {j for i in reached for j in np.flatnonzero(near[i])}
        if more == reached:
            break
        reached = more
    assert len(reached) == len(before)  # every group has one left


def test_decontamination_stage(stages, spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in stages[2][1]]
    leaks = {d for d, _ in brute_containment(before, items)}
    assert {d for d, _ in before} - {r.doc_id for r in stages[3][1]} == leaks


def test_secret_stage(stages):
    pattern = re.compile(r"password=[0-9a-f]{18}|token = \"[0-9a-f]{40}\"|AKIA[A-Z0-9]{16}")
    before, after = ({r.doc_id: r for r in stages[i][1]} for i in (3, 4))
    for i, r in after.items():
        assert not pattern.search(r.text) and r.n_chars == len(r.text)
        if not pattern.search(before[i].text):
            assert r.text == before[i].text


def test_token_stage(stages):
    v, texts = bpe.Vocabulary(), {r.doc_id: r.text for r in stages[4][1]}
    for r in stages[5][1]:
        assert r.n_tokens == len(r.tokens) and r.round_trip
        assert bpe.decode_ids(v, np.array(r.tokens, np.int64), np.array([len(r.tokens)])).to_pylist()[0].decode() == texts[r.doc_id]


def test_run(spark, sf, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in stages[5][1])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_bound_batches(spark, sf, stage):
    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "word " * 2000
    spark.conf.unset(key)
    stage(spark, spark.createDataFrame([(1, text, "en", "a.example", len(text))], "doc_id long, text string, lang string, source string, n_chars long"), sf)
    rows = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('word ', 2000) || id AS text")

    def sizes(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    got = arrow_map(rows, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 1500 and max(r.size for r in got) < BATCH_BYTES + 2 * len(text)
    spark.conf.set(key, "1m")
    corpus_pipeline.bounded_batches(spark)
    assert spark.conf.get(key) == "1m"  # a smaller setting stays
    spark.conf.unset(key)


def test_workers_give_memory_back(spark):
    """What a task freed isn't held when the next one starts in the same worker."""
    resident = "int(next(x for x in open('/proc/self/status') if x.startswith('VmRSS')).split()[1]) // 1024"
    held = {}

    def fill(batch):
        held["all"] = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces, of which some stay: malloc keeps the gaps
        sys.modules["__kept"] = held["all"][::50]
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([eval(resident)])], names=["pid", "mb"])

    def look(batch):
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([eval(resident)])], names=["pid", "mb"])

    one = spark.range(0, 1, 1, 1)
    full = arrow_map(one, fill, "pid long, mb long", held.clear).collect()[0]
    after = [r for r in (arrow_map(one, look, "pid long, mb long").collect()[0] for _ in range(16)) if r.pid == full.pid]
    assert full.mb > 256 and after and after[0].mb < full.mb - 200
