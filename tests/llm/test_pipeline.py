"""The pipeline's stages against brute force, and all registered queries on the smallest tables."""

import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from glyphward.llm import mixing, quality_classifier
from glyphward.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import linked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality(spark, stages):
    before, after = stages["quality"]
    judged = quality_classifier.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in judged.filter("predicted = 1").collect())


def test_exact(stages):
    before, after = (df.collect() for df in stages["exact"])
    best = {}
    for r in before:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())


def test_near(stages):
    before, after = (df.collect() for df in stages["near"])
    root, _ = linked([r.text for r in before])
    of = {r.doc_id: c for r, c in zip(before, root)}
    assert sorted(of[r.doc_id] for r in after) == sorted(set(root))


def test_mixed(stages):
    before, after = stages["mixed"]
    planned = mixing.plan_copies(before).collect()
    assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: r.copies for r in planned if r.copies})


def test_packed(stages):
    before, after = (df.collect() for df in stages["packed"])
    assert Counter(r.doc_id for r in after if r.start == 0) == Counter(r.doc_id for r in before)
    used = Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert all(n == 2048 for s, n in used.items() if s != max(used))


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() == stages["packed"][1].count() and found.columns == stages["packed"][1].columns


COLUMNS = {
    "op1_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_ngram_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_hmm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    found = dict(QUERIES[name](spark, SF).dtypes)
    assert {k: found.get(k) for k, _ in (c.split() for c in COLUMNS[name].split(", "))} == dict(c.split() for c in COLUMNS[name].split(", "))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = c.execute(ORACLE_SQL[name]).df()
    found = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    # A column of numbers with nulls is one of floats in one frame and not in the other.
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    rows = lambda frame: sorted(repr([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))
    assert rows(found) == rows(want)
