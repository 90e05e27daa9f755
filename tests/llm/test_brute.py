"""Operators that SQL cannot express against brute force, an exact round trip or held-out accuracy; others against SQL."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from podium.llm import bpe, language_crf, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.SQL[name])


def test_suffix_dedup(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = Counter(b[i : i + 200] for b in texts.values() for i in range(len(b) - 199))
    for r in queries.QUERIES["op10_suffix_dedup"](spark, sf_dir).collect():
        b = texts[r.doc_id]
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, y in zip(b, gone, strict=False) if not y)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_bpe_like_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    own = bpe.WordBPE(bpe.vocabulary_path())
    odd = ["", "a<|endoftext|>b", "It's We'RE 'sub É ΑΣ Σ İx", "\x1c a\x1db \x85 c", "x" * 5000, "日本語 12345 ½", "...'''s"]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        found, decoded = own.encode(text)
        assert np.frombuffer(found, dtype=np.int32).tolist() == ids
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(150, 3)), rng.normal(size=(3, 3))
    cut = np.array([0, 0, 1, 70, 150])
    found, pairs = language_crf.marginals(scores, cut, moves)
    expected = np.zeros((3, 3))
    for a, b in zip(cut, cut[1:], strict=False):
        if b == a:
            continue
        t, e = np.exp(moves), np.exp(scores[a:b])
        forward, backward = np.zeros((b - a, 3)), np.ones((b - a, 3))
        forward[0] = (np.full(3, 1 / 3) @ t) * e[0]
        for i in range(1, b - a):
            forward[i] = (forward[i - 1] @ t) * e[i]
            forward[i] /= forward[i].sum()
        for i in range(b - a - 2, -1, -1):
            backward[i] = t @ (e[i + 1] * backward[i + 1])
            backward[i] /= backward[i].sum()
        g = forward * backward
        assert np.allclose(found[a:b], g / g.sum(axis=1, keepdims=True))
        for i in range(1, b - a):
            x = forward[i - 1][:, None] * t * (e[i] * backward[i])[None]
            expected += x / x.sum()
    assert np.allclose(pairs, expected)


def test_language_held_out(spark, sf_dir):
    found = queries.QUERIES["op9_language_crf"](spark, sf_dir).filter("held_out")
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.6), ("op7_quality_fm", "quality", 0.8)])
def test_held_out_ranking(spark, sf_dir, name, label, least):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    high, low = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in high for b in low)
    assert wins / (len(high) * len(low)) > least


def test_secret_findings(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.QUERIES["op3_secret_forest"](spark, sf_dir).collect()
    planted = texts.filter(F.col("text").rlike(r'token = "[0-9a-f]{40}"') | F.col("text").rlike(r"\bAKIA[A-Z0-9]{16}\b"))
    assert {r.doc_id for r in planted.select("doc_id").collect()} == {r.doc_id for r in found if r.secret}
    assert not [r for r in found if r.kind == "other" and r.secret]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from podium.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids and left
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs, ids = out, set(left)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(ids)
