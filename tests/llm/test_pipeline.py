"""The pipeline on a small fixture with planted cases, stage by stage against what plain Python expects."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

EN = "the quick brown fox jumps over that lazy dog while we were watching from this house with some friends and more".split()
DE = "der schnelle braune fuchs springt über den faulen hund während wir aus dem haus zusahen mit freunden und mehr".split()
PASSAGE = " ".join(f"question{i}" for i in range(30))
SECRET = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"


def _text(words, seed, n=60):
    return " ".join(random.Random(seed).choices(words, k=n))


def _rows():
    rows = [(i, _text(EN, i), "en") for i in range(60)] + [(100 + i, _text(DE, 100 + i), "de") for i in range(60)]
    rows += [(200, _text(EN, 0), "en"), (201, _text(EN, 0).replace("fox", "fox", 1) + " tail", "en")]  # copies of 0
    rows += [(210, _text(EN, 500) + " " + PASSAGE, "en")]
    rows += [(220, _text(EN, 501) + f' token = "{SECRET}" and more', "en")]
    rows += [(230, None, "en"), (231, "", "en"), (232, "12 ?!", "en")]
    rows += [(240, " ".join(EN[:15] + DE[:15]), None), (None, _text(DE, 502), "de")]
    rows += [(250, _text(EN, 503, 30_000), "en"), (260, _text(EN, 504), "en"), (260, _text(EN, 504), "en")]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = docs.withColumns({c: F.lit(1) for c in ("label", "score", "_key", "ids", "row", "data", "kept", "h1")})
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, tables):
    import corpus_pipeline
    from podium.llm.common import written

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    left = [i for i, *_ in _rows()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, tables), name)
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        seen.append((name, sorted({x for x in left if x not in now}, key=str), len(now)))
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name == "secret_scan":
            texts = {r.doc_id: r for r in docs.select("doc_id", "text", "n_chars").collect()}
            assert SECRET not in texts[220].text and texts[220].n_chars == len(texts[220].text)
            plain = {i: t for i, t, _ in _rows()}
            assert all(r.text == plain[i] for i, r in texts.items() if i != 220)
        left = now
    n = len(_rows())
    assert seen == [
        ("language_id", [230, 231, 232], n - 3),
        ("near_duplicates", [200, 201], n - 5),
        ("benchmark_decontamination", [210], n - 6),
        ("secret_scan", [], n - 6),
        ("bpe_encoding", [], n - 6),
    ]


def test_run_encodes_what_is_left(spark, tables):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from podium.llm import bpe

    library = Tokenizer.from_file(bpe.vocabulary_path())
    plain = {i: t for i, t, _ in _rows()}
    rows = corpus_pipeline.run(spark, tables).collect()
    assert len(rows) == len(_rows()) - 6
    for r in rows:
        if r.doc_id == 220:
            continue
        ids = library.encode(plain[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table_passes(spark, tables, tmp_path):
    import corpus_pipeline

    base = f"file://{tmp_path}"
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").limit(0).write.parquet(f"{base}/benchmark.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
