"""The corpus pipeline against plain Python on the whole small tables."""
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from helpers import awkward, empty
from test_dedup import brute_components, brute_lines
from test_text import packed_well
from vocalake.llm import secrets, tokens, toxicity
from vocalake.llm.tokens import load_encoding


@pytest.fixture(scope="module")
def expected(spark, data):
    """Every stage in turn on Python lists; only the trained field is shared with the pipeline."""
    import public_tokenizers

    docs = spark.read.parquet(f"{data}/documents.parquet")
    field = toxicity.train_on(docs, spark.read.parquet(f"{data}/labels.parquet"))
    table = field.potentials()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [(i, t) for i, t in rows if field.score(field.evidence(toxicity.WORD.findall(t), table)[0]) < toxicity.REJECT]
    rejected = docs.count() - len(rows)
    cleaned = brute_lines([t for _, t in rows])
    rows = [(rows[i][0], text) for i, _, _, text in cleaned]
    kept = [c[3] for c in brute_components([t for _, t in rows], corpus_pipeline.NEAR_PERCENT)]
    rows = [row for row, stays in zip(rows, kept) if stays]
    rows = [(i, secrets.masked(t, secrets.scan(t))) for i, t in rows]
    encoding, _ = load_encoding(public_tokenizers.path(tokens.RANK_FILE))
    pieces = []
    for i, t in rows:
        ids = np.array(encoding.encode_ordinary(t) + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        pieces += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return rejected, sorted(pieces)


def test_pipeline_equals_plain_python(spark, data, expected):
    rejected, pieces = expected
    rows = __spark_entry__.queries()["pipeline"](spark, data).collect()
    assert rejected > 0
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    total = sum(p[3] for p in pieces)
    assert packed_well(rows, 2048) <= -(-total // 2048) + 2


def test_stages_keep_the_columns_and_take_effect(spark, data):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.filter("n_chars <> char_length(text)").isEmpty()


def test_stages_on_awkward_and_empty_documents(spark, data):
    clashing, _ = awkward(spark)
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), data).count() == 0, name
        found = stage(spark, plain, data)
        assert found.count() > 0, name
        if name != "best_fit_packing":
            assert found.columns == plain.columns


def test_entry_point_lists_the_queries():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert [name for name in names if name.startswith(f"op{n}_")], n
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
