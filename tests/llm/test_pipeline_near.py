"""The pipeline's near copies: documents whose word shingles agree to 80 % or more."""
import random
import subprocess
import sys

import corpus_pipeline
from helpers import docs_of, near_texts
from test_dedup import brute_components
from vocalake.llm import near_dedup


def test_stage_drops_copies_between_80_and_85_percent(spark, data):
    rng = random.Random(11)
    texts = near_texts(seed=8, groups=6)
    for _ in range(6):
        base = [f"w{rng.randrange(4_000)}" for _ in range(100)]
        texts.append(" ".join(base))
        for at in (20, 60):
            base[at] = f"w{rng.randrange(4_000)}"
        texts.append(" ".join(base))
    kept = {i for i, _, _, stays in brute_components(texts, 80) if stays}
    assert len(kept) < sum(c[3] for c in brute_components(texts, 85))
    docs = docs_of(spark, texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()} == kept


def test_bands_follow_from_the_similarity():
    assert near_dedup.band_count(85) == 20
    for percent in (50, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.band_count(percent) <= 1e-6
    assert (near_dedup.row_factors(28)[:80] == near_dedup.row_factors(20)).all()


def test_workers_need_no_copy_of_the_package():
    """Whatever a task calls travels by value, so nothing in it may be pickled by its name."""
    from pyspark import cloudpickle

    factors = near_dedup.row_factors(near_dedup.band_count(80))
    payload = cloudpickle.dumps(lambda text: near_dedup.band_keys(near_dedup.shingle_set(text, near_dedup.WordHashes()), factors))
    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print(len(f('a b c d e f')), 'vocalake' in sys.modules)"
    ran = subprocess.run([sys.executable, "-c", code], input=payload, capture_output=True, cwd="/")
    assert ran.stdout.split() == [b"28", b"False"], ran.stderr.decode()
