"""Shingle hashes of the n-gram join, and what its tasks leave in a Python worker."""

import random
import sys

import pyarrow as pa

from wavegrid.llm import ngram_join


def test_shingle_hashes_tell_shingles_apart():
    """Few words in every order: equal hashes if and only if equal shingles, over many texts."""
    rng, hashes = random.Random(3), {}
    for _ in range(400):
        words = [rng.choice("aAbcdé") for _ in range(rng.randint(0, 60))]
        lower = [w.replace("A", "a") for w in words]
        width = min(5, len(lower))
        want = {tuple(lower[k : k + width]) for k in range(len(lower) - width + 1)} if words else set()
        got = ngram_join.shingle_set(" \n".join(words))
        assert len(got) == len(want) and got.tolist() == sorted(set(got.tolist()))
        for k in range(len(lower) - width + 1) if words else ():
            one = ngram_join.shingle_set(" ".join(words[k : k + width]))
            assert len(one) == 1 and hashes.setdefault(tuple(lower[k : k + width]), one[0]) == one[0] and one[0] in got
    assert len(set(hashes.values())) == len(hashes) > 1000
    assert len(ngram_join.shingle_set(None)) == len(ngram_join.shingle_set(" \t")) == 0


def test_workers_keep_no_words(spark):
    """The memory of a worker does not grow with the distinct words that it has seen."""
    rows = [(k, " ".join(f"w{k}x{j % (190 + k % 2)}" for j in range(200))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert ngram_join.near_duplicates(docs).count() == 200

    def kept(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(v) if hasattr(v, "__len__") else 1 for v in sys.__dict__.get("_wavegrid_kept", {}).values()], pa.int64())], names=["n"])

    assert [r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n bigint").collect()] == []
