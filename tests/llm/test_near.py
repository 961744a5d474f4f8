"""Near-duplicate groups: recall, universes of long texts, hot buckets, groups parted by rare shingles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import near_dedup

from .helpers import blank_words, frame, random_texts


def _set(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


def _groups(texts, size, percent):
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := blank_words(t)) else set() for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def test_circulant_signatures():
    minhash, rng = near_dedup.CirculantMinHash(64), np.random.default_rng(0)
    sets = [_set(rng, n) for n in (1, 5, 20000, 300)] + [np.zeros(0, np.uint64)]
    got = minhash.signatures(sets)
    for s, row in zip(sets[:-1], got, strict=False):
        at = minhash.place(s)
        assert all(minhash.second(at + np.uint32(k)).min() == row[k] for k in range(64))
    assert (got[-1] == np.iinfo(np.uint32).max).all()


def test_both_permutations_are_bijections():
    minhash = near_dedup.CirculantMinHash(1)
    some = np.random.default_rng(1).integers(0, 1 << 32, 1 << 20, dtype=np.uint64).astype(np.uint32)
    distinct = len(np.unique(some))
    assert len(np.unique(minhash.second(some))) == distinct
    assert len(np.unique(minhash.place(some.astype(np.uint64) << np.uint64(32)))) == distinct


def test_disjoint_sets_of_a_million_share_no_band():
    rng = np.random.default_rng(2)
    a, b = _set(rng, 1_000_000), _set(rng, 1_000_000)
    one, two = near_dedup.low_bytes(near_dedup.CirculantMinHash(240).signatures([a, b]))
    assert (one == two).mean() < 0.03
    assert not (one.reshape(40, 6) == two.reshape(40, 6)).all(axis=1).any()


@pytest.mark.parametrize("share", [0.85, 0.87, 0.9])
def test_bands_find_pairs_at_the_threshold(share):
    """Of 400 pairs of each similarity all share a band: the chance of a miss is below 1e-8 a pair."""
    minhash, rng = near_dedup.CirculantMinHash(near_dedup.ROWS * near_dedup.BANDS), np.random.default_rng(3)
    for n in (20, 100, 400):
        both = int(np.ceil(2 * n * share / (1 + share)))
        sets = []
        for _ in range(130):
            own = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            sets += [own[:n], own[n - both :]]
        low = near_dedup.low_bytes(minhash.signatures(sets)).reshape(-1, 2, near_dedup.BANDS, near_dedup.ROWS)
        assert (low[:, 0] == low[:, 1]).all(axis=2).any(axis=1).all()


def test_sketch_never_rules_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 3000, 90_000):
        for both in (int(n * 0.95), int(n * 0.9), n):
            own = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            a, b = np.sort(own[:n]), np.sort(own[n - both :])
            s = near_dedup.sketches([a, b])
            for percent in (70, 80, 90, 100):
                may = near_dedup.possible(s[0], len(a), s[1:], np.array([len(b)]), percent)[0]
                assert may or not near_dedup.similar(a, b, percent)
    a, b = _set(rng, 1000), _set(rng, 1000)
    s = near_dedup.sketches([a, b])
    assert not near_dedup.possible(s[0], 1000, s[1:], np.array([1000]), 80)[0]


@pytest.mark.parametrize("many", [0, 3, 10**6])
def test_groups_however_buckets_are_parted(spark, many):
    texts = [*random_texts(150, 21, words=60), None, "", "a", "A", "a b"]
    for size, percent in ((3, 85), (2, 80)):
        got = near_dedup.near_groups(frame(spark, texts), size, percent, block_members=many).collect()
        want = _groups(texts, size, percent)
        assert all(r.component_id == want[r.doc_id] for r in got)


def test_hot_bucket_of_unlike_members(spark):
    """Thousands that share half of their words, and some bands: not compared pair by pair."""
    n, shared = 4000, " ".join(f"s{k}" for k in range(60))
    own = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("d"), F.col("id"), F.lit("x"), k)))
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), own).alias("text"))
    twins = docs.filter("doc_id % 500 = 0").select((F.col("doc_id") + n).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"))
    got = near_dedup.near_groups(docs.union(twins), 1, 85, block_members=500).filter("not kept").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(n + k, k) for k in range(0, n, 500)]
