"""Near-duplicates by five-word shingles, against brute force over all pairs."""

import random

import numpy as np
import pytest
from llm_support import ODD, passage

from sextant.llm import golay, jaccard_dedup, simhash_dedup


def sets_of(text):
    w = (text or "").encode("utf-8", "replace").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def kept_brute(rows):
    """Places of the rows that stay: the smallest id, then the first, of each component of pairs with similarity 0.8 or more."""
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 10 * shared >= 8 * either:  # empty sets are equal
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return sorted(rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))][0] for g in groups.values())


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Near copies on both sides of the similarity, in small groups and in one large one."""
    rng = random.Random(4)
    rows = [(i, passage(i, rng.randint(50, 120))) for i in range(25)]
    rows += [(100 + 10 * i + n, changed(rng, rows[i][1], n)) for i in range(25) for n in (1, 2, 3, 5)]
    rows += [(1000 + i, changed(rng, rows[0][1], rng.randint(1, 3))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [48, 2])
def test_one_of_each_group_of_near_copies_stays(make, copies, bucket):
    docs = make(copies)
    got = sorted(r["doc_id"] for r in jaccard_dedup.keep_one(docs, bucket=bucket).collect())
    assert got == kept_brute(copies)
    assert len(got) < simhash_dedup.keep_one(docs).count()  # two bits of 64 miss most of them


def test_pipeline_stage_takes_near_copies(spark, make, copies, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.near_dedup(spark, make(copies), str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(r["doc_id"] for r in got.collect()) == kept_brute(copies)


def test_odd_rows_fold_by_equal_sets(odd, empty):
    out = jaccard_dedup.keep_one(odd)
    assert out.columns == odd.columns and out.exceptAll(odd).count() == 0
    rows = [(r[0], r[1]) for r in ODD]
    key = lambda x: (x is None, x or 0)
    sets = {}
    for i, t in rows:
        sets.setdefault(sets_of(t), []).append(i)
    first = [min(g, key=key) for g in sets.values()]
    assert sorted((r["doc_id"] for r in out.collect()), key=key) == sorted(first, key=key)
    assert jaccard_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("shared, own", [(4, 1), (40, 5), (120, 15), (400, 50)])
def test_golay_keys_alone_find_the_similarity(shared, own):
    """Two sets of similarity 0.8 share a key, and every key has a Golay index of the fingerprint's segment in it."""
    rng = np.random.default_rng(shared)
    for _ in range(100):
        hashes = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
        sets = [np.unique(hashes[:shared]) if own == 1 else np.unique(hashes[: shared + own]), np.unique(np.delete(hashes, slice(shared, shared + own)))]
        keys = []
        for s in sets:
            band = jaccard_dedup.bands(s)
            key, there = jaccard_dedup.fuzzy_keys(band)
            near = golay.nearby(band & 0x7FFFFF)
            assert len(band) == jaccard_dedup.BANDS and (key[there] & 0xFFF == near[near >= 0]).all()
            keys.append(set(key[there].tolist()))
        assert keys[0] & keys[1]


def test_segments_are_majorities_of_bits():
    """Equal sets have equal segments, sets without common shingles differ in half of the bits; similar ones in 15 %."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 64, (2, 450), dtype=np.uint64)
    far = lambda a, b: sum(bin(int(d)).count("1") for d in jaccard_dedup.segments(a) ^ jaccard_dedup.segments(b)) / (23 * jaccard_dedup.BANDS)
    assert far(x, rng.permutation(x)) == 0 and 0.4 < far(x, y) < 0.6
    assert 0.1 < far(x, np.concatenate([x[:400], y[:50]])) < 0.2
