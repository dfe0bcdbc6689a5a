"""MinHash near-deduplication against brute force."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import minhash

DOCS = "doc_id long, text string, n string, set int, node string, root int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "x", 2) for i, t in rows], DOCS).repartition(4)


def set_of(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=85, size=3):
    found = [set_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= percent * (len(found[i]) + len(found[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (n, _) in enumerate(rows):
        least[top(i)] = min((x for x in (n, least.get(top(i))) if x is not None), default=None)
    return sorted(((n, len(found[i]), least[top(i)], n == least[top(i)]) for i, (n, _) in enumerate(rows)), key=str)


def corpus(seed, groups=8, copies=12):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ẞß", "X y"]
    rows, n = [], 0
    shared = " ".join(r.choices(vocabulary, k=60))
    for _ in range(groups):
        words = r.choices(vocabulary, k=r.choice([3, 8, 30, 200, 600]))
        for _ in range(r.randint(1, copies)):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            text = r.choice([" ", "\n", "\t \x0b"]).join(own)
            rows.append((n * 7 % 5003, (text.upper() if r.random() < 0.3 else text) + ((" " + shared) if r.random() < 0.2 else "")))
            n += 1
    return rows + [(4001, None), (4002, ""), (4003, " \n"), (4004, "a b"), (4005, "A  b"), (None, "a b"), (None, "lone words here now"), (None, None), rows[0], rows[0], (4006, "long " * 300_000), (4007, " ".join(map(str, range(150_000)))), (4008, " ".join(map(str, range(2_000, 150_000))))]


@pytest.mark.parametrize("seed, percent, size, tile, known", [(1, 85, 3, 512, 2_000_000), (2, 85, 3, 4, 0), (3, 80, 5, 512, 2_000_000)])
def test_components(spark, seed, percent, size, tile, known):
    rows = corpus(seed)
    got = minhash.minhash_dedup(rows_of(spark, rows), size, percent, tile=tile, known=known)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, percent, size)


def test_group_whose_least_is_an_outlier(spark):
    """A chain: neighbours are linked, ends aren't, and all share most of a long passage."""
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join(base[4 * k :] + [f"e{j}" for j in range(4 * k)])) for k in range(40)]
    got = minhash.minhash_dedup(rows_of(spark, rows), tile=8)
    want = brute(rows)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want and {x[2] for x in want} == {0}


def test_shared_passage_links_nothing(spark):
    passage = " ".join(f"p{k}" for k in range(100))
    rows = [(k, passage + " " + " ".join(f"q{k}x{j}" for j in range(40))) for k in range(60)]
    assert all(x.kept for x in minhash.minhash_dedup(rows_of(spark, rows), tile=8).collect())


def test_recall_of_bands():
    """Sets at the threshold share a band, and about as many coordinates as their similarity says."""
    r = np.random.default_rng(0)
    agree, shared, perms = [], 0, minhash.permutations()
    for _ in range(300):
        h = r.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(h[:368]), np.unique(np.r_[h[:338], h[368:398]])
        both = len(np.intersect1d(a, b))
        assert both / (len(a) + len(b) - both) >= 0.849
        x, y = minhash.signature(a, perms), minhash.signature(b, perms)
        agree.append((x == y).mean())
        shared += bool(len(np.intersect1d(minhash.band_keys(x), minhash.band_keys(y))))
    assert shared == 300 and abs(np.mean(agree) - 0.85) < 0.01 and min(agree) * minhash.COORDINATES >= minhash.least_agreement(85)


def test_all_coordinates_are_shifts():
    h = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    first, shifted = minhash.permutations()
    second = shifted[:, 0]
    places = first[(h % np.uint64(minhash.UNIVERSE)).astype(int)].astype(int)
    want = [second[(places + k) % minhash.UNIVERSE].min() for k in range(minhash.COORDINATES)]
    assert minhash.signature(h, (first, shifted)).tolist() == want


def test_pieces_of_long_texts():
    text = " ".join(f"word{k % 70_001}" for k in range(300_000))
    assert len(minhash.shingles(text)) == len(set_of(text))


def test_empty(spark):
    assert minhash.minhash_dedup(rows_of(spark, [])).collect() == []
    assert [tuple(x) for x in minhash.minhash_dedup(rows_of(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
