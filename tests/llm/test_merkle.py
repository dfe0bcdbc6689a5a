"""Merkle manifests against a plain recomputation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos string, node string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def above(nodes, fanout):
    return [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]


def siblings(nodes, at, fanout):
    """Up to the top: for each level what stands left and right of the node over place `at`."""
    out = []
    while len(nodes) > 1:
        a = at // fanout * fanout
        out.append((nodes[a:at], nodes[at + 1 : a + fanout]))
        nodes, at = above(nodes, fanout), at // fanout
    return out, nodes[0]


def brute(rows, tampered, fanout=3):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [siblings([leaf(r) for r in by_source[s]], 0, fanout)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(by_source[s]):
            low, subroot = siblings([leaf(x) for x in by_source[s]], at, fanout)
            high, root = siblings(tops, k, fanout)
            now = leaf(tampered(r))
            for left, right in low + high:
                now = sha("".join(left + [now] + right))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(a + b) for a, b in low + high)), now, now == root))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    sources = [None, "", "a", "é", "b" * 40, "-", "z"]
    rows = [(i * 13 % 10_007 - 50, r.choices(sources, [1, 1, 1, 1, 1, 0, 12])[0], r.choice([None, "de", ""]), r.choice([None, 5, -3]), r.choice([None, "", "x\ny", "ß\n\n", "plain " * r.randint(1, 9), "l\n" * 50_000 if i == 3 else "l"])) for i in range(n)]
    return rows + [rows[5], rows[5], (rows[6][0], rows[6][1], "xx", 1, "other\n"), (None, None, None, None, None), (None, "z", "de", 1, "t\n"), (None, "z", "de", 2, "t\n"), (2**62 + 1, "only", "de", 1, "q\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "n") for r in rows], DOCS).repartition(3)


def drop_lines(r):
    return (*r[:4], None if r[4] is None else r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 else r


def received():
    return F.when(F.col("doc_id") % 2 != 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


@pytest.mark.parametrize("seed, n, fanout, height", [(1, 300, 3, 7), (2, 300, 3, 1), (3, 250, 2, 2), (4, 90, 3, 2), (5, 28, 3, 3)])
def test_manifest(spark, seed, n, fanout, height):
    rows = corpus(seed, n)
    got = merkle.merkle_manifest(frame(spark, rows), received(), fanout, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(x) for x in got.collect()), key=str)
    assert found == brute(rows, drop_lines, fanout)
    assert {x[-1] for x in found} == {True, False}


def test_untouched(spark):
    got = merkle.merkle_manifest(frame(spark, corpus(6, 60))).collect()
    assert all(x.verified for x in got) and len({x.root for x in got}) == 1


@pytest.mark.parametrize("rows", [[(1, "a", "en", 3, "abc")], [(1, "a", None, None, "x\n"), (2, "b", None, None, "y")], [(1, None, None, None, None)]])
def test_lone_leaves(spark, rows):
    got = merkle.merkle_manifest(frame(spark, rows), received())
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, drop_lines)


def test_empty(spark):
    assert merkle.merkle_manifest(frame(spark, []), received()).collect() == []
