"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

DOCS = "doc_id long, text string, word string, n string, key int, form string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", 1, "f") for i, t in rows], DOCS)


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def brute(rows, least=6, min_count=5, ratio=5, every=199):
    n = Counter()
    for i, t in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, close = {}, {}
    for w in n:
        close[w] = [x for x in n if x != w and near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    base = ["running", "station", "stationen", "élégance", "Straßen", "aaaaaaa", "aaaaaaab", "ÀÉÎÕÜß", "kilometre", "kilometer", "anagram", "nagaram"]
    words = base + [w[:k] + r.choice("abé") + w[k + r.choice([0, 1]) :] for w in base for k in range(0, len(w), 2)] + [w[:k] + w[k + 1 :] for w in base for k in range(len(w))]
    weights = [r.choice([1, 2, 6, 40, 250]) for _ in words]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(words, weights, k=r.randint(0, 90))) + r.choice(["", "\n", "Łódź", "日本語running", "x1station_station"])) for i in range(150)]
    return rows + [(7, None), (8, ""), (None, "running running"), (None, None), rows[3], rows[3], (9, "kilometre " * 120_000), (10, "z" * 5000 + " " + ("q" * 3000 + " ") * 6 + ("q" * 2999 + " ") * 40)]


@pytest.mark.parametrize("seed, groups, tile, every", [(1, 5, 1024, 199), (2, 3, 4, 7), (3, 1, 8, None), (4, 6, 2, 199)])
def test_variants(spark, seed, groups, tile, every):
    rows = corpus(seed)
    got = spelling.spelling_variants(rows_of(spark, rows), typo_every=every, groups=groups, tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, every=every)


def test_chain_of_forms(spark):
    """Each word stands five times as often as the one before, so the root is four forms on."""
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(5 ** (k + 1))))]
    got = {x.word: x for x in spelling.spelling_variants(rows_of(spark, rows)).collect()}
    assert {w: got[w].root for w in words} == dict.fromkeys(words, "abjihg") and got["abcdef"].form == "abcdeg" and got["abjihg"].form is None


def test_sums_handed_on_early(spark):
    rows = corpus(5)
    now = {tuple(x) for x in spelling.vocabulary(rows_of(spark, rows), most=3).collect()}
    assert now == {tuple(x) for x in spelling.vocabulary(rows_of(spark, rows)).collect()} and now


def test_pieces_of_long_texts():
    text = "straße " * 400_000
    assert sum(map(len, spelling.runs(text))) == 400_000 and len(list(spelling.runs(text))) > 2


def test_edits_by_distances():
    long = spelling.letters_of("abcdefg" + "bacdefg" + "abcdefz", 7)
    assert [x.tolist() for x in spelling.near_pairs(spelling.letters_of("abcdef" + "zbcdef", 6), long, False)] == [[0, 0], [0, 2]]
    assert np.array_equal(spelling.near_pairs(long, long, True)[1], [2])


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, "short word")]):
        assert spelling.spelling_variants(rows_of(spark, rows)).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(rows_of(spark, []), ratio=1)
