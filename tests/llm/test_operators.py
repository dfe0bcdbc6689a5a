"""Each operator against brute force on small tables with nulls, empties, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import chat, decontaminate, exact_dedup, licenses, mixing, quality, simhash, substring_dedup, toxicity, warc
from tidemark.llm.components import components

DOCS = "doc_id long, text string, source string, lang string, digest string, n int, _hot string, rank int, doc string, keep long"
PIECES = ["red fox", "a b c d e", "ⅷ ß é", "x\ty\nz", "the quick brown fox jumps over the lazy dog again and again"]


def docs(spark, texts, sources=None):
    names = sources or [None]
    rows = [(i, t, names[(i or 0) % len(names)], "en", "q", 1, "h", 2, "d", -(i or 0)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def corpus():
    r = random.Random(5)
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "A b", "word " * 30_000, "word " * 30_000 + " "]
    texts += [" ".join(r.choices(PIECES, k=r.randint(1, 9))) for _ in range(60)] + ["copy of a text"] * 40
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, "lone"), (None, "copy of a text"), (None, None)]


def test_exact_dedup(spark):
    rows = corpus()
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(min(g := groups[norm(t)])[2]), len(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in got) == want
    assert all(x.kept == (x.doc_id == x.keep_id) for x in got if x.doc_id not in (None, rows[10][0]))
    kept = exact_dedup.keep_first(docs(spark, rows))
    assert kept.count() == len(groups)  # one row a group, though ids repeat and some are null
    again = [(1, "t"), (1, "t"), (2, "t"), (None, "u v"), (None, "u  v"), (None, "uv"), (3, "t u"), (3, "w")]
    assert sorted((str(x.doc_id), x.text) for x in exact_dedup.keep_first(docs(spark, again)).collect()) == [("1", "t"), ("3", "t u"), ("3", "w"), ("None", "u  v")]
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert {norm(x.text) for x in kept.collect()} == set(groups)
    assert all(x.digest == "q" for x in kept.collect())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0 and exact_dedup.keep_first(docs(spark, [])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while True:
        per = left / max(1e-12, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if per * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: per * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = [None, "", "a", "B", "é", "z"]
    rows = [(i, " ".join(["w"] * int(r.paretovariate(0.8))), r.choices(names, [30, 1, 2, 3, 4, 5])[0]) for i in range(300)] + [(7, None, "a"), (None, "x y", "z"), (5, "x y", "a"), (5, "x y", "a")]
    df = spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, source string, _start int, _key string")
    got = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for x in got:
        taken[x.source] += x["taken"]
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x["taken"] <= 2 * x["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(x["size"], x.target, x["taken"]) for x in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2


def brute_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = corpus()
    got = simhash.simhash_dedup(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = defaultdict(list)
    for (i, _), c in zip(rows, comp):
        least[c].append((i is None, i))
    want = sorted((str(i), f"{f:016x}", str(min(least[c])[1])) for (i, _), f, c in zip(rows, fps, comp))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0
    for some in (rows, [r for r in rows if r[0] is not None]):
        comp, best = brute_components([brute_fingerprint(t) for _, t in some]), {}
        for (i, t), c in zip(some, comp):
            best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
        kept = simhash.keep_one(docs(spark, some)).collect()
        of = {(i, t): c for (i, t), c in zip(some, comp)}
        assert len(kept) == len(best) == len({of[x.doc_id, x.text] for x in kept}) and all(x.doc == "d" for x in kept)
        assert all(best[of[x.doc_id, x.text]] == (x.doc_id is None, x.doc_id or 0) for x in kept)
    # ids of keepers that occur with unrelated texts
    base = "alpha beta gamma delta epsilon " * 400
    mixed = [(1, base), (None, base + "x"), (5, base + "y"), (5, "lone five"), (None, "lone none"), (1, base + "x"), (5, "lone five")]
    texts = [x.text for x in simhash.keep_one(docs(spark, mixed)).collect()]
    assert sorted(t[:9] for t in texts) == ["alpha bet", "lone five", "lone none"]


@pytest.mark.parametrize("cap", [1, 8, 10_000])
def test_simhash_links_of_large_blocks(spark, cap):
    r = random.Random(cap)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(60)} | {b ^ (1 << i) ^ (1 << j) for b in base[:1] for i in range(0, 64, 5) for j in range(i)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    made = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, cap)
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in made.collect())
    roots = {x.node: x.root for x in components(made).collect()}
    got = [roots.get(s, s) for s in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 2), (2, 1)]
    got = {x.node: x.root for x in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1}


ITEM = "Which river runs through the old town of the seven bridges and ends in a lake far north. The grey river."


def test_decontamination(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    fill = lambda n: " ".join(r.choices(words, k=n))
    items = [(1, ITEM), (2, fill(30) + ". " + fill(5)), (3, None), (None, "x y z"), (4, ""), (5, "one two three"), (6, ITEM)] + [(i, fill(r.randint(12, 50))) for i in range(10, 60)]
    inside = [(100 + k, fill(k) + " " + t + " " + fill(r.randint(0, 300))) for k, t in [(0, ITEM), (63, ITEM), (64, ITEM.upper()), (127, items[1][1]), (1500, items[20][1]), (9, items[30][1] + " " + items[31][1])]]
    near = [(300, fill(60) + " " + " ".join(ITEM.split()[:8]) + " " + fill(60)), (301, None), (302, ""), (None, ITEM), (303, fill(20_000))]
    df = docs(spark, inside + near)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    norm = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    want = sorted((str(i), j) for i, t in inside + near for j, x in items if j and decontaminate.words(x) and norm(x) in norm(t))
    for shard, block in ((1024, 4), (7, 1), (20, 16)):
        got = decontaminate.leaks(df, bench, shard=shard, block=block).collect()
        assert sorted((str(x.doc_id), x.item_id) for x in got) == want
        clean = decontaminate.drop_leaking(df, bench, shard=shard, block=block)
        assert clean.columns == df.columns and {str(x.doc_id) for x in clean.collect()} == {"300", "301", "302", "303"}
    # nor does a long item in the shard change what is found of a short one: here its halves lie too far apart
    halves = fill(30), fill(30)
    apart = docs(spark, [(1, halves[0] + " other" * 140 + " " + halves[1]), (2, " ".join(halves)), (3, fill(90) + " " + fill(400))])
    short, long = spark.createDataFrame([(1, " ".join(halves))], "item_id long, text string"), spark.createDataFrame([(2, fill(400))], "item_id long, text string")
    for shard in (1, 2, 1024):
        assert [(x.doc_id, x.item_id) for b in (short, short.union(long)) for x in decontaminate.leaks(apart, b, shard=shard).collect()] == [(2, 1), (2, 1)]
    # of an item's passages the best is told
    twice = docs(spark, [(1, ITEM.replace("north", "") + " " + fill(300) + " " + ITEM)])
    assert [(x.score, x.passage_word > 64) for x in decontaminate.leaks(twice, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()] == [(1.0, True)]
    # the statistics are those of all items: scores don't depend on the shards, and rows that repeat an item count once
    scores = [sorted((str(x.doc_id), x.item_id, x.score) for x in decontaminate.leaks(df, b, shard=shard).collect()) for shard, b in ((1024, bench), (20, bench), (1024, bench.union(bench)))]
    assert scores[0] == scores[1] == scores[2]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_wand_finds_all_above_threshold():
    r = random.Random(2)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 20))), "") for i in range(40)]
    (ix,) = decontaminate.build(items, 4, 32)
    for _ in range(60):
        text = " ".join(r.choices(words, k=r.randint(1, 90)))
        w, best = decontaminate.words(text), set()
        got = {h[0] for h in decontaminate.search(ix, w, 0.5, 0.0)}
        for p in range(0, max(1, len(w)), ix.window):
            terms = {ix.vocabulary[x] for x in w[p : p + 2 * ix.window] if x in ix.vocabulary}
            for i in range(40):
                score = sum(float(ix.impacts[k]) for t in terms for k in range(ix.starts[t], ix.starts[t + 1]) if ix.items[k] == i)
                if score >= 0.5 - 1e-4:
                    best.add(i)
        assert got == best


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a</p>", "", None, "ü" * 5, "<p>a</p>", "x" * 3_000_000, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n"])] + [(20, None, "b\x00"), (None, "u", "lone"), (6, "again", "<p>a</p>"), (None, "u", "ü" * 5)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, key int").repartition(3)
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    for least in (0, 5):
        want = []
        for i, _, t in rows:
            p, top = (t or "").encode(), best[t or ""]
            again = len(p) >= least and top >= 0 and i != top
            want.append(str((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None)))
        got = warc.round_trip(df, str(tmp_path / f"b{least}"), least).collect()
        assert sorted(str(tuple(x)) for x in got) == sorted(want)
    assert warc.round_trip(df.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_frames_and_seek_table(tmp_path):
    import zstandard

    w = warc.BundleWriter(f"file://{tmp_path}/a.warc.zst", 1000)
    for i in range(20):
        w.add(i, warc.record(i, "u", bytes([65 + i]) * (200 * (i % 7 + 1)), None, False))
    index = w.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    frames = warc.seek_table(data)
    assert len(frames) > 3 and sum(f[0] for f in frames) + 8 + 8 * len(frames) + 9 == len(data)
    bundle = warc.BundleReader(f"file://{tmp_path}/a.warc.zst")
    for page, _, frame, at, n in reversed(index):
        assert warc.parse(bundle.record(frame, at, n))["page_id"] == page
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole.count(b"WARC/1.1") == 20


def test_chat_pairs(spark):
    c = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "one")]
    turns = [(1, "chosen", i, *t) for i, t in enumerate(c)] + [(1, "rejected", i, *t) for i, t in enumerate(c[:3] + [("assistant", "two!")])]
    turns += [(2, "chosen", 0, "user", None), (2, "chosen", 1, None, "x"), (3, "rejected", None, "assistant", "é"), (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"), (4, "rejected", 1, "assistant", "b"), (None, "chosen", 0, "user", "q"), (5, "other", 0, "user", "q")]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "pair_id long, side string, turn long, role string, text string, c int, shared_turns int")
    got = {x.pair_id: x for x in chat.preference_pairs(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    x = got[1]
    assert x.shared_turns == 3 and x.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    a, z = map(int, x.rejected_mask.split("-"))
    assert x.rejected[a:z] == "two!<|end|>" and x.chosen == "<|assistant|>\none<|end|>\n"
    assert got[2].shared_turns == 0 and got[2].rejected == "" and got[2].chosen == "<|user|>\n<|end|>\n<||>\nx<|end|>\n"
    assert got[3].prompt == "" and got[3].rejected_mask == "14-22"
    assert got[4].shared_turns == 1 and got[4].chosen == "" and got[4].rejected_mask == "14-22"
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_neighbours(spark):
    rows = [(1, i + 1, "user" if i % 2 else "assistant", f"one {i}") for i in range(4)] + [(0, i, "user", f"zero {i}") for i in range(3)]  # turns from 1 and from 0
    rows += [(6, None, "user", "first"), (6, 3, "user", "long " * 100_000), (6, 3, "user", "long " * 100_000), (9, 1, None, None), (None, 1, "user", "x")]
    got = defaultdict(list)
    for x in chat.neighbours(spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, pair_id int, side string")).collect():
        got[x.pair_id, x.side].append((x.turn, x.text))
    said = lambda pair, side: [t for _, t in sorted(got[pair, side])]
    assert said(1, "chosen") == ["one 0", "one 1", "one 2", "one 3"] and said(1, "rejected") == ["one 0", "one 1", "zero 2"]
    assert said(0, "rejected") == ["zero 0", "zero 1", "one 2", "one 3"] and said(9, "rejected") == [""] == said(9, "chosen")
    assert said(6, "rejected") == ["first", "long " * 100_000] and len(said(6, "chosen")) == 3 and {k[0] for k in got} == {0, 1, 6, 9}
    pairs = {x.pair_id: x for x in chat.preference_pairs(chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: x.shared_turns for k, x in pairs.items()} == {0: 2, 1: 2, 6: 2, 9: 1} and len(pairs[6].prompt) > 500_000


def brute_units(rows, least):
    import xxhash

    occ, seen = [], {}
    for row, (i, t) in enumerate((i, t or "") for i, t in rows):
        key, k, at = xxhash.xxh3_64_intdigest(t.encode()), 0, 0
        key -= (key >> 63) << 64
        for raw in re.split(r"(\n|(?<=\.)(?=[ \t\x0b\x0c\r]))", t):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", raw.lower()).strip(" ")
            if norm:
                occ.append((i, key, k, at, at + len(raw), norm, len(norm.split(" ")), row))
                k += 1
            at += len(raw)
    rank = lambda o: (o[0] is None, o[0] or 0, o[2], o[1], o[7])
    for o in occ:
        seen[o[5]] = min(seen.get(o[5], rank(o)), rank(o))
    out, by = [], defaultdict(list)
    for o in occ:
        by[o[7]].append(o)
    for part in by.values():
        run = []
        for o in [*sorted(part, key=lambda o: o[2]), None]:
            if o is not None and seen[o[5]] != rank(o):
                run.append(o)
                continue
            if sum(x[6] for x in run) >= least:
                out += [(str(x[0]), x[2], x[3], x[4]) for x in run]
            run = []
    return sorted(out)


@pytest.mark.parametrize("least", [1, 6, 30])
def test_passage_dedup(spark, least):
    r = random.Random(3)
    pool = ["one two three four", "Short", "", "  a\tb  ", "x " * 40, "é ß ⅷ", "tail. of it. twice.", "v1.5 of it. Tail", "...", "of it."]
    rows = [(i, r.choice(["\n", ". "]).join(r.choices(pool, k=r.randint(1, 7)))) for i in range(40)] + [(None, "Short\nShort"), (50, None), (51, ""), (3, "one two three four\nfresh"), (3, "new\nfresh"), (60, "a b"), (60, "a b"), (None, "Short\nShort"), (61, "z\n" * 3000), (62, "z. " * 3000)]
    got = substring_dedup.repeated_units(docs(spark, rows), least)
    assert sorted((str(x.doc_id), x.unit, x.start_char, x.end_char) for x in got.collect()) == brute_units(rows, least)
    cut = substring_dedup.remove_repeats(docs(spark, rows), least).collect()
    assert len(cut) == len(rows) and all(x.digest == "q" for x in cut)
    text = dict(r for r in rows if r[0] not in (3, 60, None))
    for x in cut:
        if x.doc_id in text:
            t, said, at = text[x.doc_id], "", 0
            for s in x.removed:
                said, at = said + t[at : s.start_char], s.end_char
            assert x.text == (said + t[at:] if t is not None else None)
    assert substring_dedup.repeated_units(docs(spark, []), least).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "one text of six words. here"), (1, "one text of six words. here"), (None, "A line\nanother"), (None, "A line\nanother"), (None, "A line\nanother"), (2, "lone")]
    cut = substring_dedup.remove_repeats(docs(spark, rows), 30, 5).collect()
    assert sorted((str(x.doc_id), x.text.strip()) for x in cut) == [("1", ""), ("1", "one text of six words. here"), ("2", "lone"), ("None", ""), ("None", ""), ("None", "A line\nanother")]
    assert [c for c in cut[0].asDict() if c not in ("removed",)] == [c.split()[0] for c in DOCS.split(", ")]
    found = substring_dedup.repeated_units(docs(spark, rows), 30, 5)
    assert "_row" not in found.columns and sorted((str(x.doc_id), x.unit) for x in found.collect()) == [("1", 0), ("1", 1)] + [("None", 0)] * 2 + [("None", 1)] * 2


def test_passage_dedup_of_lines_and_sentences(spark):
    r = random.Random(4)
    pool = ["one two three four five", "one two. three four", "Short", "", "  a\tb  ", "tail. of it. twice.", "of it.", "Of it.  tail.", "six words are here at last"]
    rows = [(i, r.choice(["\n", ". "]).join(r.choices(pool, k=r.randint(1, 7)))) for i in range(60)] + [(70, "short\nof it. of it."), (71, "of it. of it.\nlone of it."), (None, "SHORT\nfresh here")]
    norm = lambda t: " ".join(t.lower().split())
    seen, lines, want = set(), set(), set()
    for i, t in rows:
        k = 0
        for line in t.split("\n"):
            for u in filter(None, map(norm, re.split(r"(?<=\.)(?=[ \t])", line))):
                if u in seen and (norm(line) in lines or len(u.split()) >= 5):
                    want.add((i, k))
                seen.add(u)
                k += 1
            lines.add(norm(line))
    got = [(x.doc_id, x.unit) for x in substring_dedup.repeated_units(docs(spark, rows), 10_000, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(70, 0), (71, 0), (71, 1), (None, 0)} <= want


def test_units_end_at_marks():
    text = "One? two! v1;5 three; four؟ five. six 七。八！ nine\nten"
    assert [u[2] for u in substring_dedup.units(text)] == ["one?", "two!", "v1;5 three;", "four؟", "five.", "six 七。", "八！", "nine", "ten"]
    assert all(text[a:z].lower().strip() == norm for a, z, norm, *_ in substring_dedup.units(text))


def labelled(spark, n=400):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [f"{r.choice(['th', 'an', 'er'])}{r.choice(['ing', 'ble', 'sh'])}" for _ in range(60)]
        if bad:
            for k in range(4):
                w[r.randrange(60)] = r.choice(["idiot", "scum", "moron", "zlorp" + r.choice("abc")]) if i % 12 else "zlorp" + r.choice("abcdef")
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(bad), int(not bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(spark)
    extra = [(1000, None), (1001, ""), (None, "you are scum, idiot"), (3, rows[3][1]), (1002, "ok " * 50_000)]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (8, 0, 0), (8, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs(spark, rows + extra), lab).collect()
    assert len(got) == len(rows) + len(extra)
    import zlib

    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert sum(x.predicted == (x.doc_id % 6 == 0) for x in held) >= 0.97 * len(held)
    assert all(not x.predicted for x in got if x.doc_id in (1000, 1001, 1002))
    # labels of held-out rows change nothing
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, q) for i, t, q in labels]
    again = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(flipped, lab.schema)).collect()
    first = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, lab.schema)).collect()
    assert max(abs(a.score - b.score) for a, b in zip(sorted(again), sorted(first))) < 1e-6
    kept = toxicity.keep_clean(docs(spark, rows), lab)
    assert kept.columns == docs(spark, []).columns and 0.8 * len(rows) <= kept.count() <= 0.9 * len(rows)
    assert toxicity.toxicity(docs(spark, []), lab).count() == 0
    assert {x.predicted for x in toxicity.toxicity(docs(spark, [(1, "scum idiot"), (2, "fine")]), lab.limit(0)).collect()} == {0, 1}


def test_label_model_learns_accuracies():
    import numpy as np

    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.2
    fire = [(0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.3, 0.1)]
    v = np.stack([np.where(y, r.random(len(y)) < a, r.random(len(y)) < b) for a, b in fire] , axis=1)
    v = np.concatenate([v, v[:, :1]], axis=1)  # a copy of the first voter
    codes, n = np.unique(v @ (1 << np.arange(5)), return_counts=True)
    pi, rates, corr, post = toxicity.fit_label_model(dict(zip(codes.tolist(), n.tolist())), 5, 0.2)
    assert abs(pi - 0.2) < 0.05 and abs(rates[1][0] - 0.6) < 0.08 and corr[0][4] > 0.9 and abs(corr[0][3]) < 0.3
    guess = np.array([post[c] for c in (v @ (1 << np.arange(5))).tolist()]) > 0.5
    assert (guess == y).mean() > 0.93


def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        junk = i % 5 == 0
        w = ["".join(r.choices("aeioutrns", k=r.randint(2, 8))) for _ in range(40)]
        text = " | ".join(x.upper() + "!!" for x in w) if junk else " ".join(w).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    extra = [(1000, None), (1001, ""), (None, "A b c."), (2, rows[2][1]), (1002, "long text. " * 50_000)]
    df = docs(spark, rows + extra, [None, "h1", "h1", "h1", "h2"])
    lab = spark.createDataFrame([*labels[:300], (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(df, lab, "source", "lang").collect()
    assert len(got) == len(rows) + len(extra)
    held = [x for x in got if x.doc_id is not None and 300 <= x.doc_id < 400]  # without labels
    assert sum(x.keep == (x.doc_id % 5 != 0) for x in held) >= 0.97 * len(held) == 97
    # the formula on the evidence, by hand: strengths by moments, each document's own evidence left out
    hosts, paths = defaultdict(list), defaultdict(list)
    for x in got:
        hosts[x.host].append(x.evidence)
        paths[x.host, x.path].append(x.evidence)
    total = sum(x.evidence for x in got) / len(got)

    def strength(groups):
        groups = [(e, c) for e, c in groups if len(e) >= 2]
        mean = lambda e: sum(e) / len(e)
        between = mean([(mean(e) - c) ** 2 - max(mean([v * v for v in e]) - mean(e) ** 2, 0) / len(e) for e, c in groups])
        return min(max(mean([c * (1 - c) for _, c in groups]) / max(between, 1e-6) - 1, 1.0), 1000.0)

    k = strength([(e, total) for e in hosts.values()])
    k2 = strength([(e, (sum(hosts[h]) + k * total) / (len(hosts[h]) + k)) for (h, _), e in paths.items()])
    for x in got:
        h, p = hosts[x.host], paths[x.host, x.path]
        of_host = (sum(h) - x.evidence + k * total) / (len(h) - 1 + k)
        of_path = (sum(p) - x.evidence + k2 * of_host) / (len(p) - 1 + k2)
        assert x.host_posterior == pytest.approx(of_host) and x.path_posterior == pytest.approx(of_path)
        odds = x.evidence / (1 - x.evidence) * of_path / (1 - of_path) / (total / (1 - total))
        assert x.quality == pytest.approx(odds / (1 + odds), abs=1e-6)
    # a bad site pulls its unsure documents down, and a sparse one little
    assert len({round(x.path_posterior, 3) for x in got}) > 3
    assert quality.quality(docs(spark, []), lab, "source", "lang").count() == 0
    assert {x["quality"] for x in quality.quality(docs(spark, [(1, "a")]), lab.limit(0), "source", "lang").collect()} == {0.5}


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "# Licensed under the Apache License, Version 2.0.\n" + "code here " * 9),
        (3, "a/b/y.py", "no word of it"),
        (4, "a/b/c/d/z.py", None),
        (5, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "e/q.py", "nothing"),
        (7, None, ""),
        (8, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (9, "e/long.py", "text of the file " * 20_000 + "\nLicensed under CC BY-NC 4.0.\n" + "more of the file " * 10),
        (None, "top.py", "under the version of the license text nobody knows"),
    ]
    df = spark.createDataFrame([(*f, "x", "y", 1) for f in files], "file_id long, path string, text string, dir string, license string, n int")
    got = {x.file_id: x for x in licenses.license_scan(df).collect()}
    assert len(got) == len(files)
    said = {k: (x.license, x.method, x.from_path) for k, x in got.items()}
    assert said[1] == ("MIT", "file", "a/LICENSE") and said[2] == ("Apache-2.0", "header", "a/b/x.py")
    assert said[3] == ("MIT", "inherited", "a/LICENSE") and said[4] == ("GPL-3.0", "inherited", "a/b/c/COPYING")
    assert said[6] == (None, "none", None) and said[7] == (None, "none", None) and said[9][:2] == ("CC-BY-NC-4.0", "header")
    assert said[None] == (None, "none", None)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_inheritance(spark):
    r = random.Random(6)
    names = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", None: "nothing to see"}
    files = []
    for i in range(150):
        folder = "/".join(r.choices(["a", "b", "c"], k=r.randint(0, 4)))
        own = r.choice(list(names)) if (licence := r.random() < 0.15) else None
        files.append((i, f"{folder}/LICENSE{i}" if licence else f"{folder}/f{i}.txt", names[own]))
    files = [(i, p.removeprefix("/"), t) for i, p, t in files]
    given = defaultdict(list)  # per directory; all scores are equal, so the least path counts
    said = {t: k for k, t in names.items()}
    for _, p, t in files:
        if said[t]:
            given[p.rpartition("/")[0]].append((p, said[t]))
    got = {x.file_id: (x.license, x.method, x.from_path) for x in licenses.license_scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    for i, p, t in files:
        at, want = p.rpartition("/")[0], (None, "none", None)
        if said[t]:
            want = (said[t], "file", p)
        else:
            while True:
                if given[at]:
                    path, name = min(given[at])
                    want = (name, "inherited", path)
                    break
                if not at:
                    break
                at = at.rpartition("/")[0]
        assert got[i] == want, p


def test_licenses_over_line_ends():
    import textwrap
    from collections import Counter

    vocabulary = {w for x in licenses.TEMPLATES.values() for f in x for w in licenses.terms(f)}
    m = licenses.Matcher(licenses.TEMPLATES, {w: 9000 // (3 + len(w) ** 2) for w in vocabulary}, 10_000, 0.8)
    wrap = lambda t, n, lead="": "\n".join(lead + x for x in textwrap.wrap(t, n))
    code = "\n".join(f"value{i} = call{i}(x{i})" for i in range(80))
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(licenses._MIT, 76)
    bsd = "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrap(licenses._BSD, 76)
    gpl = wrap(licenses.TEMPLATES["GPL-3.0"][1], 60, "# ") + "\n" + code
    lgpl = wrap("This library is free software: " + licenses._GNU.format("Lesser General Public License"), 60, " * ") + "\n" + code
    got = [m.scan(t) for t in (mit, bsd, gpl, lgpl, code, "x\nAll rights reserved.\n" + code)]
    assert [g[0] for g in got] == ["MIT", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", None, "Proprietary"]
    assert all(g[1] > 0.99 for k, g in enumerate(got) if k != 4) and got[0][3] > 0.9 and got[1][3] > 0.9 and got[2][3] < 0.5
    words = licenses.terms(code + gpl + bsd)
    for k, (_, f, size) in enumerate(m.windows):
        want = {}
        for a in range(len(words) - size + 1):
            v = m.vector(Counter(words[a : a + size]))
            if (c := sum(x * v.get(w, 0) for w, x in f.items())) >= 0.8:
                want[a] = c
        m.at_anchor, kept = {w: [i for i in x if i == k] for w, x in m.at_anchor.items()}, m.at_anchor
        found = {a: s for s, _, a, _ in m.slide(words)}
        m.at_anchor = kept
        assert found == pytest.approx(want)


def test_related_licenses_are_told_apart():
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n" + "code here " * 40
    bsd2 = "".join(x for x in re.split(r"(?=3\. Neither|THIS SOFTWARE)", licenses._BSD) if not x.startswith("3."))
    cases = {
        "GPL-2.0": gnu.format("General Public License", 2), "GPL-3.0": gnu.format("General Public License", 3), "LGPL-2.1": gnu.format("Lesser General Public License", "2.1"),
        "LGPL-3.0": gnu.format("Lesser General Public License", 3), "AGPL-3.0": gnu.format("Affero General Public License", 3), "BSD-2-Clause": bsd2, "BSD-3-Clause": licenses._BSD,
        "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "ISC": licenses.TEMPLATES["ISC"][1], "MIT": licenses._MIT,
        "Apache-2.0": licenses.TEMPLATES["Apache-2.0"][1], "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\nint x;", None: "This is not released under the MIT License.",
        "ambiguous": "This work is licensed under the GNU General Public License.",
    }
    from collections import Counter

    for seed in (1, 2, 3):
        r = random.Random(seed)
        vocabulary = sorted({w for x in licenses.TEMPLATES.values() for f in x for w in licenses.terms(f)})
        common = {w for t in cases.values() for w in Counter(licenses.terms(t))}
        m = licenses.Matcher(licenses.TEMPLATES, {w: r.randrange(0, 60 if w in common else 30) for w in vocabulary}, 1000, 0.8)
        assert {k: m.scan(t)[0] for k, t in cases.items()} == {k: k for k in cases}


def test_license_anchors_lose_nothing():
    r = random.Random(8)
    forms = [f for x in licenses.TEMPLATES.values() for f in x]
    words = sorted({w for f in forms for w in licenses.terms(f)})
    m = licenses.Matcher(licenses.TEMPLATES, {w: r.randrange(500) for w in words}, 500, 0.8)
    from collections import Counter

    for _ in range(3000):
        line = licenses.terms(r.choice(forms))
        line = [w for w in line if r.random() < 0.8] + r.choices(words, k=r.randint(0, 4))
        v = m.vector(Counter(line))
        best = max(sum(x * v.get(w, 0) for w, x in f.items()) for _, f in m.forms)
        if best >= 0.8:
            assert m.best(line)[0] == pytest.approx(best)
