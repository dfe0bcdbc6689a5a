"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_folder

K1, B = 1.2, 0.75
SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[str, str]:
    """A test item without an answer column: its last sentence answers the rest; of one sentence, the last quarter."""
    text = (text or "").strip()
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    if cut and words(text[: cut[-1]]) and words(text[cut[-1] :]):
        return text[: cut[-1]], text[cut[-1] :]
    at = [m.start() for m in _WORD.finditer(text)]
    cut_at = at[len(at) * 3 // 4] if len(at) >= 4 else len(text)
    return text[:cut_at], text[cut_at:]


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; of fewer words the whole sequence, of none nothing."""
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


@dataclass
class Index:
    """Posting lists of some items, cut at the bounds of item blocks, with each block's largest impact.

    An impact is a term's BM25 weight in an item divided by what the item's own text would score, so that a score is
    the share of an item that a passage holds and one threshold serves all items.
    """

    ids: list[int]
    parts: list[tuple[set, list[str]]]  # question shingles, answer words
    vocabulary: dict[str, int]
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    best: np.ndarray  # terms x blocks: the largest impact of a block
    block: int
    window: int  # half a passage, in words


@dataclass
class Statistics:
    """What BM25 needs to know of all items: their number, mean length, and how many hold each of a shard's terms."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str, str]]) -> Statistics:
        texts = [words(q) + words(a) for _, q, a in rows]
        return cls(len(rows), max(1.0, sum(map(len, texts)) / max(1, len(rows))), Counter(w for t in texts for w in set(t)))


def window_of(n_words: int, least: int) -> int:
    """The window of an item: `least` doubled until it has as many words, so that it depends on no other item."""
    while least < n_words:
        least *= 2
    return least


def build(rows: list[tuple[int, str, str]], block: int, least_window: int, known: Statistics | None = None) -> list[Index]:
    """The indexes of a shard, one per window length, under the statistics of all items (of `rows` alone if None)."""
    known = known or Statistics.of(rows)
    classes: dict[int, list[tuple[int, list[str], list[str]]]] = {}
    for i, q, a in rows:
        q, a = words(q), words(a)
        classes.setdefault(window_of(len(q) + len(a), least_window), []).append((i, q, a))
    return [_index(classes[w], block, w, known) for w in sorted(classes)]


def _index(rows: list[tuple[int, list[str], list[str]]], block: int, window: int, known: Statistics) -> Index:
    whole = [q + a for _, q, a in rows]
    tf = [dict(zip(*np.unique(w, return_counts=True))) if w else {} for w in whole]
    n, mean, df = known.n, known.mean, {w: known.df[w] for t in tf for w in t}
    vocabulary = {w: i for i, w in enumerate(sorted(df))}
    posts: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for i, t in enumerate(tf):
        raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(whole[i]) / mean)) for w, c in t.items()}
        own = sum(raw.values())
        for w, x in raw.items():
            posts[vocabulary[w]].append((i, float(x / own)))
    starts = np.cumsum([0, *map(len, posts)])
    items = np.array([i for p in posts for i, _ in p], dtype=np.int32)
    impacts = np.array([x for p in posts for _, x in p], dtype=np.float32)
    best = np.zeros((len(posts), max(1, -(-len(rows) // block))), dtype=np.float32)
    term = np.repeat(np.arange(len(posts)), np.diff(starts))
    np.maximum.at(best, (term, items // block), impacts)
    parts = [(shingles(q), a) for _, q, a in rows]
    return Index([r[0] for r in rows], parts, {str(w): i for w, i in vocabulary.items()}, starts, items, impacts, best, block, window)


def search(ix: Index, w: list[str], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """item, first word of the passage, score, question and answer overlap of each item that a text's words hold.

    The text is cut into passages of two windows, each starting a window after the last, so that any item lies in
    one. Blocks of items whose largest impacts can't add up to the threshold are passed over for a passage; in the
    others, pivoting by the terms' largest impacts in the block skips items that can't reach it. Of an item's
    passages that pass, the one of the highest score, then overlaps, then the first is told.
    """
    if not w or not ix.ids:
        return []
    get = ix.vocabulary.get
    terms = np.array([get(x, -1) for x in w], dtype=np.int64)
    at = np.flatnonzero(terms >= 0)
    if not len(at):
        return []
    half = len(ix.vocabulary)
    pairs = np.unique(at // ix.window * half + terms[at])
    of = pairs // half
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    bounds = np.zeros((-(-len(w) // ix.window) + 1, ix.best.shape[1]), dtype=np.float32)
    bounds[of[firsts]] = np.add.reduceat(ix.best[pairs % half], firsts, axis=0)
    live = bounds[:-1] + bounds[1:] >= threshold - 1e-4
    if len(w) > ix.window:
        live = live[:-1] if len(live) > 1 else live
    found: dict[int, tuple[float, float, float, int]] = {}
    for p in np.flatnonzero(live.any(axis=1)).tolist():
        passage = np.unique(terms[p * ix.window : (p + 2) * ix.window])
        passage = passage[passage >= 0]
        for b in np.flatnonzero(live[p]).tolist():
            if (ix.best[passage, b]).sum() < threshold - 1e-4:
                continue
            for i, score in _wand(ix, passage, b, threshold):
                q, a = _overlaps(ix, i, w, p)
                if q >= overlap and a >= overlap:
                    found[i] = max(found.get(i, (-1.0, 0.0, 0.0, 0)), (round(score, 4), round(q, 4), round(a, 4), -p))
    return [(ix.ids[i], -p * ix.window, score, q, a) for i, (score, q, a, p) in sorted(found.items())]


def _wand(ix: Index, passage: np.ndarray, b: int, threshold: float) -> list[tuple[int, float]]:
    """Items of block b whose impacts over the passage's terms reach the threshold, by pivoting."""
    lists = []
    for t in passage[ix.best[passage, b] > 0].tolist():
        lo, hi = ix.starts[t], ix.starts[t + 1]
        s = lo + np.searchsorted(ix.items[lo:hi], [b * ix.block, (b + 1) * ix.block])
        lists.append([ix.items[s[0] : s[1]].tolist(), ix.impacts[s[0] : s[1]].tolist(), 0, float(ix.best[t, b])])
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        bound, pivot = 0.0, None
        for k, x in enumerate(lists):
            bound += x[3]
            if bound >= threshold - 1e-4:
                pivot = x[0][x[2]]
                break
        if pivot is None:
            break
        score, rest = 0.0, []
        for x in lists:
            items, at = x[0], x[2]
            while at < len(items) and items[at] < pivot:
                at += 1
            if at < len(items) and items[at] == pivot:
                score += x[1][at]
                at += 1
            x[2] = at
            if at < len(items):
                rest.append(x)
        lists = rest
        if score >= threshold - 1e-4:
            out.append((pivot, score))
    return out


def _overlaps(ix: Index, i: int, w: list[str], p: int) -> tuple[float, float]:
    """Shares of the question's shingles and of the answer's words in the passage."""
    q, a = ix.parts[i]
    near = w[p * ix.window : (p + 2) * ix.window]
    have = shingles(near) if len(next(iter(q), ())) in (0, SHINGLE) else {tuple(near[k : k + len(next(iter(q)))]) for k in range(len(near))}
    there = set(near)
    return (len(q & have) / len(q) if q else 1.0), (sum(x in there for x in a) / len(a) if a else 1.0)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shard: int = 1024, block: int = 4, least_window: int = 64) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, passage_word, score, question_overlap, answer_overlap.

    `items` has item_id and question and answer, or text, which is then split (see question_answer). The index is
    cut into shards of about `shard` items at most, files in the shared folder, which a task takes in turn for each of
    its Arrow batches: all items in one scan of the documents, with one shard in memory. Every passage of every whole text
    is searched. An item is found if a passage reaches `threshold` of the item's own BM25 score, and holds `overlap` of
    the question's five-word shingles and of the answer's words. A passage's length depends on the item alone, and BM25's
    statistics are those of all items, so what is found depends neither on the shards nor on the lengths of other items.
    Null texts count as empty and hold nothing; items without words or with a null item_id are left out; items with
    equal text are each found, rows that repeat an item count once; rows that repeat a document are each searched.
    Without items or documents the result is empty. Only doc_id, text and the columns of the items named above are read.
    """
    paths = _indexes(items, shard, block, least_window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, shards in _with_shards(batches, paths):
            hits = [(d, *hit) for found in shards for d, t in zip(b.column(0).to_pylist(), b.column(1)) for hit in _held(found, t.as_py(), threshold, overlap)]
            cols = list(zip(*hits)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "passage_word", "score", "question_overlap", "answer_overlap"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, item_id long, passage_word int, score double, question_overlap double, answer_overlap double")


def _held(found: list[Index], text: str | None, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    w = words(text)
    return [hit for ix in found for hit in search(ix, w, threshold, overlap)]


def _with_shards(batches: Iterator[pa.RecordBatch], paths: list[str], keep: int = 2) -> Iterator[tuple[pa.RecordBatch, Iterator[list[Index]]]]:
    """Each batch with all shards in turn; up to `keep` stay in memory, more are read again for each batch."""
    kept: dict[str, list[Index]] = {}

    def load() -> Iterator[list[Index]]:
        for path in paths:
            if path in kept:
                yield kept[path]
                continue
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as file:
                found = [Index(*x) for x in pickle.loads(file.read())]
            if len(paths) <= keep:
                kept[path] = found
            yield found

    for b in batches:
        yield b, load()


def _indexes(items: DataFrame, shard: int, block: int, least_window: int) -> list[str]:
    """The files of the shards, dealt by a hash: one if `shard` items are all, else of half as many on average.

    Each shard is built by a task; only the files' names reach the driver.
    """
    if "question" in items.columns:
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("question").cast("string"), F.lit("")).alias("q"), F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("a"))
    else:
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("q"), F.lit(None).cast("string").alias("a"))
    rows = materialise(rows.where("item_id is not null").distinct(), "items")
    n = rows.count()
    parts = 1 if n <= shard else -(-2 * n // shard)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(parts)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, words(q) + words(a)) for p, q, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
            # the empty term counts items, and its occurrences their words
            rows = [x for p, w in got if w for x in [(p, "", 1, len(w)), *((p, t, 1, 0) for t in set(w))]]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "term", "items", "words"])

    counted = dealt.select("part", "q", "a").mapInArrow(count, "part int, term string, items long, words long").groupBy("part", "term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))
    counted = materialise(counted, "item-terms")
    total = counted.groupBy("term").agg(F.sum("items").alias("df"), F.sum("words").alias("all_words"))
    terms = counted.select("part", "term").join(total, "term")
    folder = new_folder(items.sparkSession, "bm25")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held, told in zip(b.column(0), b.column(1)):
                got = sorted((r["item_id"], *(question_answer(r["q"]) if r["a"] is None else (r["q"], r["a"]))) for r in held.as_py())
                got = [x for x in got if words(x[1]) or words(x[2])]
                if not got:
                    continue
                df = {r["term"]: (r["df"], r["all_words"]) for r in told.as_py()}
                every, length = df.pop("")
                made = build(got, block, least_window, Statistics(every, max(1.0, length / every), {t: x[0] for t, x in df.items()}))
                path = f"{folder}/{uuid.uuid4().hex}"  # a repeated attempt writes another file; the path that is returned counts
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_output_stream(at) as file:
                    file.write(pickle.dumps([tuple(getattr(ix, f.name) for f in fields(ix)) for ix in made]))
                yield pa.RecordBatch.from_pydict({"path": [path]})

    # a row per shard: its items and their terms, about `shard` items whatever the input
    held = dealt.groupBy("part").agg(F.collect_list(F.struct("item_id", "q", "a")).alias("held"))
    told = terms.groupBy("part").agg(F.collect_list(F.struct("term", "df", "all_words")).alias("told"))
    shards = held.join(told, "part").select("held", "told").mapInArrow(make, "path string")
    return sorted(r.path for r in materialise(shards, "shards").collect())


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, shard: int = 1024, block: int = 4, least_window: int = 64) -> DataFrame:
    """`docs` without the documents that hold a test item, all columns unchanged, in one scan.

    What holds an item is told under `leaks`. Null and empty texts hold nothing and stay; each of several rows that
    repeat a document is judged; without items all stay, and an empty table gives an empty result. Columns other than
    text may have any name and type.
    """
    paths, at = _indexes(items, shard, block, least_window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, shards in _with_shards(batches, paths):
            clean = np.ones(b.num_rows, dtype=bool)
            for found in shards:
                for i in np.flatnonzero(clean).tolist():
                    clean[i] = not _held(found, b.column(at)[i].as_py(), threshold, overlap)
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
