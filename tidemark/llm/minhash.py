"""MinHash near-deduplication: circulant signatures, bands, and a check of full shingle sets."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise, repeated_ids
from .components import components

COORDINATES, BANDS, ROWS = 128, 20, 4
#: Places in the universe of the permutations.
UNIVERSE = 1 << 20
PIECE = 1 << 20
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of a whole text's word shingles; of fewer words than `size` the one of all; none without words."""
    line, at, digest = (text or "").encode("utf-8", "surrogatepass").lower(), 0, xxhash.xxh64_intdigest  # of bytes: A-Z only
    found, words = [], []
    while at < len(line):  # pieces that end at white space; the last words of one begin the next
        cut = SPACES.search(line, at + PIECE)
        end = cut.start() if cut else len(line)
        words, at = words + line[at:end].split(), end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-1].tolist()]
            found.append(np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)], dtype=np.uint64)))
            words = words[len(words) - size + 1 :]
    if not found:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def permutations(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one's circular shifts: row x holds what they give for place x, one column a shift."""
    r = np.random.default_rng(seed)
    first, second = r.permutation(UNIVERSE).astype(np.uint32), r.permutation(UNIVERSE).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)


def signature(hashes: np.ndarray, both: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All coordinates of a set: the least of the second permutation, shifted by 0, 1, 2 and so on, over the places that the first one gives. `both` are permutations()."""
    first, shifted = both
    places = first[(hashes % np.uint64(UNIVERSE)).astype(np.int64)]
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(places), 4096):
        np.minimum(out, shifted[places[k : k + 4096]].min(axis=0), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A key for each band of a signature: equal ones are of equal bands but for chance."""
    rows = np.c_[np.arange(BANDS, dtype="<u4"), coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)].astype("<u4")
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], dtype=np.uint64).view(np.int64)


def sets(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, at (a hash of the text, to find it again), n, set (a digest of the shingle set), bands, sketch (a byte of each coordinate) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = permutations(seed)
        for b in batches:
            n, digests, bands, sketches = [], [], [], []
            for t in b.column(2):
                found = shingles(t.as_py(), size, seed)
                n.append(len(found))
                if len(found):
                    s = signature(found, both)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_keys(s))
                    sketches.append(s.astype(np.uint8).tobytes())
                else:
                    digests.append(None), bands.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "at", "n", "set", "bands", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, at long, n long, set binary, bands array<long>, sketch binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("at"), text.alias("text"))


def least_agreement(percent: int) -> int:
    """Of a pair at the wanted similarity fewer coordinates agree once in about 10^8 pairs: six standard deviations."""
    s = percent / 100
    return math.floor(COORDINATES * s - 6 * math.sqrt(COORDINATES * s * (1 - s)))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def close(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the wanted similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                agree = (_sketches(b.column(2)) == _sketches(b.column(3))).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(agree)), b.column(1).filter(pa.array(agree))], names=["a", "b"])

    least = least_agreement(percent)
    of = lambda x: facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    met = pairs.join(of("b"), "b").join(of("a"), "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return met.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [similar(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8"), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    of = lambda x: held.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    met = pairs.join(of("b"), "b").join(of("a"), "a")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """rows (family, node, root, n, sketch, shingles) as tiles (family, tile, held) of about `tile` members."""
    parts = rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    dealt = rows.join(parts, "family").withColumn("tile", F.pmod(F.xxhash64("node"), "parts"))
    # dealt anew, as the join leaves a family in one place
    return dealt.repartition("family", "tile").groupBy("family", "tile").agg(F.collect_list(F.struct("node", "root", "n", "sketch", "shingles")).alias("held"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each set of a shares with each of b: products of the incidence matrices, some columns at a time."""
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    every = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(*every)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    at = [np.searchsorted(shared, e) for e in every]
    kept = [(i < len(shared)) & (shared[np.minimum(i, max(0, len(shared) - 1))] == e) if len(shared) else np.zeros(len(e), bool) for i, e in zip(at, every, strict=True)]
    for k in range(0, len(shared), columns):
        part = []
        for x, r, i, ok in zip((a, b), rows, at, kept, strict=True):
            own = ok & (i >= k) & (i < k + columns)
            m = np.zeros((len(x), min(columns, len(shared) - k)), dtype=np.float32)
            m[r[own], i[own] - k] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def joining(a: dict, b: dict, percent: int, least: int) -> Iterator[tuple[int, int]]:
    """Links between members of two tiles of different roots: as many as join the roots that any link joins, and no more."""
    met = (a["root"][:, None] != b["root"][None, :]) & (100 * np.minimum(a["n"][:, None], b["n"][None, :]) >= percent * np.maximum(a["n"][:, None], b["n"][None, :]))
    for i in range(len(met)):  # a row at a time: a byte a coordinate
        j = np.flatnonzero(met[i])
        met[i, j] = (b["sketch"][j] == a["sketch"][i]).sum(axis=1) >= least
    mine, theirs = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
    if not len(mine):
        return
    both = overlaps([a["set"][i] for i in mine], [b["set"][j] for j in theirs])
    hit = met[np.ix_(mine, theirs)] & (100 * both >= percent * (a["n"][mine][:, None] + b["n"][theirs][None, :] - both))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.get(x, x)) != x:
            x = y
        return x

    for i, j in zip(*np.nonzero(hit), strict=True):
        i, j = mine[i], theirs[j]
        x, y = root(int(a["root"][i])), root(int(b["root"][j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            yield int(a["node"][i]), int(b["node"][j])


def apart(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """The links (a, b) that members (family, node, root, n, sketch, shingles) of different roots lack to be joined.

    In each family the members of all roots but the most frequent meet all members, tile by tile: overlaps of full sets are
    products inside a task, and only links that join roots leave it. So no pairs are listed, a family whose members are
    joined already costs nothing, and what isn't costs bounded pieces.
    """

    def columns(cell: pa.ListScalar) -> dict:
        held = cell.values
        return {k: held.field(i).to_numpy() for i, k in enumerate(("node", "root", "n"))} | {"sketch": _sketches(held.field(3)), "set": [np.frombuffer(x, "<u8") for x in held.field(4).to_pylist()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                found = list(joining(columns(mine), columns(theirs), percent, least))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    least = least_agreement(percent)
    by_root = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = by_root.groupBy("family").agg(F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("family", F.col("most.root").alias("most"))
    known = materialise(members.join(mixed, "family"), "apart")
    every, rest = materialise(_tiled(known.drop("most"), tile), "tiles"), _tiled(known.where("root <> most").drop("most"), tile)
    met = rest.select("family", F.col("held").alias("mine")).join(every.select("family", "held"), "family").select("mine", "held")
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "a long, b long")


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, tile: int) -> DataFrame:
    """Links (a, b) of classes that join all pairs that are similar enough and share a band into the same components.

    Classes that share a band, directly or by others, are a family. First each class is held against one of those that
    it shares a band with, the one with the most company, which is the likeliest to be what the others are copies of; most of
    a group of near copies is joined then, by a check of full sets for each. What isn't meets its family in tiles.
    """
    keyed = classes.select("node", F.explode("bands").alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialise(keyed.join(sizes, "key"), "shared")
    company = materialise(shared.groupBy("node").agg(F.sum("m").alias("company")), "company")
    hubs = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub"))
    members = materialise(shared.join(hubs, "key").select("node", "hub"), "members")
    facts = materialise(classes.join(company.select("node"), "node", "left_semi").drop("bands"), "facts")
    held = materialise(sets_of(facts.select("node", "first")), "held")
    best = members.where(F.col("hub.node") != F.col("node")).groupBy(F.col("node").alias("b")).agg(F.max("hub").alias("hub")).select(F.col("hub.node").alias("a"), "b")
    found = materialise(verified(materialise(close(best, facts, percent), "close"), held, percent), "links")
    families = components(members.select(F.col("hub.node").alias("a"), F.col("node").alias("b")))
    placed = facts.select("node", "n", "sketch").join(families.withColumnRenamed("root", "family"), "node").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return found.union(apart(placed.join(held, "node"), percent, tile))


def minhash_dedup(docs: DataFrame, shingle: int = 3, percent: int = 85, seed: int = 42, tile: int = 512, known: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of distinct word shingles have a Jaccard similarity of `percent` hundredths at least;
    fewer words than a shingle are one shingle. component_id is the smallest doc_id that links reach, the own
    included, kept tells whether it is the own. Candidates share one of 20 bands of four coordinates: a pair at 85
    percent is missed once in 2.6 million, one at 90 percent once in 10^9; every link is checked on full sets. Documents with equal sets are one
    class, so copies are never paired. Up to `known` classes with company are broadcast, as a hash each, to pick their texts; of
    more all texts are shuffled for the same join.

    Texts without words, null ones too, are linked with nothing: component_id is the own doc_id. A null doc_id gets
    a component like others, null only if no member has an id, and is kept then. Rows that repeat each have a row. An
    empty table gives an empty result. Only doc_id and text are read.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for similarities of 80 to 100 percent")
    rows = materialise(sets(docs, shingle, seed), "sets")
    grouped = rows.where("n > 0").groupBy("set").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    again = repeated_ids(docs)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node, shingles (the sorted hashes) of some classes."""
        wanted, texts = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.at").alias("place")), _texts(docs)
        if nodes.count() <= known:  # 64 bits a row: texts that aren't wanted aren't shuffled
            texts = texts.join(F.broadcast(wanted.select(F.xxhash64("id", "place").alias("_k"))), F.xxhash64("doc_id", "at") == F.col("_k"), "left_semi")
        found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("at") == F.col("place"))).select("node", "text")
        one = found if again is None else found.groupBy("node").agg(F.first("text").alias("text"))
        return one.mapInArrow(run, "node long, shingles binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle, seed).tobytes() for t in b.column(1)], pa.binary())], names=["node", "shingles"])

    roots = materialise(components(links(classes, sets_of, percent, tile)), "roots")
    rooted = materialise(classes.join(roots, "node", "left").select("set", "node", "least", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "components")
    facts = materialise(attach(rooted, ids, ["root"], "classes", F.col("node")).select("set", "copies", "component_id"), "facts")
    some = attach(rows.where("n > 0").select("doc_id", "n", "set"), facts, ["set"], "copies", F.col("doc_id")).select("doc_id", "n", "component_id")
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same rows, of the query's parameters, by plain comparison.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(ws) - 1)), lambda i: array_to_string(ws[i : i + 2], ' ')))) AS sh FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
