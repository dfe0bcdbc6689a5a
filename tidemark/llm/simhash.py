"""SimHash near-deduplication by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialise, packed, repeated_ids, unpacked
from .components import components

BLOCKS, BITS = 4, 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of all word shingles, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and white space as the contract has it
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: len(words) - k + 1]
    h, digest = np.empty(len(starts), dtype="<u8"), xxhash.xxh64_intdigest
    h[:] = [digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts in pieces: 64 bytes a shingle
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(distinct: DataFrame) -> DataFrame:
    """A row per fingerprint and pair of its four blocks: with two differing bits at most, two blocks are equal."""
    part = [F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)) for i in range(BLOCKS)]
    keys = [F.struct(F.lit(n).cast("byte").alias("pair"), (part[i] * F.lit(1 << BITS) + part[j]).alias("key")) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.key")


def links(distinct: DataFrame, bits: int = 2, cap: int = 64) -> DataFrame:
    """Links a, b that join all fingerprints within `bits` (at most 2) of each other into the same components.

    Fingerprints are joined on pairs of blocks and verified. A block that more than `cap` fingerprints share isn't
    joined with itself: each of its members stands, besides for itself, for the 32 values that differ from it in one
    of the bits outside the block. Two members share such a value exactly if they differ in two bits at most, and at
    most 33 members share one, so linking all that share it to the least of them loses no link and makes no pairs.
    """
    if not 0 <= bits <= 2:
        raise ValueError("two equal blocks of four are certain for up to 2 bits only")
    keyed = materialise(_blocks(distinct), "blocks")
    sizes = materialise(keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    shared = materialise(attach(keyed, sizes.withColumn("members", F.col("n")), ["pair", "key"], "n", F.col("fp")).where("members > 1").select("pair", "key", "fp", "members"), "shared")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    few = shared.where(F.col("members") <= cap)
    pairs = few.select("pair", "key", F.col("fp").alias("a")).join(few.select("pair", "key", F.col("fp").alias("b")), ["pair", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = shared.where(F.col("members") > cap)
    free = F.array(*[F.array(*[F.lit(BITS * b + i) for b in range(BLOCKS) if b not in pair for i in range(BITS)]) for pair in combinations(range(BLOCKS), 2)])
    values = F.concat(F.array("fp"), F.transform(F.element_at(free, F.col("pair") + 1), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = many.select("pair", F.col("fp").alias("a"), F.explode(values if bits == 2 else F.array("fp")).alias("value"))
    if bits == 1:  # one member is the value itself
        stars = many.select("pair", F.col("fp").alias("a"), F.explode(values).alias("value"))
    by_value = stars.withColumn("b", F.min("a").over(Window.partitionBy("pair", "value"))).where((F.col("a") != F.col("b")) & near).select("a", "b")
    return pairs.union(by_value).distinct()


def _members(docs: DataFrame, shingle: int, bits: int, seed: int, cap: int) -> DataFrame:
    """doc_id, fp, root (the component's least fingerprint) and component_id of every row."""
    rows = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = materialise(components(links(distinct.select("fp"), bits, cap)), "roots")
    rooted = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "components")
    facts = materialise(attach(rooted, ids, ["root"], "fps", F.col("fp")).select("fp", "n", "root", "component_id"), "facts")
    return attach(rows, facts, ["fp"], "n", F.col("doc_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42, cap: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the document's own included; links join fingerprints that
    differ in `bits` bits at most. Null and empty texts have fingerprint zero and are linked like any other; null
    doc_ids get a component like others and are its component_id only if no member has an id; rows that repeat a
    doc_id each have a row. An empty table gives an empty result. Only doc_id and text are read.
    """
    return _members(docs, shingle, bits, seed, cap).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42, cap: int = 64) -> DataFrame:
    """`docs` with one row of each component, all columns unchanged.

    That is the row of the component's smallest doc_id, null ids last; of several rows with it in the component that
    of the least fingerprint, then of the least hash of its text. A row that only shares its doc_id with a keeper of
    another component goes. Null texts count as empty; an empty table gives an empty result; other columns than doc_id and
    text may have any name and type.
    """
    keepers = _members(docs, shingle, bits, seed, cap).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("component_id").alias("keep"), F.min("fp").alias("keep_fp"))
    keepers, again = materialise(keepers, "keepers"), repeated_ids(docs)
    rows = packed(docs).withColumn("id", F.col("doc.doc_id").cast("long"))
    first = rows.join(keepers, F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    if again is None:  # then an id is a row
        return unpacked(first, docs.columns)
    single = first.join(again, F.col("id").eqNullSafe(F.col("again")), "left_anti").select("doc")
    shape = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc", "own"])

    tied = rows.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi").select("doc", F.col("doc.text").cast("string").alias("text")).mapInArrow(run, f"doc {shape}, own long")
    found = tied.join(keepers, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("keep_fp")))
    one = found.groupBy("root").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc")
    return unpacked(single.union(one), docs.columns)
