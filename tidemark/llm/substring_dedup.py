"""Removal of repeated passages by hashing lines and the sentences in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, materialise, packed, repeated_ids

#: A unit ends with its line, with a mark that ends a sentence and white space after it, or with a full-width mark.
_UNIT = re.compile(r"[^\n]*?(?:[.?!;؟؛۔।॥](?=[\x20\x09\x0B-\x0D])|[。｡！？；]|(?=\n)|\Z)", re.S)
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def units(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """start, end, normalised text, number of words and number of the line of each unit with words of a whole text.

    A unit is normalised by lower-casing and by writing each run of white space as one blank, none at the ends.
    """
    out, at, line, text = [], 0, 0, text or ""
    while at < len(text):
        end = _UNIT.match(text, at).end()
        norm = _SPACES.sub(" ", text[at:end].lower()).strip(" ")
        if norm:
            out.append((at, end, norm, norm.count(" ") + 1, line))
        if end == at:  # a newline
            at, line = at + 1, line + 1
        else:
            at = end
    return out


def lines(parts: list[tuple], below: int) -> list[tuple[int, int, str, int]]:
    """The lines among `units` that hold one of fewer than `below` words: first unit, number of units, normalised text and words."""
    out, at = [], 0
    for _, same in groupby(parts, key=lambda u: u[4]):
        of = list(same)
        if any(u[3] < below for u in of):
            out.append((at, len(of), " ".join(u[2] for u in of), sum(u[3] for u in of)))
        at += len(of)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, a number of each row, if rows repeat a doc_id; written once, so that the numbers stay. Else `docs` as it is."""
    if repeated_ids(docs) is None:
        return docs
    return materialise(docs.drop("_row").withColumn("_row", F.monotonically_increasing_id()), "numbered")


def hashed_units(docs: DataFrame, lines_below: int = 0) -> DataFrame:
    """doc_id, text_key, unit, start_char, end_char, words, holds and the 128-bit XXH3 (h1, h2) of every unit of all texts.

    holds is 0; a line with a unit of fewer than `lines_below` words has a row besides, at its first unit, in which
    it is the number of units that the line holds. Such a row has a hash of its own: no unit has a newline before it.
    `_row` comes last, if `docs` has it (see numbered).
    """
    row = ["_row"] if "_row" in docs.columns else []
    names = ["doc_id", "text_key", "unit", "start_char", "end_char", "words", "holds", "h1", "h2", *row]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), *[pa.int64() for _ in row]]

    def entries(text: str) -> list[tuple[int, int, int, int, int, str]]:
        parts = units(text)
        out = [(k, u[0], u[1], u[3], 0, u[2]) for k, u in enumerate(parts)]
        if lines_below:
            out += [(k, parts[k][0], parts[k + n - 1][1], words, n, "\n" + norm) for k, n, norm, words in lines(parts, lines_below)]
        return out

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        ids = [p[0] for p in parts for _ in p[2]]
        keys = np.repeat(np.array([p[1] for p in parts], dtype=np.uint64).view(np.int64), [len(p[2]) for p in parts])
        flat = [u for p in parts for u in p[2]]
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u[5].encode("utf-8", "surrogatepass")) for u in flat), dtype=">i8").astype(np.int64).reshape(-1, 2)
        cols = [ids, keys, *[[u[i] for u in flat] for i in range(5)], h[:, 0], h[:, 1], *[[p[3] for p in parts for _ in p[2]] for _ in row]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for k, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                t = text.as_py() or ""
                parts.append((doc_id, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), entries(t), b.column(2)[k].as_py() if row else None))
                held += len(t)
                if held > 4_000_000:
                    yield flush(parts)
                    parts, held = [], 0
            yield flush(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row).mapInArrow(run, "doc_id long, text_key long, unit int, start_char int, end_char int, words int, holds int, h1 long, h2 long" + ", _row long" * len(row))


def repeated_units(docs: DataFrame, min_run_words: int = 30, min_unit_words: int | None = None) -> DataFrame:
    """One row per removed unit: doc_id, text_key, unit, start_char, end_char, words, run_words, keep_doc_id, keep_unit.

    Occurrences of a unit are ranked by (doc_id, unit, text), null doc_ids last; the first stays. A later one goes if
    it lies in a run of such units that together have at least `min_run_words` words. With `min_unit_words` a later
    one of so many words goes by itself too, and so do all units of a line that, as a whole and normalised alike, is
    a line before; what stays of later ones are shorter fragments inside lines that are new as a whole. Units without words aren't counted. Offsets are code points of the original text,
    end exclusive. Null texts count as empty, empty texts have no unit; of rows that repeat doc_id and text one is the first and
    the others are later than it, each with rows of its own. An empty table gives an empty result; only doc_id and text are read.
    """
    return _repeated(numbered(docs.select("doc_id", "text")), min_run_words, min_unit_words).drop("_row")


def _repeated(docs: DataFrame, min_run_words: int, min_unit_words: int | None) -> DataFrame:
    """repeated_units of rows that may have `_row`, which then comes last."""
    parts = hashed_units(docs, min_unit_words or 0)
    row = ["_row"] if "_row" in parts.columns else []
    h = ["h1", "h2"]
    # null ids come last: the order is that of two numbers, and a decimal of both keeps the aggregation in hash tables
    place = lambda d, u: (F.coalesce(d.cast("decimal(20,0)"), F.expr("9223372036854775808BD")) * F.expr("4294967296BD") + u.cast("decimal(10,0)")).cast("decimal(38,0)")
    counted = parts.groupBy(*h).agg(F.min(place(F.col("doc_id"), F.col("unit"))).alias("at"), F.count(F.lit(1)).alias("n"))
    facts = materialise(counted.where("n > 1"), "units")
    told = attach(parts, facts.withColumn("copies", F.col("n")), h, "n", F.struct("doc_id", "unit")).where("copies > 1").drop("copies")
    doc = ["doc_id", "text_key", *row]
    once = told.withColumn("nth", F.row_number().over(Window.partitionBy(*doc, "unit", F.col("holds") > 0).orderBy("start_char"))).where("nth = 1").drop("nth")
    # of texts with one doc_id that hold a unit at the same place, the one with the least key is first
    tied = once.withColumn("least", F.min("text_key").over(Window.partitionBy("doc_id", "unit", *h)))
    first = (place(F.col("doc_id"), F.col("unit")) == F.col("at")) & (F.col("text_key") == F.col("least"))
    if row:
        tied = tied.withColumn("copy", F.min("_row").over(Window.partitionBy("doc_id", "unit", "text_key", *h)))
        first = first & (F.col("_row") == F.col("copy"))
    later = tied.where(~first)
    # a line comes before its units
    upto = Window.partitionBy(*doc).orderBy("unit", F.desc("holds")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.sum(F.when(F.col("holds") == 0, 1).otherwise(0)).over(upto)
    lined = F.coalesce(F.max(F.when(F.col("holds") > 0, F.col("unit") + F.col("holds"))).over(upto), F.lit(0)) > F.col("unit")
    runs = later.withColumns({"run": F.col("unit") - nth, "lined": lined}).where("holds = 0")
    goes = F.col("run_words") >= min_run_words
    if min_unit_words is not None:
        goes = goes | (F.col("words") >= min_unit_words) | F.col("lined")
    sums = runs.withColumn("run_words", F.sum("words").over(Window.partitionBy(*doc, "run"))).where(goes)
    keep = F.expr("floor(at / 4294967296BD)").cast("decimal(38,0)")
    return sums.select("doc_id", "text_key", "unit", "start_char", "end_char", "words", "run_words", F.when(keep < F.expr("9223372036854775808BD"), keep.cast("long")).alias("keep_doc_id"), F.expr("cast(pmod(at, 4294967296BD) as int)").alias("keep_unit"), *row)


def remove_repeats(docs: DataFrame, min_run_words: int = 30, min_unit_words: int | None = None) -> DataFrame:
    """`docs` with the repeated units cut from `text`, and `removed`: their offsets in the original text (a column of that name is replaced)."""
    names = [c for c in docs.columns if c != "removed"]
    whole = numbered(packed(docs).select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")))
    row = ["_row"] if "_row" in whole.columns else []
    spans = _repeated(whole.drop("doc"), min_run_words, min_unit_words).groupBy("doc_id", "text_key", *row).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([xxhash.xxh3_64_intdigest((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int64()), *[b.column(2) for _ in row]], names=["doc", "key", *["at" for _ in row]])

    keyed = whole.select("doc", F.col("text").cast("string").alias("text"), *row).mapInArrow(keys, f"doc {whole.schema['doc'].dataType.simpleString()}, key long" + ", at long" * len(row))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    joined = keyed.join(spans, same & (F.col("at") == F.col("_row")) if row else same, "left")
    none = F.array().cast("array<struct<start_char:int,end_char:int>>")
    found = joined.select("doc", F.coalesce("spans", none).alias("spans"))
    zero = F.struct(F.lit("").alias("said"), F.lit(0).alias("at"))
    text = F.col("doc.text").cast("string")
    cut = F.aggregate("spans", zero, lambda a, s: F.struct(F.concat(a["said"], F.substring(text, a["at"] + 1, s["start_char"] - a["at"])).alias("said"), s["end_char"].alias("at")), lambda a: F.concat(a["said"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return found.select(*[F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(cut).alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names], F.col("spans").alias("removed"))
