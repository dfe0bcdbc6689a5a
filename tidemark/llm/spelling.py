"""Groups of spelling variants: blocked Gram matrices of letter counts find the words that are one edit apart."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: ISO 8859-1 codes: small letters and À to ÿ stay, A to Z become small, anything else is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: The column of a letter in a matrix of counts: a to z, then À to ÿ.
COLUMN = np.array([c - 97 if c < 0xC0 else c - 0xC0 + 26 for c in range(256)])
LETTERS = 26 + 64
PIECE = 1 << 20
PAIRS = "word string, n_near long, near_n long, near string"


def runs(text: str | None) -> Iterator[list[bytes]]:
    """The maximal runs of letters of a whole text, in ISO 8859-1, a list for each piece of about a million characters."""
    folded = (text or "").encode("latin-1", "replace").translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)  # pieces end between runs
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(doc_id: int | None, text: str | None, least: int, typo_every: int | None) -> Counter:
    """How often a text has each word of at least `least` letters, after the planted deletions."""
    found, before = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in runs(text):
        for run, n in Counter(piece).items():
            if len(run) < least:
                continue
            if typo_every:
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
                if h % typo_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < least:
                        continue
            found[run] += n
    return found


def vocabulary(docs: DataFrame, least: int = 6, min_count: int = 5, typo_every: int | None = None, most: int = 200_000) -> DataFrame:
    """word, n: the words of at least `least` letters that occur `min_count` times in all documents together.

    A task sums what it reads and hands on its sums whenever it holds `most` words, so that frequent words don't
    travel as occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                held.update(counted(i.as_py(), t.as_py(), least, typo_every))
                if len(held) >= most:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters dealt to `groups` strings by their frequency in `words`: at most 90 counts reach the driver."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").collect()
    dealt, load = [""] * groups, [0] * groups
    for r in found:
        g = min(range(groups), key=lambda i: (load[i], i))
        dealt[g] += r["c"]
        load[g] += r["n"]
    return dealt


def blocks(words: DataFrame, groups: int, tile: int) -> DataFrame:
    """key, tile, sums, size (letters of a word), words (one string without blanks), ns: words with equal numbers of letters of each group, in tiles of about `tile` words.

    The numbers add up to the length, so a block holds words of one length.
    """
    sums = [F.length("word") - F.length(F.translate("word", letters, "")) if letters else F.lit(0) for letters in letter_groups(words, groups)]
    keyed = words.withColumn("sums", F.array(*sums)).withColumn("key", F.concat_ws(".", F.col("sums").cast("array<string>")))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile).select("key", F.ceil(F.col("m") / tile).alias("tiles"))
    dealt = keyed.join(large, "key", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("word"), "tiles"), F.lit(0)))
    held = dealt.groupBy("key", "tile").agg(F.first("sums").alias("sums"), F.first(F.length("word")).alias("size"), F.collect_list(F.struct("word", "n")).alias("held"))
    return held.select("key", "tile", "sums", "size", F.concat_ws("", "held.word").alias("words"), F.col("held.n").alias("ns"))


def _neighbours(groups: int) -> list:
    """Keys of the blocks whose words may be one edit from a block's own, each pair of blocks once: itself, one letter moved to an earlier group, one letter more."""
    at = [F.col("sums")[i] for i in range(groups)]
    moves = [{}] + [{i: 1, j: -1} for i in range(groups) for j in range(i + 1, groups)] + [{i: 1} for i in range(groups)]
    return [F.concat_ws(".", *[(at[i] + m.get(i, 0)).cast("string") for i in range(groups)]) for m in moves]


def letters_of(words: str, size: int) -> np.ndarray:
    """A row of codes for each of some words of one length that stand without blanks."""
    return np.frombuffer(words.encode("latin-1"), np.uint8).reshape(-1, size)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """A row of letter counts for each row of codes; longer words than 2,000 letters are counted in integers, as float32 isn't exact there."""
    cells = COLUMN[codes] + np.arange(len(codes))[:, None] * LETTERS
    return np.bincount(cells.ravel(), minlength=len(codes) * LETTERS).reshape(-1, LETTERS).astype(np.float32 if codes.shape[1] <= 2000 else np.int64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of rows a and b are exactly one edit apart; b's words are as long as a's or one letter longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def near_pairs(short: np.ndarray, long: np.ndarray, same: bool, rows: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words of `short` and `long` that are one edit apart, by squared distances of their letter counts.

    One Gram product gives all distances: |a|² + |b|² - 2ab. A replaced letter makes it 2, a letter more 1.
    """
    a, b = counts_of(short), counts_of(long)
    near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T) <= 2
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    step = max(1, rows // max(1, short.shape[1]))
    hit = [one_edit(short[i[k : k + step]], long[j[k : k + step]]) for k in range(0, len(i), step)]
    hit = np.concatenate(hit) if hit else np.zeros(0, bool)
    return i[hit], j[hit]


def _best(words: np.ndarray, other: np.ndarray, other_n: np.ndarray) -> pa.RecordBatch:
    """For each word of some links: how many there are, the greatest count of a linked word, and the least word of that count."""
    order = np.lexsort((other, -other_n, words))
    words, other, other_n = words[order], other[order], other_n[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    text = lambda x: pa.array(np.char.decode(x, "latin-1").tolist(), pa.string())
    return pa.RecordBatch.from_arrays([text(words[first]), pa.array(np.diff(np.r_[first, len(words)]), pa.int64()), pa.array(other_n[first], pa.int64()), text(other[first])], names=["word", "n_near", "near_n", "near"])


def _linked(most: int):
    """Links of tiles, summed for each word: rows (id, size, words, ns of a tile, size, words, ns of one that it meets, whether they are one).

    Rows of one id that follow each other are multiplied together, up to `most` words at once.
    """

    def links(tile: tuple, size: int, met: list[tuple], same: bool) -> Iterator[pa.RecordBatch]:
        mine, ns = letters_of("".join(m[0] for m in met), size), np.concatenate([m[1] for m in met])
        i, j = near_pairs(mine, tile[0], same)
        if len(i):
            a, b = (np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel() for x in (mine[i], tile[0][j]))  # compared by bytes, that is by code points
            yield _best(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([tile[1][j], ns[i]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        met: dict[int, list[tuple]] = {}  # by length, that of the tile or one letter less

        def flush() -> Iterator[pa.RecordBatch]:
            for size, own in met.items():
                yield from links(tile, size, own, False)
            met.clear()

        for b in batches:
            ids, sizes, mets, sames = (b.column(k).to_pylist() for k in (0, 1, 4, 7))
            for k, at in enumerate(ids):
                own = (b.column(5)[k].as_py(), b.column(6)[k].values.to_numpy())
                if at != now:
                    yield from flush()
                    now, tile = at, (letters_of(b.column(2)[k].as_py(), sizes[k]), b.column(3)[k].values.to_numpy())
                if sames[k]:
                    yield from links(tile, sizes[k], [own], True)
                    continue
                met.setdefault(mets[k], []).append(own)
                if sum(len(x[1]) for own in met.values() for x in own) > most:
                    yield from flush()
        yield from flush()

    return run


def near_words(words: DataFrame, groups: int = 5, tile: int = 1024) -> DataFrame:
    """word, n_near, near_n, near: for each word with near words their number, the greatest count of one, and the least of those with it.

    Words are near if they are exactly one inserted, deleted or replaced letter apart. An edit changes the numbers of
    letters in `groups` groups by at most one each in at most two of them, so a block meets only 1 + groups +
    groups (groups - 1) / 2 blocks of its own and the next length. Tiles bound what a product holds; a block of many
    tiles is met tile by tile, each in a place of its own. The products are costly for their bytes, so the join is dealt
    to as many tasks as the session's shuffles have, not to fewer by size.
    """
    spark, tiles = words.sparkSession, materialise(blocks(words, groups, tile), "tiles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = tiles.groupBy("key").agg((F.max("tile") + 1).alias("many")).where("many > 1")
    homes = tiles.select(F.col("key").alias("home"), F.col("tile").alias("home_tile"), F.col("size").alias("own_size"), F.col("words").alias("own"), F.col("ns").alias("own_ns"), F.explode(F.array(*_neighbours(groups))).alias("key"))
    sent = homes.join(many, "key", "left").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("many", F.lit(1).cast("long")) - 1))).where("home <> key or home_tile <= tile")
    met = sent.repartition(parts, "key", "tile").join(tiles.drop("sums").repartition(parts, "key", "tile"), ["key", "tile"])
    same = (F.col("home") == F.col("key")) & (F.col("home_tile") == F.col("tile"))
    rows = met.select(F.concat_ws("/", "key", F.col("tile").cast("string")).alias("id"), "size", "words", "ns", "own_size", "own", "own_ns", same.alias("same"))
    found = rows.mapInArrow(_linked(4 * tile), PAIRS)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.least")).alias("near_n"), F.col("best.near").alias("near"))


def followed(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: where the chain of forms ends, for each word with a form.

    Chains are halved in each round. Counts grow along a chain, by a ratio, so it has a few dozens of members at most and no circle.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = materialise(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def spelling_variants(docs: DataFrame, least: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int | None = None, groups: int = 5, tile: int = 1024) -> DataFrame:
    """One row per word: word, form, root (strings), n, n_near, form_n (longs).

    Words are maximal runs of the letters A-Z, a-z and À-ÿ in whole texts, A-Z lower-cased, of `least` letters or more
    that occur `min_count` times or more. A word's form is its near word of greatest n, the least by code points of
    several, if it occurs at least `ratio` times as often; root is where the chain of forms ends. With `typo_every`,
    one in so many occurrences, chosen by a hash of document and run, loses a letter before it is counted.

    Null and empty texts have no words, a null doc_id is an empty one for that hash, rows that repeat count as often
    as they stand there, an empty table has no words. Only doc_id and text are read. `ratio` is at least 2, so that chains end.
    """
    if ratio < 2:
        raise ValueError("a form has to occur at least twice as often, or chains needn't end")
    words = materialise(vocabulary(docs, least, min_count, typo_every), "vocabulary")
    near = near_words(words, groups, tile)
    some = F.col("near_n") >= F.col("n") * ratio
    told = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(some, F.col("near")).alias("form"), F.when(some, F.col("near_n")).alias("form_n")), "near")
    roots = followed(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows, of the query's parameters, by plain comparison.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY 1, 2), x AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS h FROM g),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INT)])), 4294967295) AS crc FROM x, tab),
v AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2) ELSE run END AS word, n FROM c),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words), q AS (SELECT word, n, substr(word, 1, CAST(i AS INT) - 1) || '*' || substr(word, CAST(i AS INT) + 1) AS k, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS less FROM p),
near AS (SELECT a.word, b.word AS other FROM q a JOIN q b ON a.k = b.k AND a.word <> b.word UNION SELECT q.word, w.word FROM q JOIN words w ON w.word = q.less UNION SELECT w.word, q.word FROM q JOIN words w ON w.word = q.less),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS near_n, arg_min(other, (-o.n, encode(other))) AS other FROM near JOIN words o ON o.word = other GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN other END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ch AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT ch.word, f.form FROM ch JOIN f ON f.word = ch.root WHERE f.form IS NOT NULL),
ends AS (SELECT ch.word, ch.root FROM ch JOIN f ON f.word = ch.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word
"""
