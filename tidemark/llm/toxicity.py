"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, materialise, packed, unpacked

#: Small general lexicons of insults, a voter each; a parameter, so that others can be given.
LEXICONS: dict[str, tuple[str, ...]] = {
    "wits": ("idiot", "moron", "stupid", "dumb", "imbecile"),
    "worth": ("loser", "worthless", "pathetic", "trash", "clown"),
    "disgust": ("scum", "disgusting", "filth", "vermin"),
    "other languages": ("crétin", "débile", "imbécile", "trottel", "depp", "abschaum", "estúpido", "imbécil", "basura"),
}
INSULTS = tuple(w for words in LEXICONS.values() for w in words)
PREFIXES = (3, 4, 5, 6)
FOLDS = 2
RATIO = 50  # a mined token is at least so many times as frequent in toxic rows as in clean ones
_WORD = re.compile(r"[^\W\d_]+")
_ANY = "|".join(INSULTS)
#: Patterns over the lower-cased text of documents with an insult, a voter each.
PATTERNS = (
    re.compile(rf"\b(?:you|your|du|ihr|tu|vous|eres|usted)\b[^.!?\n]{{0,40}}\b(?:{_ANY})\b"),  # addressed
    re.compile(rf"\b(?:such|what|is|are|was|were|by|of)\s+(?:an?|the)?\s*(?:{_ANY})\b"),  # predicated
    re.compile(rf"\b(?:{_ANY})\b[^.!?\n]{{0,20}}(?:!|\b(?:{_ANY})\b)"),  # shouted or doubled
)


def tokens(text: str | None) -> set[str]:
    """Words (ending in $) and word beginnings of a whole text; a beginning of two (three) different words and of a hundredth (fiftieth) of all also with 2 (3) at its end."""
    words = set(_WORD.findall((text or "").lower()))
    found = {w + "$" for w in words}
    for k in PREFIXES:
        begun = Counter([w[:k] for w in words if len(w) > k])
        found.update(begun)
        for p, n in begun.items():
            if n > 1 and n * 100 >= len(words):
                found.add(p + "2")
                if n > 2 and n * 50 >= len(words):
                    found.add(p + "3")
    return found


@dataclass
class Model:
    """What scoring needs; its size is bounded by the numbers of features and voters."""

    features: list[str]
    lexicons: list[list[str]]
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    prior: float = 0.5
    rates: list[tuple[float, float]] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)

    @property
    def voters(self) -> int:
        return len(LEXICONS) + 1 + len(PATTERNS) + len(self.lexicons)


def _marker(model: Model):
    """A function from a text to its votes, as bits, and the numbers of its features: one tokenising pass for both.

    The voters are the fixed lexicons, two different insults, the patterns and the mined lexicons.
    """
    fixed = {w + "$": 1 << k for k, words in enumerate(LEXICONS.values()) for w in words}
    first = len(LEXICONS) + 1
    mined: dict[str, int] = {}
    for i, words in enumerate(model.lexicons):
        for w in words:
            mined[w] = mined.get(w, 0) | 1 << (first + len(PATTERNS) + i)
    at = {t: i for i, t in enumerate(model.features)}

    def mark(text: str | None) -> tuple[int, list[int]]:
        found = tokens(text)
        votes, insults = 0, fixed.keys() & found
        for w in insults:
            votes |= fixed[w]
        if insults:
            low = text.lower()
            votes |= (len(insults) > 1) << (first - 1)
            for k, p in enumerate(PATTERNS):
                votes |= (p.search(low) is not None) << (first + k)
        for w in mined.keys() & found:
            votes |= mined[w]
        return votes, sorted(at[t] for t in at.keys() & found)

    return mark


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled rows whose crc32(doc_id) mod 3 isn't 1, chosen by a hash of the id."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = materialise(told.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "told")
    # at most `most` pairs of numbers, so that they can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(least_hashes(told, most)), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [least_shingle(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], names=["doc_id", "text", "toxic", "copies"])

    # copies would make chance words look like a lexicon: of rows with the same label and least shingle hash one counts
    rows = rows.select("doc_id", "text", "toxic").mapInArrow(keyed, "doc_id long, text string, toxic int, copies string")
    return rows.groupBy("copies", "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("d.doc_id", "d.text", "toxic")


def least_shingle(text: str | None) -> str:
    """The least XXH64 of the five-word shingles (of fewer words: of the whole), which near copies mostly share."""
    w = (text or "").lower().split()
    return min(xxhash.xxh64_hexdigest(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learned from; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mine(sample: DataFrame, least: int, n_features: int, lexicon: int) -> tuple[Model, int, int]:
    """Features by the z-score of their log odds between the labels, and lexicons of tokens that hardly occur in clean rows.

    There is a lexicon of at most `lexicon` tokens for each kind of token (words, beginnings, those of two or of three words)
    and each of two folds of the rows, so that lexicons share neither tokens nor, within a kind, the rows that they are from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}
        for b in batches:
            for text, y, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for t in ("", *tokens(text.as_py())):
                    counts.setdefault((fold, t), [0, 0])[y > 0] += 1
            if len(counts) > 200_000:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    def rows(counts: dict[tuple[int, str], list[int]]) -> pa.RecordBatch:
        kinds = pa.int32(), pa.string(), pa.int64(), pa.int64()
        cols = [k[0] for k in counts], [k[1] for k in counts], [c[0] for c in counts.values()], [c[1] for c in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["fold", "token", "n0", "n1"])

    folds = sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    by_fold = materialise(folds.mapInArrow(run, "fold int, token string, n0 long, n1 long").groupBy("fold", "token").agg(*sums), "tokens")
    size = {r.fold: (r.n0, r.n1) for r in by_fold.where("token = ''").collect()}
    n0, n1 = (sum(x[i] for x in size.values()) for i in (0, 1))

    def scored(counts: DataFrame, n0: int, n1: int) -> DataFrame:
        odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
        return counts.where("token != ''").withColumn("z", odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))

    whole = scored(by_fold.groupBy("token").agg(*sums), n0, n1).where(F.col("n0") + F.col("n1") >= least)
    high = [r.token for r in whole.orderBy(F.desc("z"), "token").limit(n_features * 3 // 4).collect()]
    low = [r.token for r in whole.orderBy("z", "token").limit(n_features // 4).collect()]
    lexicons = []
    for fold in range(FOLDS):
        a, b = size.get(fold, (0, 0))
        pure = scored(by_fold.where(F.col("fold") == fold), a, b).where((F.col("n1") >= max(2, least // 2)) & (F.col("n1") * F.lit(a + 1.0) >= RATIO * (F.col("n0") + 0.5) * F.lit(b + 1.0)))
        for kind in (r"\$$", "2$", "3$", "[^$23]$"):
            of_kind = F.col("token").rlike(kind)
            lexicons.append([r.token for r in pure.where(of_kind).orderBy(F.desc("z"), "token").limit(lexicon).collect()])
    return Model(list(dict.fromkeys(high + low)), lexicons), n0, n1


def _tree(v: np.ndarray, w: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in the spanning tree of the most mutual information given the class (Chow and Liu)."""
    k = v.shape[1]
    total, info = w.sum(), np.zeros((k, k))
    for wy in w:
        both = (v * wy[:, None]).T @ v / total
        one, n = (wy @ v) / total, wy.sum() / total
        for p, a, b in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], n - one[None, :]), (one[None, :] - both, n - one[:, None], one[None, :]), (n - one[:, None] - one[None, :] + both, n - one[:, None], n - one[None, :])):
            info += np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) * n / np.maximum(a * b, 1e-12)), 0.0)
    parent, best, link = [-1] * k, info[0].copy(), [0] * k
    left = set(range(1, k))
    while left:
        j = max(left, key=lambda i: (best[i], -i))
        parent[j] = link[j]
        left.discard(j)
        for i in left:
            if info[j, i] > best[i]:
                best[i], link[i] = info[j, i], j
    return parent


def fit_label_model(counts: dict[int, int], voters: int, prior: float, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray, dict[int, float]]:
    """Two classes behind the voters' patterns, by expectation maximisation on the patterns' counts.

    Each voter has a rate of firing in either class (its accuracy). After some rounds of independent voters, the
    correlations inside the classes enter: a voter's rate then depends on the vote of its parent in a tree of the strongest
    dependencies, so that what repeats another voter adds little. A voter is taken to be no worse than chance. Returns
    prior, rates (voters x 2), correlations inside the classes and the posterior of each pattern.
    """
    if not counts:
        return prior, np.zeros((voters, 2)), np.eye(voters), {}
    pats = np.array(list(counts), dtype=np.int64)
    n = np.array([counts[p] for p in pats.tolist()], dtype=float)
    v = (pats[:, None] >> np.arange(voters) & 1).astype(float)
    pi, parent = min(max(prior, 1e-3), 0.5), [-1] * voters
    up = np.zeros((len(pats), voters), dtype=int)  # the parent's vote, 0 without one
    rate = np.tile(np.array([0.01, 0.5])[None, :, None], (2, 1, voters))  # parent's vote, class, voter
    post = np.zeros(len(pats))
    for i in range(rounds):
        if i == 10:
            parent = _tree(v, np.stack([n * (1 - post), n * post]))
            up = np.stack([v[:, p].astype(int) if p >= 0 else np.zeros(len(pats), dtype=int) for p in parent], axis=1)
        logit = np.full(len(pats), math.log(pi / (1 - pi)))
        for y, sign in ((1, 1.0), (0, -1.0)):
            r = np.clip(rate[up, y, np.arange(voters)], 1e-5, 1 - 1e-4)
            logit += sign * (v * np.log(r) + (1 - v) * np.log(1 - r)).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        w = np.stack([n * (1 - post), n * post])
        for b in (0, 1):
            there = up == b
            for y in (0, 1):
                # pseudo-rows keep rates off 0 and 1
                rate[b, y] = ((w[y][:, None] * v * there).sum(axis=0) + (0.5 if y else 0.01)) / ((w[y][:, None] * there).sum(axis=0) + 1)
        rate[:, 0] = np.minimum(rate[:, 0], rate[:, 1])
        pi = min(max((w[1].sum() + prior) / (n.sum() + 1), 1e-4), 0.5)
    rates = np.stack([(w[1] @ v + 0.5) / (w[1].sum() + 1), (w[0] @ v + 0.01) / (w[0].sum() + 1)], axis=1)
    a, b = v - rates[:, 0], v - rates[:, 1]
    cov = (a * w[1][:, None]).T @ a + (b * w[0][:, None]).T @ b
    d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return pi, rates, cov / np.outer(d, d), dict(zip(pats.tolist(), post.tolist()))


def _marked(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (doc, text) -> doc, votes, hits, written once, so that fitting and scoring tokenise no text again."""
    mark = _marker(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(i, 1000) for part in batches for i in range(0, part.num_rows, 1000)):
            got = [mark(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc", "votes", "hits"])

    return materialise(rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, votes int, hits array<int>"), "marked")


def _fit(docs: DataFrame, rows: DataFrame, labels: DataFrame, most: int, n_features: int, lexicon: int, least: int) -> tuple[Model, DataFrame]:
    """The model, and `rows` (doc, text) marked: lexicons of labelled rows, then the votes of all documents, then a classifier."""
    sample = materialise(training_rows(docs, labels, most), "labelled")
    model, n0, n1 = mine(sample, least, n_features, lexicon)
    if not n0 or not n1 or not model.features:
        model.features, model.lexicons, model.weights, model.bias = [x + "$" for x in INSULTS], [], [3.0] * len(INSULTS) + [0.0] * (len(LEXICONS) + 1 + len(PATTERNS)), -2.0
        return model, _marked(rows, model)
    marked = _marked(rows, model)
    # at most 2 to the number of voters, whatever the input
    patterns = {r.votes: r.n for r in marked.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model.prior, rates, corr, post = fit_label_model(patterns, model.voters, n1 / (n0 + n1))
    model.rates, model.correlations = [tuple(x) for x in rates.tolist()], corr.tolist()
    own, size = len(model.features), len(model.features) + model.voters

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = np.zeros((b.num_rows, size))
            votes = np.array(b.column(0).to_pylist(), dtype=np.int64)
            for x, hits in zip(xs, b.column(1).to_pylist()):
                x[hits] = 1
            xs[:, own:] = votes[:, None] >> np.arange(model.voters) & 1
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(xs), pa.list_(pa.float64())), "p": pa.array([post.get(p, 0.0) for p in votes.tolist()], pa.float64())})

    ids = marked.select(F.col("doc.doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    chosen = F.broadcast(least_hashes(ids, most))
    seen = marked.withColumn("doc_id", F.col("doc.doc_id").cast("long")).join(chosen, "doc_id").select("votes", "hits").mapInArrow(vectors, "x array<double>, p double")
    # a posterior is two weighted labels
    both = seen.select(array_to_vector("x").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("l")).select("features", "l.label", "l.w").where("w > 1e-6").cache()
    try:
        spread = both.agg(F.min("label"), F.max("label")).first()
        if spread[0] is None or spread[0] == spread[1]:  # the voters see one class only: their weights stay those of a constant
            model.weights, model.bias = [0.0] * size, -5.0 if spread[0] != 1 else 5.0
            return model, marked
        lr = LogisticRegression(maxIter=60, regParam=1e-4, weightCol="w", standardization=False).fit(both)
    finally:
        both.unpersist()
    model.weights, model.bias = lr.coefficients.toArray().tolist(), float(lr.intercept)
    return model, marked


def _score(model: Model) -> Column:
    """The classifier's probability, from votes and hits."""
    own = len(model.features)
    weights = F.array(*[F.lit(float(w)) for w in model.weights[:own]])
    z = F.lit(model.bias) + F.aggregate("hits", F.lit(0.0), lambda a, h: a + F.element_at(weights, h + 1))
    for k, w in enumerate(model.weights[own:]):
        z = z + F.when(F.col("votes").bitwiseAND(F.lit(1 << k)) > 0, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 20_000, n_features: int = 512, lexicon: int = 500, least: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Lexicons of at most `lexicon` tokens and `n_features` features come from at most `most` labelled rows, none held
    out; the votes are those of all whole texts; the classifier learns the label model's posteriors on at most `most`
    documents, none held out. Null and empty texts get the score of a text without any feature. Labels with a null
    doc_id or label are left out, of several for a document the highest counts; rows that repeat a doc_id are each
    scored, and a null doc_id isn't held out. Without labels of both kinds the fixed lexicons score. An empty table
    gives an empty result. Only doc_id and text are read of the documents; neither doc_id, source, lang nor a label
    enters a score.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    model, marked = _fit(docs, rows, labels, most, n_features, lexicon, least)
    out = marked.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), _score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 20_000, n_features: int = 512, lexicon: int = 500, least: int = 5) -> DataFrame:
    """`docs` without those whose score, as in `toxicity`, reaches the threshold; all columns unchanged.

    Null and empty texts are scored like others; each of several rows that repeat a document is judged; an empty table
    gives an empty result; other columns than doc_id and text may have any name and type.
    """
    rows = packed(docs).withColumn("text", F.col("doc.text").cast("string"))
    model, marked = _fit(docs, rows, labels, most, n_features, lexicon, least)
    return unpacked(marked.where(_score(model) < threshold), docs.columns)
