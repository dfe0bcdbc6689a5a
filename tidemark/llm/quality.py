"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, attach, least_hashes, materialise

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "distinct", "repeated_lines", "line_words", "ended_lines", "long_words")


def features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the shape of each whole `text`, all 0 without words: lengths, shares of kinds of characters, repetition of words and lines.

    Everything is counted by built-in functions, each once: the counts are a projection of their own.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    counted = rows.select(*keep, text.alias("text"), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("_lines")).select(
        *keep,
        count(WORD).alias("_words"),
        F.char_length("text").alias("_chars"),
        F.char_length(F.regexp_replace("text", f"{SPACE}+", "")).alias("_ink"),
        count(r"[^\p{L}\x20\x09-\x0D]").alias("_others"),  # far fewer than letters
        count(r"\p{Lu}").alias("_upper"),
        count(r"\p{Nd}").alias("_digits"),
        count(r"[^\p{L}\p{N}\s.,'\"\-;:()]").alias("_symbols"),
        count(r"[!|?*#=<>{}](?=[\x20\x09-\x0D]|\z)").alias("_marks"),
        F.size(F.array_distinct(F.split("text", f"{SPACE}+"))).alias("_distinct"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_new_lines"),
        count(r"[.!?][\x20\x09\x0B-\x0D]*(?=\n|\z)").alias("_ends"),
        count(r"[^\x20\x09-\x0D]{21,}").alias("_long"),
    )
    c = F.col
    n, m, chars = F.greatest(F.lit(1.0), c("_words")), F.greatest(F.lit(1), c("_n_lines")).cast("double"), F.greatest(F.lit(1), c("_chars"))
    shapes = {
        "log_words": F.log1p("_words"),
        "word_length": c("_ink") / n,
        "upper": c("_upper") / F.greatest(F.lit(1.0), c("_ink") - c("_others")),
        "digit": c("_digits") / chars,
        "symbol": c("_symbols") / chars,
        "mark": c("_marks") / n,
        "distinct": c("_distinct") / F.pow(n, 0.8),
        "repeated_lines": 1 - c("_new_lines") / m,
        "line_words": F.log1p(n / m),
        "ended_lines": c("_ends") / m,
        "long_words": c("_long") / n,
    }
    return counted.select(*keep, *[F.when(c("_words") > 0, shapes[name]).otherwise(0.0).alias(name) for name in FEATURES])


def _rows(docs: DataFrame, host: str | Column, path: str | Column) -> DataFrame:
    at = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at(host).alias("host"), at(path).alias("path"))


def evidence(docs: DataFrame, labels: DataFrame, host: str | Column, path: str | Column, most: int = 20_000, seed: int = 7) -> DataFrame:
    """doc_id, host, path, p: the probability of quality 1 by a logistic regression on `features`.

    The regression is fitted on at most `most` labelled rows, those of the least hashes; of several labels of a
    document the lowest counts. Without labels of both kinds p is their share, or one half without any.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where("doc_id is not null and label is not null")
    told = materialise(told.groupBy("doc_id").agg(F.min("label").alias("label")), "told")
    chosen = F.broadcast(least_hashes(told, most, seed))  # pairs of numbers
    rows = _rows(docs, host, path)
    sample = materialise(features(rows.join(chosen, "doc_id"), ["label"]), "quality")
    least, most_, share = sample.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if least is None or least == most_:
        return rows.select("doc_id", "host", "path", F.lit(0.5 if share is None else share).alias("p"))
    gathered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    fit = LogisticRegression(maxIter=100, regParam=1e-4, standardization=True).fit(gathered)
    z = F.lit(float(fit.intercept))
    for name, w in zip(FEATURES, fit.coefficients.toArray().tolist()):
        z = z + F.lit(w) * F.col(name)
    return features(rows, ["doc_id", "host", "path"]).select("doc_id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("p"))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Prior strength by moments: how many documents the centre weighs, from the spread of the groups' means beyond their noise."""
    n, mean = F.col("n"), F.col("s") / F.col("n")
    noise = F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0)) / n
    row = groups.where("n >= 2").agg(F.avg(F.pow(mean - centre, 2) - noise), F.avg(centre * (1 - centre))).first()
    between, within = row[0], row[1]
    if between is None or within is None:
        return 10.0
    return min(max(within / max(between, 1e-6) - 1, 1.0), 1000.0)


def quality(docs: DataFrame, labels: DataFrame, host: str | Column = "host", path: str | Column = "path", threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep.

    A host's posterior is the mean of its documents' evidence with the global mean added `strength` times, a path's
    the mean with its host's posterior added, so that sparse sites lean on what is above them; the strengths come
    from the moments of the groups. For each document both leave its own evidence out, which counts once, beside them:
    quality is the document's odds with the global odds replaced by its path's. `path` is taken within its host. Null
    texts count as empty, null hosts and paths as empty names; repeated rows count and are returned each; an empty table
    gives an empty result. Only doc_id, text and the columns for host and path are read, and doc_id and quality of the
    labels.
    """
    rows = materialise(evidence(docs, labels, host, path, most), "evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")]
    paths = materialise(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.count(F.lit(1)).alias("paths")), "hosts")
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    prior = min(max(0.5 if total is None else total, 1e-4), 1 - 1e-4)
    k = _strength(hosts, F.lit(prior))
    by_host = hosts.select("host", "paths", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    facts = materialise(attach(paths, by_host, ["host"], "paths", F.col("path")).select("host", "path", "n", "s", "ss", "host_n", "host_s"), "sited")
    k2 = _strength(facts, (F.col("host_s") + k * prior) / (F.col("host_n") + k))
    out = attach(rows, facts.drop("ss"), ["host", "path"], "n", F.col("doc_id"))
    of_host = (F.col("host_s") - F.col("p") + k * prior) / (F.col("host_n") - 1 + k)
    out = out.withColumn("host_posterior", of_host).withColumn("path_posterior", (F.col("s") - F.col("p") + k2 * F.col("host_posterior")) / (F.col("n") - 1 + k2))
    odds = lambda x: F.log(x / (1 - x))
    bound = lambda x: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), x))
    z = odds(bound(F.col("p"))) + odds(bound(F.col("path_posterior"))) - F.lit(math.log(prior / (1 - prior)))
    scored = out.withColumn("quality", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("keep"))
