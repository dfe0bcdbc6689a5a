"""The pipeline against the stages' brute-force versions."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from tidemark.llm import decontaminate, toxicity

from .test_operators import brute_components, brute_fingerprint, brute_targets, labelled

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rows, labels = labelled(spark, 240)
    r = random.Random(12)
    fill = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(90)}" for _ in range(n))
    items = [(k, fill(25) + ". " + fill(5)) for k in range(5)]
    long = fill(900)
    texts = dict(rows)
    texts |= {500: texts[1] + "  ", 501: texts[1].replace(" ", "\n"), 502: long, 503: long + " end", 504: long + " fin", 505: None, 506: "", 507: fill(70) + " " + items[2][1] + " " + fill(20), 508: texts[2], 509: fill(30)}
    docs = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in texts.items()]
    sf = str(tmp_path)
    df = spark.createDataFrame(docs, COLS)
    df.write.parquet(f"{sf}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    lab.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    toxic = {x.doc_id for x in toxicity.toxicity(df, lab).collect() if x.predicted}
    left = {i: t for i, t in texts.items() if i not in toxic}
    groups = defaultdict(list)
    for i, t in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    ids = sorted(left)
    comp, least = brute_components([brute_fingerprint(left[i]) for i in ids]), {}
    for i, c in zip(ids, comp):
        least.setdefault(c, i)
    left = {i: left[i] for i in least.values()}
    norm = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    left = {i: t for i, t in left.items() if not any(norm(x) in norm(t) for _, x in items)}
    assert 500 in left and 501 not in left and 1 not in left and 507 not in left and {502, 503} - set(left)

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left)
    source, sizes, taken = {d[0]: d[3] for d in docs}, defaultdict(int), defaultdict(int)
    for i, t in left.items():
        sizes[source[i]] += len((t or "").split())
        taken[source[i]] += got[i].taken
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None)], COLS)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, sf).schema.simpleString() == df.schema.simpleString(), name
        assert stage(spark, df.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf).count() == 0
