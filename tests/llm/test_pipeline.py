"""The pipeline against a plain-Python version of its stages."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import BYTES, ITEM, shingles, texts

import corpus_pipeline
from bookloom.llm.tokenizer import Encoder


def expected(rows):
    """Ids that reach packing: with a language, one per equal text, one per class, without leaks."""
    kept = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    groups = {}
    for i, t in kept.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\v\f\r"), []).append((-len(t), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    sets = {i: shingles(t) for i, t in kept.items()}
    root = {i: i for i in kept}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in kept:
        for j in kept:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i, t in kept.items() if top(i) == i and ITEM not in t}


def test_pipeline_matches_brute_force(spark, tmp_path):
    made = texts(21)
    made += [f"{made[3]} {ITEM} {made[8]}", "12 34 ?!", made[1].replace(" ", "\n")]
    rows = list(enumerate(made))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"), "source": F.lit("s"),
         "n_chars": F.length("text").cast("long")})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, e = expected(rows), Encoder(BYTES)
    assert {p.doc_id for p in got} == want
    for i in want:
        pieces = sorted((p for p in got if p.doc_id == i), key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()
        assert ids == [*e.whole(made[i]), 1]


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], cols)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
