"""The cells of lexical search pass on each query's best, as ranking all pairs does."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lexical as L


def best(found, by, k):
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "d"))
    return {tuple(r) for r in found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "d", "rank", F.round("score", 6), "n").collect()}


@pytest.mark.parametrize("cell", [1, 7, 40, 1 << 19])
def test_candidates_hold_the_best_of_all_pairs(spark, monkeypatch, cell):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choices("a b c d e f gg hh".split(), k=rng.randrange(0, 7)))) for k in range(60)]
    docs += [(100 + k, "a b") for k in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(docs, "d long, text string").repartition(3)
    asked = L.asked_terms(spark.createDataFrame([("x", "a b"), ("y", "c gg a"), ("z", "nowhere"), ("w", "hh")], "q string, text string"), "q", "text")
    index = L.postings(docs, asked, "d", "text")
    every = L.scored(index, asked, "d", "q").join(L.shared(index, asked, "d", "q"), ["q", "d"])
    monkeypatch.setattr(L, "CELL", cell)
    found = L.candidates(index, asked, "d", "q", 5)
    assert best(found, "n", 5) == best(every, "n", 5)
    assert best(L.candidates(index, asked, "d", "q", 5, counts=False).withColumn("score", F.round("score", 6)), "score", 5) == best(every.withColumn("score", F.round("score", 6)), "score", 5)
    pairs = [(r.q, r.d) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and (cell < 1 << 19 or len(pairs) < every.count())
