"""Keyword rescue of many questions: the same hits as one at a time, and a cost that doesn't grow with documents times words."""

import time
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators import retrieval as R

TEXTS = [
    "alphabet soup, xbetax", "alphabet", "beta gamma", "", None, "ALPHAébeta", "alph", "abeta", "gamma-gamma delta 2015delta",
    "Điều gamma ộdeltaộ", "delta.gamma.beta.alpha", "gammadeltabetaalpha", "del ta gam ma", "x" * 5000 + "gamma" + "y" * 5000 + " delta", "2015", "alpha beta gamma delta",
]
QUESTIONS = [
    "alpha beta gamma delta", "Beta, gamma", "gamma", "abc xyz", "alphabet alpha alph beta", "", None, "2015delta 2015 delta", "delta " + " ".join(f"word{i}" for i in range(400)) + " gamma",
    " ".join(f"word{i}" for i in range(400)),
]


@pytest.mark.parametrize(("block", "table_bytes"), [(1000, 1 << 25), (1000, 0), (4, 40)])
def test_same_hits_as_one_question(spark, block, table_bytes):
    texts = TEXTS * 3 + [" ".join(f"xword{i}" for i in range(n, 400)) for n in (0, 1, 150, 300, 399)]
    # keys fall, so later rows win ties
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "k long, t string").coalesce(1)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    for least, most, longer in ((2, 10, 3), (1, 2, 0), (3, 100, 4)):
        got = R.rescue_every(docs, asked, "k", "t", least=least, most=most, longer_than=longer, block=block, step=5, table_bytes=table_bytes)
        alone = [R.keyword_rescue(docs.where("t is not null"), F.lit(question), "k", "t", least=least, most=most, longer_than=longer).select(F.lit(q).alias("query_id"), "k", "hits", "score") for q, question in enumerate(QUESTIONS) if question]
        want = sorted(map(tuple, reduce(DataFrame.unionByName, alone).collect()))
        assert want and sorted(map(tuple, got.select("query_id", "k", "hits", "score").collect())) == want


def test_words_of_questions_are_not_searched_one_by_one(spark, tmp_path):
    def asked(words):
        return spark.range(words // 40).select(F.col("id").alias("query_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.format_string("word%06d", F.col("id") * 40 + i)), " ").alias("query"))

    # document d has the words of question d % 400, and filler
    parts = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.format_string("word%06d", (F.col("id") % 400) * 40 + i))
    spark.range(0, 12_000, 1, 4).select(F.col("id").alias("k"), F.concat_ws(" ", F.array_join(parts, " "), F.repeat(F.lit("other filler "), 200)).alias("t")).write.parquet(f"{tmp_path}/docs")
    docs, seconds = spark.read.parquet(f"{tmp_path}/docs"), []
    for words in (40, 400, 16_000):
        began = time.time()
        got = R.rescue_every(docs, asked(words), "k", "t").collect()
        seconds.append(time.time() - began)
        assert sorted((r.query_id, r.k, r.hits) for r in got) == [(q, q + 400 * i, 40) for q in range(words // 40) for i in range(10)]
    # forty times the words: the texts are read, not searched, so it takes little longer
    assert seconds[2] < 3 * seconds[1] + 5
