"""Encoding against the public libraries, and round trips."""

import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canonry.llm.tokens import default_vocabulary, encode_array, encode_corpus, load_vocabulary, merge_exactly

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(default_vocabulary())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


HARD = ["'s", "x's", "x 's", "x\n's", "'sa", "''s", "!'s", "a're'll", "'", "a'", " '", "'l", "'ll", "  a", "a  ", "\n\n a", "<|endoftext|>", "\x00\x1c\x85", "é", "👩‍⚖️", "一二三", " " * 700, "a" * 3000, "…" * 50, "12½", " x", "ｘ１２"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab'stredl vmLĐấ \n\t.,12", max_size=40), st.sampled_from(HARD)), max_size=8))
def test_against_library(vocabulary, library, texts):
    assert encode_array(pa.array(texts, pa.string()), vocabulary).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_hard_cases(vocabulary, library):
    assert encode_array(pa.array([*HARD, None, ""]), vocabulary).to_pylist() == [*map(library.encode_ordinary, HARD), [], []]


def test_against_other_file(vocabulary):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert encode_array(pa.array(HARD), vocabulary).to_pylist() == [e.ids for e in t.encode_batch(HARD, add_special_tokens=False)]


def test_exact_merge(vocabulary, library):
    for word in ("internationalization", "ngườicưtrú", "aaaaaaab" * 40):
        assert [vocabulary.ranks[p] for p in merge_exactly(word.encode(), vocabulary.ranks)] == library.encode_ordinary(word)


def test_corpus(spark, folder, library):
    df = spark.read.parquet(os.path.join(folder, "documents.parquet")).select("doc_id", "text", F.lit(1).alias("ids"))
    got = {r.doc_id: r.ids for r in encode_corpus(df, F.col("doc_id"), F.col("text"), slice_bytes=20_000).collect()}
    rows = df.collect()
    assert got == {r.doc_id: library.encode_ordinary(r.text) if r.text else [] for r in rows}
    assert all(library.decode(got[r.doc_id]) == r.text for r in rows if r.text)
    assert encode_corpus(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
    long = spark.createDataFrame([(1, "Điều khoản " * 60_000), (1, "Điều khoản " * 60_000)], "doc_id long, text string")
    assert [len(r.ids) for r in encode_corpus(long, F.col("doc_id"), F.col("text")).collect()] == [len(library.encode_ordinary("Điều khoản " * 60_000))] * 2
