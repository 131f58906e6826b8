"""Pieces against a step-by-step cutter, and the promises of the operator."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from canonry.functions.arrow_text import code_points
from canonry.llm.splitting import CLAUSE_ENDS, LINE_ENDS, cut_points, split_oversized


def one_by_one(text, limit, overlap):
    """The same cuts, one after the other."""
    def level(i):
        if not 0 < i < len(text) or not text[i - 1].isspace() or text[i].isspace():
            return 0
        j = i - 1
        while j >= 0 and text[j].isspace():
            j -= 1
        if any(c in LINE_ENDS for c in text[j + 1 : i]) or (j < 0 and any(c in LINE_ENDS for c in text[:i])):
            return 3
        return 2 if j >= 0 and text[j] in CLAUSE_ENDS else 1

    out, s = [], 0
    while True:
        if s + limit >= len(text):
            return [*out, (s, len(text))]
        e = s + limit
        for kind, least in ((3, limit // 2), (2, limit // 2), (1, overlap)):
            found = next((i for i in range(s + limit, s + least, -1) if level(i) >= kind), None)
            if found:
                e = found
                break
        out.append((s, e))
        nxt = next((i for i in range(max(e - overlap, 0), e) if level(i)), None)
        s = nxt if nxt is not None and nxt > s else max(e - overlap, s + 1)


def test_against_one_by_one():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaaab; .\n") if i % 7 else rng.choice(["ầ", " ", "😀"]) for i in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["x" * 300, " " * 200, "", "a " * 150, "\n" * 130 + "b" * 40]
    codes, offsets = code_points(pa.array(texts))
    row, start, end = cut_points(codes, offsets, 40, 8)
    for i, text in enumerate(texts):
        own = row == i
        got = list(zip((start[own] - offsets[i]).tolist(), (end[own] - offsets[i]).tolist()))
        assert got == (one_by_one(text, 40, 8) if text else []), repr(text)


def test_marks_stay_with_letters():
    text = "é" * 300
    codes, offsets = code_points(pa.array([text]))
    _, start, end = cut_points(codes, offsets, 101, 10)
    assert all(text[e] != "́" for e in end[:-1]) and np.all(end - start <= 101)


def test_operator(spark):
    long = "Một hai ba bốn; năm sáu. " * 20_000
    rows = [("a", long, "Điều 1", 1), ("b", "ngắn", None, 1), ("c", None, None, 1), ("d", "", None, 1), ("a", long, "Điều 1", 1), (None, "y" * 5000, None, 1)]
    df = spark.createDataFrame(rows, "id string, body string, article_ref string, piece int")
    out = split_oversized(df, F.col("body"), {"id": F.col("id"), "article_ref": F.col("article_ref")})
    assert out.columns == ["id", "article_ref", "piece", "start_at", "end_at", "piece_text"]
    pieces = out.where("id = 'a'").distinct().orderBy("piece").collect()
    assert out.where("id = 'a'").count() == 2 * len(pieces)
    assert pieces[0].start_at == 0 and pieces[-1].end_at == len(long) and {p.article_ref for p in pieces} == {"Điều 1"}
    assert all(p.piece_text == long[p.start_at : p.end_at] and len(p.piece_text) <= 2000 for p in pieces)
    assert all(0 <= a.end_at - b.start_at <= 200 for a, b in zip(pieces, pieces[1:]))
    assert [(p.start_at, p.end_at) for p in out.where("id is null").orderBy("piece").collect()] == [(0, 2000), (1800, 3800), (3600, 5000)]
    assert out.where("id in ('b', 'c', 'd')").count() == 0
    assert split_oversized(df.limit(0), F.col("body"), {"id": F.col("id")}, texts=False).count() == 0
