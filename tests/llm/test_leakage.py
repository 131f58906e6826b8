"""Leaks against brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonry.llm import leakage
from canonry.llm.leakage import build_index, distance_within, find_hits, leaked_items, myers, words_of


def plain_words(text):
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).replace("đ", "d")
    return re.findall(r"[^\W_]+", text)


def brute(texts, passages, window, edits):
    out = []
    for i, t in enumerate(texts):
        words = plain_words(t)
        for j, p in enumerate(passages):
            own = plain_words(p)
            windows = [own[a : a + window] for a in range(len(own) - window + 1)]
            near = min((distance_within(w, words) for w in windows), default=edits + 1)
            if near <= edits:
                out.append((i, j, near))
    return out


@pytest.mark.parametrize("window, edits", [(12, 0), (6, 0), (6, 1), (8, 2)])
def test_against_brute_force(window, edits, monkeypatch):
    rng = random.Random(window * 10 + edits)
    vocabulary = ["đất", "Bãi", "cống", "12", "luồng", "nước"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) for _ in range(6)]
    texts = []
    for _ in range(40):
        own = rng.choice(passages).split()
        a = rng.randint(0, max(0, len(own) - window))
        part = own[a : a + window + rng.randint(-1, 2)]
        for _ in range(rng.randint(0, 2)):
            if part:
                part[rng.randrange(len(part))] = rng.choice(["khác", ""])
        texts.append(rng.choice([", ", " ", "\n"]).join([rng.choice(vocabulary), *filter(None, part), rng.choice(vocabulary)]))
    index = build_index(list(range(6)), passages, window, edits)
    want = brute(texts, passages, window, edits)
    assert find_hits(texts, index) == want
    # candidates of a piece that many places share come in several stretches
    monkeypatch.setattr(leakage, "_AT_ONCE", 7)
    assert find_hits(texts, index) == want


def test_forms_of_a_word():
    passage = "Đường đến bãi cũ mở từ 12 giờ sáng hôm nay nhé bạn"
    texts = [passage, passage.upper(), unicodedata.normalize("NFD", passage), "duong den bai cu mo tu 12 gio sang hom nay nhe ban", passage.replace(" ", " — "), passage.replace("bãi", "bãi mới"), passage.replace("đến", "đ​ến"), "", None]
    assert [d for d, *_ in find_hits(texts, build_index([7], [passage], 12, 0))] == [0, 1, 2, 3, 4]


def test_myers():
    rng = np.random.default_rng(1)
    p, t = rng.integers(1, 4, (200, 7)).astype(np.uint64), rng.integers(1, 4, (200, 15)).astype(np.uint64)
    assert myers(p, t).tolist() == [distance_within(list(a), list(b)) for a, b in zip(p, t)]


def test_words():
    w = words_of(["Đất_đai 12a", None, "", "x"])
    assert [(w.word(i), int(w.text[i])) for i in range(len(w.hash))] == [("dat", 0), ("dai", 0), ("12a", 0), ("x", 3)]


def test_operator(spark):
    words = " ".join(f"từ{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a {words} b", 0), (1, f"a {words} b", 0), (2, None, 0), (3, "", 0), (None, words, 0), (4, "x " * 200_000 + words, 0)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(10, words, "x"), (11, None, "x"), (12, "ngắn", "x"), (13, " ".join(f"từ{i}" for i in range(5, 18)), "x"), (10, words, "x")], "item_id long, passage string, text string")
    for block in (1, 1 << 20):
        got = leaked_items(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage"), block_chars=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(d, i, 0) for d in (1, None, 4) for i in (10, 13)], key=str)
    assert leaked_items(docs.limit(0), F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage")).count() == 0
    assert leaked_items(docs, F.col("doc_id"), F.col("text"), items.limit(0), F.col("item_id"), F.col("passage")).count() == 0
