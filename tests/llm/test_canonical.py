"""Mapping to a canonical list: made misspellings, strangers and limits."""

import random

import pytest

from canonry.llm.canonical import Matcher, accepted, decide, edits, map_values, normalise, _room

NAMES = ["Ủy ban nhân dân tỉnh Ghềnh Ngạn", "Hội đồng nhân dân tỉnh Ghềnh Ngạn", "Bộ Kinh tế Biển", "Cục Thanh tra Kinh tế Biển", "Sở Bến bãi tỉnh Phù Châm", "Bộ Công sản"]
SHORT = ["UBND tỉnh Ghềnh Ngạn", "HĐND tỉnh Ghềnh Ngạn", "Bộ KTB", "CTT Kinh tế Biển", "SBB Phù Châm", "Bộ CS"]


def matcher():
    return Matcher.build([(i, n, s) for i, (n, s) in enumerate(zip(NAMES, SHORT), 1)])


def match(values, m=None):
    return [decide(h, 0.85, 0.02)[0] for h in (m or matcher()).match(values, 0.3, 0.85, 0.02, 2)]


def test_ways_of_writing():
    rng = random.Random(1)
    values, want = [], []
    for i, name in enumerate(NAMES, 1):
        for text in (name, SHORT[i - 1]):
            p = rng.randrange(4, len(text))
            for v in (text.upper(), f"  {text} (bản sao)", f"Cơ quan ban hành: {text}", f"TM. {text}", f"“{text}”,", text.replace("tỉnh", "t."), text[:p] + text[p - 1] + text[p:], text.replace(" ", " ")):
                values.append(v)
                want.append(i)
    assert match(values) == want


def test_strangers():
    assert match(["Bảo tàng Sông nước tỉnh Ghềnh Ngạn", "Tòa Trọng tài số 9", "xyz", "?", "Sở Thiên văn tỉnh Phù Châm"]) == [0] * 5


def test_people():
    m = Matcher.build([(1, "Quách Thục Vỹ", None), (2, "Mạc Uyển Miên", None)], person=True)
    assert match(["Vỹ, Quách Thục", "(đã ký) Mạc Uyển Miên", "KT. Chủ tịch Quách Thục Vỹ", "Mạc-Uyển-Miên", "Bà mac uyen mien", "Quách Thục Vỹ, Chủ tịch", "Quách Phượng Tháp"], m) == [1, 2, 1, 2, 2, 1, 0]


def test_ties_are_not_decided():
    m = Matcher.build([(1, "Bến Lạc Ngư", None), (2, "Bến Lạc Ngơ", None)])
    assert match(["Bến Lạc Ng"], m) == [0]


def test_edits():
    assert [edits(*p, 2) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "xyz"), ("", "ab"), ("abcd", "badc"))] == [0, 1, 1, 3, 2, 2]
    assert normalise("...", False) == "" and normalise("(x)", False) == "x"


def test_operator(spark):
    canon = spark.createDataFrame([("authority", i, n, s, "z") for i, (n, s) in enumerate(zip(NAMES, SHORT), 1)] + [("authority", 99, None, None, "z")], "kind string, canon_id long, canon_name string, short_form string, raw string")
    rows = [("authority", "Bộ Công sản", 1), ("authority", "bo cong san", 2), ("authority", "bo cong san", 2), ("authority", None, 3), ("authority", " ", 4), ("authority", "N/A", 5), ("other", "abc", 6), (None, "abc", 7), ("authority", "x" * 50_000, 8), ("authority", "Bộ CS", 9)]
    values = spark.createDataFrame(rows, "kind string, raw string, n int")
    got = sorted((r.n, r.canon_id) for r in map_values(values, canon).collect())
    assert got == [(2, 6), (2, 6), (6, 0), (7, 0), (8, 0), (9, 6)]
    assert map_values(values.limit(0), canon).count() == 0
    assert {r.canon_id for r in map_values(values, canon.limit(0)).collect()} == {0}
    clash = map_values(values.withColumnRenamed("n", "score"), canon)
    assert clash.columns == ["kind", "raw", "canon_id", "score"]
    for parts in ({"most_postings": 30}, {"most_broadcast": 0}):
        assert sorted((r.n, r.canon_id) for r in map_values(values, canon, **parts).collect()) == got


def test_all_that_brute_force_finds(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abceghilmnopqtuvxy") for _ in range(rng.randint(2, 6)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(300)})
    m = Matcher.build([(i, n, None) for i, n in enumerate(names, 1)])
    values = []
    for n in rng.sample(names, 150):
        p = rng.randrange(len(n))
        values.append(rng.choice([n[:p] + n[p + 1 :], n[:p] + rng.choice("abcxyz") + n[p:], n[:p] + n[p + 1 : p + 2] + n[p] + n[p + 2 :], " ".join(reversed(n.split()))]))
    values += [" ".join(word() for _ in range(3)) for _ in range(50)]
    hits = m.match(values, 0.3, 0.85, 0.02, 2)
    blocks = [Matcher.build([(i, n, None) for i, n in enumerate(names, 1) if i % 3 == b], False, *counted(names)).match(values, 0.3, 2.0, 0.02, 2) for b in range(3)]
    for k, v in enumerate(values):
        name, room = normalise(v, False), _room(normalise(v, False), 2)
        near = {i: min(edits(name, n, room), edits(" ".join(sorted(name.split())), " ".join(sorted(n.split())), room)) for i, n in enumerate(names, 1)}
        best = min(near.values())
        if accepted(hits[k], 0.85, 0.02):
            assert near[decide(hits[k], 0.85, 0.02)[0]] <= 4
        else:
            assert {h.id for h in hits[k] if h.distance < 99} <= {i for i, d in near.items() if d <= room}
            assert best > room or any(h.distance == best for h in hits[k])
        assert decide([h for b in blocks for h in b[k]], 0.85, 0.02) == pytest.approx(decide(hits[k], 0.85, 0.02))


def counted(names):
    from collections import Counter

    from canonry.llm.canonical import grams

    return Counter(g for n in names for g in grams(normalise(n, False))), len(names)
