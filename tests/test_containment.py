"""Contained names against brute force, with frequent words and short names."""

from canonry.operators.containment import contained


def test_against_brute_force(spark):
    names = [f"phường {i} x" for i in range(60)] + ["phường", "ường", "x", "1", "5 x", "phường", "", None, "đ" * 3000, "đ" * 7, "aaa", "aa"]
    rows = list(enumerate(names))
    of = {}
    for i, n in rows:
        if n:
            of.setdefault(n, []).append(i)
    want = sorted((min(x), min(y), len(x), len(y)) for a, x in of.items() for b, y in of.items() if a != b and b in a)
    df = spark.createDataFrame([(i, n, "z") for i, n in rows], "id long, name string, piece string")
    assert sorted(map(tuple, contained(df, "id", "name").collect())) == want
    assert sum(1 for w in want if w[1] in (60, 61)) == 121
    assert contained(df.limit(0), "id", "name").count() == 0
