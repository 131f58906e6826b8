"""Packed fields: cases, a character-by-character parser, and round trips."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canonry.operators.packed import SEPARATORS, split_array, split_packed

CASES = {
    "a, b": ["a", "b"], '"a, b";c': ["a, b", "c"], '["x", "y, z"]': ["x", "y, z"], "['Chương trình \"Sóng Xanh\"', 'b']": ['Chương trình "Sóng Xanh"', "b"], '"Chương trình ""Sóng Xanh""";Quy hoạch': ['Chương trình "Sóng Xanh"', "Quy hoạch"],
    "cây\\, con;b": ["cây, con", "b"], "“A B, Chủ tịch:241”;b": ["A B, Chủ tịch:241", "b"], '"A, Phó":253\nX:1': ["A, Phó:253", "X:1"], "a / / b": ["a", "b"], "Bảo hiểm/Trợ cấp": ["Bảo hiểm/Trợ cấp"],
    "Lao động /": ["Lao động"], "": [], " \t": [], "N/A": [], "Chung": [], "nan": [], "None": [], '"abc, d': ['"abc', "d"], "[]": [], "D'Ivoire, b": ["D'Ivoire", "b"], "Văn hóa - Di vật|X & Y": ["Văn hóa - Di vật", "X & Y"], "a，b；c•d": ["a", "b", "c", "d"],
}


def test_cases():
    assert split_array(pa.array([*CASES, None])).to_pylist() == [*CASES.values(), []]


def plain(text):
    """One character after the other, for texts without brackets and single quotes."""
    out, piece, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            piece += text[i + 1]
            i += 1
        elif c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                piece += '"'
                i += 1
            else:
                quoted = not quoted
        elif c in ",;|" and not quoted:
            out.append(piece.strip())
            piece = ""
        else:
            piece += c
        i += 1
    return [p for p in [*out, piece.strip()] if p]


word = st.text("abcđầ -&", min_size=1, max_size=8).map(lambda s: s.strip(" ")).filter(lambda s: s and s not in ("nan",))
quoted = st.text('abđ,;| "', min_size=1, max_size=8).map(lambda s: s.strip(' "')).filter(bool).map(lambda s: '"' + s.replace('"', '""') + '"')
escaped = word.map(lambda s: s + "\\," + "x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(word, quoted, escaped), max_size=5).flatmap(lambda p: st.sampled_from([",", ";", " | "]).map(lambda s: s.join(p))), max_size=4))
def test_against_plain(texts):
    assert split_array(pa.array(texts, pa.string())).to_pylist() == [plain(t) for t in texts]


def test_operator(spark):
    rows = [(1, "a;b", "x", "n"), (2, None, "y", "n"), (3, "", "z", "n"), (1, "a;b", "x", "n"), (None, "q", "w", "n"), (4, ", ".join(["v"] * 50_000), "s", "n")]
    df = spark.createDataFrame(rows, "id long, packed string, val string, pos string")
    out = split_packed(df, F.col("id"), ["packed"])
    assert out.columns == ["field_name", "record_id", "pos", "val"]
    got = [(r.record_id, r.pos, r.val) for r in out.where("record_id is null or record_id <> '4'").collect()]
    assert sorted(got, key=str) == sorted([("1", 1, "a"), ("1", 2, "b"), ("1", 1, "a"), ("1", 2, "b"), (None, 1, "q")], key=str)
    assert out.where("record_id = '4'").agg(F.max("pos"), F.countDistinct("pos")).first() == (50_000, 50_000)
    assert split_packed(df.limit(0), F.col("id"), ["packed"]).count() == 0


def test_random_join_is_split_again():
    rng = random.Random(1)
    values = [["".join(rng.choice("abc ") for _ in range(5)).strip() or "q" for _ in range(rng.randint(1, 6))] for _ in range(300)]
    packed = [rng.choice([s for s in SEPARATORS]).join(v) for v in values]
    assert split_array(pa.array(packed)).to_pylist() == values
