"""Structure scanner on a small corpus written for it."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canonry.operators.chunker import chunk_documents, effective_date, grouped, scan, table_of_contents

LAW = """CỘNG HÒA XÃ HỘI CHỦ NGHĨA
ĐỘC LẬP - TỰ DO - HẠNH PHÚC
LUẬT VỀ BẾN BÃI
Căn cứ Luật số 10/2001/LU1 ngày 2 tháng 2 năm 2001;
Chương I. QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
1. Luật này quy định về quản lý bến bãi trong phạm vi cả nước.
2. Luật này không áp dụng đối với:
a) Bến quân sự thuộc lực lượng vũ trang;
b) Bến tạm được dựng trong mùa lũ.
Điều 2. Bảng giá
| STT | Tên | Số |
|---|---|---|
| 1 | kế hoạch nạo vét luồng | 1249 |
PHỤ LỤC I
I. Danh sách bến bãi trong tỉnh được phép hoạt động
Nơi nhận: như trên"""


def test_law():
    got = [(c.kind, c.breadcrumb, c.appendix) for c in scan(LAW)]
    assert got == [
        ("article", "Lời dẫn", False), ("article", "Chương I > Điều 1 > Khoản 1, 2.", False), ("table", "Điều 2 > Dữ liệu Bảng biểu", False),
        ("article", "PHỤ LỤC I > I Danh sách bến bãi trong tỉnh được phép hoạt động", False), ("article", "Phần Nơi nhận và Chữ ký", False),
    ]
    assert "ĐỘC LẬP" not in "".join(c.content for c in scan(LAW))
    assert scan(LAW)[1].content.splitlines()[0] == "Điều 1"


def test_long_clause_continues():
    text = "Điều 1. Dài\n1. " + "x" * 900 + "".join(f"\n{c}) " + "y" * 400 for c in "abcde") + "\n2. " + "z" * 50
    chunks = scan(text)
    assert len(chunks) == 3 and all(len(c.content) < 2400 for c in chunks)
    assert "[1. tiếp theo]" in chunks[1].content
    assert sum(c.content.count("y") for c in chunks) == 5 * 400


def test_large_table_is_cut():
    rows = "\n".join(f"| {i} | hàng số {i} có đủ chữ | 1 |" for i in range(40))
    chunks = scan("| A | B | C |\n|---|---|---|\n" + rows)
    assert [c.content.count("hàng số") for c in chunks] == [15, 15, 10]
    assert all(c.content.startswith("| A | B | C |") for c in chunks)


def test_garbage():
    assert scan("") == scan(None) == scan("| 1 | 2 |") == []
    assert scan("Điều 1. Ngắn") == []
    assert len(scan("a\r\nb" * 2000)) >= 1


def test_grouped():
    assert [grouped(x) for x in (["1.", "2."], ["a)", "b)"], ["(1)", "(2)"], ["Khoản 1", "Khoản 2"], ["-"], [])] == ["Khoản 1, 2.", "Điểm a, b)", "Khoản (1, 2)", "Khoản 1, 2", "", ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Chương I. Một", "Điều 1. Hai ba bốn", "1. năm sáu bảy tám chín mười", "a) một hai ba bốn năm", "| a | b |", "chữ tự do " * 20, "PHỤ LỤC II", "1.1. mục con", "Nơi nhận:"]), max_size=25))
def test_no_line_is_repeated_too_often(lines):
    marked = [f"{line} q{i}q" for i, line in enumerate(lines)]
    text = "\n".join(c.content for c in scan("\n".join(marked)))
    assert all(text.count(f"q{i}q") <= 30 for i in range(len(lines)))
    assert all(c.content for c in scan("\n".join(marked)))


def test_operator(spark):
    df = spark.createDataFrame([("d1", LAW, "x"), ("d2", None, "x"), ("d3", "", "x"), ("d4", "chữ " * 100_000, "x")], "doc_id string, text string, kind string")
    out = chunk_documents(df, F.col("text"), {"doc_id": F.col("doc_id")})
    rows = out.where("doc_id = 'd1'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [1, 2, 3, 4, 5]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {"d1", "d4"}
    assert chunk_documents(df.limit(0), F.col("text"), {}).count() == 0


def test_contents_and_date(spark):
    text = LAW.replace("Điều 2. Bảng giá", "Điều 2. Luật này có hiệu lực từ ngày 1/7/2019")
    df = spark.createDataFrame([(text,), ("Luật có hiệu lực kể từ ngày ký.",), ("",), (None,)], "t string")
    got = df.select(table_of_contents("t").alias("toc"), effective_date(F.col("t"), F.lit("2000-01-01")).alias("d")).collect()
    assert got[0].toc == "Chương I: QUY ĐỊNH CHUNG\nĐiều 1. Phạm vi điều chỉnh\nĐiều 2. Luật này có hiệu lực từ ngày 1/7/2019"
    assert [g.d for g in got] == ["2019-07-01", "2000-01-01", None, None]
