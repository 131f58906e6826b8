"""Four documents written for the structure scanner, and the chunks that its rules give, worked out by hand.

`LAW`: header and motto, preamble, chapters, articles, clauses, points, a
section, a signature. `APP`: appendix titles and levels; a heading that begins
like a roman number is text, a part ends the appendix. `TABLE`: 40 rows in
batches of 15, a row over the limit by itself, text after a table, a table at
the end. `LONG`: a clause beyond the limit goes on with its name, free text is
cut at its limit.
"""

import pytest

from canonry.operators.chunker import scan

LAW = """QUỐC HỘI
CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
ĐỘC LẬP - TỰ DO - HẠNH PHÚC
LUẬT
VỀ QUẢN LÝ BẾN BÃI
Căn cứ Hiến pháp năm 2013;
Căn cứ Luật Sông nước số 10/2001/LU1;
Theo đề nghị của Bộ trưởng Bộ Bến bãi,
Chương I
NHỮNG QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Luật này quy định về việc lập, quản lý và khai thác bến bãi trên cả nước.
Điều 2. Giải thích từ ngữ
Trong Luật này các từ ngữ sau được hiểu như sau:
1. Bến là nơi tàu thuyền neo đậu để bốc dỡ hàng hóa.
2. Bãi là khu đất ven sông gồm:
a) Bãi bồi tự nhiên theo mùa nước;
b) Bãi đã được kè đá hai bên bờ.
Chương II
ĐIỀU KHOẢN THI HÀNH
Điều 3. Hiệu lực thi hành
Luật này có hiệu lực từ ngày 01/07/2020.
Mục 1. Chuyển tiếp
Giấy phép đã cấp trước ngày này còn giá trị cho đến khi hết hạn.
Nơi nhận:
- Như trên;
CHỦ TỊCH QUỐC HỘI"""
APP = """Điều 1. Ban hành kèm theo Thông tư này bảng phân loại bến bãi.
PHỤ LỤC II
DANH MỤC BẾN BÃI ĐƯỢC KIỂM KÊ
I. Bến bãi loại một trong toàn vùng hạ lưu sông
1. Bến có cầu tàu dài trên một trăm mét và kho kín
1.1. Bến chuyên dùng cho hàng lỏng có bồn chứa riêng
a) Bồn chứa trên năm nghìn khối đặt cách bờ hai mươi mét
CÁC BẾN BÃI ĐANG XÂY DỰNG DỞ DANG
2. Bến chưa nghiệm thu nhưng đã có tàu ra vào thường xuyên
Phần II: Bến bãi loại hai gồm các bến tạm theo mùa
B. Nhóm bến tạm được dựng trong mùa lũ hằng năm"""
TABLE = "Điều 4. Mức thu\n| TT | Loại bến | Mức thu |\n|---|---|---|\n" + "\n".join(f"| {i} | bến loại {i} trong vùng | {i}00 đồng |" for i in range(1, 41)) + "\n| 41 | " + "rất dài " * 330 + " | 9 |\nGhi chú: mức thu chưa gồm thuế giá trị gia tăng.\n| A | B |\n| 1 |\n| cuối | bảng ở cuối văn bản |"
LONG = "Điều 9. Nghĩa vụ\n1. Chủ bến có các nghĩa vụ sau đây:\n" + "\n".join(f"{c}) " + f"nghĩa vụ {c} " * 30 for c in "abcdeghik") + "\n2. Khoản sau.\nĐiều 10. Văn xuôi\n" + "\n".join(f"Đoạn {i} " + "chữ " * 100 for i in range(8))

CHUNKS = {
    "LAW": [
        ("article", "", "Lời dẫn", "", "Lời dẫn", False, 8, "Lời dẫn", "Theo đề nghị của Bộ trưởng Bộ Bến bãi,"),
        ("article", "Chương I", "Điều 1", "", "Chương I > Điều 1", False, 3, "Điều 1", "Luật này quy định về việc lập, quản lý và khai thác bến bãi "),
        ("article", "Chương I", "Điều 2", "Khoản 1, 2.", "Chương I > Điều 2 > Khoản 1, 2.", False, 7, "Điều 2", "b) Bãi đã được kè đá hai bên bờ."),
        ("article", "Chương II", "Điều 3", "", "Chương II > Điều 3", False, 3, "Điều 3", "Luật này có hiệu lực từ ngày 01/07/2020."),
        ("article", "Chương II", "Mục 1", "", "Chương II > Mục 1", False, 3, "Mục 1", "Giấy phép đã cấp trước ngày này còn giá trị cho đến khi hết "),
        ("article", "", "Phần Nơi nhận và Chữ ký", "", "Phần Nơi nhận và Chữ ký", False, 4, "Phần Nơi nhận và Chữ ký", "CHỦ TỊCH QUỐC HỘI"),
    ],
    "APP": [
        ("article", "", "Điều 1", "", "Điều 1", False, 2, "Điều 1", "Ban hành kèm theo Thông tư này bảng phân loại bến bãi."),
        ("article", "DANH MỤC BẾN BÃI ĐƯỢC KIỂM KÊ", "I Bến bãi loại một trong toàn vùng hạ lưu sông", "Khoản 1, 2.", "DANH MỤC BẾN BÃI ĐƯỢC KIỂM KÊ > I Bến bãi loại một trong toàn vùng hạ lưu sông > Khoản 1, 2.", True, 6, "I Bến bãi loại một trong toàn vùng hạ lưu sông", "2. Bến chưa nghiệm thu nhưng đã có tàu ra vào thường xuyên"),
        ("article", "Phần II", "", "", "Phần II", False, 1, "B. Nhóm bến tạm được dựng trong mùa lũ hằng năm", "B. Nhóm bến tạm được dựng trong mùa lũ hằng năm"),
    ],
    "TABLE": [
        ("table", "", "Điều 4", "", "Điều 4 > Dữ liệu Bảng biểu", False, 17, "| TT | Loại bến | Mức thu |", "| 15 | bến loại 15 trong vùng | 1500 đồng |"),
        ("table", "", "Điều 4", "", "Điều 4 > Dữ liệu Bảng biểu", False, 17, "| TT | Loại bến | Mức thu |", "| 30 | bến loại 30 trong vùng | 3000 đồng |"),
        ("table", "", "Điều 4", "", "Điều 4 > Dữ liệu Bảng biểu", False, 12, "| TT | Loại bến | Mức thu |", "| 40 | bến loại 40 trong vùng | 4000 đồng |"),
        ("table", "", "Điều 4", "", "Điều 4 > Dữ liệu Bảng biểu", False, 3, "| TT | Loại bến | Mức thu |", "| 41 | rất dài rất dài rất dài rất dài rất dài rất dài rất d"),
        ("article", "", "Điều 4", "", "Điều 4", False, 3, "Điều 4", "Ghi chú: mức thu chưa gồm thuế giá trị gia tăng."),
        ("table", "", "Điều 4", "", "Điều 4 > Dữ liệu Bảng biểu", False, 3, "| A | B |", "| cuối | bảng ở cuối văn bản |"),
    ],
    "LONG": [
        ("article", "", "Điều 9", "Khoản 1. - Điểm a, b, c, d)", "Điều 9 > Khoản 1. > Điểm a, b, c, d)", False, 7, "Điều 9", "d) nghĩa vụ d nghĩa vụ d nghĩa vụ d nghĩa vụ d nghĩa vụ d ng"),
        ("article", "", "Điều 9", "Khoản 1. - Điểm e, g, h, i)", "Điều 9 > Khoản 1. > Điểm e, g, h, i)", False, 6, "Điều 9", "i) nghĩa vụ i nghĩa vụ i nghĩa vụ i nghĩa vụ i nghĩa vụ i ng"),
        ("article", "", "Điều 9", "Khoản 1, 2.", "Điều 9 > Khoản 1, 2.", False, 4, "Điều 9", "2. Khoản sau."),
        ("article", "", "Điều 10", "", "Điều 10", False, 6, "Điều 10", "Đoạn 3 chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ c"),
        ("article", "", "Điều 10", "", "Điều 10", False, 5, "Điều 10", "Đoạn 7 chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ chữ c"),
    ],
}


@pytest.mark.parametrize("name, text", [("LAW", LAW), ("APP", APP), ("TABLE", TABLE), ("LONG", LONG)])
def test_chunks(name, text):
    lines = [c.content.split("\n") for c in scan(text)]
    got = [(c.kind, c.chapter, c.article, c.clause, c.breadcrumb, c.appendix, len(x), x[0][:60], x[-1][:60]) for c, x in zip(scan(text), lines)]
    assert got == CHUNKS[name]


def test_no_line_is_lost():
    for text in (LAW, APP, TABLE, LONG):
        kept = " ".join(" ".join((c.chapter, c.article, c.clause, c.content)) for c in scan(text))
        dropped = [line for line in text.split("\n") if line.strip("|-: ") and not all(w in kept for w in line.replace(".", " ").replace(":", " ").split())]
        # the motto, and titles too short to be chunks of their own
        assert set(dropped) <= {"ĐỘC LẬP - TỰ DO - HẠNH PHÚC", "NHỮNG QUY ĐỊNH CHUNG", "ĐIỀU KHOẢN THI HÀNH", "PHỤ LỤC II", "Phần II: Bến bãi loại hai gồm các bến tạm theo mùa"}
