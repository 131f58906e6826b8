"""Wrong decodings made here are found and undone; correct texts of many kinds stay as they are."""

import random

import pytest
from pyspark.sql import functions as F

from canonry.llm.mojibake import TCVN, VNI_MARK, VNI_SINGLE, cost, examine, garbled

TEXTS = [
    "Điều 15. Thời hạn của giấy phép khai thác cát sỏi trong phạm vi toàn tỉnh",
    "NGHỊ QUYẾT VỀ PHƯƠNG ÁN BẢO VỆ BỜ BÃI TẠI PHÙ CHÂM",
    "Doanh nghiệp vận tải chịu trách nhiệm về hợp đồng thuê mặt nước chậm nhất 43 giờ sau khi phát hiện.",
    "L’exploitant du réservoir doit présenter le procès-verbal de réception à la demande de l’autorité compétente",
]
CORRECT = [
    "Ông nói: “ĐÃ” rồi", "CHÂ… và LÂ—HÀ", "ĐÃ”, XÃ’, LÃ•", "São João comeu maçã; não à vista", "¿Qué pasó? ¡El Niño, señor!", "Grüße aus Köln, Maß", "Zażółć gęślą jaźń", "Чоловік ВІД Києва; «Правда» — №5", "├── src\n│   └── main.py",
    "Điều 5 § 2; §§ 3–4; ¶ 5", "«Â», «Ã», chữ Â hoa", "a\xa0b VÀ\xa0CÁC\xa0ĐIỀU ĐÃ\xa0KÝ LÂ\xa0N", "ภาษาไทย ประกาศ", "العربية النص", "한국어 문서", "H₂O, x², 10⁻³, 5 Å", "1º, 2ª, nº 5",
    *TEXTS, "® Bản in lại © kho lưu trữ, khổ ½ trang, sai số ±2 µm, giá £3/¥400. «Ghi chú» — §4.", "Tên riêng: Ångström, Señor Ibáñez, Müller, São Tomé, Dvořák, Ærø, Þórr; ĐÃ, XÃ, GIÃN, ÂU, ÊM.",
    "​✔ Đã kiểm 🙂👩‍⚖️ 一二三  → …____ 0x1F ½", "Постановление о порядке", "Ελληνικά και μαθηματικά: π ≈ 3,14", "D&#233;cret 7864/2016/TT-TN&#272;", "=C4=90i=E1=BB=81u", "Dieu 5. Thoi han", "", "m², km², 25 °C, n° 5, 1º",
    "Điều 5. Thời hạn « de tutelle »", __import__("unicodedata").normalize("NFD", TEXTS[2]),
]


def sloppy(text, encoding):
    """UTF-8 read as another encoding; bytes without a character become controls."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("encoding", ["latin_1", "cp1252", "cp1251", "cp437", "mac_roman", "cp1258"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_read_as(text, encoding):
    bad = sloppy(text, encoding)
    assert examine(bad, any_line=True)[0]
    found, restored, steps, whole = examine(bad)
    assert found and restored == text and steps and whole


@pytest.mark.parametrize("text", TEXTS)
def test_twice(text):
    bad = sloppy(sloppy(text, "cp1252"), "cp1252")
    assert examine(bad, any_line=True)[0]
    assert examine(bad)[1] == text


def test_two_different_encodings():
    bad = sloppy(sloppy(TEXTS[0], "cp1252"), "cp1251")
    assert examine(bad)[1] == TEXTS[0] and examine(bad)[3]


#: Small Russian letters alone are Russian letters in either code page; capitals give them away.
RUSSIAN = "Министерство Финансов Российской Федерации и Правительство Москвы: Постановление о порядке"


@pytest.mark.parametrize("text, true, read", [(RUSSIAN, "koi8_r", "cp1251"), (RUSSIAN, "cp1251", "cp1252"), (RUSSIAN, "cp1251", "koi8_r"), (TEXTS[3], "cp850", "cp1252"), (TEXTS[3].replace("’", "'"), "cp1252", "cp850"), (TEXTS[3], "mac_roman", "cp1252")])
def test_single_byte_pairs(text, true, read):
    bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.replace("’", "'").encode(true))
    assert examine(bad, any_line=True)[0]
    assert examine(bad)[1] == text.replace("’", "'")


def test_vietnamese_code_page():
    import unicodedata

    text = "Điều 15. Thời hạn của giấy phép khai thác cát sỏi trong phạm vi toàn tỉnh được gia hạn một lần"
    marks = "\u0300\u0301\u0303\u0309\u0323"
    written = ""
    for c in text:
        apart = unicodedata.normalize("NFD", c)
        written += unicodedata.normalize("NFC", "".join(x for x in apart if x not in marks)) + "".join(x for x in apart if x in marks)
    bad = written.encode("cp1258").decode("cp1252")
    assert examine(bad, any_line=True)[0] and examine(bad)[1] == text


@pytest.mark.parametrize("encoding", ["gbk", "cp949"])
def test_multi_byte(encoding):
    words = []
    for word in TEXTS[0].split():
        try:
            words.append(word.encode("utf-8").decode(encoding))
        except UnicodeDecodeError:
            words.append(word)
    bad = " ".join(words)
    assert bad != TEXTS[0] and examine(bad, any_line=True)[0] and examine(bad)[1] == TEXTS[0]


def as_tcvn(text):
    back = {v: k for k, v in TCVN.items()}
    return "".join(back.get(c, back.get(c.lower(), c)) for c in text)


def as_vni(text):
    import unicodedata

    single = {v: k for k, v in VNI_SINGLE.items()}
    marks = {unicodedata.normalize("NFD", "x" + m)[1:]: k for k, m in VNI_MARK.items()}
    out = ""
    for c in text:
        if c in single:
            out += single[c]
            continue
        apart = unicodedata.normalize("NFD", c)
        base, rest = apart[0], apart[1:]
        if "̛" in rest:
            base, rest = single[unicodedata.normalize("NFC", base + "̛")], rest.replace("̛", "")
        out += base + (marks[rest].upper() if c.isupper() else marks[rest]) if rest else base
    return out


@pytest.mark.parametrize("text", TEXTS[:3])
def test_vietnamese_fonts(text):
    for bad in (as_tcvn(text), as_vni(text)):
        assert bad != text and examine(bad, any_line=True)[0]
        assert examine(bad)[1] == text


@pytest.mark.parametrize("text", CORRECT)
def test_correct_texts(text):
    assert examine(text) == (False, text, "", False)
    assert not examine(text, any_line=True)[0]


SIGNS = [("the parties’ agreement", "’"), ("a fee — taxes included", "—"), ("the “competent body” may", "“"), ("§ 1. The unit", "§"), ("organe « de tutelle » peut", "«"), ("Act 2266/2018/TT-TNĐ", "Đ"), ("Tàu dịch vụ là", "à"), ("25 °C", "°"), ("khổ ½ trang", "½"), ("Đã bãi bỏ.", "ã")]


@pytest.mark.parametrize("encoding", ["latin_1", "cp1252", "cp1251", "cp437", "mac_roman", "cp1258"])
def test_single_signs(encoding):
    for text, sign in SIGNS:
        bad = text.replace(sign, sloppy(sign, encoding))
        assert examine(bad, any_line=True)[0] and examine(bad)[1] == text, bad


def test_parts_and_loss():
    rng = random.Random(3)
    lines = [t if rng.random() < 0.5 else sloppy(t, "cp1252") for t in TEXTS * 4] + [sloppy(TEXTS[0], "latin_1")]
    assert examine("\n".join(lines))[1] == "\n".join([*TEXTS * 4, TEXTS[0]])
    assert examine("Nh�� th��u")[0]
    assert cost("Điều") == 0 < cost("Ä\x90iá»\x81u")


def test_operator(spark):
    bad = sloppy(TEXTS[0], "cp1252")
    rows = [(1, bad, "a"), (1, bad, "a"), (2, TEXTS[0], "a"), (3, None, "a"), (4, "", "a"), (5, " ", "a"), (None, bad, "a"), (6, (TEXTS[2] + "\n") * 2000 + bad, "a"), (7, "a�b", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    out = garbled(df, F.col("doc_id"), F.col("text"))
    assert out.columns == ["doc_id", "restored", "operations", "whole"]
    got = {(r.doc_id, r.whole) for r in out.collect()}
    assert got == {(1, True), (None, True), (6, True), (7, False)}
    assert garbled(df, F.col("doc_id"), F.col("text"), texts=False).count() == 5
    assert garbled(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
