"""Scalar functions on legal texts, by hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from canonry.functions import legal as L
from canonry.functions.text import fold, known, letters_digits, squeeze


def values(spark, expression, raws, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


CASES = [
    (lambda: L.slugify("x"), ["Luật Đất", "A--b", "", None], ["lu-t-t", "a-b", "unknown", "unknown"]),
    (lambda: L.document_type("x"), ["Bộ luật Dân sự", "LUẬT đất", "Nghi dinh 1", "thư", None], ["code", "law", "decree", "other", "other"]),
    (lambda: L.extract_year("x"), ["12/2015/QH", "1234 và 1999", "20150101", "99991", "", None], ["2015", "1999", "2015", None, None, None]),
    (lambda: L.document_status("x"), ["hết hiệu lực 1 phần", "Het hieu luc", "chưa", "còn", "N/A", None], [L.V.PARTLY_EXPIRED, L.V.EXPIRED, L.V.NOT_YET, L.V.IN_FORCE, L.V.IN_FORCE, L.V.IN_FORCE]),
    (lambda: L.document_number("x"), ["số 12/2015/NĐ-CP ngày", "5/QĐ", "không", None], ["12/2015/NĐ-CP", "5/QĐ", None, None]),
    (lambda: L.document_key("x"), ["12 / 2015/nđ-cp.", "", None], ["122015NĐCP", "", None]),
    (lambda: L.entity_hint("x"), ["UBND và Bộ Tài chính", "bộc lộ", "", None], [True, False, False, False]),
    (lambda: L.relation_hint("x"), ["sửa đổi 12/2015/NĐ-CP", "SỬA  ĐỔI 12/2015/nđ-cp", "sửa đổi", "12/2015/NĐ-CP", None], [True, True, False, False, False]),
    (lambda: L.letter_count("x"), ["Đất 12", "", None], [3, 0, 0]),
    (lambda: L.line_kind("x"), ["Chương I", "ĐIỀU 5. A", "1. a", "(2) b", "a) c", "| a | b |", "Phụ lục I", "Căn cứ Luật", "", "chữ"], ["chapter", "article", "clause", "clause", "point", "table", "appendix", "basis", "blank", "text"]),
    (lambda: L.intent("x"), ["Mức phạt và thủ tục?", "thủ tục", "xin chào", None, "Ai ký nghị định?", "bao lâu", "cơ quan giám sát", "lệ phí"], ["penalty", "procedure", None, None, "authority", "timeframe", "management", "fee"]),
    (lambda: L.intent_scope("x")["relations"], ["bị phạt", "đăng ký", "không"], [["APPLIES_TO", "AFFECTED_BY"], ["ISSUED_BY", "SIGNED_BY", "APPROVED_BY", "CREATED_BY"], None]),
    (lambda: L.relation_name("x"), ["assigned to", "UPDATED_EVERY", "IS", "PAYS_FOR", "approving", "SHARES", "", None], ["FUNDED_BY", "AMENDED_BY", "RELATED_TO", "PAYS_FOR", "APPROVED_BY", "SHARES", "RELATED_TO", "RELATED_TO"]),
    (lambda: L.relation_name("x"), ["APPLIES", "issues", "guides", "Transferred via", "transferred_from", "performed_by", "directs_implementation_of", "PRODUCES", "monitors", "uses for", "permitted_by", "permits", "lacks skill", "stored at", "ISSUED_WITH", "evaluates"],
     ["APPLIES_TO", "ISSUED_BY", "GUIDED_BY", "TRANSFERRED_TO", "TRANSFERRED_FROM", "IMPLEMENTED_BY", "IMPLEMENTED_BY", "CREATED_BY", "MANAGED_BY", "USED_FOR", "APPLIES_TO", "PERMITTED_TO", "RELATED_TO", "LOCATED_IN", "ISSUED_BY", "MANAGED_BY"]),
    (lambda: L.document_relation_name("x"), ["references", "Applies", "amends", "x-y", None], ["BASED_ON", "APPLIES_TO", "AMENDS", "BASED_ON", "BASED_ON"]),
    (lambda: L.entity_type("x"), ["Authority", "organization", "Organs", "NewKind", "bad kind", "", None], ["Organization", "Organization", "Organization", "NewKind", "Concept", "Concept", "Concept"]),
    (lambda: L.entity_name("x"), ["  bộ  y tế ", "cơ quan", "luật này", "", None], ["Bộ y tế", None, None, None, None]),
    (lambda: L.json_values("x", "$.a"), ['{"a": 1,}', "{", "", None], ["1", None, None, None]),
    (lambda: L.hierarchy_rank("x"), ["Luật ", "Khác", None], [3, 99, 99]),
    (lambda: fold("x"), ["Đường Đi", "é", None], ["duong di", "e", None]),
    (lambda: squeeze("x"), ["  a  b ", "", None], ["a b", "", None]),
    (lambda: known("x", "N/A"), [" n/a ", "", "a", None], [None, None, "a", None]),
    (lambda: letters_digits("x"), ["12 / 2015–NĐ", "--", None], ["122015nd", None, None]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(spark, i):
    expression, raws, want = CASES[i]
    assert values(spark, expression(), raws) == want


def test_signer(spark):
    got = values(spark, L.signer("x"), ["A B:12", "A:x", "A", "nan", "", None])
    assert [tuple(g) for g in got] == [("A B", 12), ("A", None), ("A", None), (None, None), (None, None), (None, None)]


def test_uuid5(spark):
    raws = ["a", "điều::1", "", "x" * 5000]
    assert values(spark, L.uuid5("x"), raws) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, r)) for r in raws]


def test_basis(spark):
    refs = values(spark, L.basis_references("x"), ["Căn cứ Luật Bến bãi số 10/2001/LU1 năm 2001; Nghị định 5/2008/NĐ-CP", "không", None])
    assert [(r.doc_type, r.doc_number, r.doc_year) for r in refs[0]] == [("law", "10/2001/LU1", "2001"), ("decree", "5/2008/NĐ-CP", "2008")]
    assert refs[0][1].parent_law_id == "parent::decree::5-2008-n-cp::2008"
    assert refs[1] == [] and not refs[2]


def test_status_on(spark):
    df = spark.createDataFrame([("2030-01-01",), ("2010-01-01",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(L.status_on(F.col("d"), F.lit("2020-01-01"))).collect()] == [L.V.NOT_YET, L.V.IN_FORCE, L.V.IN_FORCE, L.V.IN_FORCE]
