"""Ingestion from raw rows, session tables, fallbacks."""

import datetime as dt

from pyspark.sql import functions as F

from canonry.functions import legal as L
from canonry.operators import retrieval as R
from canonry.operators import sessions as S
from canonry.operators.pipeline import document_contexts, processed_chunks

TEXT = "Số: 5/2019/QĐ-A\nChương I. Một\nĐiều 1. Phạm vi điều chỉnh của văn bản\n1. Quyết định này có hiệu lực từ ngày 1/7/2030 trên toàn tỉnh theo 6/2011/TT-C sửa đổi."
META = "document_number string, title string, legal_type string, issuing_authority string, url string, signers string, issuance_date string, legal_sectors string, doc_status string, crawled_at timestamp_ntz, text string"


def test_contexts_and_chunks(spark):
    day = dt.datetime(2020, 1, 1)
    contents = spark.createDataFrame([(1, TEXT, None, "x"), (2, None, "9/2020/QĐ-Z", "x"), (3, "", "N/A", "x")], "doc_id long, text string, document_number string, title string")
    meta = spark.createDataFrame([
        ("5 / 2019 / qđ-a", "Cũ", None, None, None, None, None, None, None, day, "m"), ("5/2019/QĐ-A", "Mới", "Quyết định", "Sở A", "u", "Nguyễn:7", "2019-05-06 00:00", "Đất, Nước", "N/A", day + dt.timedelta(1), "m"),
        ("N/A", "z", None, None, None, None, None, None, None, None, "m"), (None, None, None, None, None, None, None, None, None, None, "m"),
    ], META)
    rows = {r.doc_id: r for r in document_contexts(contents, meta, F.lit("2024-01-01")).collect()}
    one = rows[1]
    assert (one.doc_number, one.doc_title, one.doc_year, one.signer_name, one.signer_id, one.sectors_str) == ("5/2019/QĐ-A", "Mới", "2019", "Nguyễn", 7, "Đất, Nước")
    assert (one.promulgation_date, one.final_effective_date, one.doc_status) == ("2019-05-06", "2030-07-01", L.V.NOT_YET)
    assert one.document_toc.startswith("Chương I: Một")
    assert rows[2].doc_title == "N/A" and rows[2].sectors_str == "Chung" and rows[3].doc_number == "N/A"
    chunks = processed_chunks(document_contexts(contents, meta, F.lit("2024-01-01"))).collect()
    assert [c.chunk_id for c in chunks if c.article_ref == "Điều 1"] == [c.chunk_id for c in chunks if c.has_potential_relations]
    assert all(c.chunk_id.startswith("1::article::c") and len(c.point_id) == 36 for c in chunks)
    assert document_contexts(contents.limit(0), meta.limit(0)).count() == 0


def test_sessions(spark):
    sessions = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, title string")
    new = spark.createDataFrame([("b", "other"), ("c", "C"), ("c", "D")], "id string, title string")
    made = S.create_sessions(sessions, new)
    assert sorted(map(tuple, made.collect())) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert S.rename_session(made, "a", "Z").where("title = 'Z'").count() == 1
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, session_id string")
    left, kept = S.delete_sessions(made, messages, made.where("id = 'a'"))
    assert left.count() == 2 and sorted(r.id for r in kept.collect()) == [2, 3]


def test_fallback_and_gate(spark):
    df = spark.range(3)
    assert R.with_fallback(df.where("id > 5"), df).count() == 3
    assert R.with_fallback(df.where("id = 1"), df).count() == 1
    hits = spark.createDataFrame([("s", 0.9), ("s", 0.2), ("t", 0.8)], "own string, score double")
    assert sorted(r.score for r in R.session_first(hits, F.col("own") == "s", 0.5).collect()) == [0.9]
    assert R.session_first(hits, F.col("own") == "s", 0.95).count() == 3
    rescued = R.keyword_rescue(spark.createDataFrame([(1, "Bến bãi alpha beta"), (2, "alpha"), (3, None)], "k long, t string"), F.lit("alpha beta gamma x"), "k", "t")
    assert [(r.k, r.hits) for r in rescued.collect()] == [(1, 2)]
    assert spark.range(1).select(L.after_marker(F.lit("a Nội dung:\nb")), L.translated(F.lit("X"), {"X": "Y"}), L.display_id(F.lit(" "), F.lit("q"))).first()[:] == ("b", "Y", "q")
