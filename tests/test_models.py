"""Model contracts, answers of models, and the later scalar functions."""

import json

from pyspark.sql import functions as F

from canonry.functions import legal as L
from canonry.operators.models import HashEmbedder, OverlapReranker, Strategy, asked_model, embed, first_json, parse_responses, rename_report, rerank, response_entities, response_relations


def one(spark, expression, raw):
    return spark.createDataFrame([(raw,)], "x string").select(expression.alias("y")).first().y


def test_first_json():
    assert json.loads(first_json('text {"a": {"b": "}"}, "c": [1,2,],} more')) == {"a": {"b": "}"}, "c": [1, 2]}
    assert first_json('{bad} {"a": 1}') == '{"a": 1}'
    assert first_json("{") is first_json("") is first_json(None) is None
    assert first_json("{" * 2000) is None


def test_answers(spark):
    answer = "Sure: " + json.dumps({"doc_relations": [], "entities": {"Authority": ["bộ a", "cơ quan", "Bộ a"], "Article": ["Điều 1"]}, "node_relations": [{"source_node": "bộ a", "relationship": "issues", "target_node": "văn bản x", "source_type": "", "target_type": ""}]})
    parsed = parse_responses(spark.createDataFrame([("d", answer), ("e", "no"), ("f", None)], "doc string, answer string"), "answer")
    assert sorted((r.doc, r.entity_type, r.name) for r in response_entities(parsed, ["doc"]).collect()) == [("d", "Organization", "Bộ a")]
    assert [(r.source, r.relation, r.target) for r in response_relations(parsed, ["doc"]).collect()] == [("Bộ a", "ISSUED_BY", "Văn bản x")]
    assert parsed.where("parsed is null").count() == 2


def test_rerank(spark):
    class Broken:
        def scores(self, question, texts):
            raise ValueError("down")

    hits = spark.createDataFrame([("a b", "a b c"), ("a b", None), (None, "x"), ("a b", "a")], "q string, t string")
    assert sorted(r.rerank_score for r in rerank(hits, OverlapReranker(), "q", "t").collect()) == [0.0, 0.0, 0.5, 1.0]
    assert {r.rerank_score for r in rerank(hits, Broken(), "q", "t").collect()} == {0.0}
    assert {r.rerank_error for r in rerank(hits, Broken(), "q", "t").collect()} == {"ValueError: down"}
    assert "rerank_score" not in hits.columns


def test_embedding_and_asking(spark):
    class Broken:
        def embed(self, texts):
            raise ValueError("down")

    class Echo:
        def complete(self, prompts):
            if "bad" in prompts[0]:
                raise ValueError("no")
            return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "b a")], "id int, t string")
    got = {r.id: r for r in embed(rows, HashEmbedder(8), F.col("t"), at_once=1).collect()}
    assert got[1].embedding == got[4].embedding and sum(got[1].embedding) == 2 and got[2].embedding is None and sum(got[3].embedding) == 2
    assert {(r.id, r.embedding, r.embedding_error) for r in embed(rows, Broken(), F.col("t")).collect()} == {(1, None, "ValueError: down"), (2, None, None), (3, None, "ValueError: down"), (4, None, "ValueError: down")}
    asked = asked_model(spark.createDataFrame([(1, "x"), (1, "x"), (2, "bad"), (3, None)], "id int, t string").coalesce(1), Echo(), "id", "t", "|".join, per_prompt=1).collect()
    assert sorted((tuple(r["keys"]), r.answer, r.error) for r in asked) == [(("1",), "X", None), (("2",), None, "ValueError: no")]
    steps = Strategy(lambda q: q.withColumn("u", F.lit(1)), lambda q: q.withColumn("r", F.lit(2)), lambda q: q.withColumn("g", F.lit(3)))
    assert steps.answer(rows).columns == ["id", "t", "u", "r", "g"]


def test_rename(spark):
    edges = spark.createDataFrame([("ISSUES",), ("ISSUES",), ("AMENDED_BY",), (None,)], "type string")
    assert [tuple(r) for r in rename_report(edges.where("type is not null"), "type", L.relation_name("type")).collect()] == [("ISSUES", "ISSUED_BY", 2)]


def test_scalars(spark):
    assert one(spark, L.citations_in("x"), "Theo Điều 5, khoản 2 và điều  5; số 1/2020/QĐ-A") == ["điều 5", "khoản 2", "1/2020/qđ-a"]
    assert one(spark, L.question_entities("x"), "Bộ Công Thương ban hành 1/2020/QĐ-A, 1/2020/QĐ-A?") == ["1/2020/QĐ-A", "Bộ Công Thương"]
    text = "Điều 1. A\nmột\nĐiều 12. B\nhai\nChương II\nba"
    assert one(spark, L.article_body(F.col("x"), F.lit("Điều 1")), text) == "Điều 1. A\nmột"
    assert one(spark, L.article_body(F.col("x"), F.lit("Điều 12")), text) == "Điều 12. B\nhai"
    assert one(spark, L.article_body(F.col("x"), F.lit("Điều 3")), text) is None
    assert [one(spark, L.is_legal_document("x"), v) for v in ("15/2020/nđ-cp", "Bộ Tài chính", "Luật Đất", "abc", "", None)] == [True, False, True, False, False, False]
    assert one(spark, L.without_self_references("x"), "Theo Luật này và nghị định  này.") == "Theo  và ."
    assert [one(spark, L.verb_stem("x"), v) for v in ("ISSUED_BY", "ISSUES")] == ["ISSUED", "ISSUES"]
    assert one(spark, L.file_name("x"), ' a/b: "c" ') == "a_b_c_"
    assert [one(spark, L.embedding_input("x"), v) for v in ("a\x00b", " ", None)] == ["ab", "N/A", "N/A"]
    assert [one(spark, L.year_of_date("x"), v) for v in ("1/2/2019", "2018-03-04", "x", None)] == ["2019", "2018", None, None]
    assert [one(spark, L.is_greeting("x"), v) for v in ("Xin chào!", "chào luật sư", None)] == [True, False, False]
    assert tuple(one(spark, L.order_key("x"), "d::article::c12")) == (12, 0, "d::article::c12")


def test_labels_and_hints(spark):
    assert [one(spark, L.label_name("x"), v) for v in ("Article", " Institution", "1st Kind!", "Ủy ban", "", None)] == ["LegalArticle", "Organization", "E_1stKind", "yban", "Entity", "Entity"]
    assert [one(spark, L.edge_type("x"), v) for v in ("signed", "is-part  of", "implemented_by", "__a__", "", None)] == ["SIGNED_BY", "IS_PART_OF", "MANAGED_BY", "A", "RELATED_TO", "RELATED_TO"]
    assert tuple(one(spark, L.triplet(F.col("x"), F.lit("Legal Term!"), F.lit("is part-of"), F.lit(" b "), F.lit("")), " a ")) == ("a", "LegalTerm", "IS_PARTOF", "b", "Entity")
    assert one(spark, L.triplet(F.col("x"), F.lit("t"), F.lit("r"), F.lit("b"), F.lit("t")), "") is None
    assert one(spark, L.sector_hints("x", ["Y tế", "Thuế", "Đất", "Biển", "Rừng"]), "đất RỪNG biển thuế") == ["Thuế", "Đất", "Biển"]
    assert one(spark, L.sector_hints("x", []), "a") == []
    hints = one(spark, L.file_hints("x"), "Số 12/2020/NĐ-CP\nĐiều 2 Khoản 3 Điều 1 Điều 2 Mục 4")
    assert (hints.number, hints.headings) == ("12/2020/NĐ-CP", ["Khoản 3", "Mục 4", "Điều 1"])


def test_files(spark, tmp_path):
    from canonry.sources import files

    path = f"{tmp_path}/t"
    assert files.create_table(spark, path, "a int, b string") and not files.create_table(spark, path, "a int")
    spark.createDataFrame([(1, "x")], "a int, b string").write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 1
    files.flush_table(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["a", "b"]
    old, new = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "k int, v string, w int"), spark.createDataFrame([(1, None, 7), (3, "z", None)], "k int, v string, w int")
    assert sorted(map(tuple, files.merged(old, new, ["k"]).collect())) == [(1, "x", 7), (2, "y", None), (3, "z", None)]
    assert [one(spark, files.upload_problem("x"), v) for v in ("a.PDF", "b.txt", None)] == [None, "format", "format"]
    files.split_by_sector_and_year(spark.createDataFrame([(1, "A, B", "2020"), (2, "A", "2021")], "id int, s string, year string"), "s", "year", f"{tmp_path}/csv")
    assert sorted((r.id, r.sector, str(r.year)) for r in spark.read.csv(f"{tmp_path}/csv", header=True, inferSchema=True).collect()) == [(1, "A", "2020"), (1, "B", "2020"), (2, "A", "2021")]
    files.write_report(spark.createDataFrame([("b",), ("a",)], "value string"), f"{tmp_path}/report")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/report").collect()) == ["a", "b"]
