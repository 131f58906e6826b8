"""The whole job where an older query does a part of it."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

QUERIES = entry.queries()


def rows(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def test_context_has_whole_texts(spark, folder):
    from canonry.plans.retrieval import _keyword

    texts = {r.doc_id: r.text.strip(" ") for r in spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").collect()}
    contexts = {r["query_id"]: r["context"] for r in rows(spark, folder, "context_text")}
    hits = _keyword(spark, folder, 8).collect()
    assert len(hits) > 8 and any(len(texts[h.doc_id]) > 300 for h in hits)
    for h in hits:
        assert texts[h.doc_id] in contexts[h.query_id]


def test_changed_articles_have_their_own_text(spark, folder):
    chunks = spark.read.parquet(f"{folder}/chunks.parquet").select("document_id", "article_ref", "chunk_index", "chunk_id", "chunk_text").collect()
    got = rows(spark, folder, "changed_articles")
    for r in got:
        of = [(c.chunk_index, c.chunk_id, c.chunk_text) for c in chunks if r["article"] and c.document_id == r["document_id"] and (c.article_ref or "").strip().lower() == r["article"].lower()]
        assert (r["first_chunk"], r["old_text"]) == (min(of)[1:] if of else (None, None))


def test_changed_article_of_a_small_case(spark, tmp_path):
    rel = lambda article: ("1/2020/A", "2/2020/B", "AMENDS", "", "", article, True)
    rels = "array<struct<source_doc:string,target_doc:string,edge_label:string,relation_phrase:string,context:string,target_article:string,is_cross_doc:boolean>>"
    spark.createDataFrame([("1", "1/2020/A", [rel("Điều 2"), rel("Điều 9"), rel("")]), ("2", "2/2020/B", [])], f"doc_id string, doc_number string, ontology_rels {rels}").write.parquet(f"{tmp_path}/doc_contexts.parquet")
    spark.createDataFrame([], "doc_id string, doc_number string").write.parquet(f"{tmp_path}/base_laws.parquet")
    parts = [("2", "a", 1, "Điều 1", "x"), ("2", "c", 3, "điều 2", "z"), ("2", "b", 2, "Điều  2", "y")]
    spark.createDataFrame(parts, "document_id string, chunk_id string, chunk_index int, article_ref string, chunk_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r["article"], r["first_chunk"], r["old_text"]) for r in rows(spark, str(tmp_path), "changed_articles")}
    assert got == {("Điều 2", "b", "y"), ("Điều 9", None, None), (None, None, None)}


def test_tree_sectors_and_phantoms(spark):
    from canonry.operators import graph as G

    parts = [
        ("d", "t", 0, "Điều 1", None, True), ("d", "a", 1, "Điều 1", None, False), ("d", "a", 1, "Điều 1", None, False), ("d", "b", 2, "Điều 1", "", False), ("d", "c", 3, "Điều 2", "Khoản 1", None),
        ("d", "e", 4, "Điều 2", "Khoản 1 (tiếp theo)", False), ("d", "f", 5, "Điều 2", "[Khoản 1 tiếp theo]", False), ("d", "o", 6, "", "Khoản 9", False), ("d", "p", 7, None, None, False),
    ]
    chunks = spark.createDataFrame(parts, "document_id string, chunk_id string, chunk_index int, article_ref string, clause_ref string, is_table boolean")
    assert sorted((r.src, r.type, r.dst) for r in G.tree_edges(chunks).collect()) == sorted([
        ("d", "HAS_ARTICLE", "d_Điều 1"), ("d", "HAS_ARTICLE", "d_Điều 2"), ("t", "PART_OF", "d_Điều 1"), ("b", "PART_OF", "d_Điều 1"), ("d_Điều 2_Khoản 1", "PART_OF", "d_Điều 2"),
        ("e", "PART_OF", "d_Điều 2_Khoản 1"), ("f", "PART_OF", "d_Điều 2_Khoản 1"), ("o", "BELONGS_TO", "d"), ("p", "BELONGS_TO", "d"),
    ])
    docs = spark.createDataFrame([("1", 'Y tế; "Thuế, phí";Y tế'), ("2", "Chung"), ("3", None)], "doc_id string, sectors_str string")
    assert sorted((r.src, r.type, r.dst) for r in G.sector_edges(docs).collect()) == [("1", "HAS_SECTOR", "Thuế, phí"), ("1", "HAS_SECTOR", "Y tế")]
    rels = spark.createDataFrame([("7", "1/2020/A", "Điều 3"), (None, "9/2020/X", "Điều 4"), (None, None, "Điều 5"), ("7", "1/2020/A", "")], "id string, number string, article string")
    assert sorted((r.src, r.type, r.dst) for r in G.phantom_edges(rels).collect()) == [("7_Điều 3", "BELONGS_TO", "7"), ("REF_9/2020/X_Điều 4", "BELONGS_TO", "REF_9/2020/X")]


def test_whole_graph_and_same_sector(spark, folder):
    edges = {(r["src"], r["type"], r["dst"]) for r in rows(spark, folder, "graph_edges")}
    chunks = spark.read.parquet(f"{folder}/chunks.parquet").select("document_id", "article_ref", "chunk_id").distinct().collect()
    parents = {s for s, t, _ in edges if t in ("PART_OF", "BELONGS_TO")}
    assert {(c.document_id, f"{c.document_id}_{c.article_ref}") for c in chunks if c.article_ref} == {(s, d) for s, t, d in edges if t == "HAS_ARTICLE"}
    assert {c.chunk_id for c in chunks if not c.article_ref} <= parents
    of = {}
    for s, t, d in edges:
        if t == "HAS_SECTOR":
            of.setdefault(s, set()).add(d)
    got = {}
    for r in rows(spark, folder, "same_sector"):
        assert r["sector"] in of[r["doc_id"]] & of[r["other"]] and r["doc_id"] != r["other"]
        got.setdefault(r["doc_id"], set()).add((r["other"], r["sector"]))
    for doc, sectors in of.items():
        pairs = sum(len(sectors & other) for o, other in of.items() if o != doc)
        assert len(got.get(doc, ())) == min(3, pairs)


def test_every_question_is_asked(spark, folder):
    from canonry.operators import retrieval as R
    from canonry.plans.retrieval import every_question, folded_words

    docs = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet")
    asked = every_question(spark, f"{folder}/../sf0.01")
    ids = {r.doc_id for r in docs.where("doc_id % 100 = 0 and text <> ''").collect()}
    assert ids and {r["query_id"] for r in rows(spark, f"{folder}/../sf0.01", "bm25_topk_all")} == ids
    want = sorted(map(tuple, R.bm25_topk(R.bm25_index(docs, tokens=folded_words), asked, 7, tokens=folded_words).select("query_id", "doc_id", F.round("score", 6), "rank").collect()))
    for size in (3, 1024):
        got = R.bm25_every(docs, asked, 7, tokens=folded_words, block=size, step=64, words_at_once=50).select("query_id", "doc_id", F.round("score", 6), "rank")
        assert sorted(map(tuple, got.collect())) == want
    titled = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    want = sorted(map(tuple, R.bm25_topk(R.bm25_index(titled, tokens=folded_words), asked, 7, tokens=folded_words).select("query_id", "doc_id", "rank").collect()))
    assert sorted(map(tuple, R.bm25_every(titled, asked, 7, tokens=folded_words).select("query_id", "doc_id", "rank").collect())) == want
    got = {(r.query_id, r.doc_id, r.hits) for r in R.rescue_every(docs, asked, "doc_id", "text", block=3, step=64).collect()}
    for q in asked.collect():
        alone = R.keyword_rescue(docs.where("text is not null"), F.lit(q.query), "doc_id", "text").collect()
        assert {(d, h) for i, d, h in got if i == q.query_id} == {(r.doc_id, r.hits) for r in alone}


def test_search_has_all_stages(spark):
    from canonry.plans.answers import searched

    texts = ["alpha beta", "gamma", "alpha delta epsilon zetas"] + [f"delta epsilon filler{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, "cong_bao" if i == 1 else "", "7/2020/TT-A" if i == 1 else f"{i}/1999/X") for i, t in enumerate(texts)], "doc_id long, text string, source string, document_number string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "see 7/2020/TT-A"), (3, "delta epsilon one two three four"), (4, "nothing")], "query_id long, query string")
    keyword = spark.createDataFrame([(1, 0, 1)] + [(3, i, i - 2) for i in range(3, 23)], "query_id long, doc_id long, rank int")
    dense = spark.createDataFrame([(1, 1, 1)], "query_id long, doc_id long, rank int")
    got = {(r.query_id, r.doc_id): r for r in searched(docs, asked, [keyword, dense], spark.createDataFrame([("72020tta",)], "k string")).collect()}
    assert got[1, 1].score == 0.305 and got[1, 0].score == 1.0 and {d for q, d in got if q == 1} == {0, 1}
    assert (got[2, 1].stage, got[2, 1].score) == ("number", 1.0) and sum(q == 2 for q, _ in got) == 1
    assert sum(r.stage == "reranked" for (q, _), r in got.items() if q == 3) == 8 and sum(r.stage == "rescued" for (q, _), r in got.items() if q == 3) == 10
    assert sorted(r["rank"] for (q, _), r in got.items() if q == 3) == sorted(r.position for (q, _), r in got.items() if q == 3) == list(range(1, 19))
    assert not any(q == 4 for q, _ in got)


def test_search_asks_every_question(spark, folder):
    base = f"{folder}/../sf0.01"
    got = rows(spark, base, "search_pipeline")
    asked = {r.id for r in spark.read.parquet(f"{base}/documents.parquet").where("doc_id % 100 = 0 and text <> ''").selectExpr("doc_id as id").collect()}
    assert asked <= {r["query_id"] for r in got}


def test_cited_hits_come_from_the_search(spark):
    from canonry.plans.answers import cited_of

    hits = [(1, "a", 1, "1/2020/A", "Điều 1", "x"), (1, "b", 2, "1/2020/A", "Điều 17", "x"), (2, "a", 1, "1/2020/A", "Điều 1", None), (2, "c", 2, None, None, None), (3, "d", 1, "2/2021/B", "", "x"), (3, "e", 2, "2/2021/B", "Điều 9", "x"), (4, "f", 2, "3/3/C", "Điều 3", "Nghị định về kế hoạch nạo vét")]
    df = spark.createDataFrame(hits, "query_id long, chunk_id string, rank int, document_number string, article_ref string, title string")
    answers = spark.createDataFrame([(1, "theo Điều 17"), (2, "gì đó"), (3, "theo 2/2021"), (4, "nghị định về kế hoạch 2020")], "query_id long, answer string")
    assert {(r.query_id, r.chunk_id, r.cited) for r in cited_of(df, answers).collect()} == {(1, "b", True), (2, "a", False), (3, "d", True), (4, "f", True)}


def test_every_item_has_a_cited_or_best_hit(spark, folder):
    items = {r.item_id for r in spark.read.parquet(f"{folder}/eval_items.parquet").where("question is not null").collect()}
    assert items == {r["query_id"] for r in rows(spark, folder, "cited_hits")}


def test_references_are_followed(spark):
    from canonry.plans.answers import with_references

    parts = [("h", "d", "Điều 1", 1, "theo Điều 2 và Điều 3, Điều 1"), ("b", "d", "Điều 2", 2, "y" * 20_000), ("c", "d", "điều 3", 3, "z"), ("x", "e", "Điều 2", 2, "w")]
    chunks = spark.createDataFrame(parts, "chunk_id string, document_id string, article_ref string, chunk_index int, chunk_text string")
    hits = chunks.where("chunk_id = 'h'").selectExpr("1L as query_id", "*", "1 as rank")
    got = lambda budget: {(r.chunk_id, r.supplemental) for r in with_references(hits, chunks, budget=budget).collect()}
    assert got(15_000) == {("h", False), ("b", True)} and got(30_000) == {("h", False), ("b", True), ("c", True)}
