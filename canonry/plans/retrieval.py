"""Retrieval queries over embeddings, documents and chunks."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.functions.legal import hierarchy_rank
from canonry.functions.text import fold, letters_digits
from canonry.operators import retrieval as R
from canonry.sources.tables import derived, table

#: The questions of the keyword and hybrid queries that SQL checks; those named `..._all` ask the whole query set: id, text, and the embedding row that stands for the question.
QUESTIONS = [(1, "thời hạn của giấy phép khai thác cát sỏi", 10), (2, "kế hoạch nạo vét luồng và bến bãi", 20), (3, "the applicant file on request of the competent body", 30)]


def folded_words(text: Column | str) -> Column:
    """Words of the text without case and accents."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != "")


def _questions(spark: SparkSession) -> DataFrame:
    ids, texts, vectors = zip(*QUESTIONS)
    return spark.createDataFrame(pa.table({"query_id": pa.array(ids, pa.int64()), "query": pa.array(texts), "vec_id": pa.array(vectors, pa.int64())}))


def every_question(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of searches: the text of every document whose id is divisible by 100."""
    return table(spark, folder, "documents").where((F.col("doc_id") % 100 == 0) & F.col("text").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _vector(embeddings: DataFrame, key: int) -> list[float]:
    """One stored vector, looked up by its key."""
    return list(embeddings.where(F.col("vec_id") == key).select("embedding").first()[0])


def _dense(spark: SparkSession, folder: str, where: Column) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    hits = R.dense_topk(rows, _vector(rows, 0), 10, where=where, keep=("label",))
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to vector 0."""
    return _dense(spark, folder, F.col("vec_id") != 0)


def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same among one label, filtered before scoring."""
    return _dense(spark, folder, (F.col("vec_id") != 0) & (F.col("label") == 3))


def dense_knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100, itself included."""
    rows = table(spark, folder, "embeddings")
    queries = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_knn(rows, queries, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def session_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of one label first if its best is good enough, all hits otherwise."""
    rows = table(spark, folder, "embeddings").where(F.col("vec_id") != 0)
    query = F.array(*[F.lit(float(x)) for x in _vector(table(spark, folder, "embeddings"), 0)])
    hits = rows.select("vec_id", "label", R.cosine(F.col("embedding"), query).alias("score"))
    kept = R.session_first(hits, F.col("label") == 3, 0.1).orderBy(F.desc("score"), "vec_id").limit(10)
    return kept.select("vec_id", "label", F.round("score", 6).alias("score"))


def _tier(tier: str) -> Column:
    """Parts of the documents that have an index of their own."""
    return {"all": F.lit(True), "vi": F.col("lang") == "vi", "rest": F.coalesce(F.col("lang") != "vi", F.lit(True))}[tier]


def word_index(spark: SparkSession, folder: str, source: str, key: str, text: str, tier: str = "all") -> DataFrame:
    """The stored word index of one text column; `tier` is a part of the documents with word frequencies of its own."""
    return derived(spark, folder, f"words-{source}-{tier}", [source], lambda: R.bm25_index(table(spark, folder, source).where(_tier(tier)), key, text, tokens=folded_words), "bucket")


def _keyword(spark: SparkSession, folder: str, k: int, tier: str = "all", every: bool = False) -> DataFrame:
    if every:
        return R.bm25_every(table(spark, folder, "documents").where(_tier(tier)), every_question(spark, folder), k, tokens=folded_words)
    return R.bm25_topk(word_index(spark, folder, "documents", "doc_id", "text", tier), _questions(spark), k, tokens=folded_words)


def bm25_topk(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """The ten best documents of each question by keywords."""
    return _keyword(spark, folder, 10, every=every).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _by_vector(spark: SparkSession, folder: str, k: int, every: bool = False) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding") if every else _questions(spark).join(rows, "vec_id").select("query_id", "embedding")
    return R.dense_knn(rows.withColumnRenamed("vec_id", "doc_id"), asked, k, key="doc_id")


def hybrid_rrf(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Keyword and vector ranks fused: 20 and 20 candidates, 5 results a question."""
    return R.fuse_ranks([_keyword(spark, folder, 20, every=every), _by_vector(spark, folder, 20, every)], 5, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tiered_rrf(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Vietnamese documents and the others as tiers of their own, fused with the vector ranks."""
    lists = [_keyword(spark, folder, 30, "vi", every), _keyword(spark, folder, 15, "rest", every), _by_vector(spark, folder, 30, every)]
    return R.fuse_ranks(lists, 10, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def typology_boost(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Keyword hits with small boosts by source and a malus for other languages, ranked anew."""
    hits = _keyword(spark, folder, 20, every=every).join(table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id")
    rules = [(F.col("source") == "cong_bao", 0.005), (F.col("source") == "cong_tinh", 0.003), (F.coalesce(F.col("lang"), F.lit("")) != "vi", -0.002)]
    return R.ranked(R.boosted(hits.drop("rank"), rules), 8, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"))


def graph_boost(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Keyword hits whose document number some document is based on gain 0.3."""
    cited = table(spark, folder, "doc_contexts").select(F.explode("basis_refs.doc_number").alias("n")).select(letters_digits("n").alias("k")).where(F.col("k").isNotNull()).distinct()
    hits = _keyword(spark, folder, 20, every=every).join(table(spark, folder, "documents").select("doc_id", letters_digits("document_number").alias("k")), "doc_id")
    flagged = hits.join(cited.withColumn("linked", F.lit(True)), "k", "left")
    return R.ranked(R.boosted(flagged.drop("rank"), [(F.col("linked"), 0.3)]), 8, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), F.coalesce("linked", F.lit(False)).alias("linked"))


def keyword_rescue(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least two long words of a question, a tenth of a point each."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return R.keyword_rescue(docs, F.lit("the archive centre shall publish the boundary drawings"), "doc_id", "text").select("doc_id", "hits", "score")


def keyword_rescue_all(spark: SparkSession, folder: str) -> DataFrame:
    """For every question of the query set up to ten documents with at least two of its long words, a tenth of a point each."""
    return R.rescue_every(table(spark, folder, "documents"), every_question(spark, folder), "doc_id", "text").select("query_id", "doc_id", "hits", "score")


def chunk_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunks by document number: `k`, the number's letters and digits, `chunk_id`, `is_appendix`, `chunk_index`; sorted by number."""
    def build() -> DataFrame:
        rows = table(spark, folder, "chunks").select(letters_digits("document_number").alias("k"), "chunk_id", "is_appendix", "chunk_index").where(F.col("k").isNotNull())
        return rows.groupBy(*rows.columns).agg(F.count("*").alias("rows")).hint("rebalance").sortWithinPartitions("k", "chunk_index")

    return derived(spark, folder, "chunk-numbers", ["chunks"], build)


def number_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunk rows each number has."""
    return derived(spark, folder, "number-counts", ["chunks"], lambda: chunk_numbers(spark, folder).groupBy("k").agg(F.sum("rows").alias("n")))


def metadata_scroll(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the most cited document number, main text first, then in order."""
    top = number_counts(spark, folder).orderBy(F.desc("n"), "k").limit(1).select("k").first()
    rows = chunk_numbers(spark, folder).where(F.col("k") == F.lit(top.k if top else None)).select("chunk_id", "is_appendix", "chunk_index")
    return rows.orderBy(F.coalesce(F.col("is_appendix"), F.lit(False)), "chunk_index", "chunk_id").limit(200)


def emergency_scroll(spark: SparkSession, folder: str) -> DataFrame:
    """For every test item up to 50 chunks of the article it cites; the rank limit bounds what a hot article sends."""
    asked = table(spark, folder, "eval_items").select("item_id", F.trim("citation").alias("article_ref")).where(F.col("article_ref") != "")
    chunks = table(spark, folder, "chunks").select("chunk_id", "article_ref").distinct()
    first = R.ranked(chunks.withColumn("score", F.lit(0.0)), 50, "chunk_id", by="article_ref")
    return first.join(asked, "article_ref").select("item_id", "chunk_id", "article_ref")


def context_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks next to a chunk of an appendix in the same document."""
    rows = table(spark, folder, "chunks").select("document_id", "chunk_index", "chunk_id", "is_appendix").distinct()
    hits = rows.where("is_appendix")
    return R.neighbours(rows.select("document_id", "chunk_index", "chunk_id"), hits.select("document_id", "chunk_index"), "document_id", "chunk_index").select("document_id", "hit_index", "chunk_index", "chunk_id")


def context_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """The first three chunks of every article as one context."""
    rows = table(spark, folder, "chunks").where(F.col("article_ref") != "").dropDuplicates(["chunk_id"])
    return R.siblings(rows, ["document_id", "article_ref"], ["chunk_index", "chunk_id"], "chunk_text", 3)


def interleave_order(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors in the order that puts the best at both ends."""
    hits = dense_knn_batch(spark, folder)
    return hits.select("query_id", "vec_id", R.interleaved(F.col("rank"), F.lit(5)).alias("position"))


def filter_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by equalities, contained texts and alternatives at once."""
    rows = table(spark, folder, "doc_contexts")
    condition = R.filters({"doc_year": "2015"}, {"doc_title": "về"}, [F.col("legal_type_meta") == "Nghị định", F.contains(F.col("doc_number"), F.lit("UBND"))], "is_active")
    return rows.where(condition).select("doc_id", "doc_number", "doc_title")


def article_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of one article in all documents."""
    rows = table(spark, folder, "chunks").where(R.filters({"article_ref": "Điều 5"}, active="is_active"))
    return rows.select("document_id", "chunk_id", "chunk_index").distinct()


def sample_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable sample of 100 documents: the lowest hashes."""
    return table(spark, folder, "documents").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100).select("doc_id", "lang", "source")


def ranked_head(spark: SparkSession, folder: str) -> DataFrame:
    """The first 8000 documents by year, rank of type, and id."""
    rows = table(spark, folder, "doc_contexts").withColumn("rank", hierarchy_rank("legal_type_meta"))
    return rows.orderBy(F.desc_nulls_last("doc_year"), "rank", "doc_id").limit(8000).select("doc_id", "doc_year", "rank")


QUERIES = {
    f.__name__: f for f in (
        dense_topk, dense_topk_filtered, dense_knn_batch, session_priority, bm25_topk, hybrid_rrf, tiered_rrf, typology_boost, graph_boost, keyword_rescue, keyword_rescue_all, metadata_scroll,
        emergency_scroll, context_neighbours, context_siblings, interleave_order, filter_tree, article_fetch, sample_by_hash, ranked_head,
    )
} | {f"{f.__name__}_all": partial(f, every=True) for f in (bm25_topk, hybrid_rrf, tiered_rrf, typology_boost, graph_boost)}

FOLD = "replace(lower(strip_accents({0})), 'đ', 'd')"
KEY = "nullif(regexp_replace(replace(lower(strip_accents({0})), 'đ', 'd'), '[^\\pL\\pN]+', '', 'g'), '')"


def _sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {v})" for i, t, v in QUESTIONS) + ") t(query_id, query, vec_id)), qv AS (SELECT query_id, vec_id FROM q)"
#: The whole query set under the same names, for the queries ending in `_all`.
_QALL = "q AS (SELECT doc_id AS query_id, text AS query, doc_id AS vec_id FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL), qv AS (SELECT vec_id AS query_id, vec_id FROM embeddings WHERE vec_id % 100 = 0)"
_TOKENS = "list_filter(string_split_regex(" + FOLD + ", '[^a-z0-9]+'), lambda w: w <> '')"


def _sql_bm25(name: str, where: str, k: int, source: str = "documents", text: str = "text") -> str:
    """CTEs that end in `name`(query_id, doc_id, score, rank)."""
    return f"""
{name}_d AS (SELECT doc_id, coalesce({_TOKENS.format(text)}, []) AS w FROM {source} WHERE {where}),
{name}_s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM {name}_d),
{name}_q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS word FROM q),
{name}_t AS (SELECT doc_id, n, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM {name}_d) WHERE word IN (SELECT word FROM {name}_q) GROUP BY ALL),
{name}_f AS (SELECT word, count(*) AS df FROM {name}_t GROUP BY word),
{name}_x AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score
  FROM {name}_t JOIN {name}_f USING (word) JOIN {name}_q USING (word), {name}_s GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_x) WHERE rank <= {k})"""


def _sql_dense(name: str, k: int) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT q.query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {_sql_cosine('e.embedding', 'v.embedding')} DESC, e.vec_id) AS rank
  FROM qv AS q JOIN embeddings v ON v.vec_id = q.vec_id, embeddings e) WHERE rank <= {k})"""


def _sql_fuse(lists: list[str], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    return f"""
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {k}"""


def _sql_top(where: str) -> str:
    return f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, {_sql_cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS score FROM embeddings WHERE {where}) ORDER BY score DESC, vec_id LIMIT 10"


_KNN = f"""SELECT q.vec_id AS query_id, e.vec_id, {_sql_cosine('e.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sql_cosine('e.embedding', 'q.embedding')} DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"""
_RANK = "CASE trim(legal_type_meta) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"Hiến pháp": 1, "Bộ luật": 2, "Luật": 3, "Pháp lệnh": 4, "Lệnh": 5, "Nghị quyết": 6, "Nghị định": 7, "Quyết định": 8, "Thông tư": 9, "Chỉ thị": 10}.items()) + " ELSE 99 END"
SQL = {
    "dense_topk": _sql_top("vec_id <> 0"),
    "dense_topk_filtered": _sql_top("vec_id <> 0 AND label = 3"),
    "dense_knn_batch": f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_KNN}) WHERE rank <= 5",
    "interleave_order": f"SELECT query_id, vec_id, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE 5 - rank // 2 + 1 END AS BIGINT) AS position FROM ({_KNN}) WHERE rank <= 5",
    "session_priority": f"""WITH h AS (SELECT vec_id, label, {_sql_cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS score FROM embeddings WHERE vec_id <> 0),
      b AS (SELECT max(score) AS best FROM h WHERE label = 3)
      SELECT vec_id, label, round(score, 6) AS score FROM h, b WHERE CASE WHEN best >= 0.1 THEN label = 3 AND score >= 0.1 * 0.7 ELSE true END ORDER BY h.score DESC, vec_id LIMIT 10""",
    "bm25_topk": f"WITH {_Q}, {_sql_bm25('b', 'true', 10)} SELECT query_id, doc_id, round(score, 6) AS score FROM b",
    "hybrid_rrf": f"WITH {_Q}, {_sql_bm25('b', 'true', 20)}, {_sql_dense('v', 20)} {_sql_fuse(['b', 'v'], 5)}",
    "tiered_rrf": f"WITH {_Q}, {_sql_bm25('m', 'lang = $$vi$$', 30)}, {_sql_bm25('r', 'coalesce(lang <> $$vi$$, true)', 15)}, {_sql_dense('v', 30)} {_sql_fuse(['m', 'r', 'v'], 10)}",
    "typology_boost": f"""WITH {_Q}, {_sql_bm25('b', 'true', 20)} SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM
      (SELECT query_id, doc_id, b.score + CASE WHEN source = 'cong_bao' THEN 0.005 ELSE 0 END::DOUBLE + CASE WHEN source = 'cong_tinh' THEN 0.003 ELSE 0 END::DOUBLE + CASE WHEN coalesce(lang, '') <> 'vi' THEN -0.002 ELSE 0 END::DOUBLE AS score FROM b JOIN documents USING (doc_id))) WHERE place <= 8""",
    "graph_boost": f"""WITH {_Q}, {_sql_bm25('b', 'true', 20)}, c AS (SELECT DISTINCT {KEY.format('n')} AS k FROM (SELECT unnest(list_transform(basis_refs, lambda x: x.doc_number)) AS n FROM doc_contexts)),
      h AS (SELECT query_id, doc_id, b.score + CASE WHEN c.k IS NOT NULL THEN 0.3 ELSE 0 END::DOUBLE AS score, c.k IS NOT NULL AS linked FROM b JOIN documents d USING (doc_id) LEFT JOIN c ON c.k = {KEY.format('d.document_number')})
      SELECT query_id, doc_id, round(score, 6) AS score, linked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM h) WHERE place <= 8""",
    "keyword_rescue": """WITH w AS (SELECT DISTINCT unnest(string_split('the archive centre shall publish the boundary drawings', ' ')) AS word), h AS (SELECT doc_id, count(*) AS hits FROM documents, w WHERE length(word) > 3 AND contains(lower(text), word) GROUP BY doc_id HAVING count(*) >= 2)
      SELECT doc_id, CAST(hits AS INTEGER) AS hits, round(hits * 0.1::DOUBLE, 6) AS score FROM h ORDER BY hits DESC, doc_id LIMIT 10""",
    "metadata_scroll": f"""WITH c AS (SELECT *, {KEY.format('document_number')} AS k FROM chunks), t AS (SELECT k FROM c WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
      SELECT DISTINCT chunk_id, is_appendix, chunk_index FROM c WHERE k = (SELECT k FROM t) ORDER BY coalesce(is_appendix, false), chunk_index, chunk_id LIMIT 200""",
    "emergency_scroll": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY article_ref ORDER BY chunk_id) AS r FROM (SELECT DISTINCT chunk_id, article_ref FROM chunks))
      SELECT item_id, chunk_id, article_ref FROM eval_items JOIN c ON c.article_ref = trim(citation) WHERE r <= 50""",
    "context_neighbours": """WITH r AS (SELECT DISTINCT document_id, chunk_index, chunk_id, is_appendix FROM chunks) SELECT r.document_id, h.chunk_index AS hit_index, r.chunk_index, r.chunk_id
      FROM r JOIN (SELECT document_id, chunk_index FROM r WHERE is_appendix) h ON r.document_id = h.document_id AND abs(r.chunk_index - h.chunk_index) <= 1""",
    "context_siblings": """WITH u AS (SELECT DISTINCT document_id, article_ref, chunk_index, chunk_id, chunk_text FROM chunks WHERE article_ref <> ''), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, article_ref ORDER BY chunk_index, chunk_id) AS n FROM u) WHERE n <= 3)
      SELECT document_id, article_ref, string_agg(chunk_text, chr(10) ORDER BY n) AS context, count(*) AS pieces FROM f GROUP BY ALL""",
    "filter_tree": "SELECT doc_id, doc_number, doc_title FROM doc_contexts WHERE doc_year = '2015' AND contains(lower(doc_title), 'về') AND (legal_type_meta = 'Nghị định' OR contains(doc_number, 'UBND')) AND is_active",
    "article_fetch": "SELECT DISTINCT document_id, chunk_id, chunk_index FROM chunks WHERE article_ref = 'Điều 5' AND is_active",
    "sample_by_hash": "SELECT doc_id, lang, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "ranked_head": f"SELECT doc_id, doc_year, {_RANK} AS rank FROM doc_contexts ORDER BY doc_year DESC NULLS LAST, 3, doc_id LIMIT 8000",
}

for _name in ("bm25_topk", "hybrid_rrf", "tiered_rrf", "typology_boost", "graph_boost"):
    SQL[f"{_name}_all"] = SQL[_name].replace(_Q, _QALL)
SQL["keyword_rescue_all"] = f"""WITH {_QALL}, w AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(query), '[^a-z0-9]+')) AS word FROM q), h AS (SELECT query_id, doc_id, count(*) AS hits FROM w JOIN documents ON contains(lower(text), word) WHERE length(word) > 3 GROUP BY ALL HAVING count(*) >= 2)
  SELECT query_id, doc_id, CAST(hits AS INTEGER) AS hits, round(hits * 0.1::DOUBLE, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS place FROM h) WHERE place <= 10"""
