"""Composed search, contexts and references over the document tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.functions import legal as L
from canonry.functions import vocabulary as V
from canonry.functions.text import fold, letters_digits, squeeze
from canonry.operators import retrieval as R
from canonry.operators.containment import contained
from canonry.operators.models import OverlapReranker, rename_report, rerank
from canonry.operators.ordered import Ordered
from canonry.operators.pipeline import document_contexts, processed_chunks
from canonry.plans.graph import changes, links
from canonry.plans.retrieval import FOLD, _by_vector, _keyword, _questions, every_question, folded_words, word_index
from canonry.sources.tables import table


#: A document number in a question, and its short form.
_NUMBER, _SHORT = r"(?iu)\d+/\d{4}/(?:TT|NĐ|QH|L|QĐ|NQ)(?:-[\p{L}]+)*", r"\d+/\d{4}"


def searched(documents: DataFrame, asked: DataFrame, lists: list[DataFrame], cited: DataFrame) -> DataFrame:
    """A whole search from ranked candidate lists: `query_id`, `doc_id`, `score`, `rank`, `position`, `stage`.

    25 fused candidates, 60 where the question names a number, reranked to 8;
    boosts by source and of documents in `cited` (`k`, folded numbers); for a
    question without candidates up to 50 documents of each number it names;
    last up to ten other candidates that have at least two long words of it.
    """
    full = F.regexp_extract_all("query", F.lit(_NUMBER), F.lit(0))
    numbers = F.when(F.size(full) > 0, full).otherwise(F.regexp_extract_all("query", F.lit(_SHORT), F.lit(0)))
    asked = asked.select("query_id", "query", F.array_distinct(F.transform(numbers, F.upper)).alias("numbers"))
    docs = documents.select("doc_id", "text", "source", "document_number", letters_digits("document_number").alias("k"))
    broad = R.fuse_ranks(lists, 60, "doc_id").withColumnRenamed("score", "fused").join(asked, "query_id").where((F.col("rank") <= 25) | (F.size("numbers") > 0)).drop("rank", "numbers")
    scored = rerank(broad.join(docs.drop("document_number"), "doc_id"), OverlapReranker(), "query", "text").withColumn("score", F.round("rerank_score", 6))
    placed = R.ranked(scored, 60, "doc_id")
    heavy = F.array_distinct(F.filter(F.split("query", r"[\s,;.]+"), lambda w: F.length(w) > 3))
    top = F.col("rank") <= 8
    flagged = placed.join(cited.withColumn("linked", F.lit(True)), "k", "left").withColumn("matches", F.when(top, 0).otherwise(F.size(F.filter(heavy, lambda w: F.contains("text", w)))))
    boosted = R.boosted(flagged, [(top & (F.col("source") == "cong_bao"), 0.005), (top & (F.col("source") == "cong_tinh"), 0.003), (top & F.col("linked"), 0.3)])
    staged = boosted.withColumns({"stage": F.when(top, "reranked").otherwise("rescued"), "score": F.when(top, F.col("score")).otherwise(F.col("fused") + 0.1 * F.col("matches"))})
    best = R.ranked(staged.where(top | (F.col("matches") >= 2)).drop("rank"), 10, "doc_id", by=["query_id", "stage"], score="matches").select("query_id", "doc_id", "score", "stage")
    empty = asked.join(broad.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode("numbers").alias("number"))
    named = docs.join(F.broadcast(empty), F.contains(F.upper("document_number"), F.col("number"))).withColumn("score", F.lit(1.0))
    scrolled = R.ranked(named, 50, "doc_id", by=["query_id", "number"]).select("query_id", "doc_id", "score", F.lit("number").alias("stage")).distinct()
    every = best.unionByName(scrolled)
    order = Window.partitionBy("query_id").orderBy(F.col("stage") == "rescued", F.desc("score"), "doc_id")
    total = F.count("*").over(Window.partitionBy("query_id"))
    out = every.withColumns({"rank": F.row_number().over(order), "total": total})
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", R.interleaved(F.col("rank"), F.col("total")).alias("position"), "stage")


def search_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """A whole search for every question of the query set, in the order that puts the best at both ends; candidates from keywords and vectors."""
    lists = [_keyword(spark, folder, 60, every=True), _by_vector(spark, folder, 60, every=True)]
    cited = table(spark, folder, "doc_contexts").select(F.explode("basis_refs.doc_number").alias("n")).select(letters_digits("n").alias("k")).where(F.col("k").isNotNull()).distinct()
    return searched(table(spark, folder, "documents"), every_question(spark, folder), lists, cited)


def hinted_missing(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Up to three documents that a question's hits by title cite and that aren't hits themselves."""
    if every:
        hits = R.bm25_every(table(spark, folder, "doc_contexts"), every_question(spark, folder), 20, text="doc_title", tokens=folded_words)
    else:
        hits = R.bm25_topk(word_index(spark, folder, "doc_contexts", "doc_id", "doc_title"), _questions(spark), 20, tokens=folded_words)
    found = hits.select("query_id", F.col("doc_id").alias("id"))
    near = found.join(links(spark, folder).select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id")).distinct()
    missing = near.join(found, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.25))
    return R.ranked(missing, 3, "id").select("query_id", "id", "score")


def chunk_hits(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best `k` chunks of each question by keywords, with all that `chunks` has of them; one row a chunk."""
    rows = chunks.groupBy("chunk_id").agg(F.min(F.struct(*[c for c in chunks.columns if c != "chunk_id"])).alias("c")).select("chunk_id", "c.*")
    return R.bm25_every(rows, asked, k, key="chunk_id", text="chunk_text", tokens=folded_words).join(rows, "chunk_id")


def cited_of(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """The hits that the answer of their question cites, by article, by number where a hit has no article, or by title; the best hit where none is.

    `hits` has `query_id`, `rank`, `document_number`, `article_ref`, `title`; `answers` has `query_id`, `answer`.
    """
    said, number, article, title = F.lower("answer"), F.lower(F.trim("document_number")), F.coalesce(F.lower(squeeze("article_ref")), F.lit("")), squeeze("title")
    short = F.regexp_extract(number, r"^([^/]*/[^/]*)", 1)
    by_number = (F.length(number) > 3) & (F.contains(said, number) | ((short != "") & F.contains(said, short)))
    # not the beginning of a longer number
    by_article = (F.length(article) > 2) & F.regexp_like(said, F.concat(F.regexp_replace(article, r"([.()\[\]\\+*?^$|{}])", r"\\$1"), F.lit("(?![0-9])")))
    parts = F.split(title, " ")
    by_title = (F.length(title) > 15) & (F.size(parts) > 3) & F.contains(said, F.lower(F.array_join(F.slice(parts, 1, 5), " ")))
    cited = F.coalesce(by_article, F.lit(False)) | F.coalesce(by_number & (article == ""), F.lit(False)) | F.coalesce(by_title, F.lit(False))
    marked = hits.join(answers, "query_id", "left").withColumn("cited", cited)
    some = F.max("cited").over(Window.partitionBy("query_id"))
    return marked.withColumn("some", some).where(F.col("cited") | (~F.col("some") & (F.col("rank") == 1))).drop("some", "answer")


def cited_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Of the eight best chunks of each test question those that its citation names; the best where none is named."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), F.col("citation").alias("answer"))
    titles = table(spark, folder, "doc_contexts").groupBy(F.col("doc_id").alias("document_id")).agg(F.min("doc_title").alias("title"))
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "document_number", "article_ref", "chunk_text")
    hits = chunk_hits(chunks, items.select("query_id", "query"), 8).drop("chunk_text").join(titles, "document_id", "left")
    return cited_of(hits, items.select("query_id", "answer")).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "cited")


def with_references(hits: DataFrame, chunks: DataFrame, most: int = 10, budget: int = 15_000) -> DataFrame:
    """The hits, and after them up to `most` chunks of the articles of the same document that their texts cite.

    Chunks are added in the order of hits and citations as long as fewer than
    `budget` characters are added before them; hits are always kept.
    """
    article = lambda c: F.lower(squeeze(c))
    known_parts = hits.select("query_id", "document_id", article("article_ref").alias("a")).distinct()
    refs = hits.select("query_id", "document_id", F.col("rank").alias("hit"), F.posexplode(L.citations_in("chunk_text")).alias("at", "citation"))
    refs = refs.withColumn("a", F.regexp_extract("citation", r"^(điều \d+[a-zđ]?)$", 1)).where(F.col("a") != "").groupBy("query_id", "document_id", "a").agg(F.min(F.struct("hit", "at")).alias("o"))
    parts = chunks.select("document_id", article("article_ref").alias("a"), "chunk_id", "chunk_index", F.length("chunk_text").alias("chars")).dropDuplicates(["chunk_id"])
    found = refs.join(known_parts, ["query_id", "document_id", "a"], "left_anti").join(parts, ["document_id", "a"])
    order = Window.partitionBy("query_id").orderBy("o.hit", "o.at", "chunk_index", "chunk_id")
    counted = found.withColumns({"n": F.row_number().over(order), "before": F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    added = counted.where((F.col("n") <= most) & (F.col("before") < budget)).select("query_id", "chunk_id", F.col("n").alias("rank"), F.lit(True).alias("supplemental"), F.col("chars"))
    return hits.select("query_id", "chunk_id", "rank", F.lit(False).alias("supplemental"), F.length("chunk_text").alias("chars")).unionByName(added)


def context_references(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of each question of the query set, and the parts of their documents that they cite."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "article_ref", "chunk_index", "chunk_text")
    return with_references(chunk_hits(chunks, every_question(spark, folder), 10), chunks)


def text_citations(spark: SparkSession, folder: str) -> DataFrame:
    """How often articles, clauses and numbers are cited in chunks."""
    rows = table(spark, folder, "chunks").select("chunk_id", "chunk_text").distinct()
    return rows.select("chunk_id", F.explode(L.citations_in("chunk_text")).alias("citation")).groupBy("citation").agg(F.count("*").alias("chunks"))


def chunk_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every chunk in its document by the numbers in its id."""
    rows = table(spark, folder, "chunks").select("document_id", "chunk_id").distinct().withColumn("key", L.order_key("chunk_id"))
    return Ordered(rows, ["document_id"], F.col("key.c"), [F.col("key")]).row_number("place").rows().select("document_id", "chunk_id", F.col("place").cast("int").alias("place"))


def article_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of article 2 in every document that has one."""
    rows = table(spark, folder, "documents").where(F.col("text").rlike(r"(?iu)(^|\n)\s*điều 2(?![0-9])"))
    return rows.select("doc_id", L.article_body(F.col("text"), F.lit("Điều 2")).alias("body"))


def changed_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Changing relations with the article they change, its first chunk and that chunk's text; null where no article is named or the document hasn't got it."""
    article = lambda c: F.nullif(F.lower(squeeze(c)), F.lit(""))
    rels = changes(spark, folder).withColumn("__a", article("article"))
    chunks = table(spark, folder, "chunks").select("document_id", article("article_ref").alias("__a"), F.struct("chunk_index", "chunk_id", "chunk_text").alias("c")).where(F.col("__a").isNotNull())
    first = chunks.groupBy("document_id", "__a").agg(F.min("c").alias("c"))
    return rels.join(first, ["document_id", "__a"], "left").select("by_id", "type", "document_id", "article", F.col("c.chunk_id").alias("first_chunk"), F.col("c.chunk_text").alias("old_text"))


def leaf_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of the entities that the document of every chunk has, with their number; a null label for a chunk whose document has none."""
    names = table(spark, folder, "doc_contexts").select(F.col("doc_id").alias("document_id"), F.explode("entities").alias("label", "names")).select("document_id", "label", F.size("names").alias("entities")).where(F.col("entities") > 0)
    return table(spark, folder, "chunks").select("chunk_id", "document_id").distinct().join(names, "document_id", "left").select("chunk_id", "label", F.coalesce("entities", F.lit(0)).alias("entities"))


def samples_per_document(spark: SparkSession, folder: str) -> DataFrame:
    """The first three chunks of every document."""
    rows = table(spark, folder, "chunks").select("document_id", "chunk_index", "chunk_id").distinct()
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))).where(F.col("n") <= 3)


def entity_search(spark: SparkSession, folder: str) -> DataFrame:
    """Entities whose name has all words of a query, or differs from it by at most one letter, with the number of their documents."""
    query = "trạm quan trắc"
    names = table(spark, folder, "doc_contexts").select("doc_id", F.explode("entities").alias("label", "members")).select("doc_id", "label", F.explode("members").alias("raw")).select("doc_id", "label", fold(squeeze("raw")).alias("name"))
    word = fold(F.lit(query))
    hit = F.contains(F.col("name"), word) | (F.levenshtein(F.col("name"), word) <= 1)
    return names.where(hit).groupBy("label", "name").agg(F.countDistinct("doc_id").alias("docs"))


def name_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical names and sectors of which one contains the other; equal ones are one class."""
    return contained(table(spark, folder, "canon_names").select("canon_id", fold("canon_name").alias("name")), "canon_id", "name")


def relation_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Dry run of renaming relation labels to canonical names."""
    rels = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels.edge_label").alias("raw"))
    return rename_report(rels, "raw", L.relation_name("raw"))


def date_years(spark: SparkSession, folder: str) -> DataFrame:
    """Years of raw dates in two simple forms."""
    return table(spark, folder, "corpus_metadata").groupBy(L.year_of_date("issuance_date").alias("year")).agg(F.count("*").alias("n"))


def flattened_chats(spark: SparkSession, folder: str) -> DataFrame:
    """The last fourteen messages of each session as one prompt; the rank limit bounds what is gathered."""
    from canonry.operators.sessions import history_window
    from canonry.plans.sessions import _ORDER, _messages

    last = history_window(_messages(spark, folder).where(F.col("content").isNotNull() & F.col("role").isNotNull()), "session_id", _ORDER)
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(": "), "content").alias("line"))))
    return last.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def verb_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of relation labels with more than one form, in the corpus and among fixed names."""
    found = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels.edge_label").alias("raw")).distinct()
    every = found.unionByName(spark.createDataFrame([(x,) for x in V.DOC_RELATIONS], "raw string")).distinct()
    return every.groupBy(F.regexp_replace(L.verb_stem("raw"), "(S|ED|D)$", "").alias("stem")).agg(F.count("*").alias("forms"), F.array_join(F.array_sort(F.collect_set("raw")), ",").alias("names")).where(F.col("forms") > 1)


def context_text(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """The context of each question: the whole texts of its eight best documents, the best at both ends."""
    texts = _keyword(spark, folder, 8, every=every).join(table(spark, folder, "documents").select("doc_id", "document_number", "text"), "doc_id")
    total = F.count("*").over(Window.partitionBy("query_id"))
    placed = texts.select("query_id", R.interleaved(F.col("rank"), total).alias("position"), L.rerank_text(F.col("document_number"), F.lit(""), F.col("text")).alias("piece"))
    gathered = F.array_sort(F.collect_list(F.struct("position", "piece")))
    return placed.groupBy("query_id").agg(F.array_join(F.transform(gathered, lambda x: x["piece"]), "\n---\n").alias("context"))


def processed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document contexts made of raw texts and the last crawl of their number, without the texts."""
    return document_contexts(table(spark, folder, "documents"), table(spark, folder, "corpus_metadata"), F.lit("2024-01-01")).drop("text", "sectors")


def ingested_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ingestion: contexts, chunks, citations, hints and point ids."""
    contexts = document_contexts(table(spark, folder, "documents"), table(spark, folder, "corpus_metadata"), F.lit("2024-01-01"))
    return processed_chunks(contexts).select("doc_id", "chunk_id", "chunk_index", "reference_citation", "has_potential_entities", "has_potential_relations", "point_id")


QUERIES = {
    f.__name__: f for f in (
        verb_groups, context_text, processed_documents, ingested_chunks, search_pipeline, hinted_missing, cited_hits, context_references, text_citations, chunk_order, article_bodies, changed_articles, leaf_entities, samples_per_document, entity_search, name_overlaps,
        relation_rename, date_years, flattened_chats,
    )
} | {f"{f.__name__}_all": partial(f, every=True) for f in (context_text, hinted_missing)}

from canonry.plans import graph as _graph  # noqa: E402
from canonry.plans import retrieval as _retrieval  # noqa: E402
from canonry.plans import sessions as _sessions  # noqa: E402
from canonry.plans import texts as _texts  # noqa: E402

_SQ = _graph._sq
SQL = {
    "verb_groups": "WITH e AS (SELECT DISTINCT x.edge_label AS raw FROM " + _texts._REL + " UNION SELECT unnest([" + ", ".join(f"'{x}'" for x in V.DOC_RELATIONS) + """])),
      s AS (SELECT regexp_replace(regexp_replace(raw, '_(BY|TO|IN|FOR|FROM|WITH|AS|VIA|ON|AT|OF)$', ''), '(S|ED|D)$', '') AS stem, raw FROM e) SELECT stem, count(*) AS forms, string_agg(raw, ',' ORDER BY raw) AS names FROM s GROUP BY stem HAVING count(*) > 1""",
    "context_text": f"""WITH {_retrieval._Q}, {_retrieval._sql_bm25('b', 'true', 8)}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM b JOIN documents USING (doc_id)),
      p AS (SELECT query_id, CASE WHEN total <= 2 THEN rank WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE total - rank // 2 + 1 END AS position, concat_ws(chr(10), nullif(trim(document_number), ''), nullif(trim(text, ' '), '')) AS piece FROM t)
      SELECT query_id, string_agg(piece, chr(10) || '---' || chr(10) ORDER BY position) AS context FROM p GROUP BY query_id""",
    "hinted_missing": f"""WITH {_retrieval._Q}, {_retrieval._sql_bm25('b', 'true', 20, 'doc_contexts', 'doc_title')}, {_graph._BASE}, f AS (SELECT query_id, doc_id AS id FROM b),
      n AS (SELECT DISTINCT query_id, l.dst AS id FROM f JOIN links l ON l.src = f.id), m AS (SELECT * FROM n WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM f))
      SELECT query_id, id, 0.25::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM m) WHERE r <= 3""",
    "cited_hits": f"""WITH q AS (SELECT item_id AS query_id, question AS query, lower(citation) AS said FROM eval_items), u AS (SELECT chunk_id AS doc_id, min((document_id, document_number, article_ref, chunk_text)) AS x, min((document_id, document_number, article_ref, chunk_text))[4] AS chunk_text FROM chunks GROUP BY chunk_id), {_retrieval._sql_bm25('b', 'true', 8, 'u', 'chunk_text')},
      h AS (SELECT b.query_id, b.doc_id AS chunk_id, b.score, b.rank, q.said, lower(trim(x[2], ' ')) AS number, coalesce(lower({_SQ('x[3]')}), '') AS article, {_SQ('title')} AS title FROM b JOIN u USING (doc_id) JOIN q USING (query_id) LEFT JOIN (SELECT doc_id AS d, min(doc_title) AS title FROM doc_contexts GROUP BY 1) t ON t.d = x[1]),
      m AS (SELECT *, coalesce(length(article) > 2 AND regexp_matches(said, regexp_replace(article, '([.()\\[\\]\\\\+*?^$|{{}}])', '\\\\\\1', 'g') || '(?:[^0-9]|$)'), false)
        OR coalesce(article = '' AND length(number) > 3 AND (contains(said, number) OR (regexp_extract(number, '^([^/]*/[^/]*)', 1) <> '' AND contains(said, regexp_extract(number, '^([^/]*/[^/]*)', 1)))), false)
        OR coalesce(length(title) > 15 AND len(string_split(title, ' ')) > 3 AND contains(said, lower(array_to_string(string_split(title, ' ')[1:5], ' '))), false) AS cited FROM h)
      SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, cited FROM (SELECT *, bool_or(cited) OVER (PARTITION BY query_id) AS found FROM m) WHERE cited OR (NOT found AND rank = 1)""",
    "context_references": f"""WITH {_retrieval._QALL}, u AS (SELECT chunk_id AS doc_id, min((document_id, article_ref, chunk_index, chunk_text)) AS x, min((document_id, article_ref, chunk_index, chunk_text))[4] AS chunk_text FROM chunks GROUP BY chunk_id), {_retrieval._sql_bm25('b', 'true', 10, 'u', 'chunk_text')},
      h AS (SELECT query_id, doc_id AS chunk_id, rank, x[1] AS document_id, lower({_SQ('x[2]')}) AS a, u.chunk_text FROM b JOIN u USING (doc_id)),
      c AS (SELECT query_id, document_id, rank, generate_subscripts(l, 1) AS spot, lower(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS a FROM (SELECT *, regexp_extract_all(chunk_text, '(?i)((?:điều|khoản|điểm|mục|chương)\\s+(?:\\d+[a-zđ]?|[a-zđ]|[ivxlc]+))(?:[^\\pL\\pN\\pM_]|$)', 1) AS l FROM h)),
      r AS (SELECT query_id, document_id, a, min((rank, spot)) AS o FROM c WHERE regexp_full_match(a, 'điều \\d+[a-zđ]?') AND (query_id, document_id, a) NOT IN (SELECT (query_id, document_id, a) FROM h WHERE a IS NOT NULL) GROUP BY ALL),
      p AS (SELECT doc_id AS chunk_id, x[1] AS document_id, lower({_SQ('x[2]')}) AS a, x[3] AS chunk_index, length(chunk_text) AS chars FROM u),
      f AS (SELECT query_id, chunk_id, chars, row_number() OVER w AS n, coalesce(sum(chars) OVER (PARTITION BY query_id ORDER BY o, chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM r JOIN p USING (document_id, a) WINDOW w AS (PARTITION BY query_id ORDER BY o, chunk_index, chunk_id))
      SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, false AS supplemental, CAST(length(chunk_text) AS INTEGER) AS chars FROM h UNION ALL SELECT query_id, chunk_id, CAST(n AS INTEGER), true, CAST(chars AS INTEGER) FROM f WHERE n <= 10 AND prior < 15000""",
    "text_citations": r"""SELECT citation, count(*) AS chunks FROM (SELECT chunk_id, unnest(list_distinct(list_transform(regexp_extract_all(chunk_text, '(?i)((?:điều|khoản|điểm|mục|chương)\s+(?:\d+[a-zđ]?|[a-zđ]|[ivxlc]+))(?:[^\pL\pN\pM_]|$)', 1) || regexp_extract_all(chunk_text, '\d+/\d{4}/[A-ZĐ][A-Z0-9Đ\-]*'),
        lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))))) AS citation FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks)) GROUP BY citation""",
    "article_bodies": r"""SELECT doc_id, rtrim(regexp_replace(rest, '(?is)\n\s*(?:điều|chương|mục|phần)\s+[0-9ivxlc]+.*$', ''), ' ') AS body FROM (SELECT doc_id, regexp_extract(chr(10) || text, '(?is)\n\s*(điều 2(?:[^0-9].*)?)$', 1) AS rest FROM documents WHERE text IS NOT NULL) WHERE rest <> ''""",
    "chunk_order": """SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY coalesce(TRY_CAST(regexp_extract(chunk_id, 'c(\\d+)', 1) AS INTEGER), 0), coalesce(TRY_CAST(regexp_extract(chunk_id, 'p(\\d+)', 1) AS INTEGER), 0), chunk_id) AS INTEGER) AS place
      FROM (SELECT DISTINCT document_id, chunk_id FROM chunks)""",
    "changed_articles": f"""WITH {_graph._BASE}, r AS (SELECT DISTINCT by_id, type, id AS document_id, article FROM (SELECT by_id, x.edge_label AS type, {_graph._real('x.target_article')} AS article, {_graph._k('x.target_doc')} AS key
        FROM (SELECT doc_id AS by_id, unnest(ontology_rels) AS x FROM doc_contexts) WHERE x.edge_label IN ('AMENDS', 'REPLACES', 'REPEALS')) JOIN nums USING (key)),
      f AS (SELECT document_id, lower({_SQ('article_ref')}) AS a, min((chunk_index, chunk_id, chunk_text)) AS c FROM chunks WHERE {_SQ('article_ref')} <> '' GROUP BY ALL)
      SELECT by_id, type, r.document_id, article, c[2] AS first_chunk, c[3] AS old_text FROM r LEFT JOIN f ON f.document_id = r.document_id AND f.a = lower(r.article)""",
    "leaf_entities": "SELECT c.chunk_id, e.label, CAST(coalesce(e.n, 0) AS INTEGER) AS entities FROM (SELECT DISTINCT chunk_id, document_id FROM chunks) c LEFT JOIN (SELECT doc_id, label, len(names) AS n FROM (SELECT doc_id, unnest(map_keys(entities)) AS label, unnest(map_values(entities)) AS names FROM doc_contexts) WHERE len(names) > 0) e ON e.doc_id = c.document_id",
    "samples_per_document": "SELECT * FROM (SELECT document_id, chunk_index, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS INTEGER) AS n FROM (SELECT DISTINCT document_id, chunk_index, chunk_id FROM chunks)) WHERE n <= 3",
    "entity_search": f"""WITH e AS (SELECT doc_id, label, {FOLD.format(_SQ('raw'))} AS name FROM (SELECT doc_id, label, unnest(names) AS raw FROM (SELECT doc_id, unnest(map_keys(entities)) AS label, unnest(map_values(entities)) AS names FROM doc_contexts)))
      SELECT label, name, count(DISTINCT doc_id) AS docs FROM e WHERE contains(name, 'tram quan trac') OR levenshtein(name, 'tram quan trac') <= 1 GROUP BY ALL""",
    "name_overlaps": f"""WITH n AS (SELECT {FOLD.format('canon_name')} AS name, min(canon_id) AS id, count(*) AS same FROM canon_names WHERE canon_name <> '' GROUP BY 1)
      SELECT a.id AS a_id, b.id AS b_id, a.same AS a_same, b.same AS b_same FROM n a JOIN n b ON a.name <> b.name AND contains(a.name, b.name)""",
    "relation_rename": "WITH n AS (" + _texts.SQL["relation_names"] + f") SELECT n.raw AS old, n.relation AS new, count(*) AS edges FROM {_texts._REL} r JOIN n ON n.raw = r.x.edge_label WHERE n.raw <> n.relation GROUP BY ALL",
    "date_years": "SELECT coalesce(nullif(regexp_extract(trim(issuance_date, ' '), '^\\d{1,2}/\\d{1,2}/(\\d{4})', 1), ''), nullif(regexp_extract(trim(issuance_date, ' '), '^(\\d{4})-\\d{1,2}-\\d{1,2}', 1), '')) AS year, count(*) AS n FROM corpus_metadata GROUP BY 1",
    "flattened_chats": _sessions._M + ", b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC, created_at DESC NULLS LAST, role DESC, content DESC) AS back FROM m WHERE content IS NOT NULL AND role IS NOT NULL) SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY back DESC) AS prompt FROM b WHERE back <= 14 GROUP BY session_id",
}
SQL |= {f"{n}_all": SQL[n].replace(_retrieval._Q, _retrieval._QALL) for n in ("context_text", "hinted_missing")}


def _sql_documents() -> str:
    """Document contexts in SQL: contents as in `contents_and_dates`, fields of the last crawl of the number."""
    contents = _texts.SQL["contents_and_dates"].split("SELECT doc_id, coalesce(array_to_string(toc")[0]
    known = lambda x: f"CASE WHEN lower({_SQ(x)}) NOT IN ('', 'n/a', 'nan', 'none') THEN {x} END"
    year = lambda x: f"coalesce(nullif(regexp_extract({x}, '\\b((?:19|20)\\d{{2}})\\b', 1), ''), CASE WHEN TRY_CAST(regexp_extract({x}, '(\\d{{4}})', 1) AS INTEGER) BETWEEN 1900 AND 2100 THEN regexp_extract({x}, '(\\d{{4}})', 1) END)"
    number = lambda x: f"coalesce(nullif(regexp_extract({x}, '(?i)(?:số\\s*)?(\\d+/\\d+(?:/[A-Z0-9Đ\\-]+)?)', 1), ''), nullif(regexp_extract({x}, '(?i)(\\d+/[A-Z0-9Đ\\-]+)', 1), ''))"
    key = _retrieval.KEY.format
    head = "array_to_string(string_split(text, chr(10))[1:100], chr(10))"
    return f"""{contents}, n AS (SELECT doc_id, coalesce({known('document_number')}, {number(head)}) AS number FROM documents),
      m AS (SELECT *, {key(known('document_number'))} AS k, row_number() OVER (PARTITION BY {key(known('document_number'))} ORDER BY crawled_at DESC NULLS LAST, title DESC NULLS LAST) AS place FROM corpus_metadata),
      j AS (SELECT n.doc_id, n.number, m.*, substr(trim({known('issuance_date')}, ' '), 1, 10) AS promulgated, array_to_string(toc, chr(10)) AS toc,
          CASE WHEN day.y <> '' THEN day.y || '-' || lpad(day.m, 2, '0') || '-' || lpad(day.d, 2, '0') WHEN regexp_matches(body, '(?i)có\\s+hiệu\\s+lực\\s+(?:thi\\s+hành\\s+)?(?:kể\\s+)?từ\\s+ngày\\s+ký|chịu\\s+trách\\s+nhiệm\\s+thi\\s+hành\\s+(?:quyết\\s+định|nghị\\s+định|thông\\s+tư|văn\\s+bản)\\s+này') THEN promulgated END AS stated
        FROM n LEFT JOIN e USING (doc_id) LEFT JOIN m ON m.k = {key('n.number')} AND m.place = 1),
      f AS (SELECT *, coalesce(stated, promulgated) AS effective FROM j), g AS (SELECT * EXCLUDE (doc_status), coalesce({known('doc_status')}, CASE WHEN length(effective) = 10 AND effective > '2024-01-01' THEN 'Chưa có hiệu lực' ELSE 'Đang có hiệu lực' END) AS doc_status FROM f)
      SELECT doc_id, coalesce(number, 'N/A') AS doc_number, coalesce({known('title')}, 'N/A') AS doc_title, coalesce({year('issuance_date')}, {year('number')}) AS doc_year,
        coalesce(nullif(array_to_string(list_filter(list_transform(string_split({known('legal_sectors')}, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), ', '), ''), 'Chung') AS sectors_str, {_texts._STATUS} AS doc_status, {known('issuing_authority')} AS issuing_auth,
        CASE WHEN signers IS NULL OR lower(trim(signers)) IN ('nan', '', 'none') THEN NULL WHEN contains(signers, ':') THEN trim(split_part(signers, ':', 1)) ELSE signers END AS signer_name,
        CASE WHEN lower(trim(signers)) NOT IN ('nan', '', 'none') AND contains(signers, ':') AND regexp_full_match(split_part(signers, ':', 2), '\\s*-?[0-9]+\\s*') THEN CAST(regexp_replace(split_part(signers, ':', 2), '\\s+', '', 'g') AS BIGINT) END AS signer_id,
        promulgated AS promulgation_date, effective AS final_effective_date, {known('legal_type')} AS legal_type_meta, url, toc AS document_toc FROM g"""


SQL["processed_documents"] = _sql_documents()
