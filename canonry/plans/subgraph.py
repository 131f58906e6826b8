"""Subgraphs of documents and chunks, their text, and the smaller lookups of graph, search and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.functions import legal as L
from canonry.functions.text import known, squeeze
from canonry.operators import retrieval as R
from canonry.plans.graph import _REAL, _key, graph_edges, numbers
from canonry.plans.retrieval import emergency_scroll
from canonry.sources.tables import table

#: Relations between documents that a subgraph shows.
SHOWN = ("AMENDS", "REPLACES", "REPEALS", "BASED_ON", "GUIDES", "APPLIES", "ISSUED_WITH", "ASSIGNS", "CORRECTS")
#: Names of relations and labels in a subgraph's text.
DISPLAY = {"AMENDS": "sửa đổi", "REPLACES": "thay thế", "REPEALS": "bãi bỏ", "BASED_ON": "căn cứ", "GUIDES": "hướng dẫn"}
#: Relations and entities of a document that its text shows.
MOST_EDGES, MOST_NAMES = 50, 200


def shown_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between documents with number and title of the other end: `doc_id`, `source`, `type`, `target`, `target_title`, `article`."""
    docs = table(spark, folder, "doc_contexts")
    rels = docs.select("doc_id", F.col("doc_number").alias("source"), F.explode("ontology_rels").alias("x")).where(F.col("x.edge_label").isin(*SHOWN))
    named = rels.select("doc_id", "source", F.col("x.edge_label").alias("type"), squeeze(known("x.target_article", *_REAL)).alias("article"), _key("x.target_doc").alias("key"))
    titles = docs.select("doc_id", F.col("doc_title").alias("target_title")).unionByName(table(spark, folder, "base_laws").select("doc_id", F.col("law_title").alias("target_title")))
    met = named.join(numbers(spark, folder), "key").join(titles.withColumnRenamed("doc_id", "id"), "id")
    return met.select("doc_id", F.coalesce("source", "doc_id").alias("source"), "type", F.col("number").alias("target"), "target_title", "article").distinct()


def _first(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of every key; the rank limit bounds what is gathered later."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most)


def _lines(rows: DataFrame, key: str, line, name: str, separator: str = "\n") -> DataFrame:
    """One text per key of lines in the order of `__n`."""
    gathered = F.array_sort(F.collect_list(F.struct("__n", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(gathered, lambda x: x["line"]), separator).alias(name))


def entity_lines(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id`, `entities`: one line for each label with the first names under it, in order."""
    names = table(spark, folder, "doc_contexts").select("doc_id", F.explode("entities").alias("label", "names")).select("doc_id", "label", F.explode("names").alias("raw")).select("doc_id", "label", squeeze("raw").alias("name"))
    kept = _first(names.where(F.col("name") != "").distinct(), "doc_id", ["label", "name"], MOST_NAMES)
    per = _lines(kept.withColumn("k", F.concat_ws("\x00", "doc_id", "label")), "k", F.col("name"), "names", ", ")
    parts = per.select(F.split("k", "\x00")[0].alias("doc_id"), F.split("k", "\x00")[1].alias("label"), "names")
    ordered = parts.withColumn("__n", F.col("label"))
    return _lines(ordered, "doc_id", F.concat("label", F.lit(": "), "names"), "entities")


def relation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id`, `relations`: one line for each of the first relations to other documents."""
    rels = _first(shown_relations(spark, folder), "doc_id", ["type", "target", "target_title", "article"], MOST_EDGES)
    part = F.when(F.col("article").isNotNull(), F.concat(F.lit(" ["), "article", F.lit("]"))).otherwise("")
    line = F.concat(F.lit("["), "source", F.lit("] --("), L.translated("type", DISPLAY), F.lit(")--> ["), "target", F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("target_title"), F.lit("")), F.lit(")")), F.lit("")), F.lit("]"), part)
    return _lines(rels, "doc_id", line, "relations")


def subgraph_text(spark: SparkSession, folder: str) -> DataFrame:
    """The subgraph of every document as text: relations to other documents and entities by label."""
    ids = table(spark, folder, "doc_contexts").select("doc_id")
    return ids.join(relation_lines(spark, folder), "doc_id", "left").join(entity_lines(spark, folder), "doc_id", "left").where(F.coalesce("relations", "entities").isNotNull())


def graph_enriched_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text with what the graph knows of its document appended."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "chunk_text").distinct()
    joined = chunks.join(subgraph_text(spark, folder).withColumnRenamed("doc_id", "document_id"), "document_id", "left")
    more = F.concat_ws("\n", "chunk_text", F.concat(F.lit("[THỰC THỂ]: "), F.replace("entities", F.lit("\n"), F.lit("; "))), F.concat(F.lit("[QUAN HỆ VĂN BẢN]: "), F.replace("relations", F.lit("\n"), F.lit("; "))))
    return joined.select("chunk_id", more.alias("text"))


def sibling_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """For every document up to 20 others that share an entity used in fewer than 30 documents, the rarest entity first."""
    names = table(spark, folder, "doc_contexts").select("doc_id", F.explode("entities").alias("label", "names")).select("doc_id", "label", F.explode("names").alias("raw")).select("doc_id", "label", squeeze("raw").alias("name")).where(F.col("name") != "").distinct()
    uses = names.groupBy("label", "name").agg(F.count("*").alias("uses")).where((F.col("uses") > 1) & (F.col("uses") < 30))
    rare = names.join(uses, ["label", "name"])
    pairs = rare.join(rare.select(F.col("doc_id").alias("sibling"), "label", "name"), ["label", "name"]).where(F.col("doc_id") != F.col("sibling"))
    return _first(pairs, "doc_id", ["uses", "label", "name", "sibling"], 20).select("doc_id", "sibling", "label", "name", "uses", F.col("__n").alias("place"))


def document_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Number, title and articles of every document: the first chunk's text of each article and the number of its chunks."""
    parts = table(spark, folder, "chunks").select(F.col("document_id").alias("doc_id"), squeeze("article_ref").alias("article"), "chunk_index", "chunk_id", "chunk_text").where(F.col("article") != "").distinct()
    first = parts.groupBy("doc_id", "article").agg(F.min(F.struct("chunk_index", "chunk_id", "chunk_text"))["chunk_text"].alias("article_text"), F.count("*").alias("chunks"))
    return table(spark, folder, "doc_contexts").select("doc_id", "doc_number", "doc_title").join(first, "doc_id")


def article_by_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Articles whose name has a keyword, of documents whose number has another."""
    rows = document_articles(spark, folder).where(F.contains(F.lower("article"), F.lit("điều 5")) & F.contains(F.lower("doc_number"), F.lit("ubnd")))
    return rows.select("doc_id", "doc_number", "article", "article_text")


def sector_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every sector whose title or number has a keyword."""
    sectors = graph_edges(spark, folder).where(F.col("type") == "HAS_SECTOR").select(F.col("src").alias("doc_id"), F.col("dst").alias("sector"))
    found = table(spark, folder, "doc_contexts").where(F.contains(F.lower("doc_title"), F.lit("bến")) | F.contains(F.lower("doc_number"), F.lit("ubnd"))).select("doc_id", "doc_title", "doc_number")
    return sectors.join(found, "doc_id")


def hit_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the test items with the fields of the document that each chunk belongs to."""
    hits = emergency_scroll(spark, folder)
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id").distinct()
    docs = table(spark, folder, "doc_contexts").select(F.col("doc_id").alias("document_id"), F.col("doc_title").alias("parent_title"), F.col("doc_number").alias("parent_number"), F.col("final_effective_date").alias("effective_date"), F.col("issuing_auth").alias("authority"))
    return hits.join(chunks, "chunk_id").join(docs, "document_id", "left").select("item_id", "chunk_id", "document_id", "parent_title", "parent_number", "effective_date", "authority")


def expanded_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the test items with their surroundings: of an appendix the chunks beside it under the same citation, of an article its first eight chunks."""
    hits = emergency_scroll(spark, folder).select("item_id", "chunk_id")
    chunks = table(spark, folder, "chunks").select("chunk_id", "document_id", "article_ref", "chunk_index", "chunk_text", F.coalesce("is_appendix", F.lit(False)).alias("is_appendix")).distinct()
    own = hits.join(chunks.drop("chunk_text"), "chunk_id")
    articles = R.siblings(chunks.where(F.col("article_ref") != ""), ["document_id", "article_ref"], ["chunk_index", "chunk_id"], "chunk_text", 8)
    within = own.where(~F.col("is_appendix")).join(articles, ["document_id", "article_ref"]).select("item_id", "chunk_id", "context", "pieces")
    near = R.neighbours(chunks, own.where("is_appendix").select("document_id", "chunk_index").distinct(), "document_id", "chunk_index")
    named = own.where("is_appendix").select("item_id", F.col("chunk_id").alias("hit"), "document_id", F.col("chunk_index").alias("hit_index"), F.col("article_ref").alias("cited"))
    beside = named.join(near, ["document_id", "hit_index"]).where(F.col("cited").eqNullSafe(F.col("article_ref")))
    lines = F.array_sort(F.collect_list(F.struct("chunk_index", F.col("chunk_id").alias("c"), "chunk_text")))
    text = F.array_join(F.transform(lines, lambda x: x["chunk_text"]), "\n")
    return within.unionByName(beside.groupBy("item_id", F.col("hit").alias("chunk_id")).agg(text.alias("context"), F.count("*").alias("pieces")))


def unlinked_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Cited bases of a document that none of its BASED_ON relations names."""
    docs = table(spark, folder, "doc_contexts")
    bases = docs.select("doc_id", F.explode("basis_refs").alias("x")).select("doc_id", _key("x.doc_number").alias("key"), F.col("x.doc_title").alias("title")).where(F.col("key").isNotNull())
    linked = docs.select("doc_id", F.explode("ontology_rels").alias("x")).where(F.col("x.edge_label") == "BASED_ON").select("doc_id", _key("x.target_doc").alias("key"))
    return bases.join(linked, ["doc_id", "key"], "left_anti").distinct()


def leaf_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """The document above every chunk of the graph, and how many steps up it is."""
    edges = graph_edges(spark, folder)
    direct = edges.where(F.col("type") == "BELONGS_TO").select(F.col("src").alias("leaf"), F.col("dst").alias("doc_id"), F.lit(1).alias("hops"))
    chunks = table(spark, folder, "chunks").select(F.col("chunk_id").alias("leaf")).distinct()
    articles = edges.where(F.col("type") == "HAS_ARTICLE").select(F.col("dst").alias("up"), F.col("src").alias("doc_id"))
    above = edges.where(F.col("type") == "PART_OF").select(F.col("src").alias("leaf"), F.col("dst").alias("up")).join(articles, "up").select("leaf", "doc_id", F.lit(2).alias("hops"))
    return direct.join(chunks, "leaf", "left_semi").unionByName(above)


def node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the graph by label."""
    edges = graph_edges(spark, folder)
    ends = {"ISSUED_BY": "Authority", "SIGNED_BY": "Signer", "HAS_TYPE": "LegalType", "HAS_SECTOR": "Sector", "HAS_ARTICLE": "Article", "HAS_ENTITY": "Entity"}
    labels = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
    nodes = edges.where(F.col("type").isin(*ends)).select(labels[F.col("type")].alias("label"), F.col("dst").alias("id")).unionByName(table(spark, folder, "doc_contexts").select(F.lit("Document").alias("label"), F.col("doc_id").alias("id")))
    leaves = edges.where(F.col("type") == "PART_OF").select(F.lit("Chunk").alias("label"), F.col("src").alias("id"))
    return nodes.unionByName(leaves).groupBy("label").agg(F.countDistinct("id").alias("nodes"))


def node_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical relations with how often they occur and between how many different ends."""
    rels = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels").alias("x"))
    return rels.groupBy(L.relation_name("x.edge_label").alias("relation")).agg(F.count("*").alias("n"), F.countDistinct("x.source_doc").alias("sources"), F.countDistinct("x.target_doc").alias("targets"))


def session_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that the messages of a session name, each once: the union of its turns' sets."""
    rows = table(spark, folder, "messages").where(F.col("session_id").isNotNull()).select(F.lower(F.trim("session_id")).alias("session_id"), F.explode(L.question_entities("content")).alias("entity"))
    return rows.distinct()


def question_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three sectors that each test question, and one that names four, names; the list of sectors may have a thousand."""
    names = [r.canon_name for r in table(spark, folder, "canon_names").where((F.col("entry_kind") == "sector") & F.col("canon_name").isNotNull()).select("canon_name").distinct().orderBy("canon_name").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 sectors: pass a list of hot ones")
    asked = table(spark, folder, "eval_items").select("item_id", "question").unionByName(spark.createDataFrame([(-1, "Chính sách đất đai, thủy lợi, môi trường và giáo dục nghề?")], "item_id long, question string"))
    return asked.select("item_id", F.explode(L.sector_hints("question", names)).alias("sector"))


def uploaded_hints(spark: SparkSession, folder: str) -> DataFrame:
    """For every document what its first three chunks would add to a question: number and headings."""
    rows = table(spark, folder, "chunks").select("document_id", "chunk_index", "chunk_id", "chunk_text").distinct()
    first = _first(rows.where(F.col("chunk_text").isNotNull()), "document_id", ["chunk_index", "chunk_id"], 3)
    hints = _lines(first, "document_id", F.col("chunk_text"), "sample").withColumn("h", L.file_hints("sample"))
    return hints.select("document_id", F.col("h.number").alias("number"), F.array_join("h.headings", ", ").alias("headings"))


def chunk_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of up to twelve chunks of a document, as a model is asked them."""
    rows = table(spark, folder, "chunks").select("document_id", "chunk_index", "chunk_id").distinct()
    placed = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")) - 1) / 12))
    return placed.groupBy("document_id", "batch").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))


def sanitised_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and relations as a graph store takes them, for those of the corpus and some raw ones."""
    labels = table(spark, folder, "doc_contexts").select(F.explode(F.map_keys("entities")).alias("raw")).select(F.lit("label").alias("kind"), "raw").distinct()
    more = spark.createDataFrame([("label", "Article"), ("label", "1st Kind!"), ("label", "Signer"), ("label", "!!"), ("relation", "signed"), ("relation", " is-part  of "), ("relation", "assigns"), ("relation", ""), ("relation", "__a__")], "kind string, raw string")
    every = labels.unionByName(more).distinct()
    return every.select("kind", "raw", F.when(F.col("kind") == "label", L.label_name("raw")).otherwise(L.edge_type("raw")).alias("name"))


QUERIES = {
    f.__name__: f for f in (
        subgraph_text, graph_enriched_chunks, sibling_chunks, document_articles, article_by_keyword, sector_documents, hit_nodes, expanded_hits, unlinked_bases, leaf_ancestors, node_counts, node_relation_counts,
        session_entities, question_sectors, uploaded_hints, chunk_batches, sanitised_labels,
    )
}

from canonry.plans import graph as _g  # noqa: E402
from canonry.plans import retrieval as _r  # noqa: E402

_SQ, _K, _REALSQL = _g._sq, _g._k, _g._real
_SUB = f"""
shown AS (SELECT DISTINCT r.doc_id, coalesce(r.source, r.doc_id) AS source, r.type, n.number AS target, t.title AS target_title, r.article FROM
  (SELECT doc_id, doc_number AS source, x.edge_label AS type, {_REALSQL('x.target_article')} AS article, {_K('x.target_doc')} AS key FROM (SELECT doc_id, doc_number, unnest(ontology_rels) AS x FROM doc_contexts) WHERE x.edge_label IN ('AMENDS', 'REPLACES', 'REPEALS', 'BASED_ON', 'GUIDES', 'APPLIES', 'ISSUED_WITH', 'ASSIGNS', 'CORRECTS')) r
  JOIN nums n USING (key) JOIN (SELECT doc_id, doc_title AS title FROM doc_contexts UNION ALL SELECT doc_id, law_title FROM base_laws) t ON t.doc_id = n.id),
sl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type, target, target_title NULLS FIRST, article NULLS FIRST) AS n FROM shown),
rl AS (SELECT doc_id, string_agg('[' || source || '] --(' || CASE type WHEN 'AMENDS' THEN 'sửa đổi' WHEN 'REPLACES' THEN 'thay thế' WHEN 'REPEALS' THEN 'bãi bỏ' WHEN 'BASED_ON' THEN 'căn cứ' WHEN 'GUIDES' THEN 'hướng dẫn' ELSE type END || ')--> [' || target || coalesce(' (' || nullif(target_title, '') || ')', '') || ']' || coalesce(' [' || article || ']', ''), chr(10) ORDER BY n) AS relations FROM sl WHERE n <= 50 GROUP BY doc_id),
en AS (SELECT DISTINCT doc_id, label, {_SQ('raw')} AS name FROM (SELECT doc_id, label, unnest(names) AS raw FROM (SELECT doc_id, unnest(map_keys(entities)) AS label, unnest(map_values(entities)) AS names FROM doc_contexts)) WHERE {_SQ('raw')} <> ''),
ek AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY label, name) AS n FROM en),
el AS (SELECT doc_id, string_agg(label || ': ' || names, chr(10) ORDER BY label) AS entities FROM (SELECT doc_id, label, string_agg(name, ', ' ORDER BY n) AS names FROM ek WHERE n <= 200 GROUP BY ALL) GROUP BY doc_id),
sub AS (SELECT doc_id, relations, entities FROM doc_contexts LEFT JOIN rl USING (doc_id) LEFT JOIN (SELECT doc_id, entities FROM el) e2 USING (doc_id))""".replace("doc_contexts LEFT JOIN rl", "(SELECT doc_id FROM doc_contexts) LEFT JOIN rl")
_ART = f"art AS (SELECT document_id AS doc_id, {_SQ('article_ref')} AS article, min((chunk_index, chunk_id, chunk_text))[3] AS article_text, count(*) AS chunks FROM (SELECT DISTINCT document_id, article_ref, chunk_index, chunk_id, chunk_text FROM chunks) WHERE {_SQ('article_ref')} <> '' GROUP BY ALL)"
SQL = {
    "subgraph_text": f"WITH {_g._BASE}, {_SUB} SELECT * FROM sub WHERE relations IS NOT NULL OR entities IS NOT NULL",
    "graph_enriched_chunks": f"WITH {_g._BASE}, {_SUB} SELECT chunk_id, concat_ws(chr(10), chunk_text, '[THỰC THỂ]: ' || replace(entities, chr(10), '; '), '[QUAN HỆ VĂN BẢN]: ' || replace(relations, chr(10), '; ')) AS text FROM (SELECT DISTINCT chunk_id, document_id, chunk_text FROM chunks) c LEFT JOIN sub ON sub.doc_id = c.document_id",
    "sibling_chunks": f"""WITH {_g._BASE}, {_SUB}, u AS (SELECT label, name, count(*) AS uses FROM en GROUP BY ALL HAVING count(*) BETWEEN 2 AND 29)
      SELECT doc_id, sibling, label, name, uses, CAST(place AS INTEGER) AS place FROM (SELECT a.doc_id, b.doc_id AS sibling, label, name, uses, row_number() OVER (PARTITION BY a.doc_id ORDER BY uses, label, name, b.doc_id) AS place FROM en a JOIN u USING (label, name) JOIN en b USING (label, name) WHERE a.doc_id <> b.doc_id) WHERE place <= 20""",
    "document_articles": f"WITH {_ART} SELECT doc_id, doc_number, doc_title, article, article_text, chunks FROM art JOIN doc_contexts USING (doc_id)",
    "article_by_keyword": f"WITH {_ART} SELECT doc_id, doc_number, article, article_text FROM art JOIN doc_contexts USING (doc_id) WHERE contains(lower(article), 'điều 5') AND contains(lower(doc_number), 'ubnd')",
    "sector_documents": f"WITH s AS (SELECT DISTINCT record_id AS doc_id, {_SQ('val')} AS sector FROM ({_g._problems._P2}) WHERE field_name = 'sectors_str') SELECT doc_id, sector, doc_title, doc_number FROM s JOIN doc_contexts USING (doc_id) WHERE contains(lower(doc_title), 'bến') OR contains(lower(doc_number), 'ubnd')",
    "hit_nodes": f"WITH h AS ({_r.SQL['emergency_scroll']}) SELECT item_id, chunk_id, c.document_id, doc_title AS parent_title, doc_number AS parent_number, final_effective_date AS effective_date, issuing_auth AS authority FROM h JOIN (SELECT DISTINCT chunk_id, document_id FROM chunks) c USING (chunk_id) LEFT JOIN doc_contexts d ON d.doc_id = c.document_id",
    "expanded_hits": f"""WITH h AS (SELECT DISTINCT item_id, chunk_id FROM ({_r.SQL['emergency_scroll']})), u AS (SELECT DISTINCT chunk_id, document_id, article_ref, chunk_index, chunk_text, coalesce(is_appendix, false) AS app FROM chunks), o AS (SELECT * FROM h JOIN u USING (chunk_id)),
      f AS (SELECT *, row_number() OVER (PARTITION BY document_id, article_ref ORDER BY chunk_index, chunk_id) AS n FROM u WHERE article_ref <> ''), a AS (SELECT document_id, article_ref, string_agg(chunk_text, chr(10) ORDER BY n) AS context, count(*) AS pieces FROM f WHERE n <= 8 GROUP BY ALL)
      SELECT item_id, chunk_id, context, pieces FROM o JOIN a USING (document_id, article_ref) WHERE NOT app
      UNION ALL SELECT o.item_id, o.chunk_id, string_agg(u.chunk_text, chr(10) ORDER BY u.chunk_index, u.chunk_id), count(*) FROM o JOIN u ON u.document_id = o.document_id AND abs(u.chunk_index - o.chunk_index) <= 1 AND u.article_ref IS NOT DISTINCT FROM o.article_ref WHERE o.app GROUP BY ALL""",
    "unlinked_bases": f"""WITH b AS (SELECT DISTINCT doc_id, {_K('x.doc_number')} AS key, x.doc_title AS title FROM (SELECT doc_id, unnest(basis_refs) AS x FROM doc_contexts)), l AS (SELECT doc_id, {_K('x.target_doc')} AS key FROM (SELECT doc_id, unnest(ontology_rels) AS x FROM doc_contexts) WHERE x.edge_label = 'BASED_ON')
      SELECT * FROM b WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = b.doc_id AND l.key = b.key)""",
    "leaf_ancestors": f"""WITH {_g._PARTS} SELECT chunk_id AS leaf, document_id AS doc_id, 1 AS hops FROM parts WHERE a IS NULL UNION SELECT chunk_id, document_id, 2 FROM parts LEFT JOIN leaves USING (document_id, a) WHERE a IS NOT NULL AND (t OR chunk_id IS DISTINCT FROM leaf)""",
    "node_counts": f"""WITH {_g._PARTS}, e AS ({_g._EDGES}) SELECT CASE type WHEN 'ISSUED_BY' THEN 'Authority' WHEN 'SIGNED_BY' THEN 'Signer' WHEN 'HAS_TYPE' THEN 'LegalType' WHEN 'HAS_SECTOR' THEN 'Sector' WHEN 'HAS_ARTICLE' THEN 'Article' WHEN 'HAS_ENTITY' THEN 'Entity' END AS label, count(DISTINCT dst) AS nodes FROM e
      WHERE type IN ('ISSUED_BY', 'SIGNED_BY', 'HAS_TYPE', 'HAS_SECTOR', 'HAS_ARTICLE', 'HAS_ENTITY') AND dst IS NOT NULL GROUP BY 1 UNION ALL SELECT 'Document', count(DISTINCT doc_id) FROM doc_contexts UNION ALL SELECT 'Chunk', count(DISTINCT src) FROM e WHERE type = 'PART_OF'""",
    "node_relation_counts": """SELECT CASE x.edge_label WHEN 'AMENDS' THEN 'AMENDED_BY' WHEN 'REPEALS' THEN 'REPEALED_BY' WHEN 'REPLACES' THEN 'REPLACED_BY' WHEN 'GUIDES' THEN 'GUIDED_BY' WHEN 'BASED_ON' THEN 'BASED_ON' ELSE 'RELATED_TO' END AS relation, count(*) AS n, count(DISTINCT x.source_doc) AS sources, count(DISTINCT x.target_doc) AS targets
      FROM (SELECT unnest(ontology_rels) AS x FROM doc_contexts) GROUP BY 1""",
    "question_sectors": """WITH s AS (SELECT DISTINCT canon_name FROM canon_names WHERE entry_kind = 'sector' AND canon_name IS NOT NULL), h AS (SELECT item_id, canon_name, row_number() OVER (PARTITION BY item_id ORDER BY canon_name) AS n FROM (SELECT item_id, question FROM eval_items UNION ALL SELECT -1, 'Chính sách đất đai, thủy lợi, môi trường và giáo dục nghề?') JOIN s ON contains(lower(question), lower(canon_name)))
      SELECT item_id, canon_name AS sector FROM h WHERE n <= 3""",
    "uploaded_hints": r"""WITH f AS (SELECT document_id, chunk_text, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM (SELECT DISTINCT document_id, chunk_index, chunk_id, chunk_text FROM chunks) WHERE chunk_text IS NOT NULL), t AS (SELECT document_id, string_agg(chunk_text, chr(10) ORDER BY n) AS s FROM f WHERE n <= 3 GROUP BY 1)
      SELECT document_id, nullif(regexp_extract(s, '\d+/\d{4}/[A-Za-zĐđ\-]+'), '') AS number, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '(?:Điều|Khoản|Mục|Chương|Phụ lục)\s+\d+[a-z]?')))[1:3], ', ') AS headings FROM t""",
    "chunk_batches": """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1) // 12 AS batch FROM (SELECT DISTINCT document_id, chunk_index, chunk_id FROM chunks)) SELECT document_id, batch, count(*) AS chunks, min(chunk_index) AS first, max(chunk_index) AS last FROM p GROUP BY ALL""",
    "sanitised_labels": """SELECT 'label' AS kind, raw, CASE raw WHEN 'Article' THEN 'LegalArticle' WHEN 'Authority' THEN 'Organization' WHEN 'Signer' THEN 'Person' ELSE regexp_replace(raw, '[^a-zA-Z0-9_]', '', 'g') END AS name FROM (SELECT DISTINCT unnest(map_keys(entities)) AS raw FROM doc_contexts) WHERE raw NOT IN ('Article', 'Signer')
      UNION ALL SELECT * FROM (VALUES ('label', 'Article', 'LegalArticle'), ('label', '1st Kind!', 'E_1stKind'), ('label', 'Signer', 'Person'), ('label', '!!', 'Entity'), ('relation', 'signed', 'SIGNED_BY'), ('relation', ' is-part  of ', 'IS_PART_OF'), ('relation', 'assigns', 'ASSIGNED_BY'), ('relation', '', 'RELATED_TO'), ('relation', '__a__', 'A'))""",
    "session_entities": r"""SELECT DISTINCT lower(trim(session_id, ' ')) AS session_id, unnest(list_distinct(regexp_extract_all(content, '\d+/\d{4}/[A-ZĐ][A-Z0-9Đ\-]*') || regexp_extract_all(content, 'Bộ\s+\p{Lu}\p{L}*(?:\s+\p{Lu}\p{L}*)*'))[1:5]) AS entity FROM messages WHERE session_id IS NOT NULL""",
}
