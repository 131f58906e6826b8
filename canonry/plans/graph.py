"""Graph queries over the citation graph of documents, chunks and base laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.functions.text import known, letters_digits, squeeze
from canonry.operators import graph as G
from canonry.operators.ordered import Ordered
from canonry.sources.tables import derived, table

_REAL = ("N/A", "unknown", "nan")


def _key(name: str):
    return letters_digits(known(name, *_REAL))


#: The tables that citations are made of.
_CITING = ["doc_contexts", "base_laws"]


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """One document per number: the lowest id, documents before base laws; `key`, `id`, `number`."""
    return derived(spark, folder, "numbers", _CITING, lambda: _numbers(spark, folder))


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_contexts").select(_key("doc_number").alias("key"), F.col("doc_id").alias("id"), F.col("doc_number").alias("number"), F.lit(0).alias("t"))
    laws = table(spark, folder, "base_laws").select(_key("doc_number").alias("key"), F.col("doc_id").alias("id"), F.col("doc_number").alias("number"), F.lit(1).alias("t"))
    every = docs.unionByName(laws).where(F.col("key").isNotNull())
    return every.groupBy("key").agg(F.min_by(F.struct("id", "number"), F.struct("t", "id")).alias("r")).select("key", "r.id", "r.number")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """`src` document, `type`, `dst` key of the cited number; distinct."""
    return derived(spark, folder, "citations", _CITING[:1], lambda: _citations(spark, folder))


def _citations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_contexts")
    basis = docs.select(F.col("doc_id").alias("src"), F.lit("BASED_ON").alias("type"), F.explode("basis_refs.doc_number").alias("raw"))
    rels = docs.select(F.col("doc_id").alias("src"), F.explode("ontology_rels").alias("x")).select("src", F.col("x.edge_label").alias("type"), F.col("x.target_doc").alias("raw"))
    return basis.unionByName(rels).select("src", "type", _key("raw").alias("dst")).where(F.col("dst").isNotNull()).distinct()


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Citations whose number is that of a document: `src`, `type`, `dst` ids."""
    known_numbers = lambda: numbers(spark, folder).select(F.col("key").alias("dst"), "id")
    return derived(spark, folder, "links", _CITING, lambda: citations(spark, folder).join(known_numbers(), "dst").select("src", "type", F.col("id").alias("dst")).distinct())


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changing relations to numbers that a document has: `by_id`, `type`, `document_id`, and the `article` they name, null where none; distinct."""
    rels = table(spark, folder, "doc_contexts").select(F.col("doc_id").alias("by_id"), F.explode("ontology_rels").alias("x")).where(F.col("x.edge_label").isin("AMENDS", "REPLACES", "REPEALS"))
    named = rels.select("by_id", F.col("x.edge_label").alias("type"), squeeze(known("x.target_article", *_REAL)).alias("article"), _key("x.target_doc").alias("key"))
    return named.join(numbers(spark, folder), "key").select("by_id", "type", F.col("id").alias("document_id"), "article").distinct()


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All edges of the graph: those of documents, their sectors, the tree of articles and chunks, and the articles that relations name."""
    return derived(spark, folder, "graph", [*_CITING, "chunks"], lambda: _graph_edges(spark, folder), "type").select("src", "type", "dst")


def _graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "doc_contexts")
    rels = docs.select(F.explode("ontology_rels").alias("x")).where(F.length("x.target_article") > 0).select(squeeze(known("x.target_doc", "N/A", "nan")).alias("number"), F.col("x.target_article").alias("article")).distinct()
    named = rels.withColumn("key", _key("number")).join(numbers(spark, folder).select("key", "id"), "key", "left")
    tree = G.tree_edges(table(spark, folder, "chunks")).unionByName(G.phantom_edges(named))
    return G.document_edges(docs).unionByName(G.sector_edges(docs)).unionByName(tree).distinct()


def edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by type."""
    return graph_edges(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def ghost_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Cited numbers that no document has."""
    return G.ghosts(citations(spark, folder), numbers(spark, folder).select(F.col("key").alias("id")), ["BASED_ON", "AMENDS", "REPEALS", "REPLACES", "GUIDES", "APPLIES_TO"])


def canonical_references(spark: SparkSession, folder: str) -> DataFrame:
    """Every cited number in the spelling of the document that has it."""
    rows = table(spark, folder, "doc_contexts").select("doc_id", F.explode("basis_refs.doc_number").alias("raw")).withColumn("key", _key("raw"))
    joined = rows.join(numbers(spark, folder), "key", "left")
    return joined.select("doc_id", "raw", F.coalesce("number", "raw").alias("number"), F.col("number").isNotNull().alias("known")).distinct()


def closure_two(spark: SparkSession, folder: str) -> DataFrame:
    """Documents within two citations of the documents of one year."""
    seeds = table(spark, folder, "doc_contexts").where(F.col("doc_year") == "2019").select(F.col("doc_id").alias("id"))
    return G.closure(seeds, links(spark, folder), 2)


def leaf_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of each article is its node, the others are leaves."""
    rows = table(spark, folder, "chunks").select("document_id", "article_ref", "chunk_index", "chunk_id").distinct()
    return G.levels(rows, "document_id", "article_ref", ["chunk_index", "chunk_id"]).select("chunk_id", "document_id", "level")


def document_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of every document with the number of chunks, tables and their places."""
    rows = table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    return rows.groupBy("document_id", "chapter_ref", "article_ref").agg(F.count("*").alias("chunks"), F.count_if("is_table").alias("tables"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))


def admin_card(spark: SparkSession, folder: str) -> DataFrame:
    """Authority, signer, type, and numbers of chunks and citations of every document."""
    docs = table(spark, folder, "doc_contexts").select("doc_id", "doc_number", squeeze(known("issuing_auth", *_REAL)).alias("authority"), squeeze(known("signer_name", *_REAL)).alias("signer"), "legal_type_meta")
    parts = table(spark, folder, "chunks").groupBy(F.col("document_id").alias("doc_id")).agg(F.countDistinct("chunk_id").alias("chunks"))
    cited = citations(spark, folder).groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("cites"))
    joined = docs.join(parts, "doc_id", "left").join(cited, "doc_id", "left")
    return joined.select("doc_id", "doc_number", "authority", "signer", "legal_type_meta", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("cites", F.lit(0)).alias("cites"))


def time_travel(spark: SparkSession, folder: str) -> DataFrame:
    """Who amends, replaces or repeals each document; documents without such a citer too."""
    later = links(spark, folder).where(F.col("type").isin("AMENDS", "REPLACES", "REPEALS")).select(F.col("dst").alias("doc_id"), F.col("src").alias("by_id"), "type")
    return table(spark, folder, "doc_contexts").select("doc_id").join(later, "doc_id", "left")


def conflicts_by_article(spark: SparkSession, folder: str) -> DataFrame:
    """Changing relations that name an article of a document whose chunks have that article."""
    rels = table(spark, folder, "doc_contexts").select(F.col("doc_id").alias("by_id"), F.explode("ontology_rels").alias("x")).where(F.col("x.edge_label").isin("AMENDS", "REPLACES", "REPEALS") & (F.length("x.target_article") > 0))
    named = rels.select("by_id", F.col("x.edge_label").alias("type"), F.col("x.target_article").alias("article"), _key("x.target_doc").alias("key"))
    targets = named.join(numbers(spark, folder), "key").select("by_id", "type", "article", F.col("id").alias("document_id")).distinct()
    parts = table(spark, folder, "chunks").select("document_id", "article_ref", "chunk_id").distinct()
    # names meet names first: a document has far fewer articles than chunks and relations
    met = parts.select("document_id", "article_ref").distinct().join(targets.select("document_id", "article").distinct(), "document_id").where(F.contains(F.lower("article_ref"), F.lower("article")))
    return met.join(targets, ["document_id", "article"]).join(parts, ["document_id", "article_ref"]).select("by_id", "type", "document_id", "chunk_id").distinct()


def chain_two(spark: SparkSession, folder: str) -> DataFrame:
    """Changing citations that others follow, how many do, and the least of them; the chains of a hub aren't written out."""
    change = links(spark, folder).where(F.col("type").isin("AMENDS", "REPLACES", "REPEALS"))
    return G.chains(change).select("first", "second", "two", "onward")


def chains_two_three(spark: SparkSession, folder: str) -> DataFrame:
    """Amending and replacing citations with the number of chains of two and three that begin with each."""
    return G.chains(links(spark, folder).where(F.col("type").isin("AMENDS", "REPLACES"))).select("first", "second", "two", "three")


def reverse_basis(spark: SparkSession, folder: str) -> DataFrame:
    """Documents based on a law that have another type than it; by law."""
    laws = table(spark, folder, "base_laws").select(F.col("doc_id").alias("dst"), "law_title")
    based = links(spark, folder).where(F.col("type") == "BASED_ON").join(laws, "dst")
    outside = based.join(table(spark, folder, "doc_contexts").where(F.col("legal_type_meta") == "Luật").select(F.col("doc_id").alias("src")), "src", "left_anti")
    return outside.groupBy(F.col("dst").alias("law_id"), "law_title").agg(F.countDistinct("src").alias("documents"))


def one_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices next to the documents of one year, by type of edge."""
    seeds = table(spark, folder, "doc_contexts").where(F.col("doc_year") == "2019").select(F.col("doc_id").alias("id"))
    return G.histogram(links(spark, folder), seeds, 1)


def two_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices at two steps of the documents of one year, by type of the last edge."""
    seeds = table(spark, folder, "doc_contexts").where(F.col("doc_year") == "2019").select(F.col("doc_id").alias("id"))
    return G.histogram(links(spark, folder), seeds, 2)


def _ends(edges: DataFrame) -> tuple[str | None, str | None]:
    """The first citing document and the most cited base law."""
    goal = edges.where(F.length("dst") <= 4).groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select("dst")
    row = edges.agg(F.min("src").alias("start")).select("start", goal.scalar().alias("goal")).first()
    return row.start, row.goal


def path_length(spark: SparkSession, folder: str) -> DataFrame:
    """Steps between the first citing document and the most cited base law, however many."""
    edges = links(spark, folder)
    return G.shortest_path(edges, *_ends(edges))


def path_two(spark: SparkSession, folder: str) -> DataFrame:
    """The same where there are at most two."""
    edges = links(spark, folder)
    return G.shortest_path(edges, *_ends(edges), 2)


def impact_three(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents depend on one base law within three citations, by distance."""
    edges = links(spark, folder).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = table(spark, folder, "base_laws").where(F.col("doc_id") == "1001").select(F.col("doc_id").alias("id"))
    return G.closure(seeds, edges, 3).groupBy("depth").agg(F.count("*").alias("documents"))


def rare_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share entities used in fewer than 30 documents."""
    names = table(spark, folder, "doc_contexts").select("doc_id", F.explode("entities").alias("label", "names")).select("doc_id", F.explode("names").alias("raw")).select("doc_id", squeeze("raw").alias("name")).where(F.col("name") != "")
    return G.rare_siblings(names, "doc_id", "name", 30)


def same_authority(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three other documents of the same authority for every document: the next by id, found by windows that split hot authorities, not by pairs."""
    rows = table(spark, folder, "doc_contexts").select("doc_id", squeeze(known("issuing_auth", *_REAL)).alias("authority"), F.col("doc_id").try_cast("double").alias("at")).where(F.col("authority").isNotNull())
    ordered = Ordered(rows, ["authority"], F.col("at"), [F.col("at"), F.col("doc_id")]).lead("doc_id", "o1").lead("o1", "o2").lead("o2", "o3")
    ahead = F.array(*[F.struct(F.col(f"o{i}").alias("other"), F.lit(i).alias("place")) for i in (1, 2, 3)])
    return ordered.rows().select("doc_id", "authority", F.inline(ahead)).where(F.col("other").isNotNull())


def same_sector(spark: SparkSession, folder: str) -> DataFrame:
    """Three pairs of another document and a sector shared with it for each document, or all if fewer: the next by id first, then those before it."""
    rows = G.sector_edges(table(spark, folder, "doc_contexts")).select(F.col("src").alias("doc_id"), F.col("dst").alias("sector"), F.col("src").try_cast("double").alias("at"))
    ordered = Ordered(rows, ["sector"], F.col("at"), [F.col("at"), F.col("doc_id")]).lead("doc_id", "o1").lead("o1", "o2").lead("o2", "o3").lag("doc_id", "o4").lag("o4", "o5").lag("o5", "o6")
    near = F.array(*[F.struct(F.col(f"o{i}").alias("other"), F.lit(i).alias("place")) for i in range(1, 7)])
    found = ordered.rows().select("doc_id", "sector", F.inline(near)).where(F.col("other").isNotNull())
    return found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "sector"))).where(F.col("n") <= 3).select("doc_id", "sector", "other", F.col("n").alias("place"))


def article_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """For every chunk the number of other chunks of its article and the first of them."""
    rows = table(spark, folder, "chunks").where(F.col("article_ref") != "").select("document_id", "article_ref", "chunk_id").distinct()
    per = rows.groupBy("document_id", "article_ref").agg((F.count("*") - 1).alias("others"), F.min("chunk_id").alias("first"))
    return rows.join(per, ["document_id", "article_ref"]).select("chunk_id", "document_id", "others", "first")


def keyword_union(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, laws and articles whose name has a keyword."""
    word = "bến"
    docs = table(spark, folder, "doc_contexts").where(F.contains(F.lower("doc_title"), F.lit(word))).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("doc_title").alias("name"))
    laws = table(spark, folder, "base_laws").where(F.contains(F.lower("law_title"), F.lit(word))).select(F.lit("law").alias("kind"), F.col("doc_id").alias("id"), F.col("law_title").alias("name"))
    names = table(spark, folder, "canon_names").where(F.contains(F.lower("canon_name"), F.lit(word))).select(F.lit("name").alias("kind"), F.col("canon_id").cast("string").alias("id"), F.col("canon_name").alias("name"))
    return docs.union(laws).union(names).distinct()


def cross_authority(spark: SparkSession, folder: str) -> DataFrame:
    """Citations between documents of different authorities, counted by pair of authorities."""
    docs = table(spark, folder, "doc_contexts").select(F.col("doc_id"), squeeze(known("issuing_auth", *_REAL)).alias("authority")).where(F.col("authority").isNotNull())
    pairs = links(spark, folder).join(docs.select(F.col("doc_id").alias("src"), F.col("authority").alias("by")), "src").join(docs.select(F.col("doc_id").alias("dst"), F.col("authority").alias("of")), "dst")
    return pairs.where(F.col("by") != F.col("of")).groupBy("by", "of").agg(F.count("*").alias("n"))


def enriched_laws(spark: SparkSession, folder: str) -> DataFrame:
    """Cited numbers with the title of their document or law where one is known, and how often they are cited."""
    docs = table(spark, folder, "doc_contexts").select(_key("doc_number").alias("dst"), F.col("doc_title").alias("title"), F.lit(0).alias("t"), F.col("doc_id").alias("i"))
    laws = table(spark, folder, "base_laws").select(_key("doc_number").alias("dst"), F.col("law_title").alias("title"), F.lit(1).alias("t"), F.col("doc_id").alias("i"))
    titles = docs.unionByName(laws).where(F.col("dst").isNotNull()).groupBy("dst").agg(F.min_by("title", F.struct("t", "i")).alias("title"))
    cited = citations(spark, folder).groupBy("dst").agg(F.count("*").alias("cited"))
    return cited.join(titles, "dst", "left").select(F.col("dst").alias("number_key"), F.coalesce("title", F.concat(F.lit("REF_"), "dst")).alias("title"), "cited")


QUERIES = {
    f.__name__: f for f in (
        graph_edges, edge_counts, ghost_documents, canonical_references, closure_two, leaf_levels, document_tree, admin_card, time_travel, conflicts_by_article, chain_two, chains_two_three,
        reverse_basis, one_hop, two_hop, path_length, path_two, impact_three, rare_siblings, same_authority, same_sector, article_siblings, keyword_union, cross_authority, enriched_laws,
    )
}

from canonry.plans import problems as _problems  # noqa: E402

_NO = "('', 'n/a', 'unknown', 'nan')"


def _k(x: str) -> str:
    return f"CASE WHEN lower({_sq(x)}) NOT IN {_NO} THEN nullif(regexp_replace(replace(lower(strip_accents({x})), 'đ', 'd'), '[^\\pL\\pN]+', '', 'g'), '') END"


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x{{200B}}\\x{{FEFF}}]+', ' ', 'g'))"


def _real(x: str) -> str:
    return f"CASE WHEN lower({_sq(x)}) NOT IN {_NO} THEN {_sq(x)} END"


def _real2(x: str) -> str:
    return f"CASE WHEN lower({_sq(x)}) NOT IN ('', 'n/a', 'nan') THEN {_sq(x)} END"


_BASE = f"""
nums AS (SELECT key, arg_min(id, (t, id)) AS id, arg_min(number, (t, id)) AS number FROM (SELECT {_k('doc_number')} AS key, doc_id AS id, doc_number AS number, 0 AS t FROM doc_contexts UNION ALL SELECT {_k('doc_number')}, doc_id, doc_number, 1 FROM base_laws) WHERE key IS NOT NULL GROUP BY key),
cites AS (SELECT DISTINCT src, type, dst FROM (SELECT src, type, {_k('raw')} AS dst FROM (SELECT doc_id AS src, 'BASED_ON' AS type, unnest(list_transform(basis_refs, lambda x: x.doc_number)) AS raw FROM doc_contexts
  UNION ALL SELECT src, x.edge_label, x.target_doc FROM (SELECT doc_id AS src, unnest(ontology_rels) AS x FROM doc_contexts))) WHERE dst IS NOT NULL),
links AS (SELECT DISTINCT src, type, id AS dst FROM cites JOIN nums ON nums.key = cites.dst)"""
_EDGES = f"""
SELECT doc_id AS src, 'ISSUED_BY' AS type, {_real2('issuing_auth')} AS dst FROM doc_contexts UNION SELECT doc_id, 'SIGNED_BY', {_real2('signer_name')} FROM doc_contexts UNION SELECT doc_id, 'HAS_TYPE', {_real2('legal_type_meta')} FROM doc_contexts
UNION SELECT doc_id, 'BASED_ON', {_real2('n')} FROM (SELECT doc_id, unnest(list_transform(basis_refs, lambda x: x.doc_number)) AS n FROM doc_contexts)
UNION SELECT doc_id, x.edge_label, {_real2('x.target_doc')} FROM (SELECT doc_id, unnest(ontology_rels) AS x FROM doc_contexts) WHERE x.edge_label IS NOT NULL
UNION SELECT doc_id, 'HAS_ENTITY', {_real2('n')} FROM (SELECT doc_id, unnest(flatten(map_values(entities))) AS n FROM doc_contexts)
UNION SELECT record_id, 'HAS_SECTOR', {_sq('val')} FROM ({_problems._P2}) WHERE field_name = 'sectors_str'
UNION SELECT document_id, 'HAS_ARTICLE', document_id || '_' || a FROM parts WHERE a IS NOT NULL
UNION SELECT chunk_id, 'PART_OF', p.document_id || '_' || a FROM parts p LEFT JOIN leaves l USING (document_id, a) WHERE a IS NOT NULL AND (t OR chunk_id IS DISTINCT FROM leaf)
UNION SELECT chunk_id, 'BELONGS_TO', document_id FROM parts WHERE a IS NULL
UNION SELECT owner || '_' || a, 'BELONGS_TO', owner FROM (SELECT coalesce(id, 'REF_' || n) AS owner, a FROM
  (SELECT {_real2('x.target_doc')} AS n, nullif({_sq('x.target_article')}, '') AS a, {_k('x.target_doc')} AS key FROM (SELECT unnest(ontology_rels) AS x FROM doc_contexts)) LEFT JOIN nums USING (key)) WHERE a IS NOT NULL AND owner IS NOT NULL"""
_PARTS = f"""{_BASE}, parts AS (SELECT DISTINCT document_id, chunk_id, chunk_index, coalesce(is_table, false) AS t, nullif({_sq('article_ref')}, '') AS a FROM chunks),
leaves AS (SELECT document_id, a, arg_min(chunk_id, (chunk_index, chunk_id)) AS leaf FROM parts WHERE a IS NOT NULL AND NOT t GROUP BY ALL)"""
_CHANGE = "change AS (SELECT DISTINCT src, dst FROM links WHERE type IN ('AMENDS', 'REPLACES', 'REPEALS'))"
_BOTH = "both_ways AS (SELECT src, type, dst FROM links UNION SELECT dst, type, src FROM links)"
SQL = {
    "graph_edges": f"WITH {_PARTS} SELECT * FROM ({_EDGES}) WHERE dst IS NOT NULL",
    "edge_counts": f"WITH {_PARTS} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ({_EDGES}) WHERE dst IS NOT NULL GROUP BY type",
    "ghost_documents": f"WITH {_BASE} SELECT dst AS id, count(*) AS refs FROM cites WHERE type IN ('BASED_ON', 'AMENDS', 'REPEALS', 'REPLACES', 'GUIDES', 'APPLIES_TO') AND dst NOT IN (SELECT key FROM nums) GROUP BY dst",
    "canonical_references": f"WITH {_BASE}, r AS (SELECT doc_id, raw, {_k('raw')} AS key FROM (SELECT doc_id, unnest(list_transform(basis_refs, lambda x: x.doc_number)) AS raw FROM doc_contexts)) SELECT DISTINCT doc_id, raw, coalesce(number, raw) AS number, number IS NOT NULL AS known FROM r LEFT JOIN nums USING (key)",
    "closure_two": f"WITH RECURSIVE {_BASE}, c(id, depth) AS (SELECT doc_id, 0 FROM doc_contexts WHERE doc_year = '2019' UNION SELECT l.dst, c.depth + 1 FROM c JOIN links l ON l.src = c.id WHERE c.depth < 2) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY id",
    "leaf_levels": "SELECT chunk_id, document_id, CASE WHEN row_number() OVER (PARTITION BY document_id, article_ref ORDER BY chunk_index, chunk_id) = 1 THEN 'article' ELSE 'leaf' END AS level FROM (SELECT DISTINCT document_id, article_ref, chunk_index, chunk_id FROM chunks)",
    "document_tree": "SELECT document_id, chapter_ref, article_ref, count(*) AS chunks, count(*) FILTER (is_table) AS tables, min(chunk_index) AS first, max(chunk_index) AS last FROM (SELECT DISTINCT chunk_id, document_id, chapter_ref, article_ref, is_table, chunk_index FROM chunks) GROUP BY ALL",
    "admin_card": f"""WITH {_BASE} SELECT d.doc_id, d.doc_number, {_real('d.issuing_auth')} AS authority, {_real('d.signer_name')} AS signer, d.legal_type_meta, coalesce(p.n, 0) AS chunks, coalesce(c.n, 0) AS cites FROM doc_contexts d
      LEFT JOIN (SELECT document_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY 1) p ON p.document_id = d.doc_id LEFT JOIN (SELECT src, count(*) AS n FROM cites GROUP BY 1) c ON c.src = d.doc_id""",
    "time_travel": f"WITH {_BASE} SELECT d.doc_id, l.src AS by_id, l.type FROM doc_contexts d LEFT JOIN (SELECT * FROM links WHERE type IN ('AMENDS', 'REPLACES', 'REPEALS')) l ON l.dst = d.doc_id",
    "conflicts_by_article": f"""WITH {_BASE}, r AS (SELECT by_id, x.edge_label AS type, x.target_article AS article, {_k('x.target_doc')} AS key FROM (SELECT doc_id AS by_id, unnest(ontology_rels) AS x FROM doc_contexts) WHERE x.edge_label IN ('AMENDS', 'REPLACES', 'REPEALS') AND length(x.target_article) > 0)
      SELECT DISTINCT by_id, type, document_id, chunk_id FROM r JOIN nums USING (key) JOIN chunks ON chunks.document_id = nums.id AND contains(lower(article_ref), lower(article))""",
    "chain_two": f"WITH {_BASE}, {_CHANGE} SELECT a.src AS first, a.dst AS second, count(*) AS two, min(b.dst) AS onward FROM change a JOIN change b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst GROUP BY ALL",
    "chains_two_three": f"""WITH {_BASE}, change AS (SELECT DISTINCT src, dst FROM links WHERE type IN ('AMENDS', 'REPLACES') AND src <> dst),
      t AS (SELECT a.src AS first, a.dst AS second, count(*) AS two FROM change a JOIN change b ON a.dst = b.src GROUP BY ALL),
      u AS (SELECT a.src AS first, a.dst AS second, count(*) AS three FROM change a JOIN change b ON a.dst = b.src JOIN change c ON b.dst = c.src WHERE NOT (c.src = a.src AND c.dst = a.dst) GROUP BY ALL)
      SELECT first, second, two, coalesce(three, 0) AS three FROM t LEFT JOIN u USING (first, second)""",
    "reverse_basis": f"WITH {_BASE} SELECT b.doc_id AS law_id, b.law_title, count(DISTINCT l.src) AS documents FROM links l JOIN base_laws b ON b.doc_id = l.dst WHERE l.type = 'BASED_ON' AND l.src NOT IN (SELECT doc_id FROM doc_contexts WHERE legal_type_meta = 'Luật') GROUP BY ALL",
    "one_hop": f"WITH {_BASE}, {_BOTH} SELECT type, count(DISTINCT dst) AS vertices FROM both_ways WHERE src IN (SELECT doc_id FROM doc_contexts WHERE doc_year = '2019') GROUP BY type",
    "two_hop": f"WITH {_BASE}, {_BOTH} SELECT type, count(DISTINCT dst) AS vertices FROM both_ways WHERE src IN (SELECT dst FROM both_ways WHERE src IN (SELECT doc_id FROM doc_contexts WHERE doc_year = '2019')) GROUP BY type",
    **{name: f"""WITH RECURSIVE {_BASE}, {_BOTH}, s AS (SELECT min(src) AS start FROM links), g AS (SELECT dst AS goal FROM links WHERE length(dst) <= 4 GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
      c(id, steps) AS (SELECT start, 0 FROM s UNION SELECT b.dst, c.steps + 1 FROM c JOIN both_ways b ON b.src = c.id WHERE c.steps < {most}) SELECT id, CAST(min(steps) AS INTEGER) AS steps FROM c WHERE id = (SELECT goal FROM g) GROUP BY id""" for name, most in (("path_length", 12), ("path_two", 2))},
    "impact_three": f"WITH RECURSIVE {_BASE}, c(id, depth) AS (SELECT doc_id, 0 FROM base_laws WHERE doc_id = '1001' UNION SELECT l.src, c.depth + 1 FROM c JOIN links l ON l.dst = c.id WHERE c.depth < 3) SELECT depth, count(*) AS documents FROM (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY id) GROUP BY depth",
    "rare_siblings": f"""WITH u AS (SELECT DISTINCT doc_id, {_sq('n')} AS name FROM (SELECT doc_id, unnest(flatten(map_values(entities))) AS n FROM doc_contexts) WHERE {_sq('n')} <> ''), f AS (SELECT * FROM u WHERE name IN (SELECT name FROM u GROUP BY name HAVING count(*) BETWEEN 2 AND 29))
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM f x JOIN f y USING (name) WHERE x.doc_id < y.doc_id GROUP BY ALL""",
    "same_authority": f"""WITH r AS (SELECT doc_id, {_real('issuing_auth')} AS authority FROM doc_contexts), n AS (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY TRY_CAST(doc_id AS DOUBLE) NULLS FIRST, doc_id) AS p FROM r WHERE authority IS NOT NULL)
      SELECT a.doc_id, a.authority, b.doc_id AS other, CAST(b.p - a.p AS INTEGER) AS place FROM n a JOIN n b ON a.authority = b.authority AND b.p - a.p BETWEEN 1 AND 3""",
    "same_sector": f"""WITH s AS (SELECT DISTINCT record_id AS doc_id, {_sq('val')} AS sector FROM ({_problems._P2}) WHERE field_name = 'sectors_str'), n AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY TRY_CAST(doc_id AS DOUBLE) NULLS FIRST, doc_id) AS p FROM s),
      o AS (SELECT a.doc_id, a.sector, b.doc_id AS other, CASE WHEN b.p > a.p THEN b.p - a.p ELSE 3 + a.p - b.p END AS far FROM n a JOIN n b ON a.sector = b.sector AND abs(b.p - a.p) BETWEEN 1 AND 3)
      SELECT doc_id, sector, other, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY far, sector) AS place FROM o) WHERE place <= 3""",
    "article_siblings": "SELECT chunk_id, document_id, count(*) OVER w - 1 AS others, min(chunk_id) OVER w AS first FROM (SELECT DISTINCT document_id, article_ref, chunk_id FROM chunks WHERE article_ref <> '') WINDOW w AS (PARTITION BY document_id, article_ref)",
    "keyword_union": "SELECT 'document' AS kind, doc_id AS id, doc_title AS name FROM doc_contexts WHERE contains(lower(doc_title), 'bến') UNION SELECT 'law', doc_id, law_title FROM base_laws WHERE contains(lower(law_title), 'bến') UNION SELECT 'name', CAST(canon_id AS VARCHAR), canon_name FROM canon_names WHERE contains(lower(canon_name), 'bến')",
    "cross_authority": f'WITH {_BASE}, d AS (SELECT doc_id, {_real("issuing_auth")} AS authority FROM doc_contexts) SELECT a.authority AS "by", b.authority AS "of", count(*) AS n FROM links l JOIN d a ON a.doc_id = l.src JOIN d b ON b.doc_id = l.dst WHERE a.authority <> b.authority GROUP BY ALL',
    "enriched_laws": f"""WITH {_BASE}, t AS (SELECT dst, arg_min(title, (t, i)) AS title FROM (SELECT {_k('doc_number')} AS dst, doc_title AS title, 0 AS t, doc_id AS i FROM doc_contexts UNION ALL SELECT {_k('doc_number')}, law_title, 1, doc_id FROM base_laws) WHERE dst IS NOT NULL GROUP BY dst)
      SELECT c.dst AS number_key, coalesce(title, 'REF_' || c.dst) AS title, cited FROM (SELECT dst, count(*) AS cited FROM cites GROUP BY dst) c LEFT JOIN t USING (dst)""",
}
