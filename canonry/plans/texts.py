"""Scalar functions, counts and duplicates over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.functions import legal as L
from canonry.functions import vocabulary as V
from canonry.functions.text import letters_digits
from canonry.operators.chunker import chunk_documents, citable, effective_date, table_of_contents
from canonry.operators.packed import split_packed
from canonry.operators.relations import case_insensitive_names, extract_relations, passive_chains
from canonry.sources.tables import table


def document_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Key, slug, type, year, status and rank of every document context."""
    rows = table(spark, folder, "doc_contexts")
    return rows.select(
        "doc_id", L.document_key("doc_number").alias("number_key"), L.slugify("doc_title").alias("slug"), L.document_type("doc_title").alias("doc_type"),
        L.extract_year("doc_number").alias("number_year"), L.document_status("doc_status").alias("status"), L.hierarchy_rank("legal_type_meta").alias("type_rank"),
    )


def signer_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Name and number of single signers."""
    rows = table(spark, folder, "corpus_metadata").select("row_id", L.signer("signers").alias("s"))
    return rows.select("row_id", F.col("s.name").alias("signer_name"), F.col("s.id").alias("signer_id"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Version 5 UUIDs of chunk ids."""
    return table(spark, folder, "chunks").select("chunk_id").distinct().select("chunk_id", L.uuid5("chunk_id").alias("point_id"))


def chunk_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Entity and relation hints and letter counts of all chunks."""
    rows = table(spark, folder, "chunks").select("chunk_id", "chunk_text").distinct()
    return rows.select("chunk_id", L.entity_hint("chunk_text").alias("entities"), L.relation_hint("chunk_text").alias("relations"), (L.letter_count("chunk_text") > 20).alias("meaningful"))


def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Structural kinds of all lines of all documents, counted by source."""
    lines = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("source", L.line_kind("line").alias("kind")).agg(F.count("*").alias("n"))


def intents(spark: SparkSession, folder: str) -> DataFrame:
    """Intent of every test question and user message."""
    asked = table(spark, folder, "eval_items").select(F.lit("eval").alias("origin"), F.col("item_id").alias("id"), F.col("question").alias("q"))
    said = table(spark, folder, "messages").where(F.lower(F.trim("role")).isin("user", "human")).select(F.lit("chat").alias("origin"), "id", F.col("content").alias("q"))
    return asked.unionByName(said).where(F.col("q").isNotNull()).groupBy("origin", L.intent("q").alias("intent")).agg(F.count("*").alias("n"))


def relation_names(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical names of all relation labels and of some that models give."""
    found = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels.edge_label").alias("raw")).distinct()
    more = spark.createDataFrame([(x,) for x in ("assigned to", "UPDATED_EVERY", "IS", "signs", "PAYS_FOR", "approving", "SHARES_BORDER", "", "references", "applies", "monitors", "produces")], "raw string")
    return found.unionByName(more).distinct().select("raw", L.relation_name("raw").alias("relation"), L.document_relation_name("raw").alias("doc_relation"))


def entity_types(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by canonical label."""
    names = table(spark, folder, "doc_contexts").select(F.explode("entities").alias("label", "names")).select(L.entity_type("label").alias("entity_type"), F.explode("names").alias("name"))
    return names.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def entity_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """One spelling of entity names that differ in case only."""
    names = table(spark, folder, "doc_contexts").select(F.explode("entities").alias("label", "names")).select("label", F.explode("names").alias("raw"))
    return case_insensitive_names(names, ["label"], "raw")


def cited_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """How often each number with a year is cited in the corpus, and in how many documents."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+/(?:19|20)[0-9]{2}/[A-ZĐ][A-Z0-9Đ-]*"), F.lit(0))).alias("number"))
    return rows.groupBy("number").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def message_references(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that messages refer to, from their JSON."""
    rows = table(spark, folder, "messages").select("id", L.json_values("references_json", "$[0].article_ref").alias("article_ref"))
    return rows.where(F.col("article_ref").isNotNull()).groupBy("article_ref").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Relations by label: all, across documents, and repeated pairs."""
    rels = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels").alias("x")).select("x.*")
    return rels.groupBy("edge_label").agg(F.count("*").alias("n"), F.count_if("is_cross_doc").alias("across"), (F.count("*") - F.countDistinct("source_doc", "target_doc")).alias("repeated"))


def number_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """How many document numbers occur once, twice, and so on."""
    per = table(spark, folder, "documents").where(F.col("document_number").isNotNull()).groupBy("document_number").agg(F.count("*").alias("times"))
    return per.groupBy("times").agg(F.count("*").alias("numbers"))


def most_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most repeated document numbers."""
    per = table(spark, folder, "documents").where(F.col("document_number").isNotNull()).groupBy("document_number").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "document_number").limit(20)


def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that occur more than once: first document, number of documents. Texts meet by SHA-256, not in full."""
    rows = table(spark, folder, "documents").where(F.length("text") > 0).groupBy(F.sha2("text", 256).alias("h"))
    return rows.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") > 1).select("first_id", "copies")


def type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by type: number, distinct authorities, and the first fifteen titles. The rank limit bounds what is gathered."""
    from pyspark.sql.window import Window

    rows = table(spark, folder, "doc_contexts").where(F.col("legal_type_meta").isNotNull())
    counts = rows.groupBy("legal_type_meta").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("issuing_auth").alias("authorities"))
    titles = rows.select("legal_type_meta", "doc_title").where(F.col("doc_title").isNotNull()).distinct()
    first = titles.withColumn("n", F.row_number().over(Window.partitionBy("legal_type_meta").orderBy("doc_title"))).where(F.col("n") <= 15)
    joined = first.groupBy("legal_type_meta").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_title"))), lambda x: x["doc_title"]), " | ").alias("titles"))
    return counts.join(joined, "legal_type_meta", "left")


def phantom_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by whether their document is known, active or withdrawn."""
    chunks, docs = table(spark, folder, "chunks").select("document_id", "is_table").distinct(), table(spark, folder, "doc_contexts").select(F.col("doc_id").alias("document_id"), "is_active", "withdrawn_at")
    joined = chunks.join(docs.withColumn("known", F.lit(True)), "document_id", "left")
    return joined.agg(F.count("*").alias("groups"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if("is_active").alias("active"), F.count_if(F.col("withdrawn_at").isNotNull()).alias("withdrawn"), F.countDistinct("document_id").alias("documents"))


def rare_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that are cited by a relation at most twice."""
    rels = table(spark, folder, "doc_contexts").select(F.explode("ontology_rels").alias("x")).select("x.edge_label", letters_digits("x.target_doc").alias("target"))
    return rels.where(F.col("target").isNotNull()).groupBy("edge_label", "target").agg(F.count("*").alias("n")).where(F.col("n") <= 2)


def sector_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent sectors of document contexts."""
    values = split_packed(table(spark, folder, "doc_contexts"), F.col("doc_id"), ["sectors_str"])
    return values.groupBy(F.col("val").alias("sector")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector").limit(5)


def structure_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut into chapters, articles, clauses and tables, with ids and citations."""
    rows = table(spark, folder, "documents")
    chunks = chunk_documents(rows, F.col("text"), {"doc_id": F.col("doc_id").cast("string"), "number": F.coalesce("document_number", F.lit("N/A")), "source": F.col("source")})
    return citable(chunks, F.col("doc_id"), F.col("number"), F.col("number"), F.coalesce("source", F.lit("Chung")))


def contents_and_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Table of contents and effective date of every document."""
    rows = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", table_of_contents("text").alias("toc"), effective_date(F.col("text"), F.date_format("loaded_at", "yyyy-MM-dd")).alias("effective_date"))


def legal_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the first 80 lines name as legal bases."""
    lines = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.slice(F.split("text", "\n"), 1, 80)).alias("line")).where(F.col("line").rlike(r"(?iu)^\s*căn cứ(?U)\b"))
    return lines.select("doc_id", F.explode(L.basis_references("line")).alias("x")).select("doc_id", "x.*").distinct()


def text_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between documents from citations by number and by name and the words before them."""
    return extract_relations(table(spark, folder, "documents"), "document_number", "text", _laws(spark, folder))


def _laws(spark: SparkSession, folder: str) -> dict[str, str]:
    """Numbers of laws by name: the known ones and those of the base laws, of which there may be a thousand."""
    rows = table(spark, folder, "base_laws").where("law_title <> '' AND doc_number <> ''").select(F.lower("law_title").alias("t"), "doc_number").orderBy("t", "doc_number").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 base laws: a pattern of their names would be too large")
    return V.LAW_NUMBERS | {r.t: r.doc_number for r in rows}


def amended_by(spark: SparkSession, folder: str) -> DataFrame:
    """Cited documents that a later one changed, from passive clauses of preambles."""
    return passive_chains(table(spark, folder, "documents"), "doc_id", "text", _laws(spark, folder)).where(F.col("by").isNotNull()).select("doc_id", "changed", "by", "edge_label").distinct()


QUERIES = {
    f.__name__: f for f in (
        document_fields, signer_fields, point_ids, chunk_hints, line_kinds, intents, relation_names, entity_types, entity_spellings, cited_numbers, message_references, relation_counts,
        number_frequencies, most_repeated, exact_copies, type_summary, phantom_stats, rare_relations, sector_histogram, structure_chunks, contents_and_dates, legal_bases, text_relations, amended_by,
    )
}


def _words(expr: str, words: list[str]) -> str:
    body = "|".join(w.replace(" ", "\\s+") for w in words)
    return f"regexp_matches({expr}, '(?i)(^|[^\\pL\\pN\\pM_])({body})($|[^\\pL\\pN\\pM_])')"


_STATUS = f"""CASE WHEN doc_status IS NULL OR lower(trim(doc_status)) IN ('', 'nan', 'none', 'n/a') THEN '{V.IN_FORCE}'
  WHEN contains(lower(doc_status), 'hết hiệu lực') OR contains(lower(doc_status), 'het hieu luc') THEN CASE WHEN contains(lower(doc_status), 'một phần') OR contains(lower(doc_status), 'mot phan') OR contains(lower(doc_status), '1 phần') THEN '{V.PARTLY_EXPIRED}' ELSE '{V.EXPIRED}' END
  WHEN contains(lower(doc_status), 'chưa') OR contains(lower(doc_status), 'chua') OR contains(lower(doc_status), 'sắp') THEN '{V.NOT_YET}' ELSE '{V.IN_FORCE}' END"""
_RANK = "coalesce(list_position(['Hiến pháp', 'Bộ luật', 'Luật', 'Pháp lệnh', 'Lệnh', 'Nghị quyết', 'Nghị định', 'Quyết định', 'Thông tư', 'Chỉ thị'], trim(legal_type_meta)), 99)"
#: What the labels of the corpus and some others become, written down by hand.
_EXPECTED = """SELECT * FROM (VALUES ('AMENDS', 'AMENDED_BY', 'AMENDS', false), ('BASED_ON', 'BASED_ON', 'BASED_ON', false), ('GUIDES', 'GUIDED_BY', 'GUIDES', false), ('REPEALS', 'REPEALED_BY', 'REPEALS', false), ('REPLACES', 'REPLACED_BY', 'REPLACES', false),
  ('assigned to', 'FUNDED_BY', 'ASSIGNED_TO', true), ('UPDATED_EVERY', 'AMENDED_BY', 'UPDATED_EVERY', true), ('IS', 'RELATED_TO', 'IS', true), ('signs', 'SIGNED_BY', 'SIGNS', true), ('PAYS_FOR', 'PAYS_FOR', 'PAYS_FOR', true), ('approving', 'APPROVED_BY', 'APPROVING', true),
  ('SHARES_BORDER', 'SHARES_BORDER', 'SHARES_BORDER', true), ('', 'RELATED_TO', 'BASED_ON', true), ('references', 'REFERENCED_BY', 'BASED_ON', true), ('applies', 'APPLIES_TO', 'APPLIES_TO', true), ('monitors', 'MANAGED_BY', 'MONITORS', true), ('produces', 'CREATED_BY', 'PRODUCES', true)) t(raw, relation, doc_relation, shown)"""
_KINDS = r"""CASE WHEN l = '' THEN 'blank' WHEN length(l) - length(replace(l, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(l, '(?i)^(chương|phần)\s+(thứ\s+)?[a-z0-9]+') THEN 'chapter'
  WHEN regexp_matches(l, '(?i)^(điều|mục)\s+[0-9]+') THEN 'article' WHEN regexp_matches(l, '(?i)^(phụ\s+lục|danh\s+mục|mẫu\s+số)') THEN 'appendix' WHEN regexp_matches(l, '(?i)^(căn\s+cứ)') THEN 'basis'
  WHEN regexp_matches(l, '^[0-9]+(\.[0-9]+)*[.)]|^\([0-9]+\)') OR regexp_matches(l, '(?i)^khoản\s+[0-9]+') THEN 'clause' WHEN regexp_matches(l, '^[a-zđ]\s*[).]') THEN 'point' ELSE 'text' END"""
_REL = "(SELECT unnest(ontology_rels) AS x FROM doc_contexts)"
_ENT = "(SELECT label, unnest(names) AS raw FROM (SELECT unnest(map_keys(entities)) AS label, unnest(map_values(entities)) AS names FROM doc_contexts))"
SQL = {
    "document_fields": f"""SELECT doc_id, upper(regexp_replace(doc_number, '[\\s.\\-/]', '', 'g')) AS number_key, coalesce(nullif(regexp_replace(regexp_replace(lower(doc_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
      CASE WHEN regexp_matches(lower(doc_title), 'hiến pháp|hien phap') THEN 'constitution' WHEN regexp_matches(lower(doc_title), 'bộ luật|bo luat') THEN 'code' WHEN regexp_matches(lower(doc_title), 'luật|luat') THEN 'law' WHEN regexp_matches(lower(doc_title), 'pháp lệnh|phap lenh') THEN 'ordinance' WHEN regexp_matches(lower(doc_title), 'nghị quyết|nghi quyet') THEN 'resolution' WHEN regexp_matches(lower(doc_title), 'nghị định|nghi dinh') THEN 'decree' WHEN regexp_matches(lower(doc_title), 'thông tư|thong tu') THEN 'circular' ELSE 'other' END AS doc_type,
      coalesce(nullif(regexp_extract(doc_number, '\\b((?:19|20)\\d{{2}})\\b', 1), ''), CASE WHEN TRY_CAST(regexp_extract(doc_number, '(\\d{{4}})', 1) AS INTEGER) BETWEEN 1900 AND 2100 THEN regexp_extract(doc_number, '(\\d{{4}})', 1) END) AS number_year,
      {_STATUS} AS status, {_RANK} AS type_rank FROM doc_contexts""",
    "signer_fields": """SELECT row_id, CASE WHEN signers IS NULL OR lower(trim(signers)) IN ('nan', '', 'none') THEN NULL WHEN contains(signers, ':') THEN trim(split_part(signers, ':', 1)) ELSE signers END AS signer_name,
      CASE WHEN signers IS NULL OR lower(trim(signers)) IN ('nan', '', 'none') OR NOT contains(signers, ':') THEN NULL ELSE CASE WHEN regexp_full_match(split_part(signers, ':', 2), '\\s*-?[0-9]+\\s*') THEN CAST(regexp_replace(split_part(signers, ':', 2), '\\s+', '', 'g') AS BIGINT) END END AS signer_id FROM corpus_metadata""",
    "point_ids": """SELECT chunk_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(d, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id
      FROM (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS d FROM chunks)""",
    "chunk_hints": f"""SELECT chunk_id, coalesce({_words('chunk_text', ['bộ', 'sở', 'ban', 'ngành', 'ủy ban', 'uy ban', 'tổng cục', 'cục', 'chi cục', 'đoàn', 'hội đồng', 'chính phủ', 'quốc hội', 'đảng', 'nhà nước', 'trung ương', 'địa phương', 'doanh nghiệp', 'công ty', 'tập đoàn', 'tổng công ty', 'tổ chức', 'đề án', 'dự án', 'chương trình', 'kế hoạch', 'chiến lược', 'quỹ'])}, false) AS entities,
      coalesce({_words('chunk_text', ['sửa đổi', 'bổ sung', 'thay thế', 'bãi bỏ', 'hết hiệu lực', 'hủy bỏ', 'đình chỉ', 'đính chính', 'giao cho', 'giao trách nhiệm', 'giao nhiệm vụ', 'ủy quyền', 'phân công', 'căn cứ', 'áp dụng', 'hướng dẫn thi hành', 'quy định chi tiết', 'ban hành kèm theo', 'thực hiện theo', 'ngưng hiệu lực', 'chấm dứt hiệu lực'])} AND regexp_matches(chunk_text, '(?i)(^|[^\\pL\\pN_])[0-9]+[/-](20[0-9]{{2}}|19[0-9]{{2}})[/-][A-ZĐ][A-Z0-9Đ/-]+|(^|[^\\pL\\pN_])[0-9]+[/-][A-ZĐ][A-Z0-9Đ/-]{{2,}}'), false) AS relations,
      coalesce(length(regexp_replace(chunk_text, '[^\\pL]+', '', 'g')), 0) > 20 AS meaningful FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks)""",
    "line_kinds": f"SELECT source, {_KINDS} AS kind, count(*) AS n FROM (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS l FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
    "intents": """SELECT origin, CASE WHEN regexp_matches(q, 'ban hành|ký|phê duyệt|thẩm quyền') THEN 'authority' WHEN regexp_matches(q, 'xử phạt|mức phạt|vi phạm|hình thức xử lý|phạt tiền|bị phạt') THEN 'penalty' WHEN regexp_matches(q, 'phí|tiền') THEN 'fee'
        WHEN regexp_matches(q, 'quy trình|thủ tục|cấp phép|đăng ký|hồ sơ|các bước|làm thế nào để') THEN 'procedure' WHEN regexp_matches(q, 'điều kiện|tiêu chuẩn|yêu cầu|tiêu chí') THEN 'condition'
        WHEN regexp_matches(q, 'thời hạn|thời gian|bao nhiêu ngày|bao lâu|trong vòng|hạn nộp|hạn chót|deadline') THEN 'timeframe' WHEN regexp_matches(q, 'quản lý|giám sát|điều phối|chịu trách nhiệm') THEN 'management' END AS intent, count(*) AS n
      FROM (SELECT 'eval' AS origin, lower(question) AS q FROM eval_items UNION ALL SELECT 'chat', lower(content) FROM messages WHERE lower(trim(role, ' ')) IN ('user', 'human')) WHERE q IS NOT NULL GROUP BY ALL""",
    "relation_names": f"""SELECT raw, coalesce(relation, 'RELATED_TO') AS relation, coalesce(doc_relation, 'BASED_ON') AS doc_relation FROM (SELECT DISTINCT x.edge_label AS raw FROM {_REL} UNION SELECT raw FROM ({_EXPECTED}) WHERE shown) LEFT JOIN ({_EXPECTED}) USING (raw)""",
    "entity_types": f"SELECT label AS entity_type, count(*) AS n, count(DISTINCT raw) AS names FROM {_ENT} GROUP BY label",
    "entity_spellings": f"SELECT label, lower(raw) AS name_key, arg_min(raw, (CASE WHEN regexp_matches(raw, '^\\p{{Lu}}') THEN 0 ELSE 1 END, raw)) AS name, count(*) AS n FROM {_ENT} WHERE raw IS NOT NULL GROUP BY ALL",
    "cited_numbers": "SELECT number, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+/(?:19|20)[0-9]{2}/[A-ZĐ][A-Z0-9Đ-]*')) AS number FROM documents) GROUP BY number",
    "message_references": "SELECT article_ref, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id, json_extract_string(references_json, '$[0].article_ref') AS article_ref FROM messages WHERE json_valid(references_json)) WHERE article_ref IS NOT NULL GROUP BY article_ref",
    "relation_counts": f"SELECT x.edge_label AS edge_label, count(*) AS n, count(*) FILTER (x.is_cross_doc) AS across, count(*) - count(DISTINCT (x.source_doc, x.target_doc)) FILTER (x.source_doc IS NOT NULL AND x.target_doc IS NOT NULL) AS repeated FROM {_REL} GROUP BY 1",
    "number_frequencies": "SELECT times, count(*) AS numbers FROM (SELECT count(*) AS times FROM documents WHERE document_number IS NOT NULL GROUP BY document_number) GROUP BY times",
    "most_repeated": "SELECT document_number, count(*) AS n FROM documents WHERE document_number IS NOT NULL GROUP BY 1 ORDER BY n DESC, document_number LIMIT 20",
    "exact_copies": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE length(text) > 0 GROUP BY text HAVING count(*) > 1",
    "type_summary": """WITH t AS (SELECT legal_type_meta, doc_title, row_number() OVER (PARTITION BY legal_type_meta ORDER BY doc_title) AS n FROM (SELECT DISTINCT legal_type_meta, doc_title FROM doc_contexts WHERE doc_title IS NOT NULL))
      SELECT c.legal_type_meta, c.docs, c.authorities, j.titles FROM (SELECT legal_type_meta, count(DISTINCT doc_id) AS docs, count(DISTINCT issuing_auth) AS authorities FROM doc_contexts WHERE legal_type_meta IS NOT NULL GROUP BY 1) c
      LEFT JOIN (SELECT legal_type_meta, string_agg(doc_title, ' | ' ORDER BY n) AS titles FROM t WHERE n <= 15 GROUP BY 1) j USING (legal_type_meta)""",
    "phantom_stats": """SELECT count(*) AS groups, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) FILTER (d.is_active) AS active, count(*) FILTER (d.withdrawn_at IS NOT NULL) AS withdrawn, count(DISTINCT c.document_id) AS documents
      FROM (SELECT DISTINCT document_id, is_table FROM chunks) c LEFT JOIN doc_contexts d ON d.doc_id = c.document_id""",
    "rare_relations": f"SELECT edge_label, target, count(*) AS n FROM (SELECT x.edge_label AS edge_label, nullif(regexp_replace(replace(lower(strip_accents(x.target_doc)), 'đ', 'd'), '[^\\pL\\pN]+', '', 'g'), '') AS target FROM {_REL}) WHERE target IS NOT NULL GROUP BY ALL HAVING count(*) <= 2",
    "legal_bases": r"""WITH l AS (SELECT doc_id, trim(regexp_replace(line, '[\s\p{Z}\x{200B}\x{FEFF}]+', ' ', 'g')) AS basis_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))[1:80]) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '(?i)^\s*căn cứ(?:[^\pL\pN\pM_]|$)')),
      r AS (SELECT doc_id, basis_line, unnest(regexp_extract_all(basis_line, '(?i)((?:Hiến pháp|Bộ luật|Luật|Nghị quyết|Pháp lệnh|Nghị định|Thông tư)(?:[^\pL\pN\pM_.;\n][^.;\n]*)?)(?:$|[.;])', 1)) AS ref FROM l),
      f AS (SELECT doc_id, basis_line, CASE lower(regexp_extract(ref, '(?i)^(Hiến pháp|Bộ luật|Luật|Nghị quyết|Pháp lệnh|Nghị định|Thông tư)', 1)) WHEN 'hiến pháp' THEN 'constitution' WHEN 'bộ luật' THEN 'code' WHEN 'luật' THEN 'law' WHEN 'nghị quyết' THEN 'resolution' WHEN 'pháp lệnh' THEN 'ordinance' WHEN 'nghị định' THEN 'decree' ELSE 'circular' END AS doc_type,
        coalesce(nullif(regexp_extract(ref, '(?i)(?:số\s*)?(\d+/\d+(?:/[A-Z0-9Đ\-]+)?)', 1), ''), regexp_extract(ref, '(?i)(\d+/[A-Z0-9Đ\-]+)', 1)) AS doc_number,
        coalesce(nullif(regexp_extract(ref, '\b((?:19|20)\d{2})\b', 1), ''), CASE WHEN TRY_CAST(regexp_extract(ref, '(\d{4})', 1) AS INTEGER) BETWEEN 1900 AND 2100 THEN regexp_extract(ref, '(\d{4})', 1) END, '') AS doc_year, trim(ref) AS doc_title FROM r)
      SELECT DISTINCT *, 'parent::' || doc_type || '::' || coalesce(nullif(regexp_replace(regexp_replace(lower(CASE WHEN doc_number <> '' THEN doc_number ELSE doc_title END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') || '::' || coalesce(nullif(doc_year, ''), 'unknown') AS parent_law_id FROM f""",
    "contents_and_dates": r"""WITH d AS (SELECT doc_id, text, loaded_at, list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ')) AS lines FROM documents WHERE text IS NOT NULL),
      a AS (SELECT *, list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)^(phụ\s+lục|danh\s+mục|(biểu\s+)?mẫu)(?:[^\pL\pN\pM_]|$)')), true) AS app,
        regexp_replace(text, '(?is)\n\s*(?:phụ\s+lục|danh\s+mục|mẫu\s+số)(?:[^\pL\pN\pM_].*)?$', '') AS body FROM d),
      e AS (SELECT *, list_filter(list_transform(CASE WHEN app > 0 THEN lines[1:app - 1] ELSE lines END, lambda x: CASE
        WHEN regexp_matches(x, '(?i)^(Chương|Phần)(?:\s+thứ)?\s+([a-zA-Z0-9]+)\b\s*[.:\-]?\s*(.*)$') THEN regexp_replace(x, '(?i)^(Chương|Phần)(?:\s+thứ)?\s+([a-zA-Z0-9]+)\b\s*[.:\-]?\s*(.*)$', '\1 \2: \3')
        WHEN regexp_matches(x, '(?i)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$') THEN regexp_replace(x, '(?i)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$', '\1 \2. ') ||
          CASE WHEN length(regexp_extract(x, '(?i)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$', 3)) > 100 THEN substr(regexp_extract(x, '(?i)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$', 3), 1, 100) || '...' ELSE regexp_extract(x, '(?i)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$', 3) END END), lambda x: x IS NOT NULL) AS toc,
        regexp_extract(body, '(?i)có\s+hiệu\s+lực\s+(?:từ|kể\s+từ)\s+ngày\s+(\d{1,2})[/\- ](\d{1,2})[/\- ](\d{4})', ['d', 'm', 'y']) AS day FROM a)
      SELECT doc_id, coalesce(array_to_string(toc, chr(10)), '') AS toc, CASE WHEN day.y <> '' THEN day.y || '-' || lpad(day.m, 2, '0') || '-' || lpad(day.d, 2, '0')
        WHEN regexp_matches(body, '(?i)có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+)?từ\s+ngày\s+ký|chịu\s+trách\s+nhiệm\s+thi\s+hành\s+(?:quyết\s+định|nghị\s+định|thông\s+tư|văn\s+bản)\s+này') THEN strftime(loaded_at, '%Y-%m-%d') END AS effective_date FROM e""",
}
