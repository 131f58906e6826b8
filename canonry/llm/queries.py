"""Queries of the training-text problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.llm.canonical import TITLES, map_values
from canonry.llm.conversations import bare, conversations, fold_events
from canonry.llm.leakage import leaked_items
from canonry.llm.mojibake import garbled
from canonry.llm.splitting import split_oversized
from canonry.llm.tokens import encode_corpus
from canonry.sources.tables import table


def _long_items(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    docs, chunks = table(spark, folder, "doc_contexts"), table(spark, folder, "chunks")
    of_chunks = split_oversized(chunks, F.col("chunk_text"), {"field_name": F.lit("chunk_text"), "item_id": F.col("chunk_id"), "article_ref": F.col("article_ref")}, texts=texts)
    of_docs = split_oversized(docs, F.col("document_toc"), {"field_name": F.lit("document_toc"), "item_id": F.col("doc_id"), "article_ref": F.lit(None).cast("string")}, texts=texts)
    return of_chunks.unionByName(of_docs)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that were cut: those of which there is a second piece."""
    return _long_items(spark, folder, False).where(F.col("piece") == 2).select("field_name", "item_id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized items; exact repeats of an item's row give its pieces once."""
    return _long_items(spark, folder, True).distinct()


def p3_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized item put together again from its pieces, as a hash, with the longest piece and the largest overlap."""
    pieces = p3_pieces(spark, folder)
    before = F.lag("end_at").over(Window.partitionBy("field_name", "item_id", "article_ref").orderBy("piece"))
    own = pieces.withColumn("shared", F.coalesce(before - F.col("start_at"), F.lit(0))).withColumn("new", F.substr("piece_text", F.col("shared") + 1, F.lit(2000)))
    parts = F.array_sort(F.collect_list(F.struct("piece", "new")))
    whole = F.array_join(F.transform(parts, lambda x: x["new"]), "")
    gaps = F.count_if((F.col("shared") < 0) | ((F.col("piece") == 1) & (F.col("start_at") != 0)))
    return own.groupBy("field_name", "item_id", "article_ref").agg(F.md5(whole).alias("text_hash"), (F.max(F.length("piece_text")) <= 2000).alias("fits"), (F.max("shared") <= 200).alias("shares"), (gaps == 0).alias("covers"))


def p5_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value with its canonical entry and score."""
    docs, canon = table(spark, folder, "doc_contexts"), table(spark, folder, "canon_names")
    single = [F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field_name"), F.lit(1).alias("pos"), F.col(f).alias("raw")) for f, k in (("issuing_auth", "authority"), ("signer_name", "signer"))]
    fields = docs.select("doc_id", F.inline(F.array(*single)))
    lists = docs.select("doc_id", F.explode("entities").alias("label", "members")).select("doc_id", "label", F.posexplode("members").alias("p", "raw"))
    entities = lists.select("doc_id", F.lit("entity").alias("kind"), F.concat(F.lit("entities."), "label").alias("field_name"), (F.col("p") + 1).alias("pos"), "raw")
    return map_values(fields.unionByName(entities), canon.withColumnRenamed("entry_kind", "kind"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical entry of every value that is not spelled as in the list."""
    return p5_mapped(spark, folder).select("doc_id", "field_name", F.col("pos").cast("int").alias("pos"), "canon_id")


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values without an entry and how often each occurs."""
    none = p5_mapped(spark, folder).where(F.col("canon_id") == 0)
    return none.groupBy("kind", "raw").agg(F.count("*").alias("n"))


def p7_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations with roles and contents."""
    messages = table(spark, folder, "messages")
    turns = fold_events(messages, "session_id", "role", "content", "created_at", "id")
    return conversations(turns, table(spark, folder, "sessions"), "id", counted=messages.select(bare("session_id").alias("session_id")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of whole conversations."""
    return p7_conversations(spark, folder).select("session_id", "turn", "message_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def _leaks(spark: SparkSession, folder: str, edits: int) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), table(spark, folder, "eval_items"), F.col("item_id"), F.col("passage"), edits=edits)


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of a test item's passage but for one word, with the number of words that differ."""
    return _leaks(spark, folder, 1)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents that hold the twelve words without a difference."""
    return p9_near(spark, folder).where(F.col("distance") == 0).select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text that was decoded wrongly."""
    return garbled(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), texts=False).distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with their original text, as far as it can be had."""
    return garbled(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p7_found": p7_found, "p7_conversations": p7_conversations, "p8_ids": p8_ids, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found, "p10_restored": p10_restored}

_P7 = r"""
WITH m AS (SELECT id, lower(trim(session_id, E' \t\n\r')) AS sid, content,
    CASE lower(trim(role)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'other' END AS role,
    CASE WHEN regexp_full_match(trim(created_at), '\d+') THEN CAST(trim(created_at) AS BIGINT) * 1000
         WHEN regexp_matches(trim(created_at), '(Z|[+-]\d\d:\d\d)$') THEN epoch_us(CAST(trim(created_at) AS TIMESTAMPTZ))
         ELSE epoch_us(CAST(trim(created_at) || '+07:00' AS TIMESTAMPTZ)) END AS ts
  FROM messages WHERE session_id IS NOT NULL AND regexp_matches(content, '\S')),
one AS (SELECT sid, role, ts, content, min(id) AS id FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS turn, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY sid) AS n FROM one WINDOW w AS (PARTITION BY sid ORDER BY ts, id)),
ok AS (SELECT sid FROM o GROUP BY sid HAVING bool_and(CASE role WHEN 'system' THEN coalesce(prev = 'system', true) WHEN 'user' THEN coalesce(prev <> 'user', true) WHEN 'assistant' THEN coalesce(prev = 'user', false) ELSE false END) AND arg_max(role, turn) = 'assistant')
"""
_P9 = """
WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS l FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i:i + 11], ' '))) AS gram FROM w),
v AS (SELECT item_id, regexp_extract_all(replace(lower(strip_accents(passage)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS l FROM eval_items),
h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i:i + 11], ' '))) AS gram FROM v)
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)
"""


#: Brute force: the windows with each word left out (replaced), the passages' with each word left out (missing), the texts' with each inner word left out (inserted).
_P9_NEAR = """
WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS l FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(replace(lower(strip_accents(passage)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS l FROM eval_items),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(l) - 10), lambda i: l[i:i + 11])) AS g FROM v),
j AS (SELECT unnest(range(1, 14)) AS j),
pk AS (SELECT item_id, hash(g, 0) AS k, 0 AS n FROM p UNION SELECT item_id, hash(g[1:j - 1] || g[j + 1:12], j), 1 FROM p, j WHERE j <= 12 UNION SELECT item_id, hash(g[1:j - 1] || g[j + 1:12], 100), 1 FROM p, j WHERE j <= 12 UNION SELECT item_id, hash(g, 200), 1 FROM p),
t AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w WHERE len(l) >= 11),
tk AS (SELECT doc_id, hash(l[i:i + 11], 0) AS k FROM t WHERE i + 11 <= len(l) UNION ALL SELECT doc_id, hash(l[i:i + j - 2] || l[i + j:i + 11], j) FROM t, j WHERE j <= 12 AND i + 11 <= len(l)
  UNION ALL SELECT doc_id, hash(l[i:i + 10], 100) FROM t WHERE i + 10 <= len(l) UNION ALL SELECT doc_id, hash(l[i:i + j - 2] || l[i + j:i + 12], 200) FROM t, j WHERE j BETWEEN 2 AND 12 AND i + 12 <= len(l))
SELECT doc_id, item_id, CAST(min(n) AS INTEGER) AS distance FROM tk JOIN pk USING (k) GROUP BY ALL
"""


def _p5_sql(columns: str = "w.doc_id, w.field_name, w.pos, coalesce(b.canon_id, 0) AS canon_id", rest: str = "") -> str:
    """Brute force: every distinct value against every entry, equal but for one letter after the same normalisation."""

    def name(text: str, person: str) -> str:
        """CTEs would repeat the input, so the steps are nested; `person` is a condition."""
        plain = f"replace(lower(strip_accents(CASE WHEN trim(regexp_replace({text}, '\\([^()]*\\)', '', 'g')) = '' THEN {text} ELSE regexp_replace({text}, '\\([^()]*\\)', ' ', 'g') END)), 'đ', 'd')"
        body = f"CASE WHEN regexp_matches({plain}, ':.*[a-z0-9]') THEN regexp_extract({plain}, '^.*:(.*)$', 1) ELSE {plain} END"
        turned = f"CASE WHEN {person} AND regexp_matches({body}, '^[^,]*[a-z0-9][^,]*,[^,]*[a-z0-9][^,]*$') THEN regexp_replace({body}, '^([^,]*),([^,]*)$', '\\2 \\1') ELSE {body} END"
        return f"array_to_string(regexp_extract_all(regexp_replace(regexp_replace({turned}, '\\btp\\.', 'thanh pho ', 'g'), '\\bt\\.', 'tinh ', 'g'), '[a-z0-9]+'), ' ')"

    titles = "|".join(sorted(TITLES, key=len, reverse=True))
    bare = f"CASE WHEN contains(regexp_replace(n, '^(?:(?:{titles})\\b[. ]*)+', ''), ' ') THEN regexp_replace(n, '^(?:(?:{titles})\\b[. ]*)+', '') ELSE n END"
    return f"""
WITH v AS (SELECT doc_id, 'authority' AS kind, 'issuing_auth' AS field_name, 1 AS pos, issuing_auth AS raw FROM doc_contexts UNION ALL SELECT doc_id, 'signer', 'signer_name', 1, signer_name FROM doc_contexts
  UNION ALL SELECT doc_id, 'entity', 'entities.' || label, CAST(generate_subscripts(names, 1) AS INTEGER), unnest(names) FROM (SELECT doc_id, unnest(map_keys(entities)) AS label, unnest(map_values(entities)) AS names FROM doc_contexts)),
w AS (SELECT * FROM v WHERE raw IS NOT NULL AND lower(trim(raw)) NOT IN ('', 'n/a', 'nan') AND (kind, raw) NOT IN (SELECT (entry_kind, canon_name) FROM canon_names WHERE canon_name IS NOT NULL)),
d AS (SELECT kind, raw, {bare} AS n FROM (SELECT DISTINCT kind, raw, {name('raw', "kind = 'signer'")} AS n FROM w)),
c AS (SELECT kind, canon_id, {bare} AS n FROM (SELECT entry_kind AS kind, canon_id, {name('x', 'false')} AS n FROM (SELECT entry_kind, canon_id, unnest([canon_name, short_form]) AS x FROM canon_names) WHERE x IS NOT NULL)),
m AS (SELECT d.kind, d.raw, c.canon_id, least(damerau_levenshtein(d.n, c.n), damerau_levenshtein(array_to_string(list_sort(string_split(d.n, ' ')), ' '), array_to_string(list_sort(string_split(c.n, ' ')), ' '))) AS dist FROM d JOIN c ON c.kind = d.kind AND abs(length(c.n) - length(d.n)) <= 1),
b AS (SELECT kind, raw, arg_min(canon_id, (dist, canon_id)) AS canon_id FROM m WHERE dist <= 1 GROUP BY kind, raw)
SELECT {columns} FROM w LEFT JOIN b ON b.kind = w.kind AND b.raw = w.raw {rest}"""


SQL = {
    "p5_found": _p5_sql(),
    "p5_unmatched": _p5_sql("w.kind, w.raw, count(*) AS n", "WHERE b.canon_id IS NULL GROUP BY ALL"),
    "p3_found": "SELECT DISTINCT 'chunk_text' AS field_name, chunk_id AS item_id FROM chunks WHERE length(chunk_text) > 2000 UNION SELECT 'document_toc', doc_id FROM doc_contexts WHERE length(document_toc) > 2000",
    "p7_found": _P7 + "SELECT sid AS session_id, CAST(turn AS INTEGER) AS turn, id AS message_id FROM o WHERE sid IN (SELECT sid FROM ok) AND sid IN (SELECT lower(trim(id)) FROM sessions)",
    "p7_conversations": _P7 + "SELECT sid AS session_id, CAST(turn AS INTEGER) AS turn, id AS message_id, role, content FROM o WHERE sid IN (SELECT sid FROM ok) AND sid IN (SELECT lower(trim(id)) FROM sessions)",
    "p3_rebuilt": """SELECT DISTINCT field_name, item_id, article_ref, md5(t) AS text_hash, true AS fits, true AS shares, true AS covers
      FROM (SELECT 'chunk_text' AS field_name, chunk_id AS item_id, article_ref, chunk_text AS t FROM chunks UNION ALL SELECT 'document_toc', doc_id, NULL, document_toc FROM doc_contexts) WHERE length(t) > 2000""",
    "p9_found": _P9,
    "p9_near": _P9_NEAR,
}
