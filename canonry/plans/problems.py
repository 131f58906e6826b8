"""Queries of the general data problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.functions.text import known, letters_digits
from canonry.functions.times import ABBREVIATIONS, utc_seconds, utc_text
from canonry.operators.history import attribute_history, day_value, status_value
from canonry.operators.orphans import orphan_cascade
from canonry.operators.packed import split_packed
from canonry.sources.tables import table


def _stamp(name: str):
    """`YYYY-MM-DD HH:MM:SS` of a timestamp without zone, or an empty text."""
    return F.coalesce(F.substring(F.col(name).cast("timestamp_ntz").cast("string"), 1, 19), F.lit(""))


def p1_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions with their states."""
    return attribute_history(
        table(spark, folder, "doc_snapshots"), "doc_id", "observed_at", "loaded_at", "op",
        {"doc_status": status_value("doc_status"), "final_effective_date": day_value("final_effective_date"), "is_active": F.col("is_active")},
        tie="snap_id",
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The period of every version."""
    return p1_history(spark, folder).select("doc_id", _stamp("valid_from").alias("valid_from"), _stamp("valid_to").alias("valid_to"))


_P1_STATES = """
WITH norm AS (
  SELECT doc_id, observed_at, loaded_at, snap_id, lower(trim(op)) = 'delete' AS gone,
    CASE WHEN trim(regexp_replace(doc_status, '\\s+', ' ', 'g')) NOT IN ('', 'N/A')
      THEN replace(lower(strip_accents(trim(regexp_replace(doc_status, '\\s+', ' ', 'g')))), 'đ', 'd') END AS st,
    CASE WHEN trim(final_effective_date) NOT IN ('', 'N/A') THEN
      CASE WHEN regexp_matches(final_effective_date, '^\\d{4}-') THEN substr(final_effective_date, 1, 10)
           ELSE substr(final_effective_date, 7, 4) || '-' || substr(final_effective_date, 4, 2) || '-' || substr(final_effective_date, 1, 2) END END AS dt,
    is_active AS ac
  FROM doc_snapshots WHERE doc_id IS NOT NULL AND observed_at IS NOT NULL),
one AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY doc_id, observed_at ORDER BY loaded_at DESC, snap_id DESC) = 1),
filled AS (SELECT doc_id, observed_at, gone,
    last_value(st IGNORE NULLS) OVER w AS st, last_value(dt IGNORE NULLS) OVER w AS dt, last_value(ac IGNORE NULLS) OVER w AS ac
  FROM one WINDOW w AS (PARTITION BY doc_id ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marked AS (SELECT *, lag(gone) OVER w AS pgone, lag(st) OVER w AS pst, lag(dt) OVER w AS pdt, lag(ac) OVER w AS pac
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY observed_at)),
ev AS (SELECT *, CASE WHEN gone THEN 'deleted' WHEN pgone IS NULL OR pgone THEN 'inserted' ELSE 'changed' END AS change FROM marked
  WHERE (gone AND NOT coalesce(pgone, true)) OR (NOT gone AND (pgone IS NULL OR pgone OR st IS DISTINCT FROM pst OR dt IS DISTINCT FROM pdt OR ac IS DISTINCT FROM pac))),
fin AS (SELECT doc_id, st, dt, ac, change, observed_at AS valid_from, lead(observed_at) OVER (PARTITION BY doc_id ORDER BY observed_at) AS valid_to FROM ev)
"""

def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every single value of the packed fields."""
    docs, meta = table(spark, folder, "doc_contexts"), table(spark, folder, "corpus_metadata")
    return split_packed(docs, F.col("doc_id"), ["sectors_str"]).unionByName(split_packed(meta, F.col("row_id"), ["legal_sectors", "signers"]))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC time of every readable date text."""
    docs, meta = table(spark, folder, "doc_contexts"), table(spark, folder, "corpus_metadata")
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in ("promulgation_date", "final_effective_date")])
    values = docs.select(F.col("doc_id").alias("record_id"), "zone_hint", F.inline(fields)).unionByName(
        meta.select(F.col("row_id").cast("string").alias("record_id"), "zone_hint", F.lit("issuance_date").alias("field_name"), F.col("issuance_date").alias("raw"))
    )
    seconds = values.withColumn("at", utc_seconds("raw", F.col("zone_hint")))
    return seconds.where(F.col("at").isNotNull()).select("field_name", "record_id", utc_text(F.col("at")).alias("utc_time"))


#: Numbers that stand for no reference.
NO_REFERENCE = ("N/A", "unknown")


def references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, targets and owners of the document graph, as `orphan_cascade` takes them."""
    docs, laws, chunks = (table(spark, folder, t) for t in ("doc_contexts", "base_laws", "chunks"))

    def of(field: str, inner: str) -> DataFrame:
        return docs.select(F.col("doc_id").alias("record_id"), F.col("ingested_at").alias("ref_time"), F.posexplode(field).alias("p", "x")).select(
            F.lit(f"doc_contexts.{field}").alias("ref_field"), "record_id", (F.col("p") + 1).alias("ref_pos"), F.col(f"x.{inner}").alias("raw"), "ref_time"
        )

    of_chunks = chunks.select("chunk_id", "document_number", "loaded_at").distinct().select(
        F.lit("chunks.document_number").alias("ref_field"), F.col("chunk_id").alias("record_id"), F.lit(0).alias("ref_pos"), F.col("document_number").alias("raw"), F.col("loaded_at").alias("ref_time")
    )
    refs = of("basis_refs", "doc_number").unionByName(of("ontology_rels", "target_doc")).unionByName(of_chunks)
    refs = refs.withColumn("ref_key", letters_digits(known("raw", *NO_REFERENCE))).drop("raw")
    key = letters_digits(known("doc_number", *NO_REFERENCE)).alias("key")
    stamp = F.lit(None).cast("timestamp_ntz")
    targets = docs.where(F.col("ingested_at").isNotNull()).select(key, F.col("ingested_at").alias("valid_from"), F.col("withdrawn_at").alias("valid_to")).unionByName(laws.select(key, stamp.alias("valid_from"), stamp.alias("valid_to")))
    return refs, targets, docs.select(F.col("doc_id").alias("record_id"), key)


def p6_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """All orphan references, direct and inherited."""
    return orphan_cascade(*references(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The references that no target answers."""
    direct = p6_orphans(spark, folder).where(F.col("orphan") == "direct")
    return direct.select("ref_field", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "record_id", F.col("ref_pos").cast("int").alias("ref_pos")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans by table and month."""
    rows = p6_orphans(spark, folder).groupBy("ref_field", F.date_format("ref_time", "yyyy-MM").alias("ref_month"))
    return rows.agg(F.count_if(F.col("orphan") == "direct").alias("direct"), F.count_if(F.col("orphan") == "inherited").alias("inherited"), F.max("depth").alias("deepest"))


_P6_REFS = """
WITH RECURSIVE r0 AS (
  SELECT 'doc_contexts.basis_refs' AS ref_field, doc_id AS record_id, ingested_at AS ref_time, unnest(list_transform(basis_refs, lambda x: x.doc_number)) AS raw, generate_subscripts(basis_refs, 1) AS ref_pos FROM doc_contexts
  UNION ALL SELECT 'doc_contexts.ontology_rels', doc_id, ingested_at, unnest(list_transform(ontology_rels, lambda x: x.target_doc)), generate_subscripts(ontology_rels, 1) FROM doc_contexts
  UNION ALL SELECT DISTINCT 'chunks.document_number', chunk_id, loaded_at, document_number, 0 FROM chunks),
refs AS (SELECT ref_field, record_id, ref_time, CAST(ref_pos AS INTEGER) AS ref_pos, regexp_replace(replace(lower(strip_accents(raw)), 'đ', 'd'), '[^a-z0-9]+', '', 'g') AS k FROM r0
  WHERE raw IS NOT NULL AND lower(trim(raw)) NOT IN ('', 'n/a', 'unknown')),
targets AS (SELECT regexp_replace(replace(lower(strip_accents(doc_number)), 'đ', 'd'), '[^a-z0-9]+', '', 'g') AS k, ingested_at AS a, withdrawn_at AS b FROM doc_contexts WHERE doc_number IS NOT NULL AND lower(trim(doc_number)) NOT IN ('', 'n/a', 'unknown') AND ingested_at IS NOT NULL
  UNION ALL SELECT regexp_replace(replace(lower(strip_accents(doc_number)), 'đ', 'd'), '[^a-z0-9]+', '', 'g'), TIMESTAMP '0001-01-01', NULL FROM base_laws),
direct AS (SELECT * FROM refs r WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.k = r.k AND t.a <= r.ref_time AND (t.b IS NULL OR t.b > r.ref_time))),
edges AS (SELECT * FROM refs r WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.ref_field = r.ref_field AND d.record_id = r.record_id AND d.ref_pos = r.ref_pos)),
owned AS (SELECT DISTINCT doc_id AS record_id, regexp_replace(replace(lower(strip_accents(doc_number)), 'đ', 'd'), '[^a-z0-9]+', '', 'g') AS k FROM doc_contexts WHERE doc_number IS NOT NULL AND lower(trim(doc_number)) NOT IN ('', 'n/a', 'unknown')),
cas(k, depth) AS (SELECT DISTINCT o.k, 1 FROM owned o JOIN direct d ON d.record_id = o.record_id
  UNION SELECT DISTINCT o.k, c.depth + 1 FROM cas c JOIN edges e ON e.k = c.k JOIN owned o ON o.record_id = e.record_id WHERE c.depth < 60),
first AS (SELECT k, min(depth) AS depth FROM cas GROUP BY k)
"""

_P2 = r"""
WITH v AS (SELECT 'sectors_str' AS field_name, doc_id AS record_id, sectors_str AS raw FROM doc_contexts UNION ALL SELECT 'legal_sectors', CAST(row_id AS VARCHAR), legal_sectors FROM corpus_metadata UNION ALL SELECT 'signers', CAST(row_id AS VARCHAR), signers FROM corpus_metadata),
t AS (SELECT field_name, record_id, regexp_replace(regexp_replace(raw, '^\s*\[(.*)\]\s*$', '\1', 's'), '\s*/\s+|\s+/', ';', 'g') AS s FROM v WHERE raw IS NOT NULL),
p AS (SELECT field_name, record_id, regexp_extract_all(s, '(?:\\.|"(?:[^"\\]|""|\\.)*"|“[^”]*”|''(?:[^''\\]|\\.)*''|[^,;|\n\t，；•、"“''\\])+') AS l FROM t),
c AS (SELECT field_name, record_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(trim(x, E' \t\n\r'), '^"(.*)"(:[^":]*)?$', '\1\2', 's'), '^(?:“([^”]*)”|''(.*)'')(:[^:]*)?$', '\1\2\3', 's'), '""', '"'), '\\(.)', '\1', 'g'), E' \t\n\r')),
  lambda x: lower(x) NOT IN ('', 'n/a', 'nan', 'none', 'chung')) AS l FROM p)
SELECT field_name, record_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS pos, unnest(l) AS val FROM c
"""


def _p4_sql() -> str:
    """The same rules in DuckDB: patterns by number, calendar by cast, zones by its own library."""
    date, dmy, clock, zone = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s?([ap])m\b)?", r"(?:\s?\[?([a-z]+(?:[/_+-][a-z0-9_+-]+)*|[+-]\d{2}(?::?\d{2})?)\]?)?"
    months = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    forms = [
        (f"^{date}$", "12300000"), (f"^{dmy}$", "32100000"), (r"^(\d{4})(\d{2})(\d{2})$", "12300000"), (f"^{date}[t ]{clock}{zone}$", "12345678"), (f"^{dmy}[t ,]\\s?{clock}{zone}$".replace("\\\\", "\\"), "32145678"),
        (r"^(\d{1,2}) gio (\d{1,2})(?: phut)?,? (?:ngay )?" + dmy + "$", "54312000"), (r"^(?:ngay )?(\d{1,2}) thang (\d{1,2}),? nam (\d{4})$", "32100000"),
        (r"^(?:[a-z]{3,9},? )?(\d{1,2})[ -]" + months + r"[ -](\d{4})$", "32100000"), (r"^(?:[a-z]{3,9},? )?(\d{1,2})[ -]" + months + r"[ -](\d{4}) " + clock + zone + "$", "32145678"),
    ]
    which = "CASE " + " ".join(f"WHEN regexp_matches(s, '{f}') THEN {n}" for n, (f, _) in enumerate(forms)) + " END"
    part = lambda slot: "CASE w " + " ".join(f"WHEN {n} THEN regexp_extract(s, '{f}', {g[slot]})" for n, (f, g) in enumerate(forms) if g[slot] != "0") + " ELSE '' END"
    offsets = "CASE z " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + r" ELSE CASE WHEN regexp_full_match(z, '[+-]\d{2}(:?\d{2})?') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (60 * CAST(z[2:3] AS INTEGER) + coalesce(TRY_CAST(right(replace(z[4:], ':', ''), 2) AS INTEGER), 0)) END END"
    return f"""
WITH v AS (SELECT 'promulgation_date' AS field_name, doc_id AS record_id, zone_hint, promulgation_date AS raw FROM doc_contexts UNION ALL SELECT 'final_effective_date', doc_id, zone_hint, final_effective_date FROM doc_contexts
  UNION ALL SELECT 'issuance_date', CAST(row_id AS VARCHAR), zone_hint, issuance_date FROM corpus_metadata),
f AS (SELECT *, replace(lower(strip_accents(trim(regexp_replace(raw, '\\s+', ' ', 'g')))), 'đ', 'd') AS s FROM v),
m AS (SELECT *, {which} AS w FROM f),
p AS (SELECT *, {part(0)} AS y, {part(1)} AS mo, {part(2)} AS d, {part(3)} AS h, {part(4)} AS mi, {part(5)} AS se, {part(6)} AS ap, {part(7)} AS z FROM m),
q AS (SELECT *, {offsets} AS off, (SELECT any_value(name) FROM pg_timezone_names() WHERE lower(name) = z AND contains(name, '/')) AS region,
  CASE ap WHEN '' THEN coalesce(TRY_CAST(h AS INTEGER), 0) ELSE CASE WHEN CAST(h AS INTEGER) BETWEEN 1 AND 12 THEN CAST(h AS INTEGER) % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END ELSE 99 END END AS hour,
  coalesce(TRY_CAST(mo AS INTEGER), list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], mo)) AS month FROM p),
t AS (SELECT *, CASE WHEN hour < 24 AND coalesce(TRY_CAST(mi AS INTEGER), 0) < 60 AND coalesce(TRY_CAST(se AS INTEGER), 0) < 60 THEN
  TRY_CAST(CASE WHEN length(y) = 2 THEN '20' || y ELSE y END || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CASE mi WHEN '' THEN '0' ELSE mi END, 2, '0') || ':' || CASE se WHEN '' THEN '00' ELSE se END AS TIMESTAMP) END AS wall FROM q),
u AS (SELECT *, CASE WHEN regexp_full_match(s, '\\d{{12,18}}') THEN epoch_ms(CAST(s AS BIGINT)) WHEN regexp_full_match(s, '\\d{{9,11}}') THEN epoch_ms(CAST(s AS BIGINT) * 1000)
  WHEN off IS NOT NULL THEN wall - to_minutes(off) WHEN z <> '' AND region IS NULL THEN NULL
  ELSE CASE WHEN timezone(coalesce(region, zone_hint, 'Asia/Ho_Chi_Minh'), timezone(coalesce(region, zone_hint, 'Asia/Ho_Chi_Minh'), wall) - INTERVAL 1 HOUR) = wall THEN timezone('UTC', timezone(coalesce(region, zone_hint, 'Asia/Ho_Chi_Minh'), wall) - INTERVAL 1 HOUR)
    ELSE timezone('UTC', timezone(coalesce(region, zone_hint, 'Asia/Ho_Chi_Minh'), wall)) END END AS utc FROM t)
SELECT field_name, record_id, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc_time FROM u WHERE utc IS NOT NULL"""


QUERIES = {"p1_found": p1_found, "p1_history": p1_history, "p2_found": p2_found, "p4_found": p4_found, "p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p1_found": _P1_STATES + "SELECT doc_id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d %H:%M:%S'), '') AS valid_to FROM fin WHERE change <> 'deleted'",
    "p1_history": _P1_STATES + "SELECT doc_id, st AS doc_status, dt AS final_effective_date, ac AS is_active, change, valid_from, valid_to FROM fin WHERE change <> 'deleted'",
    "p2_found": _P2,
    "p4_found": _p4_sql(),
    "p6_found": _P6_REFS + "SELECT DISTINCT ref_field, strftime(ref_time, '%Y-%m') AS ref_month, record_id, ref_pos FROM direct",
    "p6_report": _P6_REFS + """SELECT ref_field, strftime(ref_time, '%Y-%m') AS ref_month, count(*) FILTER (orphan = 'direct') AS direct, count(*) FILTER (orphan = 'inherited') AS inherited, CAST(max(depth) AS INTEGER) AS deepest
      FROM (SELECT ref_field, ref_time, 'direct' AS orphan, 0 AS depth FROM direct UNION ALL SELECT e.ref_field, e.ref_time, 'inherited', f.depth FROM edges e JOIN first f ON f.k = e.k) GROUP BY ALL""",
}
