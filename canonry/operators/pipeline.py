"""From raw contents and crawled metadata to document contexts and chunks, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions import legal as L
from canonry.functions.text import known, letters_digits
from canonry.operators.chunker import chunk_documents, citable, effective_date, table_of_contents
from canonry.operators.graph import latest

_UNKNOWN = ("N/A", "nan", "none")


def document_contexts(contents: DataFrame, metadata: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row of fields per document of `contents` (`doc_id`, `text`, `document_number`).

    `metadata` (`document_number`, `title`, `legal_type`, `issuing_authority`,
    `url`, `signers`, `issuance_date`, `legal_sectors`, `doc_status`,
    `crawled_at`) may have several crawls of a number: the last counts. The
    number falls back to the one in the first 100 lines, the year to that of
    the number, the effective date to the promulgation date. Texts stay in
    the JVM; metadata meets them on the number's letters and digits.
    """
    as_of = F.current_date().cast("string") if as_of is None else as_of
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 100), "\n")
    rows = contents.select("doc_id", "text", F.coalesce(known("document_number", *_UNKNOWN), L.document_number(head)).alias("doc_number")).withColumn("__key", letters_digits("doc_number"))
    crawls = metadata.withColumn("__key", letters_digits(known("document_number", *_UNKNOWN))).where(F.col("__key").isNotNull())
    last = latest(crawls.select("__key", "title", "legal_type", "issuing_authority", "url", "signers", "issuance_date", "legal_sectors", "doc_status", "crawled_at"), ["__key"], [F.col("crawled_at"), F.col("title")])
    joined = rows.join(last, "__key", "left")
    promulgated = F.substring(F.trim(known("issuance_date", *_UNKNOWN)), 1, 10)
    effective = F.coalesce(effective_date(F.col("text"), promulgated), promulgated)
    sectors = F.filter(F.transform(F.split(known("legal_sectors", *_UNKNOWN), ","), lambda x: F.trim(x)), lambda x: x != "")
    signer = L.signer("signers")
    return joined.select(
        "doc_id", "text", F.coalesce("doc_number", F.lit("N/A")).alias("doc_number"), F.coalesce(known("title", *_UNKNOWN), F.lit("N/A")).alias("doc_title"),
        F.coalesce(L.extract_year("issuance_date"), L.extract_year("doc_number")).alias("doc_year"), F.coalesce(sectors, F.array().cast("array<string>")).alias("sectors"),
        F.coalesce(F.nullif(F.array_join(sectors, ", "), F.lit("")), F.lit("Chung")).alias("sectors_str"),
        L.document_status(F.coalesce(known("doc_status", *_UNKNOWN), L.status_on(effective, as_of))).alias("doc_status"), known("issuing_authority", *_UNKNOWN).alias("issuing_auth"),
        signer["name"].alias("signer_name"), signer["id"].alias("signer_id"), promulgated.alias("promulgation_date"), effective.alias("final_effective_date"),
        known("legal_type", *_UNKNOWN).alias("legal_type_meta"), "url", table_of_contents("text").alias("document_toc"),
    )


def processed_chunks(contexts: DataFrame) -> DataFrame:
    """The citable chunks of document contexts, with hints; fields of the document ride along."""
    kept = ("doc_id", "doc_number", "doc_title", "doc_year", "sectors_str", "doc_status", "final_effective_date")
    chunks = chunk_documents(contexts, F.col("text"), {c: F.col(c) for c in kept})
    out = citable(chunks, F.col("doc_id").cast("string"), F.col("doc_number"), F.col("doc_title"), F.col("sectors_str"))
    return out.withColumns({"has_potential_entities": L.entity_hint("content"), "has_potential_relations": L.relation_hint("content"), "point_id": L.uuid5("chunk_id")})
