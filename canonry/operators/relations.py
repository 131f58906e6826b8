"""Relations between documents from their texts, by rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.functions import vocabulary as V
from canonry.functions.legal import is_legal_document
from canonry.functions.text import letters_digits
from canonry.operators.chunker import chunk_documents

def citation(laws: dict[str, str] = V.LAW_NUMBERS, strict: bool = False) -> str:
    """The pattern of a citation by number or by name; `laws` has the numbers of laws by their names in small letters."""
    names = "|".join(re.sub(r"([.()\[\]\\+*?^$|{}])", r"\\\1", n) for n in sorted(laws, key=len, reverse=True))
    return f"(?iuU)(?:{V.CITED_STRICT if strict else V.CITED_ANY}|{V.CITED_LAW.format(names=names)})"


def mentions(texts: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """`key`, `pos` from 1, `at` from 1, `cited` of every citation, with what stands before (`window`) and around it (`context`), and the text.

    The text is split at the citations, so the pieces between them give each
    mention's place without a search per mention.
    """
    col = F.col(text)
    found = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    rows = texts.where(col.isNotNull()).select(*key, col.alias("__text"), found.alias("__found")).where(F.size("__found") > 0)
    rows = rows.withColumn("__between", F.split("__text", pattern))
    each = rows.select(*key, "__text", "__found", "__between", F.posexplode("__found").alias("__p", "cited"))
    before = F.aggregate(F.slice(F.col("__between"), 1, F.col("__p") + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(F.col("__found"), 1, F.col("__p")), F.lit(0), lambda s, x: s + F.length(x))
    placed = each.withColumn("at", before + 1)
    start = F.greatest(F.col("at") - V.LOOK_BACK, F.lit(1))
    return placed.select(
        *key, F.col("__text").alias(text), (F.col("__p") + 1).alias("pos"), "at", "cited",
        F.lower(F.substr("__text", start, F.col("at") - start)).alias("window"),
        F.trim(F.replace(F.substr("__text", start, F.col("at") - start + F.length("cited") + V.LOOK_BACK), F.lit("\n"), F.lit(" "))).alias("context"),
    )


def cited_document(cited: Column, laws: dict[str, str]) -> Column:
    """What a citation names: its number in upper case, the number of a law that is known by name (the longest name counts), else the name with capitals."""
    number = F.regexp_extract(cited, f"(?iuU)(?:{V.CITED_ANY})", 0)
    known = law_number(cited, laws)
    return F.when(number != "", F.upper(number)).otherwise(F.coalesce(known, F.replace(F.initcap(cited), F.lit("Năm"), F.lit("năm"))))


def law_number(name: Column, laws: dict[str, str]) -> Column:
    """The number of the law that the text names; null for other texts."""
    names = sorted(laws, key=len, reverse=True)
    found = F.get(F.filter(F.array(*map(F.lit, names)), lambda law: F.contains(F.lower(name), law)), F.lit(0))
    return F.try_element_at(F.create_map(*[F.lit(x) for law in names for x in (law, laws[law])]), found)


def label(window: Column, words: list[tuple[str, list[str]]] = V.RELATION_WORDS) -> Column:
    """The relation whose keyword begins last before the mention; of keywords at one place the earlier relation's; without one the default."""
    named = {w: name for name, group in reversed(words) for w in group}
    # the longest beginning leaves the last place; alternatives are tried in the order of the relations
    last = F.regexp_extract(window, "(?s)^.*(" + "|".join(w for _, group in words for w in group) + ")", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), last), F.lit(V.DEFAULT_RELATION))


def extract_relations(texts: DataFrame, source: str, text: str, laws: dict[str, str] = V.LAW_NUMBERS) -> DataFrame:
    """`source`, `target`, `edge_label`, `target_article`, `target_clause`, `mentions`, `is_cross_doc`, `context`: one row per source and target.

    Texts are cut by the structure scanner; every citation by number or by
    name in a chunk is a mention. The words before it name the relation; in a
    line that starts like one of a preamble those of preambles. The first mention
    gives the relation, the context, and the chunk's first article and
    clause. What a passive clause says (see `passive_chains`) goes before
    mentions. A document's own number and names that aren't those of
    documents are no targets; texts without a source give nothing.
    """
    named = texts.where(F.col(source).isNotNull())
    chunks = chunk_documents(named, F.col(text), {source: F.col(source)}).select(F.col(source).alias("source"), "chunk_index", "content")
    found = mentions(chunks, ["source", "chunk_index"], "content", citation(laws)).withColumn("target", cited_document(F.col("cited"), laws))
    kept = found.where(is_legal_document("target") & (letters_digits("source") != letters_digits("target")))
    edge = F.when(F.substring_index(F.substr("content", F.lit(1), F.col("at") - 1), "\n", -1).rlike(V.PREAMBLE_START), label(F.col("window"), V.PREAMBLE_WORDS)).otherwise(label(F.col("window")))
    part = lambda pattern: F.regexp_extract("content", pattern, 1)
    told = kept.select("source", "target", edge.alias("edge_label"), part(V.FIRST_ARTICLE).alias("target_article"), part(V.FIRST_CLAUSE).alias("target_clause"), "context", F.lit(False).alias("is_cross_doc"), F.col("chunk_index").alias("__n"), "at")
    passive = passive_chains(named, source, text, laws).select(F.coalesce("by", source).alias("source"), F.col("changed").alias("target"), "edge_label", F.lit("").alias("target_article"), F.lit("").alias("target_clause"), F.col("clause").alias("context"), F.col("by").isNotNull().alias("is_cross_doc"), F.lit(0).alias("__n"), "at")
    fields = F.struct("edge_label", "target_article", "target_clause", "context", "is_cross_doc")
    first = told.unionByName(passive).groupBy("source", "target").agg(F.min_by(fields, F.struct("__n", "at", fields)).alias("r"), F.count("*").alias("mentions"))
    return first.select(F.col("source").alias(source), "target", "r.*", "mentions")


def passive_chains(texts: DataFrame, key: str, text: str, laws: dict[str, str] = V.LAW_NUMBERS) -> DataFrame:
    """What the preamble says was done to a cited document by another: `key`, `changed`, `by`, `edge_label`, `at`, `clause`.

    The preamble ends at the first article, chapter, part or section; its
    clauses end at semicolons. Of two neighbouring citations with passive
    words between them the first was changed by the second. Each such pair
    gives two rows: the second changes the first, and (with a null `by`) the
    text is based on the first. Laws that are cited by name count if their
    number is known.
    """
    head = F.element_at(F.split(F.col(text), V.HEADING, 2), 1)
    clauses = texts.where(F.length(F.trim(head)) > 30).select(key, F.posexplode(F.split(F.replace(head, F.lit("\n"), F.lit(" ")), ";")).alias("__c", "clause"))
    found = mentions(clauses.where(F.col("clause").rlike(V.PASSIVE)), [key, "__c"], "clause", citation(laws, True))
    number = F.regexp_extract("cited", f"(?iuU)(?:{V.CITED_STRICT})", 0)
    named = found.withColumn("target", F.coalesce(F.upper(F.nullif(number, F.lit(""))), law_number(F.col("cited"), laws)))
    own = F.coalesce(letters_digits(F.col(key).cast("string")) == letters_digits("target"), F.lit(False))
    pair = Window.partitionBy(key, "__c", "clause").orderBy("pos")
    linked = named.where(F.col("target").isNotNull() & is_legal_document("target") & ~own).withColumns({"by": F.lead("target").over(pair), "__next": F.lead("at").over(pair)}).where(F.col("by").isNotNull())
    start = F.col("at") + F.length("cited")
    between = F.lower(F.substr("clause", start, F.col("__next") - start))
    kind = F.lit("AMENDS")
    for name, words in reversed(V.PASSIVE_WORDS):
        kind = F.when(between.rlike("|".join(words)), name).otherwise(kind)
    passive = linked.where(between.rlike(V.PASSIVE)).select(key, F.col("target").alias("changed"), "by", kind.alias("edge_label"), "at", F.trim("clause").alias("clause"))
    based = passive.withColumns({"by": F.lit(None).cast("string"), "edge_label": F.lit("BASED_ON")})
    return passive.where(F.col("by") != F.col("changed")).unionByName(based).distinct()


def case_insensitive_names(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """One spelling for names that differ in case only, a capitalised one before others, with the number of rows."""
    capital = F.when(F.col(value).rlike(r"^\p{Lu}"), 0).otherwise(1)
    kept = values.where(F.col(value).isNotNull()).groupBy(*key, F.lower(value).alias("name_key"))
    return kept.agg(F.min_by(value, F.struct(capital, F.col(value))).alias("name"), F.count("*").alias("n"))
