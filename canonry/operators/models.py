"""Contracts of the models that stay outside, with deterministic stand-ins, and the parsing of what they return."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.functions import legal as L


class Reranker(Protocol):
    """Scores of texts for a question, higher is better; must be picklable."""

    def scores(self, question: str, texts: list[str]) -> list[float]: ...


class Embedder(Protocol):
    """Vectors of texts; must be picklable."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """Raw JSON answers for prompts; must be picklable."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class OverlapReranker:
    """Stand-in: the share of the question's words that a text has."""

    def scores(self, question: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", question.lower()))
        return [len(asked & set(re.findall(r"\w+", (t or "").lower()))) / (len(asked) or 1) for t in texts]


class Retriever(Protocol):
    """The best `k` rows for each of many questions (`query_id`, `query`): `query_id`, a key, `score`, `rank`."""

    def search(self, questions: DataFrame, k: int) -> DataFrame: ...


@dataclass
class Strategy:
    """An answer's steps as functions of DataFrames; each takes what the step before gives."""

    understand: Callable[[DataFrame], DataFrame]
    retrieve: Callable[[DataFrame], DataFrame]
    generate: Callable[[DataFrame], DataFrame]
    reflect: Callable[[DataFrame], DataFrame] = lambda answers: answers

    def answer(self, questions: DataFrame) -> DataFrame:
        """The answers to the questions."""
        return self.reflect(self.generate(self.retrieve(self.understand(questions))))


class HashEmbedder:
    """Stand-in: words hashed into `width` places, so that texts with the same words have the same vector."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.width
            for word in re.findall(r"\w+", text.lower()):
                vector[zlib.crc32(word.encode()) % self.width] += 1.0
            out.append(vector)
        return out


def rerank(hits: DataFrame, model: Reranker, question: str, text: str) -> DataFrame:
    """`hits` with `rerank_score` and `rerank_error`; a model that fails on a question's texts gives 0, so the order before holds, and its error."""
    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("rerank_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, errors = pd.Series(0.0, index=batch.index), pd.Series(None, index=batch.index, dtype=object)
            for asked, part in batch.groupby(question, dropna=False):
                try:
                    out[part.index] = model.scores(asked or "", part[text].fillna("").tolist())
                except Exception as e:  # noqa: BLE001
                    errors[part.index] = f"{type(e).__name__}: {e}"
            yield batch.assign(rerank_score=out, rerank_error=errors)

    return hits.mapInPandas(run, schema)


def embed(rows: DataFrame, model: Embedder, text: Column, name: str = "embedding", at_once: int = 64) -> DataFrame:
    """`rows` with the vectors of `text` as a model gives them, `at_once` texts a call; null where the text is null or the model fails, with the error in `<name>_error`."""
    inner = rows.withColumn("__text", L.embedding_input(text)).withColumn("__null", text.isNull())
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField(f"{name}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = [None] * len(batch), [None] * len(batch)
            own = [i for i, null in enumerate(batch["__null"]) if not null]
            for a in range(0, len(own), at_once):
                part = own[a : a + at_once]
                try:
                    for i, v in zip(part, model.embed([batch["__text"].iloc[i] for i in part])):
                        vectors[i] = [float(x) for x in v]
                except Exception as e:  # noqa: BLE001
                    for i in part:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield batch.drop(columns=["__text", "__null"]).assign(**{name: vectors, f"{name}_error": errors})

    return inner.mapInPandas(run, schema)


def asked_model(contexts: DataFrame, model: Extractor, key: str, text: str, prompt: Callable[[list[str]], str], per_prompt: int = 12) -> DataFrame:
    """`keys`, `answer`, `error`: what a model answers about up to `per_prompt` different contexts at a time.

    `prompt` makes one text of the contexts. Equal contexts of a key are
    asked once. A failed call leaves its error, so that a later run can ask
    again what has no answer.
    """
    rows = contexts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), per_prompt):
                part, answer, error = batch.iloc[a : a + per_prompt], None, None
                try:
                    answer = model.complete([prompt(part["text"].tolist())])[0]
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"keys": [part["key"].tolist()], "answer": [answer], "error": [error]})

    return rows.mapInPandas(run, "keys array<string>, answer string, error string")


def first_json(text: str | None) -> str | None:
    """The first balanced object in a text that is JSON, after trailing commas are removed."""
    text = text or ""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if c == "\\" and quoted:
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    candidate = re.sub(r",\s*([\]}])", r"\1", text[start : i + 1])
                    try:
                        json.loads(candidate)
                        return candidate
                    except ValueError:
                        break
            i += 1
    return None


RESPONSE = "struct<doc_relations: array<struct<source: string, target: string, edge_label: string, relation_phrase: string, target_article: string>>, entities: map<string, array<string>>, node_relations: array<struct<source_node: string, source_type: string, target_node: string, target_type: string, relationship: string>>>"


def parse_responses(responses: DataFrame, answer: str) -> DataFrame:
    """`responses` with `parsed` (null if there is no JSON in the answer)."""
    found = F.pandas_udf(lambda s: s.map(first_json), "string")
    return responses.withColumn("parsed", F.from_json(found(answer), RESPONSE))


def response_entities(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Distinct entities of parsed answers with canonical labels and names; structural labels and vague names are left out."""
    rows = parsed.select(*key, F.explode("parsed.entities").alias("label", "names")).select(*key, L.entity_type("label").alias("entity_type"), F.explode("names").alias("raw"))
    named = rows.select(*key, "entity_type", L.entity_name("raw").alias("name"))
    return named.where(F.col("name").isNotNull() & ~F.col("entity_type").isin("Document", "LegalArticle")).distinct()


def response_relations(parsed: DataFrame, key: list[str]) -> DataFrame:
    """Distinct relations of parsed answers between named nodes, with canonical names."""
    rows = parsed.select(*key, F.explode("parsed.node_relations").alias("r"))
    out = rows.select(*key, L.entity_name("r.source_node").alias("source"), L.relation_name("r.relationship").alias("relation"), L.entity_name("r.target_node").alias("target"))
    return out.where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()


def rename_report(edges: DataFrame, name: str, canonical: Column) -> DataFrame:
    """What a rename of relation names would change: old name, new name, edges. Nothing is written."""
    return edges.groupBy(F.col(name).alias("old"), canonical.alias("new")).agg(F.count("*").alias("edges")).where(~F.col("old").eqNullSafe(F.col("new")))
