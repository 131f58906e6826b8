"""Dense and keyword retrieval, rank fusion, score boosts and context expansion.

A batch of questions is a DataFrame with a question id, so one plan answers
one question or many. Ranking of one question is a `TakeOrderedAndProject`
(a bounded heap in each task); ranking per question is a window with a rank
limit, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from canonry.session import scans


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null if either has no length or a null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dense_topk(vectors: DataFrame, query: list[float], k: int, embedding: str = "embedding", key: str = "vec_id", where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The `k` rows nearest to `query` by cosine, ties by `key`, with `score` and the columns `keep`; `where` filters before scoring, in the scan.

    A batch of vectors meets the query as one product and gives its best `k`;
    the batches' lists are merged by a bounded heap.
    """
    target = np.array(query, np.float64)
    size = np.linalg.norm(target)
    rows = (vectors if where is None else vectors.where(where)).select(key, *keep, embedding)
    schema = T.StructType([*rows.drop(embedding).schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, data = _matrix(batch[embedding], len(target))
            if not len(own) or not size:
                continue
            norms = np.linalg.norm(data, axis=1)
            real = norms > 0
            own, score = own[real], data[real] @ target / (norms[real] * size)
            # all that tie with the last one stay until the merge
            best = own if len(own) <= k else own[score >= np.partition(score, -k)[-k]]
            score = score[np.isin(own, best)]
            take = pa.array(best)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in schema.names[:-1]), pa.array(score)], schema.names)

    return rows.mapInArrow(run, schema).orderBy(F.desc("score"), key).limit(k)


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vectors of `width` numbers, none of them null."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(sizes == width)
    if lists.flatten().null_count:
        own = np.array([i for i in own if not lists[int(i)].values.null_count], np.int64)
    data = lists.take(pa.array(own, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), width)
    return own, data


def dense_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", embedding: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """`query_id`, `key`, `score`: the exact `k` nearest rows of every query.

    Queries go to the executors in blocks of at most `block_bytes` of doubles,
    each a pass over the vectors and one held at a time; a batch of rows meets a block as one matrix
    product and keeps its best `k` of each query, and a window joins the
    batches' lists. Vectors of another length, of length zero or with nulls
    are no candidates. Ties go to the lower key.
    """
    schema = T.StructType([T.StructField(query_key, T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias(key), embedding)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for r in queries.where(F.col(embedding).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(embedding).alias("v")).toLocalIterator():
            if held and size + 8 * len(r.v) > block_bytes:
                yield built(held)
                held, size = [], 0
            held.append((r.q, r.v))
            size += 8 * len(r.v)
        if held:
            yield built(held)

    def built(held: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.array([v for _, v in held], np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.array([q for q, _ in held], np.int64), np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                own, data = _matrix(batch[embedding], matrix.shape[1])
                if not len(own):
                    continue
                size = np.linalg.norm(data, axis=1)
                keys = batch[key].to_numpy(zero_copy_only=False)[own][size > 0]
                scores = matrix @ (data[size > 0] / size[size > 0, None]).T
                out = []
                for q in range(len(ids)):
                    best = np.lexsort((keys, -scores[q]))[:k]
                    out.append((np.full(len(best), ids[q]), keys[best], scores[q][best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema.names)

        return rows.mapInArrow(run, schema)

    parts = scans(vectors.sparkSession, blocks(), scan)
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def words(text: Column | str) -> Column:
    """ASCII words of the lower-case text."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), "[^a-z0-9]+"), lambda w: w != "")


#: Folders of an index: words are spread over them, and a question opens those of its words.
BUCKETS = 64


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def bm25_index(documents: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, tokens=words) -> DataFrame:
    """`bucket`, `word`, `key`, `weight`: for every word of every document what it adds to the document's BM25 score.

    The weights hold the whole formula, so a question is a lookup of its
    words and a sum. Documents with null texts count as documents without
    words. Built once and stored by `bucket` (see `stored`), rows of a bucket
    sorted by word, so that a reader skips the row groups of other words; a
    very frequent word's rows are spread over several files.
    """
    listed = documents.select(key, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("w")).select(key, F.size("w").alias("n"), F.col("w"))
    totals = listed.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).select(F.struct("docs", "mean")).scalar()
    counted = listed.select(key, "n", F.explode("w").alias("word")).groupBy(key, "n", "word").agg(F.count("*").alias("tf"))
    frequency = counted.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log(1 + (totals["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / totals["mean"]))
    rows = counted.join(frequency, "word").select(_bucket(F.col("word")).alias("bucket"), "word", key, weight.alias("weight"))
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", key)


def bm25_topk(index: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", tokens=words) -> DataFrame:
    """`query_id`, `key`, `score`, `rank` of the best documents of every query by BM25, from a `bm25_index`.

    Up to 100 000 pairs of question and word are looked up by a filter that
    picks their folders and row groups; more meet the index in a join.
    """
    spread = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))
    asked = queries.select("query_id", F.array_distinct(tokens("query")).alias("words")).select("query_id", "words", F.transform("words", spread).alias("buckets"))
    held, pairs = asked.limit(_FEW + 1).collect(), []
    for r in held:
        pairs += [(r.query_id, w, b) for w, b in zip(r.words or (), r.buckets or ())]
        if len(pairs) > _FEW:
            break
    if len(held) <= _FEW and len(pairs) <= _FEW:
        ids, sought, buckets = zip(*pairs) if pairs else ((), (), ())
        local = pa.table({"query_id": pa.array(ids, pa.int64()), "word": pa.array(sought, pa.string())})
        index = index.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("word").isin(sorted(set(sought))))
        wanted = F.broadcast(queries.sparkSession.createDataFrame(local))
    else:
        wanted = asked.select("query_id", F.explode("words").alias("word"))
    scored = index.join(wanted, "word").groupBy("query_id", key).agg(F.round(F.sum("weight"), 9).alias("score"))
    return ranked(scored, k, key)


#: Words that are sent to every executor at most.
_FEW = 100_000


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """The arrays cut to the `k` best scores of every query; ties go to the lower key."""
    order = np.lexsort((key, -score, query))
    sorted_query = query[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
    kept = order[place < k]
    return [x[kept] for x in (query, key, score, *more)]


def _word_blocks(queries: DataFrame, asked: Column, size: int, most_words: int = 32_768) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Blocks of at most `size` queries with about `most_words` words (a query with more is a block of its own): their ids, their distinct words, and which query (column) has which word (row)."""
    def built(held: list) -> tuple[np.ndarray, list[str], np.ndarray]:
        vocabulary = sorted({w for r in held for w in r.w})
        at = {w: i for i, w in enumerate(vocabulary)}
        has = np.zeros((len(vocabulary), len(held)), bool)
        for q, r in enumerate(held):
            has[[at[w] for w in r.w], q] = True
        return np.array([r.q for r in held], np.int64), vocabulary, has

    held, known = [], set()
    for r in queries.select(F.col("query_id").cast("long").alias("q"), F.array_distinct(asked).alias("w")).where(F.size("w") > 0).toLocalIterator():
        if held and (len(held) == size or len(known) + len(r.w) > most_words):
            yield built(held)
            held, known = [], set()
        held.append(r)
        known.update(r.w)
    if held:
        yield built(held)


def _top(scores: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, query) of the scores that may be among a query's best `k` and reach `least`; ties with the last one too."""
    bar = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], least)
    return np.nonzero((scores >= np.maximum(bar, least)[None]) & (scores > 0))


def bm25_every(documents: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, tokens=words, block: int = 1024, step: int = 1000, words_at_once: int = 2048) -> DataFrame:
    """The rows of `bm25_topk` for so many queries that their matches can't be shuffled.

    Queries go to the executors in blocks, each two passes over the documents:
    one counts the block's words, one scores `step` documents against the
    block by matrix products and keeps the best `k` of each query in a task.
    """
    kind = documents.schema[key].dataType
    listed = documents.select(key, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("w"))
    counts_schema = "word long, n long, size long"
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    context = documents.sparkSession.sparkContext

    def found(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Length of every document; row, word and count of the words that occur."""
        lists = batch["w"]
        size = np.diff(lists.offsets.to_numpy())
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        pairs, tf = np.unique(row[ids >= 0].astype(np.int64) * max(len(vocabulary), 1) + ids[ids >= 0], return_counts=True)
        return size, pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1), tf

    def scan(shared: Broadcast) -> DataFrame:
        vocabulary = shared.value[1]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(shared.value[1], pa.string())
            df, docs, total = np.zeros(len(names), np.int64), 0, 0
            for batch in batches:
                size, _, word, _ = found(batch, names)
                df += np.bincount(word, minlength=len(names))
                docs, total = docs + len(size), total + int(size.sum())
            word = np.append(np.flatnonzero(df), -1)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(df[df > 0], docs)), pa.array(np.append(np.zeros(len(word) - 1, np.int64), total))], ["word", "n", "size"])

        df = np.zeros(len(vocabulary))
        docs = total = 0
        for r in listed.mapInArrow(count, counts_schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect():
            if r.word < 0:
                docs, total = r.n, r["size"]
            else:
                df[r.word] = r.n
        weights = context.broadcast((np.log(1 + (docs - df + 0.5) / (df + 0.5)), total / docs if total else 1.0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (ids, vocabulary, has), (idf, mean) = shared.value, weights.value
            names, best = pa.array(vocabulary, pa.string()), None
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    size, row, word, tf = found(batch, names)
                    weight = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
                    used, place = np.unique(word, return_inverse=True)
                    scores = np.zeros((len(size), len(ids)))
                    for at in range(0, len(used), words_at_once):
                        inside = (place >= at) & (place < at + words_at_once)
                        dense = np.zeros((len(size), len(used[at : at + words_at_once])))
                        dense[row[inside], place[inside] - at] = weight[inside]
                        scores += dense @ has[used[at : at + words_at_once]].astype(np.float64)
                    scores = np.round(scores, 9)
                    r, q = _top(scores, 0.0, k)
                    keys = np.array(batch[key].to_pylist())
                    new = [ids[q], keys[r], scores[r, q]]
                    best = _best(*(np.concatenate(x) for x in zip(best, new)), k) if best else _best(*new, k)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1].tolist(), pa.string() if isinstance(kind, T.StringType) else pa.int64()), pa.array(best[2])], schema.names)

        return listed.mapInArrow(run, schema)

    parts = scans(documents.sparkSession, _word_blocks(queries, tokens("query"), block), scan)
    if not parts:
        return documents.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return ranked(reduce(DataFrame.unionByName, parts), k, key)


#: Which bytes are ASCII letters or digits.
_WORD_BYTES = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])


def _runs(texts: pa.Array, least: int) -> tuple[np.ndarray, pa.Array]:
    """Row and letters of every run of at least `least` ASCII letters and digits; each text ends with another character."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    edges = np.flatnonzero(np.diff(_WORD_BYTES[data].view(np.int8), prepend=np.int8(0)))
    first, last = edges[::2], edges[1::2]
    long = last - first >= least
    first, last = first[long], last[long]
    spans = np.diff(np.column_stack([first, last]).ravel(), prepend=0, append=len(data))
    letters = data[np.repeat(np.arange(len(spans)) % 2 == 1, spans)]
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(last - first)])
    return np.searchsorted(offsets[1:] - offsets[0], first, side="right"), pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(starts), pa.py_buffer(letters)])


def _contained(texts: pa.Array, known: dict[bytes, int], lengths: dict[bytes, set[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every word of `known` that is part of the text, once a row, in order of rows.

    A word has letters and digits only, so it lies within one run of them;
    each distinct run is looked up once. `lengths` has the words' lengths by
    their first `least` letters.
    """
    row, runs = _runs(texts, least)
    runs = runs.dictionary_encode()
    found, sizes = [], []
    for run in runs.dictionary.to_pylist():
        inside = set()
        for at in range(len(run) - least + 1):
            for n in lengths.get(run[at : at + least], ()):
                inside.add(known.get(run[at : at + n], -1))
        inside.discard(-1)
        found += inside
        sizes.append(len(inside))
    ids, sizes = runs.indices.to_numpy(), np.array(sizes, np.int64)
    each = sizes[ids]
    begin = (np.cumsum(sizes) - sizes)[ids]
    at = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())
    pairs = np.unique(np.repeat(row, each) * max(len(known), 1) + np.array(found, np.int64)[at])
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


def _asked_blocks(queries: DataFrame, asked: Column, size: int, most_words: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """Blocks of at most `size` queries with at most `most_words` words (a query with more is a block of its own): their ids; their distinct words, the most frequent first; where each word's queries end; the queries (places) word by word."""
    def built(held: list) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        of = {}
        for q, r in enumerate(held):
            for w in r.w:
                of.setdefault(w, []).append(q)
        vocabulary = sorted(of, key=lambda w: (-len(of[w]), w))
        return np.array([r.q for r in held], np.int64), vocabulary, np.cumsum([len(of[w]) for w in vocabulary]), np.array([q for w in vocabulary for q in of[w]], np.int32)

    held, count = [], 0
    # gathered first, as an iterator reads one partition after the other
    for r in queries.select(F.col("query_id").cast("long").alias("q"), F.array_distinct(asked).alias("w")).where(F.size("w") > 0).hint("rebalance").toLocalIterator():
        if held and (len(held) == size or count + len(r.w) > most_words):
            yield built(held)
            held, count = [], 0
        held.append(r)
        count += len(r.w)
    if held:
        yield built(held)


def rescue_every(documents: DataFrame, queries: DataFrame, key: str, text: str, least: int = 2, per_hit: float = 0.1, most: int = 10, longer_than: int = 3, block: int = 16_384, step: int = 1000, table_bytes: int = 1 << 25) -> DataFrame:
    """`keyword_rescue` for each of many queries, in one pass over the documents for each block of them.

    The words of the block are looked up in a text's distinct words. A word's
    queries are a row of a table where frequent (at most `table_bytes`), else
    a list; the rows of a text's words are added up. Only hits that reach a
    query's `most`-th best so far are kept.
    """
    asked = F.filter(words("query"), lambda w: F.length(w) > longer_than)
    lowered = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.concat(F.lower(F.col(text)), F.lit(" ")).alias("t"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("hits", T.IntegerType())])
    shortest, slice_bytes = max(longer_than + 1, 1), 1 << 23

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vocabulary, ends, asking = shared.value
            known, lengths = {w.encode(): i for i, w in enumerate(vocabulary)}, {}
            for w in known:
                lengths.setdefault(w[:shortest], set()).add(len(w))
            largest = int(np.bincount(asking).max())
            kind = np.dtype(np.uint8 if largest < 255 else np.uint16 if largest < 65535 else np.int32)
            lists = np.split(asking, ends[:-1])
            rows = np.zeros((min(len(vocabulary), table_bytes // (len(ids) * kind.itemsize)), len(ids)), kind)
            for line, places in zip(rows, lists):
                line[places] = 1
            best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
            new, waiting, width = [], 0, 16
            full, bar, bar_key = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

            def merged() -> list[np.ndarray]:
                out = _best(*(np.concatenate(x) for x in zip(best, *new)), most)
                count = np.bincount(out[0], minlength=len(ids))
                full[:] = count == most
                last = (np.cumsum(count) - 1)[full]
                bar[full], bar_key[full] = out[2][last], out[1][last]
                return out

            for whole in batches:
                whole = whole.take(pa.array(np.argsort(whole[key].to_numpy(zero_copy_only=False), kind="stable")))
                keys, sizes = whole[key].to_numpy(zero_copy_only=False), np.cumsum(pc.binary_length(whole["t"]).to_numpy(zero_copy_only=False), dtype=np.int64)
                start = 0
                while start < len(keys):
                    end = min(start + width, max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + slice_bytes))), len(keys))
                    hits = np.zeros((end - start, len(ids)), kind)
                    for r, w in zip(*(x.tolist() for x in _contained(whole["t"].slice(start, end - start), known, lengths, shortest))):
                        if w < len(rows):
                            np.add(hits[r], rows[w], out=hits[r])
                        else:
                            hits[r, lists[w]] += 1
                    # keys ascend within a batch, so a tie with the last one counts only against a higher key
                    reach = np.maximum(np.where(full, bar + (bar_key < keys[start]), least), 1)
                    r, q = np.nonzero(hits >= np.minimum(reach, np.iinfo(kind).max).astype(kind))
                    if len(r):
                        new.append((q, keys[start + r], hits[r, q].astype(np.int32)))
                        waiting += len(r)
                    if waiting >= most * len(ids) or (new and width < step):
                        best, new, waiting = merged(), [], 0
                    start, width = end, min(2 * width, step)
            if new:
                best = merged()
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema.names)

        return lowered.mapInArrow(run, schema)

    parts = scans(documents.sparkSession, _asked_blocks(queries, asked, block), scan)
    hits = reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], schema)
    return ranked(hits.withColumn("score", F.round(F.col("hits") * per_hit, 6)), most, key)


def ranked(hits: DataFrame, k: int, key: str, by: str | list[str] = "query_id", score: str = "score") -> DataFrame:
    """The best `k` hits of each query with their `rank`; ties go to the lower key."""
    place = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def fuse_ranks(lists: list[DataFrame], k: int, key: str, constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over lists with `query_id`, `key`, `rank`."""
    united = reduce(DataFrame.unionByName, [x.select("query_id", key, "rank") for x in lists])
    fused = united.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return ranked(fused, k, key)


def boosted(hits: DataFrame, rules: list[tuple[Column, float]], score: str = "score") -> DataFrame:
    """Adds the amount of every rule whose condition holds; a null condition doesn't hold."""
    total = F.col(score)
    for condition, amount in rules:
        total = total + F.when(condition, amount).otherwise(0.0)
    return hits.withColumn(score, total)


def keyword_rescue(documents: DataFrame, question: Column, key: str, text: str, least: int = 2, per_hit: float = 0.1, most: int = 10, longer_than: int = 3) -> DataFrame:
    """Documents that contain at least `least` of the question's words, `per_hit` points for each.

    `documents` may have a question per row (joined before) or a literal one.
    """
    asked = F.array_distinct(F.filter(words(question), lambda w: F.length(w) > longer_than))
    hits = F.size(F.filter(asked, lambda w: F.contains(F.lower(F.col(text)), w)))
    found = documents.withColumn("hits", hits).where(F.col("hits") >= least)
    return found.withColumn("score", F.round(F.col("hits") * per_hit, 6)).orderBy(F.desc("score"), key).limit(most)


def neighbours(rows: DataFrame, hits: DataFrame, parent: str, index: str, distance: int = 1) -> DataFrame:
    """Rows of the same parent whose index is within `distance` of a hit's; gaps in the index stay gaps."""
    near = hits.select(F.col(parent), F.col(index).alias("hit_index"), F.explode(F.sequence(F.col(index) - distance, F.col(index) + distance)).alias(index))
    return rows.join(near, [parent, index])


def siblings(rows: DataFrame, parents: list[str], order: list[Column | str], text: str, most: int, name: str = "context") -> DataFrame:
    """The first `most` texts of every parent in order, joined by newlines. The rank limit bounds what is gathered."""
    place = Window.partitionBy(*parents).orderBy(*order)
    first = rows.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= most)
    gathered = F.array_sort(F.collect_list(F.struct("__n", text)))
    return first.groupBy(*parents).agg(F.array_join(F.transform(gathered, lambda x: x[text]), "\n").alias(name), F.count("*").alias("pieces"))


def interleaved(rank: Column, total: Column) -> Column:
    """Position that puts the best hits at both ends: odd ranks from the left, even ranks from the right."""
    return F.when(total <= 2, rank).when(rank % 2 == 1, F.floor((rank + 1) / 2)).otherwise(total - F.floor(rank / 2) + 1).cast("long")


def session_first(hits: DataFrame, own: Column, threshold: float = 0.45, relax: float = 0.7) -> DataFrame:
    """Hits of the session if its best reaches the threshold, relaxed beyond the best; all hits otherwise."""
    best = hits.agg(F.max(F.when(own, F.col("score")))).scalar()
    return hits.where(F.when(best >= threshold, own & (F.col("score") >= threshold * relax)).otherwise(True))


def filters(equal: dict[str, object] | None = None, contains: dict[str, str] | None = None, any_of: list[Column] | None = None, active: str | None = None) -> Column:
    """One condition from equalities, texts to contain, alternatives of which one must hold, and an active flag."""
    out = F.lit(True)
    for name, value in (equal or {}).items():
        out = out & (F.col(name) == value)
    for name, value in (contains or {}).items():
        out = out & F.contains(F.lower(F.col(name)), F.lit(value.lower()))
    if any_of:
        out = out & reduce(lambda a, c: a | c, any_of)
    return out & F.col(active) if active else out


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """`first` if it has rows, else `second`; decided inside the plan, so it stays lazy."""
    some = first.agg(F.count("*")).scalar() > 0
    return first.unionByName(second.where(~some))
