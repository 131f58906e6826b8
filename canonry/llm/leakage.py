"""Evaluation passages inside a training corpus (problem 9)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.functions.arrow_text import slices
from canonry.session import scans

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 22
#: Candidates that are verified at once.
_AT_ONCE = 1 << 16


@lru_cache(maxsize=1)
def _word_kinds() -> np.ndarray:
    """1 for letters and digits, 2 for marks, 0 for the rest."""
    kind = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = unicodedata.category(chr(code))
        kind[code] = 1 if c[0] == "L" or c == "Nd" else 2 if c[0] == "M" else 0
    return kind


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of values[start:end] for every span, by prefix sums."""
    up, down = _powers(base, len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of some texts: their hashes, the text each belongs to, and the place of each in the folded text."""

    folded: str
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def word(self, i: int) -> str:
        return self.folded[self.start[i] : self.end[i]]


def words_of(texts: list[str | None]) -> Words:
    """The words of all texts without case, accents and marks; an unbroken run of letters or digits is a word."""
    plain = [unicodedata.normalize("NFD", t.lower()) if t else "" for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in plain], dtype=np.int64)
    kind = _word_kinds()[codes]
    keep = kind != 2
    kept = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    codes, kind, ends = codes[keep], kind[keep], kept[ends]
    codes = np.where((codes == 0x111) | (codes == 0x110), np.uint32(ord("d")), codes)
    inside = np.concatenate(([0], (kind == 1).astype(np.int8), [0]))
    edge = np.zeros(len(codes) + 1, bool)
    edge[ends] = True
    begins = (inside[1:] == 1) & ((inside[:-1] == 0) | edge)
    finish = (inside[:-1] == 1) & ((inside[1:] == 0) | edge)
    start, end = np.flatnonzero(begins), np.flatnonzero(finish)
    h = _spans(codes.astype(np.uint64) + np.uint64(1), start, end, _A)
    return Words(codes.tobytes().decode("utf-32-le", "surrogatepass"), start, end, np.searchsorted(ends, start, "right"), h)


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of `size` words that lies within one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.arange(n)
    whole = words.text[:n] == words.text[size - 1 :]
    first = first[whole]
    return _spans(words.hash, first, first + size, _B), first


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern to any part of its text, for many at once.

    `pattern` (rows x up to 64) and `text` (rows x length) hold word hashes;
    0 in a text matches nothing. Bit-parallel over the pattern, one step per
    word of the text.
    """
    rows, m = pattern.shape
    width = next(x for x in (8, 16, 32, 64) if x >= m)
    word = np.dtype(f"uint{width}").type
    top, one = word(m - 1), word(1)
    pv, mv = np.full(rows, np.iinfo(word).max, word), np.zeros(rows, word)
    score = np.full(rows, m, np.int16)
    best = score.copy()
    equal = np.zeros((rows, width), bool)
    for j in range(text.shape[1]):
        np.equal(pattern, text[:, j : j + 1], out=equal[:, :m])
        eq = np.packbits(equal, axis=1, bitorder="little").view(f"<u{width // 8}").ravel()
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int16) - ((mh >> top) & one).astype(np.int16)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        best = np.minimum(best, score)
    return best


def distance_within(pattern: list[str], text: list[str]) -> int:
    """Least edit distance of `pattern` to any part of `text`, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@dataclass
class Index:
    """The exact pieces of all test items; sent to every executor."""

    items: list
    words: Words
    first: np.ndarray  # the first word of each item
    last: np.ndarray  # one past its last word
    keys: np.ndarray
    places: np.ndarray  # sorted by key
    bitmap: np.ndarray
    window: int
    edits: int

    @property
    def piece(self) -> int:
        return self.window // (self.edits + 1)


def build_index(items: list, passages: list[str | None], window: int, edits: int) -> Index:
    """Pieces of `window` // (`edits` + 1) words at every place of every passage."""
    if not 1 <= window <= 64 or edits < 0 or window // (edits + 1) < 1:
        raise ValueError("window must be 1 to 64 words and have a word for each piece")
    words = words_of(passages)
    keys, places = grams(words, window // (edits + 1))
    order = np.argsort(keys, kind="stable")
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    number = np.arange(len(items))
    return Index(items, words, np.searchsorted(words.text, number), np.searchsorted(words.text, number, "right"), keys[order], places[order], bitmap, window, edits)


def _candidates(words: Words, index: Index) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item, first word of the item's window and of the text's span, and how many of the window's pieces are there, for every exact piece that the texts have; some at a time.

    The hits of all pieces are numbered in a row and taken in stretches of
    that row, so a piece that very many places share is split as well.
    """
    h, at = grams(words, index.piece)
    likely = index.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
    h, at = h[likely], at[likely]
    low, high = np.searchsorted(index.keys, h), np.searchsorted(index.keys, h, "right")
    ends = np.cumsum(high - low)
    w, k, g = index.window, index.edits, index.piece
    # the piece may be any of the k + 1 pieces of a window
    shifts = np.arange(k + 1) * g
    for a in range(0, int(ends[-1]) if len(ends) else 0, _AT_ONCE):
        number = np.arange(a, min(a + _AT_ONCE, int(ends[-1])))
        hit = np.searchsorted(ends, number, "right")
        place = index.places[high[hit] - (ends[hit] - number)]
        start, begin = (place[:, None] - shifts).ravel(), (at[hit][:, None] - shifts - k).ravel()
        doc, item = np.repeat(words.text[at[hit]], k + 1), np.repeat(index.words.text[place], k + 1)
        ok = (start >= index.first[item]) & (start + w <= index.last[item])
        if ok.any():
            # one number a candidate, as numbers sort faster than rows
            size, words_, reach = len(words.hash) + w + 2 * k, len(index.words.hash), w + k
            key, votes = np.unique((doc[ok] * words_ + start[ok]) * size + begin[ok] + reach, return_counts=True)
            owner, start = key // size // words_, key // size % words_
            yield owner, index.words.text[start], start, key % size - reach, votes


def find_hits(texts: list[str | None], index: Index) -> list[tuple[int, int, int]]:
    """Text and item (by place) such that a window of the item occurs in the text within the error budget, and the least number of errors."""
    if not len(index.keys):
        return []
    words = words_of(texts)
    w, k = index.window, index.edits
    padded = np.concatenate((words.hash, [np.uint64(0)]))
    text_of_word = np.concatenate((words.text, [-1]))
    found: dict[tuple[int, int], int] = {}

    def verify(d: np.ndarray, i: np.ndarray, s: np.ndarray, b: np.ndarray) -> None:
        span = b[:, None] + np.arange(w + 2 * k)
        span = np.where((span >= 0) & (span < len(words.hash)), span, len(words.hash))
        span = np.where(text_of_word[span] == d[:, None], span, len(words.hash))
        pattern, text = index.words.hash[s[:, None] + np.arange(w)], padded[span]
        # of a window with at most k errors all words but k stand at most k places off
        near = sum(np.count_nonzero(pattern == text[:, o : o + w], axis=1) for o in range(2 * k + 1)) >= w - k
        d, i, s, span = d[near], i[near], s[near], span[near]
        distance = myers(pattern[near], text[near])
        # the nearest of a pair's windows first, so that others needn't be compared word by word
        for j in np.flatnonzero(distance <= k)[np.argsort(distance[distance <= k], kind="stable")]:
            pair = (int(d[j]), int(i[j]))
            if found.get(pair, k + 1) <= distance[j]:
                continue
            own = [words.word(x) for x in span[j] if x < len(words.hash)]
            true = distance_within([index.words.word(x) for x in range(s[j], s[j] + w)], own)
            if true <= k:
                found[pair] = min(true, found.get(pair, true))

    for *cand, votes in _candidates(words, index):
        d, i, s, b = cand
        pair = d * len(index.items) + i
        # a window that has all its pieces is the likeliest; an exact one settles its pair, and the others of the pair needn't be tried
        likely = np.flatnonzero(votes == k + 1)
        first = likely[np.unique(pair[likely], return_index=True)[1]]
        verify(d[first], i[first], s[first], b[first])
        exact = np.array([x * len(index.items) + y for (x, y), n in found.items() if not n], np.int64)
        rest = ~np.isin(pair, exact)
        rest[first] = False
        verify(d[rest], i[rest], s[rest], b[rest])
    return sorted((d, i, n) for (d, i), n in found.items())


def leaked_items(
    documents: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, passage: Column,
    window: int = 12, edits: int = 1, block_chars: int = 8 << 20, slice_bytes: int = 2 << 20,
) -> DataFrame:
    """`doc_id`, `item_id`, `distance` of every document that holds a window of an item's passage.

    A window is `window` consecutive words of the passage; it occurs if the
    text has it with at most `edits` words inserted, left out or replaced;
    `distance` is the least number of these over all windows, 0 for an exact
    one. Words are unbroken runs of letters or digits, compared without case
    and accents. Each window has `edits` + 1 pieces, of which one must occur
    exactly; piece hits are found by hash over all texts, verified by
    Myers' bit-parallel distance, and the words themselves compared last.

    The items are sent to the executors in blocks of at most `block_chars`
    characters. Beyond one block each is a pass over the documents that is
    written before the next block is built, so one block is held at a time.
    Null and short passages and null texts give nothing; repeated documents,
    items and hits give one row.
    """
    spark = documents.sparkSession
    rows = documents.where(text.isNotNull()).select(doc_id.alias("doc_id"), text.alias("text"))
    asked = items.where(passage.isNotNull() & item_id.isNotNull()).select(item_id.alias("item_id"), passage.alias("passage"))
    schema = T.StructType([rows.schema["doc_id"], asked.schema["item_id"], T.StructField("distance", T.IntegerType())])
    kind = pa.int64() if isinstance(asked.schema["item_id"].dataType, T.LongType) else None

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b in slices(batch["text"], slice_bytes):
                    part = batch.slice(a, b - a)
                    hits = find_hits(part["text"].to_pylist(), index)
                    if hits:
                        doc, item, distance = zip(*hits)
                        yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(doc)), pa.array([index.items[i] for i in item], kind), pa.array(distance, pa.int32())], schema.names)

        return rows.mapInArrow(run, schema)

    parts = scans(spark, (build_index(ids, passages, window, edits) for ids, passages in _blocks(asked, block_chars)), scan)
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and passages of at most `block_chars` characters, or of one item; at least one block."""
    ids, passages, size = [], [], 0
    for row in items.toLocalIterator():
        if size + len(row.passage) > block_chars and ids:
            yield ids, passages
            ids, passages, size = [], [], 0
        ids.append(row.item_id)
        passages.append(row.passage)
        size += len(row.passage)
    yield ids, passages
