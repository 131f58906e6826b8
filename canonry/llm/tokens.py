"""Encoding of a corpus by a public byte-level BPE vocabulary (problem 8).

Speculate and verify: a word's tokens are proposed by greedy longest match,
every adjacent pair is tested for compatibility by unwinding merges, and
only words with an incompatible pair are merged exactly. All three work on
the distinct words of a slice of the corpus at once.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.arrow_text import code_points, slices, utf8_widths

#: Most bytes of a vocabulary file that is sent to every executor.
MOST_VOCABULARY = 64 << 20
_LETTER, _NUMBER, _OTHER, _BLANK = 1, 2, 0, 3


def default_vocabulary() -> str:
    """The place of `byte_bpe_50k` where the public tokenizer files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, blank or other for every code point."""
    kind = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = unicodedata.category(chr(code))[0]
        if c == "L":
            kind[code] = _LETTER
        elif c == "N":
            kind[code] = _NUMBER
    kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return kind


def word_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the vocabulary's pattern start, in all texts at once.

    The pattern: an English contraction; or one space and a run of letters,
    of numbers, or of other characters; or a run of blanks, which leaves its
    last blank to what follows.
    """
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    run = np.concatenate(([True], kind[1:] != kind[:-1])) | first
    blank = kind == _BLANK
    space = codes == 32
    last_of_run = np.concatenate((run[1:], [True]))
    ends_text = np.concatenate((first[1:], [True]))
    before_word = blank & last_of_run & ~ends_text
    attached = before_word & space
    start = run.copy()
    start[1:] &= ~attached[:-1]
    start |= before_word

    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        padded = np.concatenate((codes, [0, 0]))
        row_end = offsets[1:][np.searchsorted(offsets[1:], quote, "right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < row_end)
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quote + 2 < row_end)
        for at, size, end in ((quote[one], 2, row_end[one]), (quote[two], 3, row_end[two])):
            start[at + 1] = False
            inside = at[at + size < end] + size
            start[inside] |= kind[inside] == _LETTER
    return np.flatnonzero(start)


@dataclass
class Vocabulary:
    """Ranks and the tables derived from them; small enough to be sent everywhere."""

    ranks: dict[bytes, int]
    edges: np.ndarray  # sorted: node * 256 + byte
    nodes: np.ndarray  # the child of each edge
    terminal: np.ndarray  # token id of each node, or -1
    left: np.ndarray  # the parts of the last merge of a token; a single byte's are itself
    right: np.ndarray
    pairs: np.ndarray  # sorted: left * size + right
    merged: np.ndarray  # the token of each pair

    def __len__(self) -> int:
        return len(self.left)


def merge_exactly(word: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The parts of `word` after all merges of rank under `below`, lowest rank first, leftmost on ties."""
    n = len(word)
    ends = list(range(1, n + 1))
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : ends[j]])
            if rank is not None and rank < below:
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        ends[i] = end
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : ends[i]])
        i = after[i]
    return out


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a file of base64 tokens and ranks, with its tables."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"the vocabulary has over {MOST_VOCABULARY} bytes")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    size = max(ranks.values()) + 1
    left, right = np.arange(size), np.arange(size)
    children: dict[int, int] = {}
    terminal = [-1]
    for token, rank in ranks.items():
        node = 0
        for byte in token:
            key = node * 256 + byte
            node = children.get(key, -1)
            if node < 0:
                node = children[key] = len(terminal)
                terminal.append(-1)
        terminal[node] = rank
        if len(token) > 1:
            parts = merge_exactly(token, ranks, rank)
            if len(parts) == 2:
                left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
    edges = np.fromiter(children, np.int64, len(children))
    nodes = np.fromiter(children.values(), np.int64, len(children))
    order = np.argsort(edges)
    made = np.flatnonzero(left != right)
    made = np.union1d(made, np.flatnonzero((left == right) & (left != np.arange(size))))
    pairs = left[made] * size + right[made]
    by_pair = np.argsort(pairs)
    return Vocabulary(ranks, edges[order], nodes[order], np.array(terminal), left, right, pairs[by_pair], made[by_pair])


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def compatible(a: np.ndarray, b: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Whether tokens `a` and `b` may stand side by side in an encoding.

    The last merges on both sides of the border are undone from the latest
    to the earliest; the pair is incompatible if the two parts then at the
    border would have been merged before the merge that is being undone.
    """
    size = len(vocabulary)
    a, b = a.copy(), b.copy()
    good = np.ones(len(a), bool)
    limit = np.full(len(a), 1 << 60)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        joint = _find(vocabulary.pairs, vocabulary.merged, x * size + y)
        bad = (joint >= 0) & (joint < limit[live])
        good[live[bad]] = False
        rx, ly = vocabulary.right[x], vocabulary.left[y]
        can_x, can_y = rx != x, ly != y
        undo_x = can_x & ((x > y) | ~can_y)
        undo_y = can_y & ~undo_x
        limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[live]))
        a[live] = np.where(undo_x, rx, x)
        b[live] = np.where(undo_y, ly, y)
        live = live[~bad & (undo_x | undo_y)]
    return good


def encode_words(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words of `data` and the offset of each word in them."""
    n, words = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int32), np.zeros(words + 1, np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    token, size = np.full(n, -1), np.ones(n, np.int64)
    live, node, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(live):
        node = _find(vocabulary.edges, vocabulary.nodes, node * 256 + data[live + depth])
        on = node >= 0
        live, node = live[on], node[on]
        depth += 1
        found = vocabulary.terminal[node]
        hit = found >= 0
        token[live[hit]], size[live[hit]] = found[hit], depth
        inside = live + depth < end[live]
        live, node = live[inside], node[inside]
    # proposed tokens: the positions reached from each word's first byte
    reached = np.zeros(n + 1, bool)
    at = offsets[:-1][np.diff(offsets) > 0]
    stop = end[at]
    while len(at):
        reached[at] = True
        at = at + size[at]
        on = at < stop
        at, stop = at[on], stop[on]
    place = np.flatnonzero(reached[:n])
    ids = token[place]
    word = np.searchsorted(offsets, place, "right") - 1
    same = word[1:] == word[:-1]
    wrong = np.zeros(words, bool)
    if same.any():
        pair = np.flatnonzero(same)
        bad = ~compatible(ids[pair], ids[pair + 1], vocabulary)
        wrong[word[pair[bad]]] = True
    wrong[word[ids < 0]] = True
    counts = np.bincount(word, minlength=words)
    if wrong.any():
        text = data.astype(np.uint8).tobytes()
        fixed = {w: [vocabulary.ranks[p] for p in merge_exactly(text[offsets[w] : offsets[w + 1]], vocabulary.ranks)] for w in np.flatnonzero(wrong)}
        old = np.concatenate(([0], np.cumsum(counts)))
        for w, exact in fixed.items():
            counts[w] = len(exact)
        new = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(new[-1], np.int64)
        right = ~wrong[word]
        out[np.flatnonzero(right) - old[word[right]] + new[word[right]]] = ids[right]
        for w, exact in fixed.items():
            out[new[w] : new[w + 1]] = exact
        return out.astype(np.int32), new
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


def encode_array(texts: pa.Array, vocabulary: Vocabulary) -> pa.ListArray:
    """The ids of every text; null and empty texts have an empty list."""
    codes, offsets = code_points(texts)
    if not len(codes):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
    starts = word_starts(codes, offsets)
    place = np.concatenate(([0], np.cumsum(utf8_widths(codes), dtype=np.int64)))
    data = codes.tobytes().decode("utf-32-le").encode("utf-8")
    bounds = np.concatenate((place[starts], [len(data)]))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)]).dictionary_encode()
    distinct = words.dictionary
    limits = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
    ids, at = encode_words(np.frombuffer(distinct.buffers()[2], np.uint8)[: limits[-1]].astype(np.int64), limits, vocabulary)
    which = words.indices.to_numpy()
    size = np.diff(at)[which]
    total = np.concatenate(([0], np.cumsum(size)))
    flat = ids[np.arange(total[-1]) + np.repeat(at[which] - total[:-1], size)]
    per_text = total[np.searchsorted(starts, offsets)]
    return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(flat))


def encode_corpus(df: DataFrame, doc_id: Column, text: Column, vocabulary_path: str | None = None, slice_bytes: int = 2 << 20) -> DataFrame:
    """`doc_id` and `ids`, the token ids of each whole text, without special tokens.

    Null and empty texts have an empty list of ids. Names of special tokens
    in a text are ordinary text. Repeated rows stay; extra columns are
    ignored. The work is one pass over Arrow batches without a shuffle;
    `slice_bytes` bounds what is held as arrays at once, not a text's length.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for a, b in slices(batch["text"], slice_bytes):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], encode_array(part["text"], vocabulary)], ["doc_id", "ids"])

    rows = df.select(doc_id.alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
