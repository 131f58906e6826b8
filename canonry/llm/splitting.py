"""Oversized texts cut into overlapping pieces at natural boundaries (problem 3)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.functions.arrow_text import code_points, slices, text_of, utf8_widths

_WORD, _CLAUSE, _LINE = 1, 2, 3
#: Characters that end a line, and a clause or sentence.
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
CLAUSE_ENDS = ".;:!?…。；！？"


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Blank and combining code points."""
    blank, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for code in range(0x110000):
        if chr(code).isspace():
            blank[code] = True
        elif unicodedata.category(chr(code))[0] == "M" or code in (0x200D, 0xFE0E, 0xFE0F):
            mark[code] = True
    return blank, mark


def _last_at(flag: np.ndarray) -> np.ndarray:
    """For every place 0..n the last flagged place up to it, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def cut_points(codes: np.ndarray, offsets: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every piece of the texts in `codes`, in order.

    Every place is joined to its farthest legal successor: the piece from s
    ends at the last line end up to s + limit, else clause or sentence end,
    else word start, else at s + limit; an end of a higher kind must fill half
    the limit. The next piece starts at the first word start among the last
    `overlap` characters. The successor table is squared again and again, and
    each squaring doubles the known prefix of every text's chain of cuts.
    """
    n = len(codes)
    blank, mark = _kinds()
    index = np.arange(n + 1)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    is_blank = np.concatenate((blank[codes], [True]))
    start = np.zeros(n + 1, bool)
    start[1:n] = is_blank[: n - 1] & ~is_blank[1:n]
    start &= ~first
    solid = _last_at(~is_blank)
    before = np.concatenate(([-1], solid[:-1]))
    ends_clause = np.isin(codes, [ord(c) for c in CLAUSE_ENDS])
    newline = np.isin(codes, [ord(c) for c in LINE_ENDS])
    seen = np.concatenate(([0], np.cumsum(newline)))
    level = np.where(start, _WORD, 0)
    level[start & (before >= 0) & ends_clause[np.maximum(before, 0)]] = _CLAUSE
    level[start & (seen[index] > seen[np.maximum(before, 0)])] = _LINE

    stop = np.repeat(offsets[1:], np.diff(offsets))
    here = index[:n]
    reach = np.minimum(here + limit, stop)
    # a hard cut doesn't part a letter from its marks
    joined = np.concatenate((mark[codes], [False]))
    free = _last_at(~joined)[reach]
    end = np.where(free > here + limit // 2, free, reach)
    for kind, least in ((_WORD, overlap), (_CLAUSE, limit // 2), (_LINE, limit // 2)):
        last = _last_at(level >= kind)[reach]
        end = np.where(last > here + least, last, end)
    final = here + limit >= stop
    end = np.where(final, stop, end)
    following = np.where(start, index, n + 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    shared = following[np.maximum(end - overlap, 0)]
    back = np.maximum(end - overlap, here + 1)
    after = np.where((shared < end) & (shared > here), shared, back)
    jump = np.where(final, here, after)

    heads = offsets[:-1][np.diff(offsets) > 0]
    known = [heads]
    last = heads
    while True:
        reached = jump[np.concatenate(known)]
        fresh = np.setdiff1d(reached, np.concatenate(known), assume_unique=False)
        if not len(fresh):
            break
        known.append(fresh)
        jump = jump[jump]
    starts = np.sort(np.concatenate(known))
    return np.searchsorted(offsets, starts, "right") - 1, starts, end[starts]


def split_oversized(df: DataFrame, text: Column, keep: dict[str, Column], limit: int = 2000, overlap: int = 200, texts: bool = True, slice_bytes: int = 1 << 20) -> DataFrame:
    """The pieces of every text longer than `limit` code points.

    Gives the columns of `keep`, `piece` from 1, `start_at` (from 0) and
    `end_at` (exclusive) in code points, and, with `texts`, `piece_text`.
    Pieces are at most `limit` long, cover the text and follow each other;
    each shares `overlap` characters with the one before, fewer only where
    it then starts at a word. Texts up to the limit, null and empty ones give
    no row. A text without any blank is cut by length. Repeated rows give
    repeated pieces. Only long texts leave the JVM; no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    rows = df.where(F.length(text) > limit).select(text.alias("__text"), *[e.alias(n) for n, e in keep.items()])
    schema = T.StructType([rows.schema[n] for n in keep] + [T.StructField("piece", T.IntegerType()), T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType())] + ([T.StructField("piece_text", T.StringType())] if texts else []))

    kept, names = list(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["__text"], slice_bytes):
                part = batch.slice(a, b - a)
                codes, offsets = code_points(part["__text"])
                row, start, end = cut_points(codes, offsets, limit, overlap)
                number = np.arange(len(row)) - np.searchsorted(row, row) + 1
                columns = [part[n].take(pa.array(row)) for n in kept]
                columns += [pa.array(number.astype(np.int32)), pa.array(start - offsets[row]), pa.array(end - offsets[row])]
                if texts:
                    size = end - start
                    take = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
                    place = np.concatenate(([0], np.cumsum(utf8_widths(codes), dtype=np.int64)))
                    bounds = np.concatenate(([0], np.cumsum(place[end] - place[start])))
                    whole = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(text_of(codes[take]).encode("utf-8")))
                    columns.append(whole.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
