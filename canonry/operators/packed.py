"""Several values packed in one text field, one per row with its place (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.arrow_text import code_points, slices, text_of, utf8_widths

#: Separators of values. A slash separates only next to a blank or an end.
SEPARATORS = ",;|\n\t，；•、"
SLASH = "/"
#: Texts that hold no value.
NO_VALUE = ("", "n/a", "nan", "none", "chung")

_OPEN, _CLOSE, _DOUBLE, _SINGLE, _ESCAPE, _COLON = "“", "”", '"', "'", "\\", ":"


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], np.uint32))


def split_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and parent row of every piece of the texts in `codes`; blank pieces are left out.

    All steps are array operations over the whole buffer: escapes by parity of
    the backslash runs, quotes by running parity, separators masked by both.
    A quote mark counts only where it opens a piece or closes one, so an
    apostrophe inside a word is ordinary text.
    """
    n, rows = len(codes), len(offsets) - 1
    if not n:
        return (np.zeros(0, np.int64),) * 3
    index = np.arange(n)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    row = np.repeat(np.arange(rows), np.diff(offsets))

    slash = codes == ord(_ESCAPE)
    run_start = np.maximum.accumulate(np.where(~slash | first[:n], index, -1))
    before = np.zeros(n, np.int64)
    before[1:] = index[:-1] - run_start[:-1] + (slash[run_start[:-1]])
    before[first[:n]] = 0
    escaped = (before % 2 == 1) & np.concatenate(([False], slash[:-1]))

    lut_blank = np.array([c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF) or 0x2000 <= c <= 0x200A for c in range(0x3001)] + [False])
    blank = lut_blank[np.minimum(codes, 0x3001)] & ~escaped
    beside = np.zeros(n, bool)
    beside[1:] |= blank[:-1]
    beside[:-1] |= blank[1:]
    beside |= first[:n] | first[1:]
    separator = (_among(codes, SEPARATORS) | ((codes == ord(SLASH)) & beside)) & ~escaped
    bracket_open, bracket_close = (codes == ord("[")) & ~escaped, (codes == ord("]")) & ~escaped

    solid = ~blank | separator
    last_solid = np.maximum.accumulate(np.where(solid, index, -1))
    prev = np.concatenate(([-1], last_solid[:-1]))
    prev = np.where(prev >= offsets[row], prev, -1)
    next_solid = np.minimum.accumulate(np.where(solid, index, n)[::-1])[::-1]
    following = np.concatenate((next_solid[1:], [n]))
    following = np.where(following < offsets[row + 1], following, -1)
    at_start = (prev < 0) | separator[prev] | bracket_open[prev]
    at_end = (following < 0) | separator[following] | bracket_close[following] | (codes[following] == ord(_COLON))

    quoted = np.zeros(n, bool)
    for mark in (_DOUBLE, _SINGLE):
        hit = (codes == ord(mark)) & ~escaped
        if mark == _SINGLE:
            hit &= at_start | at_end
        if not hit.any():
            continue
        depth = np.cumsum(hit)
        odd = (depth - (depth[offsets[row]] - hit[offsets[row]])) % 2 == 1
        # an unpaired mark quotes nothing: the last odd one of a row is undone
        total = np.add.reduceat(hit, np.minimum(offsets[:-1], n - 1)) if rows else np.zeros(0, int)
        total = np.where(np.diff(offsets) > 0, total, 0)
        stray = (total % 2 == 1)[row]
        if stray.any():
            final = np.full(rows, -1)
            np.maximum.at(final, row[hit], index[hit])
            odd &= ~(stray & (index >= final[row]))
        quoted |= odd
    curly = ((codes == ord(_OPEN)).astype(np.int64) - (codes == ord(_CLOSE))) * ~escaped
    if curly.any():
        depth = np.cumsum(curly)
        depth -= (depth[offsets[row]] - curly[offsets[row]])
        end_depth = np.zeros(rows, np.int64)
        full = np.diff(offsets) > 0
        end_depth[full] = depth[offsets[1:][full] - 1]
        quoted |= (depth > 0) & (end_depth == 0)[row]

    cut = separator & ~quoted
    outer = np.zeros(n, bool)
    head = np.zeros(n, bool)
    head[(prev < 0) & ~blank] = True
    tail = (following < 0) & ~blank
    outer |= (head & bracket_open) | (tail & bracket_close)
    paired = np.zeros(rows, np.int64)
    np.add.at(paired, row[outer], 1)
    outer &= (paired == 2)[row]

    filled = ~blank & ~cut & ~outer
    piece = np.cumsum(cut | first[:n])
    at = index[filled]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    of = piece[at]
    lead = np.concatenate(([True], of[1:] != of[:-1]))
    close = np.concatenate((lead[1:], [True]))
    return at[lead], at[close] + 1, row[at[lead]]


def _bare(values: pa.Array) -> pa.Array:
    """Values without quotes around them or their name, and without escaping."""
    values = pc.replace_substring_regex(values, r'^"((?s:.*))"(\s*:[^":]*)?$', r"\1\2")
    values = pc.replace_substring_regex(values, r"^“((?s:[^”]*))”(\s*:[^”:]*)?$", r"\1\2")
    values = pc.replace_substring_regex(values, r"^'((?s:.*))'(\s*:[^':]*)?$", r"\1\2")
    values = pc.replace_substring_regex(values, r'""', '"')
    values = pc.replace_substring_regex(values, r"\\(.)", r"\1")
    return pc.utf8_trim_whitespace(values)


def split_array(texts: pa.Array) -> pa.ListArray:
    """A list of the values of every text; null and empty texts give an empty list."""
    codes, offsets = code_points(texts)
    start, end, row = split_codes(codes, offsets)
    if not len(start):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
    place = np.concatenate(([0], np.cumsum(utf8_widths(codes), dtype=np.int64)))
    size = end - start
    take = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    data = text_of(codes[take]).encode("utf-8")
    bounds = np.concatenate(([0], np.cumsum(place[end] - place[start])))
    pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data))
    marked = pc.match_substring_regex(pieces, r"[\"'“\\]")
    if pc.any(marked).as_py():
        pieces = pc.if_else(marked, _bare(pieces), pieces)
    pieces = pc.utf8_trim_whitespace(pieces)
    held = pc.invert(pc.is_in(pc.utf8_lower(pieces), pa.array(NO_VALUE, pa.large_string()))).to_numpy(zero_copy_only=False)
    counts = np.bincount(row[held], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pieces.filter(pa.array(held)).cast(pa.string()))


def split_packed(df: DataFrame, record_id: Column, fields: list[str]) -> DataFrame:
    """One row per value: `field_name`, `record_id`, `pos` from 1, `val`.

    Values are separated by any of `SEPARATORS`, or by a slash beside a blank,
    also several kinds in one text, but not inside straight, single or curly
    quotes nor after a backslash. Blanks, brackets of a list, quotes around a
    value or its name, and escaping are removed. Empty pieces have no
    place; null, empty and blank texts and the words in `NO_VALUE` hold no
    value. A quote mark without partner is ordinary text. Repeated values and
    rows are kept. No shuffle: Arrow batches go through array operations over
    all their texts at once.
    """
    packed = df.select(record_id.cast("string").alias("record_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("raw")) for f in fields])))
    packed = packed.where(F.col("raw").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["raw"]):
                part = batch.slice(a, b - a)
                lists = split_array(part["raw"])
                parent = pc.list_parent_indices(lists).to_numpy()
                begin = lists.offsets.to_numpy()
                pos = np.arange(len(parent)) - begin[parent] + 1
                yield pa.RecordBatch.from_arrays(
                    [part["field_name"].take(pa.array(parent)), part["record_id"].take(pa.array(parent)), pa.array(pos.astype(np.int32)), lists.values],
                    ["field_name", "record_id", "pos", "val"],
                )

    return packed.select("field_name", "record_id", "raw").mapInArrow(run, "field_name string, record_id string, pos int, val string")
