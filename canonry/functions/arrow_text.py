"""Texts of an Arrow array as flat NumPy arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of `texts` in one array and the offset of each text; null counts as empty."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, starts[offsets - offsets[0]]


def utf8_widths(codes: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)


def text_of(codes: np.ndarray) -> str:
    """The text of some code points."""
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each, which bounds the memory of a step; a longer text is a range of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + size, "right")))
        yield start, stop
        start = stop
