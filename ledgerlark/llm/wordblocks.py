"""Words of a batch of texts as whole columns: bytes by one table, cuts and codes by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mapped(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by ``table``, which leaves bytes from 0x80 on alone. Null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    put = np.frombuffer(table, dtype=np.uint8)[data]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(put))


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts cut at white space: all words in a row, as places in the second result; the distinct words; where each
    text's words begin in the first (and at last its length)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, bounds = flat.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(flat.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:  # what stands before leading white space
        full = codes != empty
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        codes = codes[full]
    return codes, flat.dictionary, bounds
