"""Arrow string columns as byte arrays with document offsets.

All scanning operators work on the UTF-8 bytes of half a megabyte of texts at a
time, so that one numpy call covers many documents and memory stays bounded
whatever the number of documents in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: The separators of words: space, tab, LF, VT, FF, CR.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches with matrix products on the task's own core, after
    which a worker gives back the memory that its allocators keep, since it may
    stand idle beside others for long."""

    def inner(batches: Iterator) -> Iterator:
        one_thread()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return inner


@lru_cache(1)
def one_thread() -> None:
    """Every core has a task: threads of one task's matrix products would wait for the others', turning."""
    import ctypes

    try:
        with open("/proc/self/maps", encoding="utf-8") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            limit = getattr(library, name, None)
            if limit is not None:
                limit(1)


def _trim() -> None:
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


class Block:
    """Consecutive texts: their bytes, and where each begins and ends."""

    def __init__(self, start: int, stop: int, data: np.ndarray, offsets: np.ndarray):
        self.start, self.stop, self.data, self.offsets = start, stop, data, offsets

    def __len__(self) -> int:
        return self.stop - self.start

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def column(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr.cast(pa.large_string()), "")


def blocks(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[Block]:
    """Blocks of about ``most`` bytes; a longer text gets one of its own."""
    arr = column(arr)
    if not len(arr):
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(arr):
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(len(arr), max(stop, start + 1))
        own = offsets[start : stop + 1]
        yield Block(start, stop, data[own[0] : own[-1]], own - own[0])
        start = stop


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The pieces of ``data`` between consecutive ``bounds``, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words per text."""
    if not len(block.data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(block), np.int64)
    return spans_of(block, ~IS_SPACE[block.data])


def spans_of(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged bytes that do not cross a text's bounds."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = block.offsets[:-1][np.diff(block.offsets) > 0]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = block.offsets[1:][np.diff(block.offsets) > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, block.per_doc(first)
