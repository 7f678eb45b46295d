"""Words of many texts at once, as Arrow arrays over the texts' bytes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_arrays(texts, lower=False):
    """(words, counts): all texts' words in one binary array, and how many each text has; null is empty.

    A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and
    carriage return; ``lower`` writes A-Z as a-z. Other bytes stay as they are.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    before = np.cumsum(inside)
    bounds = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
    kept = data[inside]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[kept] if lower else kept)])
    return words, counts


def chunks(texts, most=1_500_000):
    """Slices (from, to) of a text array holding about ``most`` bytes each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)
