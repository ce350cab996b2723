"""Words of many texts at once: cut in numpy, numbered by Arrow's dictionary encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def number(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the byte strings ``data[offsets[i]:offsets[i + 1]]`` and the distinct strings."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64), []
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 - 1 else (pa.large_binary(), np.int64)
    array = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def cut_words(raw: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bytes without what stands between, word offsets into them, and the words' starts per text.

    ``gaps`` says of each byte value whether it stands between words.
    """
    keep = ~gaps[raw]
    opens = keep.copy()
    opens[1:] &= ~keep[:-1]
    firsts = starts[:-1][starts[:-1] < starts[1:]]
    opens[firsts] = keep[firsts]
    at = np.flatnonzero(opens)
    kept = np.cumsum(keep)
    total = int(kept[-1]) if len(kept) else 0
    offsets = np.concatenate([kept[at] - 1, [total]]) if len(at) else np.zeros(1, np.int64)
    return raw[keep], offsets, np.searchsorted(at, starts)


class Cache:
    """Values per word, computed in batches and kept up to ``limit`` bytes; what comes later is computed anew."""

    #: What an entry takes besides its word and value.
    OVERHEAD = 200

    def __init__(self, compute, limit: int = 80_000_000):
        self.compute, self.left, self.known = compute, limit, {}

    def of(self, words: list[bytes]) -> list:
        get = self.known.get
        found = [get(w) for w in words]
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            for i, value in zip(missing, self.compute([words[i] for i in missing]), strict=True):
                found[i] = value
                if self.left > 0:
                    self.left -= self.OVERHEAD + len(words[i]) + 8 * len(value)
                    self.known[words[i]] = value
        return found
