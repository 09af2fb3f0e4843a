"""Sets of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, words_in: int = 5) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending; of all its words if it has fewer; none if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    each = map(b" ".join, zip(*[words[i:] for i in range(words_in)])) if len(words) >= words_in else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each), "<u8"))
