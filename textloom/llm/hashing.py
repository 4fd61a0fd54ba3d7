"""Hashes of byte strings and numbers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)
