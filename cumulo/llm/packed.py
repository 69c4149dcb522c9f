"""Whole numbers as compressed bytes, for binary columns."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, none negative, in the least width that holds them, byte by byte of all of them, compressed; the width comes first."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{data[0]}")
