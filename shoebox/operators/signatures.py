"""A face's fallback signature: a perceptual hash of its picture in grey."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a hash by row and column, and samples of the picture for each.
HASH_SIZE, FACTOR = 16, 4
SIDE = HASH_SIZE * FACTOR
#: Pictures that are transformed at once.
STACK = 256


def cosines() -> np.ndarray:
    """The rows of the discrete cosine transform (second kind, unscaled) that a hash needs."""
    k, n = np.arange(HASH_SIZE)[:, None], np.arange(SIDE)[None]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def perceptual_hashes(pictures: list[bytes | None]) -> list[str | None]:
    """64 hex digits of each picture of 64 by 64 grey samples: which low frequencies lie over their median; null for any other size.

    Pictures are stacked and transformed together, ``STACK`` at a time.
    """
    out: list[str | None] = [None] * len(pictures)
    sound = [k for k, p in enumerate(pictures) if p is not None and len(p) == SIDE * SIDE]
    rows = cosines()
    for at in range(0, len(sound), STACK):
        own = sound[at : at + STACK]
        stack = np.frombuffer(b"".join(pictures[k] for k in own), np.uint8).reshape(len(own), SIDE, SIDE).astype(float)
        low = rows @ stack @ rows.T
        bits = (low > np.median(low, axis=(1, 2), keepdims=True)).reshape(len(own), -1)
        for k, packed in zip(own, np.packbits(bits, axis=1)):
            out[k] = packed.tobytes().hex()
    return out


def perceptual_hash(samples: bytes | None) -> str | None:
    return perceptual_hashes([samples])[0]


def hashed(samples: Column) -> Column:
    """perceptual_hashes as a Column, over Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(perceptual_hashes(batch.tolist()), dtype=object)

    return run(samples)
