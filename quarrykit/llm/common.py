"""What several operators of this subpackage share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit words (multiply-xorshift), so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class SpanHash:
    """64-bit hashes of many byte spans of one buffer, without a Python loop.

    A prefix sum of ``(byte + 1) * BASE^i`` gives every span's polynomial; the
    inverse power of its start makes it independent of the place.
    """

    def __init__(self, limit: int = 1 << 16):
        self._up, self._down = powers(BASE, limit), powers(BASE_INVERSE, limit)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self._up):
            n = max(len(data) + 1, 2 * len(self._up))
            self._up, self._down = powers(BASE, n), powers(BASE_INVERSE, n)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in ``column`` have about ``limit`` bytes; a longer text comes alone, and whole."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    stop = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        last = max(at + 1, int(np.searchsorted(stop, stop[at] - size[at] + limit, side="right")))
        yield batch.slice(at, last - at)
        at = last


def current_patterns(patterns: DataFrame, *columns: str) -> DataFrame:
    """The row with the greatest ``seq`` of each ``id``, with ``seq`` and ``columns``.

    One aggregate with map-side combine, so an id that fills a third of the
    rows is reduced before the shuffle. Rows with a null id keep one row, as
    grouping treats nulls as one id. An empty table gives an empty table.
    """
    kept = F.struct("seq", *columns)
    return patterns.select("id", *dict.fromkeys(["seq", *columns])).groupBy("id").agg(F.max_by(kept, "seq").alias("row")).select("row.*")


def term(column):
    """Surrounding blanks off, lower case; a blank term becomes null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))
