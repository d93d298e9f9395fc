"""Problem 1: items that label the same record, and more often than chance.

A block of records is a sparse binary matrix X, with one more column that is 1
in every record. The upper half of its Gram matrix X'X, summed over all blocks,
holds at once how often each two items meet, how often each item occurs, and
how many records there are.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import current_patterns, term
from quarrykit.session import cut_lineage

#: Records, and items of all of them, that one block holds before its product is taken.
BLOCK_RECORDS = 65_536
BLOCK_ITEMS = 1 << 20
#: A record with more items than this is multiplied in dense item blocks.
LONG_RECORD = 128
ITEM_BLOCK = 1024
#: Pairs of short records that are held at a time before they are counted.
PAIRS = 1 << 21


def terms(tags: Column) -> Column:
    """The distinct terms of a tag array; null for a null array."""
    return F.array_distinct(F.filter(F.transform(tags, term), lambda x: x.isNotNull()))


def _sparse(item: np.ndarray, size: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pair codes and counts of the short records, taken by record length and at most PAIRS at a time."""
    begin = np.cumsum(size) - size
    for k in np.unique(size).tolist():
        left, right = np.triu_indices(k)
        starts = begin[size == k]
        step = max(1, PAIRS // len(left))
        for part in range(0, len(starts), step):
            matrix = np.sort(item[starts[part : part + step, None] + np.arange(k)], axis=1)
            yield np.unique(matrix[:, left] * width + matrix[:, right], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts as one, each code once."""
    if len(parts) < 2:
        return parts
    code, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return [(code[first], np.add.reduceat(count, first))]


def _dense(records: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pair codes and counts of the long records, one product for each two item blocks."""
    used = np.unique(np.concatenate(records))
    places = [np.searchsorted(used, r) for r in records]
    blocks = []
    for b in range(0, len(used), ITEM_BLOCK):
        blocks.append(used[b : b + ITEM_BLOCK])

    def block(b: int) -> np.ndarray:
        x = np.zeros((len(records), len(blocks[b])), np.float32)
        for i, p in enumerate(places):
            own = p[(p >= b * ITEM_BLOCK) & (p < (b + 1) * ITEM_BLOCK)] - b * ITEM_BLOCK
            x[i, own] = 1
        return x

    for i in range(len(blocks)):
        left = block(i)
        for j in range(i, len(blocks)):
            gram = left.T @ (left if i == j else block(j))
            if i == j:
                gram = np.triu(gram)
            a, b = np.nonzero(gram)
            yield blocks[i][a] * width + blocks[j][b], gram[a, b].astype(np.int64)


def block_gram(records: pa.Array) -> Iterator[pa.RecordBatch]:
    """Upper half of X'X of one block as rows (tag_a, tag_b, n); the ones column is ''."""
    flat = records.flatten().dictionary_encode()
    # code point order is the byte order of UTF-8
    names = flat.dictionary.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(1, len(names) + 1)
    names, width = ["", *sorted(names)], len(names) + 1
    size = np.asarray(records.value_lengths(), np.int64)
    item = rank[np.asarray(flat.indices, np.int64)]
    # the ones column leads every record
    begin = np.cumsum(size) - size
    full = np.insert(item, begin, 0)
    size = size + 1
    begin = np.cumsum(size) - size
    long = np.flatnonzero(size > LONG_RECORD)
    short = size <= LONG_RECORD

    def products() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if short.any():
            yield from _sparse(full[np.repeat(short, size)], size[short], width)
        for part in range(0, len(long), 1024):
            yield from _dense([full[begin[i] : begin[i] + size[i]] for i in long[part : part + 1024]], width)

    results, held, limit = [], 0, 4 * PAIRS
    for part in products():
        results.append(part)
        held += len(part[0])
        if held > limit:
            results = _summed(results)
            held = sum(len(x[0]) for x in results)
            limit = max(4 * PAIRS, 2 * held)
    results = _summed(results)
    words = pa.array(names, pa.string())
    for code, count in results:
        for at in range(0, len(code), 1 << 17):
            a, b = np.divmod(code[at : at + (1 << 17)], width)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(count[at : at + (1 << 17)])], names=["tag_a", "tag_b", "n"])


def gram(baskets: DataFrame, items: str = "items") -> DataFrame:
    """(tag_a, tag_b, n) with tag_a <= tag_b: the summed Gram matrix of ``items``.

    ``items`` is an array of distinct, non-blank strings. Null and empty arrays
    are no records. A block is multiplied where it lies, so an item or a pair
    that fills a third of all records leaves each block as one row; no pair of
    records is ever formed.
    """
    source = baskets.select(F.col(items)).where(F.size(items) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch.column(0))
            n += len(batch)
            size += len(batch.column(0).flatten())
            if n >= BLOCK_RECORDS or size >= BLOCK_ITEMS:
                yield from block_gram(pa.concat_arrays(held))
                held, n, size = [], 0, 0
        if n:
            yield from block_gram(pa.concat_arrays(held))

    blocks = source.mapInArrow(run, "tag_a string, tag_b string, n bigint")
    return blocks.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n"))


def associated_pairs(baskets: DataFrame, items: str = "items", least: int = 5, lift: int = 3) -> DataFrame:
    """Pairs that meet in at least ``least`` records and ``lift`` times as often as chance.

    Columns tag_a < tag_b (byte order), n_ab, n_a, n_b, n_records and lift, which
    is n_ab * n_records / (n_a * n_b). The comparison is made in whole numbers,
    so a pair that is exactly at a bound is kept. A pair below ``least`` cannot
    be a case, nor can a pair with an item below it, so the joins see only the
    rest. An empty table gives an empty table. The matrix is made and its rest
    written while the plan is made.
    """
    kept = cut_lineage(gram(baskets, items).where((F.col("n") >= least) | (F.col("tag_b") == "")))
    total = kept.where("tag_b = ''").agg(F.max("n").alias("n"))
    alone = kept.where("tag_a = '' AND tag_b != ''").select(F.col("tag_b").alias("tag"), F.col("n").alias("own"))
    pairs = kept.where("tag_a != '' AND tag_a < tag_b")
    a = alone.select(F.col("tag").alias("tag_a"), F.col("own").alias("n_a"))
    b = alone.select(F.col("tag").alias("tag_b"), F.col("own").alias("n_b"))
    joined = pairs.join(a, "tag_a").join(b, "tag_b").withColumn("n_records", total.scalar())
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    case = whole("n") * whole("n_records") >= F.lit(lift).cast("decimal(2,0)") * (whole("n_a") * whole("n_b"))
    ratio = F.col("n").cast("double") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    return joined.where(case).select("tag_a", "tag_b", F.col("n").alias("n_ab"), "n_a", "n_b", "n_records", ratio.alias("lift"))


def pattern_tag_pairs(patterns: DataFrame, least: int = 5, lift: int = 3) -> DataFrame:
    """``associated_pairs`` of the tag terms of the current saved patterns."""
    baskets = current_patterns(patterns, "tags").select(terms(F.col("tags")).alias("items"))
    return associated_pairs(baskets, "items", least, lift)
