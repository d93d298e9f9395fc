"""Problem 4: uses and records of every distinct term, with marks.

Heavy-light aggregation: a bounded summary of each partition finds the heavy
terms; those are counted exactly in arrays where the rows lie, and only the
remaining terms are shuffled one by one. Which terms count as heavy changes
what is shuffled, never a count.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import current_patterns, term
from quarrykit.session import cut_lineage

#: Most heavy terms that are broadcast, and counters of one partition's summary.
HEAVY = 512
COUNTERS = 4096


def normalised(patterns: DataFrame) -> DataFrame:
    """Each row's terms: ``tags`` with repeats, ``own_tags`` without, ``language``."""
    every = F.filter(F.transform("tags", term), lambda x: x.isNotNull())
    return patterns.select(every.alias("tags"), F.array_distinct(every).alias("own_tags"), term(F.col("language")).alias("language"))


def _counts(column: pa.Array) -> tuple[list[str], np.ndarray]:
    flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
    counted = pc.value_counts(flat.drop_null())
    return counted.field("values").to_pylist(), np.asarray(counted.field("counts"), np.int64)


def heavy_terms(rows: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> list[tuple[str, str]]:
    """At most ``heavy`` (field, term) that a partition-wise frequent-items summary ranks first.

    Each partition keeps at most ``counters`` counters; when there are more, all
    are lowered by the smallest that falls out, so a term above 1/counters of
    the partition's uses always stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[tuple[str, str], int] = {}
        for batch in batches:
            for field in ("tags", "language"):
                for word, n in zip(*_counts(batch.column(field))):
                    summary[field, word] = summary.get((field, word), 0) + int(n)
            if len(summary) > counters:
                floor = sorted(summary.values(), reverse=True)[counters]
                summary = {k: n - floor for k, n in summary.items() if n > floor}
        keys = list(summary)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([summary[k] for k in keys], pa.int64())], names=["field", "term", "n"])

    parts = rows.select("tags", "language").mapInArrow(run, "field string, term string, n bigint")
    best = parts.groupBy("field", "term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field", "term").limit(heavy)
    return [(r.field, r.term) for r in best.collect()]


def term_counts(rows: DataFrame, heavy: list[tuple[str, str]]) -> DataFrame:
    """(field, term, uses, records) of every term of ``normalised`` rows, each term once.

    One more row, with an empty field and term, has the number of rows.
    """
    fields = {f: {t: i for i, (g, t) in enumerate(heavy) if g == f} for f in ("tags", "language")}
    shared = rows.sparkSession.sparkContext.broadcast(fields)  # at most HEAVY terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        uses, records, total = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64), 0

        def out(is_heavy, field, words, u, r):
            n = len(words)
            return pa.RecordBatch.from_arrays([pa.array([is_heavy] * n, pa.bool_()), pa.array(field if isinstance(field, list) else [field] * n, pa.string()), pa.array(words, pa.string()), pa.array(u, pa.int64()), pa.array(r, pa.int64())], names=["heavy", "field", "term", "uses", "records"])

        for batch in batches:
            total += batch.num_rows
            for field, every, own in (("tags", "tags", "own_tags"), ("language", "language", "language")):
                light: dict[str, list[int]] = {}
                for slot, name, array in ((0, every, uses), (1, own, records)):
                    for word, n in zip(*_counts(batch.column(name))):
                        at = places[field].get(word)
                        if at is None:
                            light.setdefault(word, [0, 0])[slot] += int(n)
                        else:
                            array[at] += n
                if light:
                    yield out(False, field, list(light), [x[0] for x in light.values()], [x[1] for x in light.values()])
        yield out(True, "", [""], [0], [total])
        met = np.flatnonzero(uses)
        if len(met):
            yield out(True, [heavy[i][0] for i in met], [heavy[i][1] for i in met], uses[met], records[met])

    parts = rows.mapInArrow(run, "heavy boolean, field string, term string, uses bigint, records bigint")
    # a term is heavy in all partitions or in none, so one sum over both tables is their union
    return parts.groupBy("heavy", "field", "term").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records")).drop("heavy")


def pattern_terms(patterns: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(field, term, uses, records, mark) of the tags and languages of the current patterns.

    ``uses`` counts a repeated tag each time, ``records`` once for each row.
    ``mark`` is ``rare`` if at most 2 rows have the term, else ``common`` if at
    least a tenth of all current rows have it (rows without terms included),
    else null. Null and blank terms are dropped. An empty table gives none. The
    heavy terms are found and the counts written while the plan is made.
    """
    # the heavy terms of the whole log are near enough those of its current rows
    found = heavy_terms(normalised(patterns.select("tags", "language")), heavy)
    counted = cut_lineage(term_counts(normalised(current_patterns(patterns, "tags", "language")), found))
    total = counted.where("field = ''").agg(F.max("records").alias("n"))
    mark = F.when(F.col("records") <= 2, "rare").when(F.col("records") * 10 >= total.scalar(), "common")
    return counted.where("field != ''").withColumn("mark", mark)
