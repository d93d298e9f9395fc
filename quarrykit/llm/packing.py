"""Problem 7: fill containers of fixed capacity with texts measured in tokens.

The driver sees a histogram of lengths, never the documents. Dynamic
programming over that histogram chooses the length buckets whose padding is
least. Batches form inside each bucket until the token budget is spent; the
room that a batch leaves is filled with items of shorter buckets before these
form batches of their own. Every row finds its container from its rank among
the rows of its length.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.bpe import DEFAULT_RANKS, token_counts
from quarrykit.session import cut_lineage

#: Length buckets of each budget.
BUCKETS = 64
#: Rows of settings; each multiplies the pieces, so more of them are refused.
MAX_BUDGETS = 64
#: Rows that one salt of a bucket holds on average at most.
SALT_ROWS = 200_000


def _cheapest(bound: list[int], number: list[int], mass: list[int], price: int) -> tuple[int, list[int]]:
    """Buckets of least padding plus ``price`` for each bucket: their number and bounds.

    ``number`` and ``mass`` are prefix sums of counts and tokens. What a bucket
    from i to j costs is a straight line in its bound, so the minimum over i is
    a lower envelope, which one sweep keeps and reads.
    """
    m = len(bound)
    cost, parts, took = [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    slopes, cuts, owners, head = [], [], [], 0
    for j in range(1, m + 1):
        slope, cut = -number[j - 1], cost[j - 1] + mass[j - 1]
        while len(slopes) - head >= 2 and (cuts[-1] - cuts[-2]) * (slopes[-1] - slope) >= (cut - cuts[-1]) * (slopes[-2] - slopes[-1]):
            slopes.pop(), cuts.pop(), owners.pop()
        slopes.append(slope), cuts.append(cut), owners.append(j - 1)
        x = bound[j - 1]
        while len(slopes) - head >= 2 and slopes[head + 1] * x + cuts[head + 1] <= slopes[head] * x + cuts[head]:
            head += 1
        i = owners[head]
        cost[j] = slopes[head] * x + cuts[head] + x * number[j] - mass[j] + price
        parts[j], took[j] = parts[i] + 1, i
    bounds, j = [], m
    while j:
        bounds.append(bound[j - 1])
        j = took[j]
    return parts[m], bounds[::-1]


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` length buckets that minimise padding.

    Padding is the sum over items of (bound - length). The dynamic program
    charges a price for each bucket; the least price that keeps to ``buckets``
    gives the least padding for the number of buckets it returns, which is less
    than ``buckets`` only where one bucket more would save as much as the last.
    """
    number = np.concatenate([[0], np.cumsum(counts)]).tolist()
    mass = np.concatenate([[0], np.cumsum(counts * lengths)]).tolist()
    bound = lengths.tolist()
    low, high = 0, bound[-1] * number[-1] + 1
    best = [bound[-1]]
    while low < high:
        price = (low + high) // 2
        parts, bounds = _cheapest(bound, number, mass, price)
        if parts <= buckets:
            best, high = bounds, price
        else:
            low = price + 1
    return np.array(best)


def plan(sizes: np.ndarray, counts: np.ndarray, bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Which ranks of which length go into which containers, and how many containers.

    ``bounds`` are the buckets, taken from the longest to the shortest, and
    inside a bucket from the longest items to the shortest. Items first fill the
    room that batches of longer ones left, tightest room first. The rest forms
    batches of its bucket within the token budget: the ``capacity // bound``
    items that fit even when padded, and more as long as their own tokens fit;
    a batch that one length cannot fill takes the next lengths of its bucket.
    All containers with the same room are one entry, so the work depends on the
    capacity and not on the number of items. Each row of the result is (size,
    first rank, first container, items per container).
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows: list[tuple[int, int, int, int]] = []
    opened = 0

    def leave(space: int, first: int, n: int) -> None:
        if space <= 0 or n <= 0:
            return
        if space not in room:
            room[space] = []
            bisect.insort(rooms, space)
        room[space].append((first, n))

    def fill(size: int, rank: int, count: int) -> int:
        """Put items from ``rank`` on into the room there is; the rank that is left."""
        later = []
        while rank < count and (at := bisect.bisect_left(rooms, size)) < len(rooms):
            space = rooms[at]
            first, n = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.pop(at)
            each = space // size
            full = min(n, (count - rank) // each)
            if full:
                rows.append((size, rank, first, each))
                later.append((space - each * size, first, full))
                rank += full * each
            left = count - rank if full < n else 0
            if left:
                rows.append((size, rank, first + full, left))
                later.append((space - left * size, first + full, 1))
                rank, full = count, full + 1
            leave(space, first + full, n - full)
        for x in later:
            leave(*x)
        return rank

    bucket = np.searchsorted(bounds, sizes)
    for b in range(len(bounds) - 1, -1, -1):
        begun = None  # the container and the room of a batch that lacks items
        for i in np.flatnonzero(bucket == b)[::-1].tolist():
            size, count, rank = int(sizes[i]), int(counts[i]), 0
            if begun and (n := min(begun[1] // size, count)):
                rows.append((size, 0, begun[0], n))
                rank, begun = n, (begun[0], begun[1] - n * size)
            rank = fill(size, rank, count)
            if rank == count:
                continue
            if begun:
                leave(begun[1], begun[0], 1)
                begun = None
            each = capacity // size
            full, left = divmod(count - rank, each)
            if full:
                rows.append((size, rank, opened, each))
                leave(capacity - each * size, opened, full)
                opened, rank = opened + full, rank + full * each
            if left:
                rows.append((size, rank, opened, left))
                begun, opened = (opened, capacity - left * size), opened + 1
        if begun:
            leave(begun[1], begun[0], 1)
    return np.array(rows, np.int64).reshape(-1, 4), opened


def _pieces(items: DataFrame, *kept: str) -> DataFrame:
    """The pieces of items of ``total`` tokens for each budget of the ``budgets`` array."""
    each = items.select(*kept, "total", F.explode("budgets").alias("b")).select(*kept, "total", "b.budget_id", "b.capacity")
    last = F.greatest(F.floor((F.col("total") - 1) / F.col("capacity")), F.lit(0)).cast("int")
    start = F.col("piece") * F.col("capacity")
    return each.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "budget_id", "capacity", *kept, "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("total") - start).alias("n_tokens")
    )


def _histograms(lengths: DataFrame, budgets) -> pd.DataFrame:
    """Counts by budget and length of piece; at most the sum of the capacities rows.

    Documents are counted by length first, so that what is multiplied by the
    budgets is one row for each length; a long document's full pieces are
    counted, not made.
    """
    totals = lengths.groupBy("total").agg(F.count(F.lit(1)).alias("n")).where("total > 0").withColumn("budgets", budgets)
    each = totals.select("total", "n", F.explode("budgets").alias("b")).select("total", "n", "b.budget_id", "b.capacity")
    full, rest = F.floor(F.col("total") / F.col("capacity")), F.col("total") % F.col("capacity")
    both = F.array(F.struct(F.col("capacity").alias("n_tokens"), (full * F.col("n")).alias("n")), F.struct(rest.alias("n_tokens"), F.col("n").alias("n")))
    made = each.select("budget_id", "capacity", F.explode(both).alias("x")).select("budget_id", "capacity", "x.n_tokens", "x.n").where("n_tokens > 0 AND n > 0")
    return made.groupBy("budget_id", "capacity", "n_tokens").agg(F.sum("n").alias("count")).toPandas()


def fill_containers(lengths: DataFrame, budgets: DataFrame, key: str = "doc_id", max_buckets: int = BUCKETS) -> DataFrame:
    """Where each piece of each document goes, for each row of ``budgets``.

    ``lengths`` has ``key`` and ``n_tokens``; ``budgets`` has ``budget_id`` and
    ``capacity`` and is a table of settings of at most MAX_BUDGETS rows; more
    raise an error. One row per piece: ``budget_id``, ``container`` (from 0),
    the key, ``piece`` (from 0), ``start_token``, ``n_tokens`` and ``bucket``,
    the upper length bound that the item was batched with: ``bucket - n_tokens``
    is its padding.

    A document is split only if it is longer than the capacity: into full
    pieces and one rest. A document without tokens, or with a null count, is
    one piece of no tokens in container 0. Documents with the same key are
    documents of their own. Budgets with a null or non-positive capacity, and
    empty tables, give no rows. Two jobs run while the plan is made: the token
    counts are written once, and their histogram comes to the driver.
    """
    spark = lengths.sparkSession
    settings = [(r.budget_id, r.capacity) for r in budgets.select("budget_id", "capacity").where("capacity > 0").limit(MAX_BUDGETS + 1).collect()]
    if len(settings) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    if not settings:
        kind = lengths.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"budget_id int, container bigint, `{key}` {kind}, piece int, start_token bigint, n_tokens bigint, bucket bigint")
    array = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in settings])
    lengths = cut_lineage(lengths.select(F.col(key), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("total")))
    counted = _histograms(lengths, array)
    tables: dict[int, tuple] = {}
    largest = 1
    for budget, own in counted.groupby("budget_id"):
        own = own.sort_values("n_tokens")
        size, count, capacity = own.n_tokens.to_numpy(), own["count"].to_numpy(), int(own.capacity.iloc[0])
        bounds = bucket_bounds(size, count, max_buckets)
        rows, _ = plan(size, count, bounds, capacity)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        tables[int(budget)] = (bounds, rows, int(count.max()) + 1)
        largest = max(largest, int(count.max()))
    shared = spark.sparkContext.broadcast(tables)  # bounded by the capacities

    def place_all(budget: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        container, bucket = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for b, (bounds, rows, step) in shared.value.items():
            own = budget == b
            if own.any():
                mine, place = size[own], rank[own]
                row = rows[np.searchsorted(rows[:, 0] * step + rows[:, 1], mine * step + place, side="right") - 1]
                container[own] = row[:, 2] + (place - row[:, 1]) // row[:, 3]
                bucket[own] = bounds[np.searchsorted(bounds, mine)]
        return container, bucket

    @F.pandas_udf("container bigint, bucket bigint")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for budget, size, rank in batches:
            container, bucket = place_all(budget.to_numpy(), size.to_numpy(), rank.to_numpy())
            yield pd.DataFrame({"container": container, "bucket": bucket})

    pieces = _pieces(lengths.withColumn("budgets", array), key)
    # pieces of no tokens need no place, however many they are
    empty = pieces.where("n_tokens = 0").select("budget_id", F.lit(0).cast("bigint").alias("container"), key, "piece", "start_token", "n_tokens", F.lit(0).cast("bigint").alias("bucket"))
    salts = max(1, -(-largest // SALT_ROWS))
    known = pieces.where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    group = ["budget_id", "n_tokens", "salt"]
    inside = known.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(key, "piece")) - 1)
    if salts > 1:
        before = Window.partitionBy("budget_id", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        offset = known.groupBy(*group).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        inside = inside.join(offset, group).withColumn("place", F.col("place") + F.col("before"))
    made = inside.withColumn("at", placed("budget_id", "n_tokens", F.col("place").cast("bigint")))
    return made.select("budget_id", "at.container", key, "piece", "start_token", "n_tokens", "at.bucket").unionByName(empty)


def pack_documents(documents: DataFrame, budgets: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, max_buckets: int = BUCKETS) -> DataFrame:
    """``fill_containers`` over the token counts of ``text``."""
    return fill_containers(token_counts(documents, key, text, ranks), budgets, key, max_buckets)


def container_fill(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, containers, least_containers, tokens, padded_rows, padding, fill) of each budget.

    ``least_containers`` is what the tokens need at least; ``padding`` is the
    sum of what the buckets add to their items, and ``fill`` the share of the
    containers' room that tokens take. Budgets without a token have no row.
    """
    used = placed.where("n_tokens > 0").groupBy("budget_id").agg(
        (F.max("container") + 1).alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.count_if(F.col("bucket") > F.col("n_tokens")).alias("padded_rows"),
        F.sum(F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
    capacity = budgets.select("budget_id", F.col("capacity").cast("bigint").alias("capacity"))
    return used.join(F.broadcast(capacity.limit(MAX_BUDGETS)), "budget_id").select(
        "budget_id",
        "capacity",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        "tokens",
        "padded_rows",
        "padding",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"),
    )
