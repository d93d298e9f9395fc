"""Problem 2: records that are edited copies of others.

Min-max hashing: for each permutation both the least and the greatest hash of a
record's shingles are kept, so one evaluation gives two signature values. Bands
of these values, each of different permutations, bring likely pairs together;
small sets and those of crowded bands are joined on their rare shingles instead,
which loses none; the pairs are then verified on the shingle sets. Texts are
shingled once.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import SpanHash, mix
from quarrykit.session import cut_lineage

#: The bytes of a word after lower-casing.
WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789_"
#: Characters that are worked on at a time; a longer text is taken alone, and whole.
CHUNK_BYTES = 1 << 19
#: Bytes of a run's hash that are stored and compared when a pair is verified.
RUN_BYTES = 6
#: Classes whose band rows a task looks at together before it lets them go.
BLOCK_CLASSES = 1 << 16


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(WORD_BYTES, np.uint8)] = True
    return table


def shingle_sets(texts: list[bytes], words: int, hasher: SpanHash, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``words`` words, and how many each has.

    ``texts`` are lower-cased already. A text of fewer words has none.
    """
    size = np.array([len(t) + 1 for t in texts], np.int64)
    whole = b"\n".join(texts) + b"\n"
    data = np.frombuffer(whole, np.uint8)
    inside = table[data].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    word = hasher(data, start, stop)
    n = len(word) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    run = np.zeros(n, np.uint64)
    for i in range(words):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + word[i : n + i])
    owned = owner[:n]
    one = owned == owner[words - 1 :]
    run, owned = run[one], owned[one]
    order = np.lexsort((run, owned))
    run, owned = run[order], owned[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owned[1:] != owned[:-1])
    run, owned = run[new], owned[new]
    return run, np.bincount(owned, minlength=len(texts))


def pack(sets: np.ndarray) -> np.ndarray:
    """The low RUN_BYTES bytes of each hash, row by row; little-endian as numpy has them here."""
    return np.ascontiguousarray(sets.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES])


def unpack(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed hashes of several sets in a row, and how many each has."""
    whole = np.frombuffer(b"".join(items), np.uint8).reshape(-1, RUN_BYTES)
    wide = np.zeros((len(whole), 8), np.uint8)
    wide[:, :RUN_BYTES] = whole
    return wide.view("<u8").ravel(), np.array([len(x) // RUN_BYTES for x in items], np.int64)


def min_max(sets: np.ndarray, count: np.ndarray, permutations: int) -> np.ndarray:
    """Signature of each non-empty set: ``permutations`` minima, then as many maxima.

    Minimum and maximum of one permutation are not independent, so they stand
    apart: up to ``permutations`` consecutive values are of different permutations.
    """
    begin = np.cumsum(count) - count
    out = np.empty((len(count), 2 * permutations), np.uint64)
    for p in range(permutations):
        h = mix(sets ^ np.uint64((p + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
        out[:, p] = np.minimum.reduceat(h, begin)
        out[:, permutations + p] = np.maximum.reduceat(h, begin)
    return out


def _pieces(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in column.cast(pa.large_binary()).to_pylist():
        part.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _digests(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of each sorted set."""
    stop = np.cumsum(count)
    whole = b"".join(hashlib.blake2b(sets[a:b], digest_size=16).digest() for a, b in zip((stop - count).tolist(), stop.tolist()))
    return np.frombuffer(whole, np.int64).reshape(-1, 2)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _split_crowded(bucket: np.ndarray, own: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one block in their order; of a bucket of more than ``crowd`` + 1 rows, only so many, and whose the rest are.

    As they come, the rows of a class stand together, which compresses well.
    """
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(_starts(bucket[order]))
    size = np.diff(np.append(first, len(bucket)))
    keep = np.ones(len(bucket), bool)
    keep[order] = np.arange(len(bucket)) - np.repeat(first, size) <= crowd
    return bucket[keep], own[keep], np.unique(own[~keep])


class _BucketPairs:
    """Pairs of classes out of (bucket, class) rows in order; rows may come in any number of pieces."""

    def __init__(self, crowd: int):
        self.crowd, self.crowded = crowd, None
        self.bucket = self.own = np.zeros(0, np.int64)

    def add(self, bucket: np.ndarray, own: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, crowded): the distinct pairs of all buckets that are complete, and the classes of crowded ones."""
        bucket, own = np.concatenate([self.bucket, bucket]), np.concatenate([self.own, own])
        new = _starts(bucket, own)
        bucket, own = bucket[new], own[new]
        crowded = []
        if self.crowded is not None:
            n = int(np.searchsorted(bucket, self.crowded, side="right"))
            crowded.append(own[:n])
            bucket, own = bucket[n:], own[n:]
        first = np.flatnonzero(_starts(bucket)) if len(bucket) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(bucket)))
        if last or not len(first):
            self.bucket = self.own = np.zeros(0, np.int64)
        elif size[-1] > self.crowd:
            # no more of it need be held: whoever comes is crowded as well
            self.crowded = bucket[-1]
            self.bucket = self.own = np.zeros(0, np.int64)
        else:
            self.bucket, self.own = bucket[first[-1] :], own[first[-1] :]
            first, size = first[:-1], size[:-1]
        for at, n in zip(first[size > self.crowd].tolist(), size[size > self.crowd].tolist()):
            crowded.append(own[at : at + n])
        a, b = [], []
        for n in np.unique(size[(size > 1) & (size <= self.crowd)]).tolist():
            left, right = np.triu_indices(n, 1)
            members = own[first[size == n][:, None] + np.arange(n)]
            a.append(members[:, left].ravel())
            b.append(members[:, right].ravel())
        none = [np.zeros(0, np.int64)]
        a, b = np.concatenate(a or none), np.concatenate(b or none)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            new = _starts(a, b)
            a, b = a[new], b[new]
        return a, b, np.unique(np.concatenate(crowded or none))


class NearDuplicates:
    """Pairs of records whose sets of word runs have a Jaccard similarity of at least num/den.

    ``records`` has ``key`` (unique) and ``text``; the text is lower-cased, its
    words are the longest runs of a-z, 0-9 and _, its set is that of all runs of
    ``words`` words. Texts that are null or have fewer words are in no pair.

    Records with the same set are one class; classes, not records, are banded
    and verified, so a mass of copies costs one row per task. ``bands`` bands of
    ``rows`` signature values of different permutations find a pair of
    similarity s with a probability of at least 1 - (1 - s^rows)^bands, whatever
    the sizes: 0.996 at the default bound of one half and above 0.99999 from 0.7
    on. Classes of at most ``few_runs`` runs also go through a prefix join on
    rare word runs, which loses none of their pairs. Buckets of more than
    ``hot_bucket`` classes are not paired: their classes go through that join
    too. Most rows of such a bucket leave where they are made, so that it is
    never brought together.

    A class is a set's 128-bit digest, of which bands carry one half and
    everything else both. Word runs are told apart by 64-bit hashes; of a run,
    48 bits travel to the verification, so two sets of n runs can be one run off
    with a probability below n^2 / 2^48.

    The sets are written once when they are first needed.
    """

    def __init__(self, records: DataFrame, key: str, text: str, words: int = 3, similarity: tuple[int, int] = (1, 2), bands: int = 42, rows: int = 3, hot_bucket: int = 512, few_runs: int = 16):
        self.key, self.words, self.similarity, self.hot_bucket = key, words, similarity, hot_bucket
        self.bands, self.rows, self.few_runs = bands, rows, few_runs
        self.source = records.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where("text IS NOT NULL")
        self._made: DataFrame | None = None

    def shingled(self) -> DataFrame:
        """(key, class, check, items) of every record with a non-empty set.

        ``items`` are the sorted hashes of the set; a task gives each set once,
        so they are null for its later copies.
        """
        if self._made is not None:
            return self._made
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, table, seen = SpanHash(), _word_table(), set()
            for batch in batches:
                done = 0
                for part in _pieces(batch.column(1)):
                    sets, count = shingle_sets(part, words, hasher, table)
                    keys = batch.column(0).slice(done, len(part))
                    done += len(part)
                    full = np.flatnonzero(count)
                    if not len(full):
                        continue
                    count = count[full]
                    digest, stop, packed = _digests(sets, count), np.cumsum(count), pack(sets)
                    items = []
                    for own, b, n in zip(map(tuple, digest.tolist()), stop.tolist(), count.tolist()):
                        items.append(None if own in seen else packed[b - n : b].tobytes())
                        seen.add(own)
                    columns = [keys.take(pa.array(full)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(items, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "class", "check", "items"])

        kind = self.source.schema["key"].dataType.simpleString()
        self._made = cut_lineage(self.source.mapInArrow(run, f"key {kind}, class bigint, check bigint, items binary"))
        return self._made

    def members(self) -> DataFrame:
        """(key, class, check) of every record with a non-empty set."""
        return self.shingled().select("key", "class", "check")

    def _sets(self) -> DataFrame:
        """(class, check, items) of each class."""
        return self.shingled().where("items IS NOT NULL").select("class", "check", "items").repartition("class").dropDuplicates(["class", "check"])

    def band_rows(self) -> DataFrame:
        """(bucket, class): ``bands`` rows for each class, once per task.

        Where a block of classes crowds a bucket, only as many of its rows are
        given as show that it is crowded; the other classes come once, with a
        null bucket.
        """
        bands, rows, crowd = self.bands, self.rows, self.hot_bucket
        permutations = max(-(-bands * rows // 2), rows)

        def out(held: list) -> pa.RecordBatch:
            bucket, own, crowded = _split_crowded(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), crowd)
            empty = pa.nulls(len(crowded), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(bucket), empty]), pa.array(np.concatenate([own, crowded]))], names=["bucket", "class"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    sets, count = unpack(part.column(1).to_pylist())
                    signature = min_max(sets, count, permutations)[:, : bands * rows].reshape(-1, bands, rows)
                    bucket = np.broadcast_to(np.arange(bands, dtype=np.uint64), signature.shape[:2]).copy()
                    for r in range(rows):
                        bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
                    held.append((bucket.ravel().view(np.int64), np.repeat(np.asarray(part.column(0)), bands)))
                    n += part.num_rows
                    if n >= BLOCK_CLASSES:
                        yield out(held)
                        held, n = [], 0
            if held:
                yield out(held)

        return self.shingled().where("items IS NOT NULL").select("class", "items").mapInArrow(run, "bucket bigint, class bigint")

    def _rare_prefixes(self, sets: DataFrame) -> DataFrame:
        """Candidates (a, b) among ``sets`` that a prefix filter leaves; none is lost.

        With its word runs ordered from rare to common, a set of n runs can reach
        the similarity only with a set that shares one of its first
        n - ceil(similarity * n) + 1 runs; and where the first run that two sets
        share stands, enough runs must be left in both.
        """
        num, den = self.similarity

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                run, n = unpack(batch.column(2).to_pylist())
                own, check = (np.repeat(np.asarray(batch.column(i)), n) for i in (0, 1))
                columns = [pa.array(own), pa.array(check), pa.array(np.repeat(n, n)), pa.array(run.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "check", "n", "run"])

        runs = sets.select("class", "check", "items").mapInArrow(explode, "class bigint, check bigint, n bigint, run bigint")
        common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "run")))
        ranked = runs.join(common, "run", "left").groupBy("class", "check", "n").agg(by_rarity.alias("order"))
        length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
        prefix = ranked.select("class", "n", F.posexplode(F.slice("order", F.lit(1), length.cast("int"))).alias("place", "x"))
        shared = prefix.where("x.df > 1").select(F.col("x.run").alias("run"), "class", "n", (F.col("n") - F.col("place")).alias("left"))
        a = shared.select("run", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
        b = shared.select("run", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
        enough = F.least("left_a", "left_b") * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
        return a.join(b, "run").where(F.col("a") < F.col("b")).where(enough).select("a", "b")

    def candidates(self) -> DataFrame:
        """Distinct pairs (a <= b) of classes that share a bucket or, both small or from crowded buckets, a rare run; (a, a) for a half that two sets have."""
        crowd = self.hot_bucket

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _BucketPairs(crowd)

            def out(a, b, crowded):
                other = pa.concat_arrays([pa.array(b), pa.nulls(len(crowded), pa.int64())])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, crowded])), other], names=["a", "b"])

            none = np.zeros(0, np.int64)
            for batch in batches:
                alone = pc.is_null(batch.column(0))
                if pc.any(alone).as_py():
                    yield out(none, none, np.asarray(batch.filter(alone).column(1)))
                    batch = batch.filter(pc.invert(alone))
                yield out(*made.add(np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            yield out(*made.add(none, none, last=True))

        ordered = self.band_rows().repartition(F.coalesce("bucket", "class")).sortWithinPartitions("bucket", "class")
        met = cut_lineage(ordered.mapInArrow(run, "a bigint, b bigint").distinct())
        crowded = met.where("b IS NULL").select(F.col("a").alias("class"), F.lit(True).alias("crowded"))
        sets = self._sets().join(crowded, "class", "left").where((F.length("items") <= self.few_runs * RUN_BYTES) | F.col("crowded"))
        checks = self.members().groupBy(F.col("class").alias("a")).agg(F.min("check").alias("low"), F.max("check").alias("high"))
        halves = checks.where("low < high").select("a", F.col("a").alias("b"))
        return met.where("b IS NOT NULL").unionByName(halves).unionByName(self._rare_prefixes(sets)).distinct()

    def class_pairs(self) -> DataFrame:
        """Verified pairs of classes: (a, check_a, b, check_b), each pair once."""
        num, den = self.similarity
        sets = self._sets()
        left = self.candidates().join(sets.select(F.col("class").alias("a"), F.col("check").alias("check_a"), F.col("items").alias("x")), "a")
        both = left.join(sets.select(F.col("class").alias("b"), F.col("check").alias("check_b"), F.col("items").alias("y")), "b")
        both = both.where("a != b OR check_a < check_b").select("a", "check_a", "b", "check_b", "x", "y")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    (x, nx), (y, ny) = unpack(part.column(4).to_pylist()), unpack(part.column(5).to_pylist())
                    pair = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                    value = np.concatenate([x, y])
                    order = np.lexsort((value, pair))
                    pair, value = pair[order], value[order]
                    both_have = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                    common = np.bincount(pair[1:][both_have], minlength=len(nx))
                    keep.append((common > 0) & (den * common >= num * (nx + ny - common)))
                if keep:
                    yield batch.select(["a", "check_a", "b", "check_b"]).filter(pa.array(np.concatenate(keep)))

        return both.mapInArrow(verify, "a bigint, check_a bigint, b bigint, check_b bigint")

    def pairs(self, members: DataFrame | None = None) -> DataFrame:
        """(key_a, key_b), key_a < key_b: every pair of records, copies included.

        ``members`` may be a part of ``members()``; only its records are paired.
        """
        members = self.members() if members is None else members
        copies = members.groupBy("class", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        same = copies.select(F.col("class").alias("a"), F.col("check").alias("check_a"), F.col("class").alias("b"), F.col("check").alias("check_b"))
        left = members.select(F.col("class").alias("a"), F.col("check").alias("check_a"), F.col("key").alias("x"))
        right = members.select(F.col("class").alias("b"), F.col("check").alias("check_b"), F.col("key").alias("y"))
        met = self.class_pairs().unionByName(same).join(left, ["a", "check_a"]).join(right, ["b", "check_b"]).where("a != b OR check_a != check_b OR x < y")
        return met.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b), the least node naming the component.

    Each round gives every node the least label among its own and its
    neighbours', then the label of that label; both are combined before the
    shuffle. Rounds are cut off from each other by checkpoints and go on until
    no label changes; labels only fall, so they end.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = cut_lineage(least.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), "old"))
        labels = step.select("node", "label")
        if step.where("label != old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _patterns(patterns: DataFrame, **options) -> tuple[NearDuplicates, DataFrame]:
    text = F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), "code").alias("text")
    found = NearDuplicates(patterns.where("code != ''").select("seq", text), "seq", "text", **options)
    current = patterns.groupBy("id").agg(F.max("seq").alias("key")).select("key")
    return found, found.members().join(current, "key", "left_semi")


def pattern_pairs(patterns: DataFrame, **options) -> DataFrame:
    """(seq_a, seq_b) of the current saved patterns whose name and code are near-duplicates.

    Rows with a null or empty code are in no pair, and neither are superseded
    rows. A null name counts as empty. An empty table gives an empty table.
    """
    found, members = _patterns(patterns, **options)
    return found.pairs(members).select(F.col("key_a").alias("seq_a"), F.col("key_b").alias("seq_b"))


def pattern_groups(patterns: DataFrame, **options) -> DataFrame:
    """(seq, group, links): the current patterns that have a near-duplicate.

    ``group`` is the least ``seq`` reached over pairs, ``links`` the number of
    patterns that the row is paired with, copies included. Copies are joined by
    their class and never expanded into pairs.
    """
    found, members = _patterns(patterns, **options)
    members = cut_lineage(members)
    # a class goes by the least of its current rows
    classes = members.groupBy("class", "check").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("node"))

    def side(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("check").alias(f"check_{x}"), F.col("n").alias(f"n_{x}"), F.col("node").alias(f"node_{x}"))

    met = found.class_pairs().join(side("a"), ["a", "check_a"]).join(side("b"), ["b", "check_b"])
    edges = cut_lineage(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b"))
    part = connected_groups(edges).select("node", F.col("component").alias("group"))
    one, other = edges.select(F.col("a").alias("node"), F.col("n_b").alias("m")), edges.select(F.col("b").alias("node"), F.col("n_a").alias("m"))
    links = one.unionByName(other).groupBy("node").agg(F.sum("m").alias("m"))
    known = classes.join(links, "node", "left").join(part, "node", "left").select(
        "class", "check", F.coalesce("group", "node").alias("group"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links")
    ).where("links > 0")
    return members.join(known, ["class", "check"]).select(F.col("key").alias("seq"), "group", "links")
