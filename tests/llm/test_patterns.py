"""Co-occurring tags, term counts and near-duplicates against brute force."""
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrykit.llm import cooccur, neardup, termfreq

SCHEMA = "seq bigint, id string, name string, language string, tags array<string>, code string, items string"


def log(spark, n=400, seed=4):
    rng = random.Random(seed)
    words = ["rest", " REST ", "b", "c", "d", "é", "", " ", None, "e", "f", "rare%d"]
    rows = []
    for seq in range(n):
        tags = None if seq % 41 == 0 else [(w % rng.randint(0, 90) if w and "%" in w else w) for w in rng.choices(words, weights=[9, 3, 6, 5, 4, 3, 1, 1, 1, 2, 2, 2], k=rng.randint(0, 6))]
        rows.append((seq, f"i{rng.randint(0, int(n * 0.8))}", "x", rng.choice(["java", " Java", "go", "", None, f"l{seq % 50}"]), tags, "c", "clash"))
    return rows, spark.createDataFrame(rows, SCHEMA)


def current(rows):
    return list({r[1]: r for r in sorted(rows)}.values())


def clean(x):
    return x.strip().lower() if x and x.strip() else None


@pytest.mark.parametrize("long_record,block", [(128, 65536), (2, 50)])
def test_tag_pairs(spark, monkeypatch, long_record, block):
    monkeypatch.setattr(cooccur, "LONG_RECORD", long_record)
    monkeypatch.setattr(cooccur, "BLOCK_RECORDS", block)
    monkeypatch.setattr(cooccur, "ITEM_BLOCK", 3)
    monkeypatch.setattr(cooccur, "PAIRS", 40)
    monkeypatch.setattr(cooccur, "BLOCK_ITEMS", block * 3)
    rows, df = log(spark)
    sets = [s for r in current(rows) if (s := {clean(t) for t in r[4] or [] if clean(t)})]
    one = Counter(t for s in sets for t in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    want = {(a, b): (n, one[a], one[b], len(sets)) for (a, b), n in two.items() if n >= 5 and n * len(sets) >= 1 * one[a] * one[b]}
    got = {(r.tag_a, r.tag_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in cooccur.pattern_tag_pairs(df, lift=1).collect()}
    assert got == want and want
    assert cooccur.pattern_tag_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("heavy", [2, 512])
def test_term_counts(spark, heavy):
    rows, df = log(spark)
    now = current(rows)
    uses, records = Counter(), Counter()
    for r in now:
        tags = [clean(t) for t in r[4] or [] if clean(t)]
        for t in tags:
            uses["tags", t] += 1
        for t in set(tags):
            records["tags", t] += 1
        if clean(r[3]):
            uses["language", clean(r[3])] += 1
            records["language", clean(r[3])] += 1
    mark = lambda n: "rare" if n <= 2 else "common" if n * 10 >= len(now) else None
    got = {(r.field, r.term): (r.uses, r.records, r.mark) for r in termfreq.pattern_terms(df, heavy=heavy).collect()}
    assert got == {k: (uses[k], records[k], mark(records[k])) for k in uses}
    assert termfreq.pattern_terms(df.limit(0)).collect() == []


def texts(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    found = []
    for family in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 60]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], rng.choice(vocabulary)]])
            found.append(" ".join(copy))
    return found + [found[0].upper(), found[0], "one two", "", "KKelvin a b c", "kkelvin A b C", None, "boiler plate " * 40]


def brute(rows, words=3, num=1, den=2):
    sets = {}
    for key, text in rows:
        w = re.findall("[a-z0-9_]+", (text or "").lower())
        sets[key] = set(zip(*[w[i:] for i in range(words)]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (c := len(sets[a] & sets[b])) and den * c >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [512, 2])
def test_near_duplicates(spark, hot):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "key bigint, text string")
    found = neardup.NearDuplicates(df, "key", "text", hot_bucket=hot)
    got = [(r.key_a, r.key_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def few_run_pairs(n):
    """n pairs each of sets of word runs with 1/2, 2/4 and 3/6 runs in common, no word used twice."""
    rows = []
    for i, common in itertools.product(range(n), (1, 2, 3)):
        words = [f"p{i}c{common}w{j}" for j in range(2 * common + 2)]
        rows += [(len(rows), " ".join(words[: common + 2])), (len(rows) + 1, " ".join(words))]
    return rows


@pytest.mark.parametrize("few,least", [(16, 1.0), (0, 0.99)])
def test_pairs_of_few_runs(spark, few, least):
    rows = few_run_pairs(150)
    want = {(key, key + 1) for key, _ in rows[::2]}
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "key bigint, text string"), "key", "text", few_runs=few)
    got = {(r.key_a, r.key_b) for r in found.pairs().collect()}
    assert got <= want and len(got) >= least * len(want)


def test_other_similarity(spark):
    rows = list(enumerate(texts(9)))
    df = spark.createDataFrame(rows, "key bigint, text string")
    found = neardup.NearDuplicates(df, "key", "text", words=5, similarity=(4, 5), hot_bucket=1)
    assert {(r.key_a, r.key_b) for r in found.pairs().collect()} == brute(rows, 5, 4, 5)


def test_pattern_pairs_and_groups(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, "a", "N", base), (2, "a", "N", base + " lambda"), (3, "b", "N", base), (4, "c", None, base), (5, "d", "N", None), (6, "e", "N", ""), (7, "f", "N", base), (8, "g", "M", "nothing like it at all"),
    ]
    df = spark.createDataFrame(rows, "seq bigint, id string, name string, code string")
    assert sorted(map(tuple, neardup.pattern_pairs(df).collect())) == [(2, 3), (2, 4), (2, 7), (3, 4), (3, 7), (4, 7)]
    assert sorted(map(tuple, neardup.pattern_groups(df).collect())) == [(2, 2, 3), (3, 2, 3), (4, 2, 3), (7, 2, 3)]
    assert neardup.pattern_pairs(df.limit(0)).collect() == [] and neardup.pattern_groups(df.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 200)]
    got = {r.node: r.component for r in neardup.connected_groups(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}


@pytest.mark.parametrize("crowd,piece", [(3, 1), (3, 7), (50, 1000), (2, 5)])
def test_bucket_pairs(crowd, piece):
    rng = random.Random(crowd * piece)
    rows = sorted((rng.choice([-5, 0, 1, 2, 3, 9, 9, 9, 9]), rng.randrange(40)) for _ in range(120))
    made, pairs, crowded = neardup._BucketPairs(crowd), set(), set()
    for at in range(0, len(rows), piece):
        bucket, own = np.array(rows[at : at + piece], np.int64).T
        a, b, c = made.add(bucket, own)
        pairs |= set(zip(a.tolist(), b.tolist()))
        crowded |= set(c.tolist())
    a, b, c = made.add(np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)
    pairs |= set(zip(a.tolist(), b.tolist()))
    crowded |= set(c.tolist())
    classes = {}
    for bucket, own in rows:
        classes.setdefault(bucket, set()).add(own)
    assert pairs == {p for c in classes.values() if len(c) <= crowd for p in itertools.combinations(sorted(c), 2)}
    assert crowded == {x for c in classes.values() if len(c) > crowd for x in c}


def test_crowded_buckets_leave_where_they_are_made(spark):
    # 300 texts with one half in common: every band of that half is crowded
    half = " ".join(f"s{i}" for i in range(40))
    rows = [(i, half + " " + " ".join(f"u{i // 2}x{j}" for j in range(14)) + (" end" if i % 2 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "key bigint, text string").repartition(3)
    found = neardup.NearDuplicates(df, "key", "text", words=2, similarity=(4, 5), hot_bucket=8)
    assert found.band_rows().where("bucket IS NULL").count() > 0
    assert found.band_rows().where("bucket IS NOT NULL").groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 3 * 9
    assert {(r.key_a, r.key_b) for r in found.pairs().collect()} == brute(rows, 2, 4, 5)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)]
    got = neardup.connected_groups(spark.createDataFrame(edges, "a bigint, b bigint")).select("component").distinct().collect()
    assert [r[0] for r in got] == [0]
