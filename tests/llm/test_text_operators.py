"""Encoding, container filling and look-alike forms."""
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from quarrykit.llm import bpe, lookalike, packing

HARD = ["", " ", "  a", "'s", "it's 's ''s we'll we'LL 'tis 'r 're don't've", "a\n\nb \n c", "\t\tx", "x'", "1's", "日本 語、テスト", "½²3x", "a　b", "\x1c\x1d x", "é", "🙂🙂 👍🏽", "<|endoftext|>", "a" * 5000, " ' s", "\x00\x01", "'v", "'l"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_encoder_matches_a_public_one(reference):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("a'strevlmd \n\t1é½。  ﬁ") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    encoder, got = bpe.Encoder(), []
    for part in bpe.chunks(pa.array(texts)):
        ids, count = encoder(part)
        stop = np.cumsum(count)
        got += [ids[a:b].tolist() for a, b in zip(stop - count, stop)]
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = bpe.PerfectHash(keys, np.arange(len(keys)))
    assert len(table.keys) == len(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()


def test_encode_rows(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    want = reference.encode_ordinary("Hello  world")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect()) == [(1, []), (2, []), (3, want), (3, want)]
    assert bpe.encode(df.limit(0)).collect() == []
    assert [f.simpleString() for f in bpe.encode(df).schema] == ["doc_id:bigint", "ids:array<int>"]


def test_bucket_bounds_minimise_padding():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 60, 14))
    counts = rng.integers(1, 9, len(lengths))

    def padding(bounds):
        return int((counts * (bounds[np.searchsorted(bounds, lengths)] - lengths)).sum())

    def least(k):
        best = {0: {0: 0}}
        for _ in range(k):
            new = {}
            for j in range(1, len(lengths) + 1):
                new[j] = min((best[i] if isinstance(best.get(i), int) else 0 if i == 0 else 10**9) + int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum()) for i in range(j))
            best = new
        return best[len(lengths)]

    for k in (1, 2, 4, 7):
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert padding(bounds) == least(len(bounds))
    assert (packing.bucket_bounds(lengths, counts, 99) == lengths).all()


@pytest.mark.parametrize("salt_rows,buckets", [(200_000, 2048), (7, 2048), (200_000, 4)])
def test_containers(spark, monkeypatch, salt_rows, buckets):
    monkeypatch.setattr(packing, "SALT_ROWS", salt_rows)
    rng = random.Random(1)
    sizes = [0, 0, 10, 10, 25, 100, None] + [rng.choice([1, 2, 3, 3, 3, 7, 9, 10, 11, 31]) for _ in range(150)]
    lengths = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([(1, 10), (2, 64), (3, 0), (4, None)], "budget_id int, capacity int")
    rows = packing.fill_containers(lengths, budgets, max_buckets=buckets).toPandas()
    assert set(rows.budget_id) == {1, 2}
    for budget, capacity in ((1, 10), (2, 64)):
        own = rows[rows.budget_id == budget]
        used = own.groupby("container").n_tokens.sum()
        assert used.max() <= capacity
        assert (own.n_tokens <= own.bucket).all()
        for doc, pieces in own.groupby("doc_id"):
            pieces, size = pieces.sort_values("piece"), sizes[doc] or 0
            assert pieces.n_tokens.sum() == size and len(pieces) == max(1, -(-size // capacity))
            assert pieces.start_token.tolist() == [capacity * i for i in range(len(pieces))]
        if buckets > 4:
            assert (used > 0).sum() <= -(-sum(s or 0 for s in sizes) // capacity) + 2


def test_batches_of_padded_items():
    rng = np.random.default_rng(5)
    for capacity, most, buckets in ((64, 64, 5), (1000, 400, 8), (97, 97, 3)):
        sizes = np.unique(rng.integers(1, most + 1, 60))
        counts = rng.integers(1, 60, len(sizes))
        bounds = packing.bucket_bounds(sizes, counts, buckets)
        assert len(bounds) <= buckets < len(sizes)
        rows, opened = packing.plan(sizes, counts, bounds, capacity)
        used, held = np.zeros(opened, np.int64), {s: [] for s in sizes.tolist()}
        for size, rank, first, each in rows.tolist():
            held[size].append((rank, first, each))
        for size, count in zip(sizes.tolist(), counts.tolist()):
            parts = sorted(held[size])
            assert parts[0][0] == 0
            for (rank, first, each), stop in zip(parts, [p[0] for p in parts[1:]] + [count]):
                np.add.at(used, first + np.arange(stop - rank) // each, size)
        # every rank has one place, and no container holds more than it can
        assert used.sum() == (sizes * counts).sum() and used.max() <= capacity
        # about as many containers as first fit decreasing over exact lengths
        room = []
        for size, count in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
            for _ in range(count):
                at = next((i for i, r in enumerate(room) if r >= size), None)
                if at is None:
                    room.append(capacity - size)
                else:
                    room[at] -= size
        assert opened <= 1.01 * len(room) + 2


def test_fill_of_containers(spark):
    rng = random.Random(3)
    lengths = spark.createDataFrame([(i, rng.randint(0, 200)) for i in range(3000)], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([(1, 64, "x"), (2, 512, "x")], "budget_id int, capacity int, fill string")
    placed = packing.fill_containers(lengths, budgets, max_buckets=8)
    rows = {r.budget_id: r for r in packing.container_fill(placed, budgets).collect()}
    for budget, capacity in ((1, 64), (2, 512)):
        own = placed.where(f"budget_id = {budget} AND n_tokens > 0").toPandas()
        assert rows[budget].tokens == own.n_tokens.sum() and rows[budget].containers == own.container.nunique()
        assert rows[budget].padded_rows == (own.bucket > own.n_tokens).sum() > 0 and rows[budget].padding == (own.bucket - own.n_tokens).sum()
        assert rows[budget].fill > 0.99 and rows[budget].least_containers == -(-own.n_tokens.sum() // capacity)
    many = spark.createDataFrame([(i, 10) for i in range(packing.MAX_BUDGETS + 1)], "budget_id int, capacity int")
    with pytest.raises(ValueError):
        packing.fill_containers(lengths, many)


def test_containers_of_nothing(spark):
    lengths = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([(1, 10)], "budget_id int, capacity int")
    assert packing.fill_containers(lengths, budgets).collect() == []
    some = spark.createDataFrame([(1, 3)], "doc_id bigint, n_tokens bigint")
    assert packing.fill_containers(some, budgets.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint")
    assert sorted((r.doc_id, r.container, r.n_tokens) for r in packing.fill_containers(blank, budgets).collect()) == [(1, 0, 0), (2, 0, 0)]


SAME = ["Für 3 Pumpen: see file-name.", "Für 3 Pumpen: see ﬁle-name.", "Für 3 Pump​en: ｓｅｅ ﬁle‑name．", "Für 3 Pumреn: see file‐name.﻿"]
APART = ["Fur 3 Pumpen: see file-name.", "Für ³ Pumpen: see file-name.", "für 3 Pumpen: see file-name.", "Für 4 Pumpen: see file-name."]


def test_visible_form():
    table = lookalike.shape_table()
    forms = {lookalike.visible(t, table) for t in SAME}
    assert len(forms) == 1
    others = [lookalike.visible(t, table) for t in APART]
    assert len(set(others)) == len(APART) and not forms & set(others)
    assert lookalike.visible("ｶﾞ", table) == lookalike.visible("ガ", table) == lookalike.visible("ガ", table)
    assert lookalike.comparable("ＦÜR ³", table) == lookalike.comparable("für 3", table)


def test_look_alike_pairs(spark):
    rows = [(i, t) for i, t in enumerate(SAME + APART)] + [(20, SAME[0]), (21, SAME[0]), (30, None), (31, ""), (32, " "), (33, "​"), (34, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    got = sorted((r.doc_id_a, r.doc_id_b) for r in lookalike.look_alike_pairs(df).collect())
    kinds = {0: 0, 1: 1, 2: 2, 3: 3, 20: 0, 21: 0}
    assert got == sorted((a, b) for a in kinds for b in kinds if a < b and kinds[a] != kinds[b])
    assert lookalike.look_alike_pairs(df.limit(0)).collect() == []
    assert {r.doc_id: r.form for r in lookalike.visible_form(df).collect()}[30] is None


def test_hits_and_misses_are_told_by_their_bytes(reference):
    made = bpe.vocabulary()
    encoder = bpe.Encoder(made)
    text = "Hello zqxjvw zqxjvv " + "ab" * 200 + " " + "ab" * 200 + "c"
    want = reference.encode_ordinary(text)
    assert encoder([text.encode()])[0].tolist() == want

    class OneKey(bpe.SpanHash):
        """Hashes that all meet: only the bytes can tell pre-tokens apart."""

        def __call__(self, data, start, end):
            return np.full(len(start), made["keys"][7], np.uint64)

    encoder.hash = OneKey(1 << 12)
    assert encoder([text.encode()])[0].tolist() == want


def test_spans():
    rng = random.Random(8)
    data = bytes(rng.choice(b"ab") for _ in range(300))
    spans = bpe.Spans(data)
    a, b = (np.array([rng.randrange(260) for _ in range(4000)]) for _ in range(2))
    n, m = (np.array([rng.randrange(1, 40) for _ in range(4000)]) for _ in range(2))
    m[::2] = n[::2]
    want = [data[i : i + k] == data[j : j + l] for i, j, k, l in zip(a, b, n, m)]
    assert spans.same(a, n, spans, b, m).tolist() == want and any(want)


def test_executors_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = (
        "import sys; sys.path.append(sys.argv[1])\n"
        "from quarrykit.session import local_session\n"
        "spark = local_session('2', partitions=2, memory='1g')\n"
        "from quarrykit.llm import bpe, lookalike, packing\n"
        "docs = spark.createDataFrame([(1, 'Hello world'), (2, None)], 'doc_id bigint, text string')\n"
        "budgets = spark.createDataFrame([(1, 8)], 'budget_id int, capacity int')\n"
        "print(bpe.encode(docs).count(), packing.pack_documents(docs, budgets).count(), lookalike.look_alike_pairs(docs).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["2", "2", "0"], done.stderr[-2000:]


def test_letters_of_other_scripts(spark):
    table = lookalike.shape_table(spark)
    for one, other in (("Ꭺdmin", "Admin"), ("ѵia", "via"), ("ⲟpen", "open"), ("ΡΑΥ", "PAY"), ("⼈", "人"), ("ﾊﾟ", "パ"), ("a b　c", "a b c")):
        assert lookalike.visible(one, table) == lookalike.visible(other, table)
    for one, other in (("α", "a"), ("г", "r"), ("ı", "i"), ("é", "e"), ("ß", "β"), ("ł", "l"), ("’", "'"), ("—", "ー"), ("O", "0"), ("l", "I"), ("𝐚", "a"), ("м", "m"), ("二", "ニ")):
        assert lookalike.visible(one, table) != lookalike.visible(other, table)
    assert all(len(v) == 1 for k, v in lookalike.confusable_letters(spark).items()) and lookalike.confusable_letters(None) == {}


@pytest.mark.parametrize("part", [20_000, 2])
def test_forms_and_pairs_agree(spark, monkeypatch, part):
    monkeypatch.setattr(lookalike, "PART_ROWS", part)
    rows = [(i, t) for i, t in enumerate(SAME * 3 + APART * 2)] + [(90, None), (91, ""), (92, " ​")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as form", "'clash' as parts")
    forms = lookalike.look_alike_forms(df).collect()
    pairs = {(a.doc_id, b.doc_id) for a in forms for b in forms if a.doc_id < b.doc_id and a.form == b.form and a.spelling != b.spelling}
    got = [(r.doc_id_a, r.doc_id_b) for r in lookalike.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) == 54
    assert {(r.form, r.form_rows, r.form_spellings) for r in forms} == {(0, 12, 4)} and len(forms) == 12
    assert lookalike.look_alike_forms(df.limit(0)).collect() == []
    assert {r.doc_id: r.form for r in lookalike.comparison_form(df).collect()}[90] is None
