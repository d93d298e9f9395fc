"""Search, relevance, prompts, the store and replies."""
import itertools

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import classify as C
from quarrykit.functions.textfn import contains_code
from quarrykit.operators import reply, retrieve, store
from quarrykit.sources import kbjson

PATTERNS = [
    (0, "p1", "OrderController Pattern", "java", "controller", "create a new order controller", ["controller", "rest"], "code one"),
    (1, "p2", "UserService Pattern", "typescript", "service", "user lookup", ["service", None], "code two"),
    (2, "p3", "Button Pattern", "typescript", "component", "", [], None),
]
CLASSES = [(0, "OrderController", "/ws/src/legacy/OrderController.js", "controller"), (1, "UserService", "/ws/src/user.service.ts", "service"), (2, "appConfig", "/ws/src/app.config.ts", "config"), (3, "Button", "/ws/src/Button.tsx", "component")]
FENCE = "```"
R1 = f"Here:\n{FENCE}java\npublic class PaymentController {{}}\n{FENCE}\nand\n{FENCE}ts\nexport const a = 1;\n{FENCE}"


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(PATTERNS, "seq bigint, id string, name string, language string, type string, description string, tags array<string>, code string")


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame(CLASSES, "first_pos int, class_name string, file_path string, type string").withColumn("language", F.lit("typescript")).withColumn("content", F.lit("export class X {}"))


def test_search(patterns):
    for query, want in {"CONTROLLER": ["p1"], "create a new order controller": ["p1"], "make an order controller": [], "rest": ["p1"], "typescript": [], "": ["p1", "p2", "p3"]}.items():
        assert [r.id for r in store.search(patterns, query).orderBy("seq").collect()] == want, query


def test_relevance(spark, classes):
    questions = spark.createDataFrame([("a", "create a new order controller"), ("b", "Create a new order-controller, réque service!"), ("c", "src"), ("d", "config"), ("e", "to do"), ("f", None)], "question_id string, question string")
    got = {r.question_id: r.places for r in retrieve.relevant_classes(questions, classes).collect()}
    assert got == {"a": [0], "b": [0, 1], "c": [0, 1], "d": [2]}


def test_first_containing_is_exact(spark):
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product("abc", repeat=n)]
    rows = [(i, [words[(i * 7) % len(words)] + words[(i * 5 + 1) % len(words)], None if i % 9 == 0 else "x" * (i % 3)]) for i in range(60)]
    hay = spark.createDataFrame(rows, "n int, texts array<string>")
    asked = ["", "a", "ab", "abc", "cba", "zz", "xx", "abcabcabcabcabc", *words[:20]]
    needles = spark.createDataFrame([(w,) for w in asked] + [(None,)], "needle string")
    got = {r.needle: r.places for r in retrieve.first_containing(needles, hay, "n", "texts").collect()}
    want = {w: [i for i, t in rows if any(x is not None and w in x for x in t)][:2] for w in asked}
    assert got == {k: v for k, v in want.items() if v}


def test_prompts_and_summary(spark, classes, patterns):
    questions = spark.createDataFrame([("a", "user lookup"), ("b", "nothing here"), ("c", "button")], "question_id string, question string")
    got = {r.question_id: r for r in retrieve.prompts(questions, classes, patterns).withColumn("summary", retrieve.summary(F.col("prompt"))).collect()}
    assert got["b"].prompt == "nothing here" and not got["b"].has_context and got["b"].summary == retrieve.SUMMARY_NONE
    assert got["a"].prompt.startswith("Saved patterns from Knowledge Base:\n\n**UserService Pattern** (service):\n```typescript\ncode two\n```\n\nCurrent workspace code:\n\n**UserService** (service):")
    assert got["a"].prompt.endswith("---\n\nUser: user lookup\n\nFollow the patterns shown above.")
    assert got["a"].summary == "📚 From Knowledge Base:\n  • UserService Pattern (service)\n💻 From Workspace:\n  • UserService (service)"


def test_empty_tables(spark, classes, patterns):
    none = spark.createDataFrame([], "question_id string, question string")
    assert retrieve.prompts(none, classes, patterns).count() == 0
    some = spark.createDataFrame([("a", "order")], "question_id string, question string")
    assert [r.prompt for r in retrieve.prompts(some, classes.limit(0), patterns.limit(0)).collect()] == ["order"]


def test_store_log(spark, tmp_path):
    path = str(tmp_path / "log")
    kbjson.bootstrap(spark, path)
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "name string").selectExpr("name", "'java' language", "'service' type", "'x' code", "'' description", "'' query", "array('t') tags")
    store.append_patterns(rows, path)
    kbjson.bootstrap(spark, path)
    log = spark.read.parquet(path)
    assert log.count() == 3 and log.select("id").distinct().count() == 3
    gone = log.where("name = 'B'").select("id").collect()[0].id
    store.delete_patterns(spark.createDataFrame([(gone,), ("unknown",)], "id string"), path)
    now = store.current(spark.read.parquet(path))
    assert sorted(r.name for r in now.collect()) == ["A", "C"]
    assert store.stats(now, "here").collect()[0].asDict() == {"feature_count": 0, "pattern_count": 2, "path": "here"}


def test_index_document(spark, tmp_path):
    old, new = tmp_path / "old.json", tmp_path / "new.json"
    old.write_text('{"version":"1.0.0","createdAt":"2025-11-01T05:01:45.123Z","lastUpdated":"x","featureCount":0}')
    new.write_text('{\n "version":"1.0.0",\n "patterns":[{"id":"p1","name":"N","tags":["a"],"savedAt":"2025"}]}')
    assert kbjson.read_index(spark, str(old)).first().patterns == []
    row = kbjson.patterns_of(kbjson.read_index(spark, str(new))).first()
    assert (row.seq, row.id, row.saved_at, row.tags, row.code) == (0, "p1", "2025", ["a"], None)


def test_code_blocks_and_suggestions(spark):
    texts = [R1, "no code here", f"{FENCE}java\r\nA\r\n{FENCE}", f"{FENCE}c++\nB\n{FENCE} u {FENCE}\nC\n{FENCE}", f"{FENCE}c++\nB\n{FENCE}\ntext\n{FENCE}java\nA\n{FENCE}", "the class of things", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", C.code_blocks(F.col("t")).alias("b"), contains_code(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.b for r in got] == [["public class PaymentController {}", "export const a = 1;"], [], [], ["C"], ["text"], [], []]
    assert [r.c for r in got] == [True, False, True, True, True, True, False]
    forms = reply.save_form(spark.createDataFrame([(R1, "create payment controller"), ("", None), ("no code", "x")], "response string, query string")).collect()
    assert (forms[0].language, forms[0].suggested_name, forms[0].suggested_tags) == ("java", "PaymentController Pattern", "controller, payment")
    assert [f.status for f in forms] == ["form", "no_response", "no_code"]
    names = spark.createDataFrame([("x = 1", "build the thing"), ("x = 1", "do it")], "c string, q string").select(C.suggested_name(F.col("c"), F.col("q"))).collect()
    assert [n[0] for n in names] == ["Build Thing Pattern", "Custom Pattern"]


def test_fold_replies_and_model_hook(spark):
    rows = [("s", "r", 2, "c"), ("s", "r", 0, "a"), ("s", "r", 1, None), ("s", "r", 0, "a"), ("s", "q", 0, None)]
    got = {r.request_id: r.response for r in reply.fold_replies(spark.createDataFrame(rows, "session_id string, request_id string, fragment_seq int, fragment string")).collect()}
    assert got == {"r": "ac", "q": ""}
    prompts = spark.createDataFrame([("a", "x"), ("b", None)], "question_id string, prompt string")
    assert {r.question_id: r.response for r in reply.answered(prompts, lambda p: [x.upper() for x in p]).collect()} == {"a": "X", "b": None}
    assert [r.response for r in reply.answered(prompts).collect()] == [None, None]
