"""Extraction, scanning and snippets on small hand-traced sources."""
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import classify as C
from quarrykit.functions import textfn as T
from quarrykit.operators.snippet import essential_snippet
from quarrykit.sources import corpus

ORDER = """package com.acme;

import x.Y;

@RestController
@RequestMapping("/orders")
public class OrderController {
    private final OrderService orderService;

    public OrderController(OrderService orderService) {
        this.orderService = orderService;
    }

    public Order get(Long id) { return orderService.get(id); }
    public Order get(String key) { return null; }
    public List<Order> list() { return null; }
    public void delete(Long id) { }
    public void purge() { }
}
"""
USER = """import { Injectable } from '@nestjs/common';
@Injectable()
export class UserService {
  constructor(private repo: UserRepository, private log: Logger) {}
  async find(id: string) { return this.repo.find(id); }
}
"""
FILES = [
    ("/ws/src/main/java/com/acme/OrderController.java", ORDER),
    ("/ws/src/user.service.ts", USER),
    ("/ws/src/OrderController.test.ts", "export class T {}"),
    ("/ws/src/helpers.js", "const x = 1;"),
    ("/ws/src/legacy/OrderController.js", "export class OrderController {}"),
    ("/ws/src/Button.tsx", "export const Button = () => null;"),
    ("/ws/src/app.config.ts", "export function appConfig() {}"),
    ("/ws/src/A.java", "@Autowired\nprivate static final Foo foo;"),
    ("/ws/src/real.ts", "// class of things\nexport function realName() {}"),
    ("/ws/src/B.java", "@Autowired\nprivate BarRepo bar;\n@Autowired private final Baz baz;"),
    ("/ws/src/App.jsx", "export default function App() {}"),
    ("/ws/node_modules/p/index.js", "export class Hidden {}"),
    ("/ws/src/none.ts", None),
]


@pytest.fixture(scope="module")
def extracted(spark):
    files = spark.createDataFrame(FILES, "file_path string, content string")
    return {r.file_path.split("/")[-1] + ("*" if "legacy" in r.file_path else ""): r for r in corpus.extract(corpus.scanned(files)).collect()}


def test_extraction(extracted):
    want = {
        "OrderController.java": ("OrderController", "controller", "java", ["OrderService"]),
        "user.service.ts": ("UserService", "service", "typescript", ["UserRepository"]),
        "OrderController.js*": ("OrderController", "controller", "javascript", []),
        "Button.tsx": ("Button", "component", "typescript", []),
        "app.config.ts": ("appConfig", "config", "typescript", []),
        "real.ts": ("of", "component", "typescript", []),
    }
    assert {k: (r.class_name, r.type, r.language, r.dependencies) for k, r in extracted.items()} == want


def test_dependencies_alone(spark):
    rows = spark.createDataFrame([(FILES[7][1],), (FILES[9][1],), (None,)], "c string").select(C.dependencies(F.col("c"))).collect()
    assert [r[0] for r in rows] == [["static"], ["BarRepo", "Baz"], []]


def test_class_map_keeps_last_at_first_place(spark):
    rows = [(0, "OrderController", "F0"), (1, "UserService", "F1"), (2, "appConfig", "F6"), (3, "Button", "F5"), (4, "OrderController", "F4")]
    found = corpus.class_map(spark.createDataFrame(rows, "pos int, class_name string, file string")).orderBy("first_pos").collect()
    assert [(r.class_name, r.file) for r in found] == [("OrderController", "F4"), ("UserService", "F1"), ("appConfig", "F6"), ("Button", "F5")]


def test_scan_cap_and_reading(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "node_modules" / "x.ts").write_text("export class X {}")
    (tmp_path / "a" / "y.py").write_text("class Y: pass")
    for i in range(5):
        (tmp_path / f"f{i}.ts").write_bytes(b"export class F%d {}\r\n\xff\n" % i)
    files = corpus.read_source_files(spark, str(tmp_path))
    capped = corpus.scanned(files, limit=3).orderBy("file_ord").collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in capped] == ["f0.ts", "f1.ts", "f2.ts"]
    assert capped[0].content == "export class F0 {}\r\n�\n"
    assert corpus.read_source_files(spark, None).count() == 0


def test_snippets(spark):
    rows = spark.createDataFrame([(ORDER, "OrderController"), (USER, "UserService"), ("export function appConfig() {}", "appConfig"), (None, "X"), ("", None)], "c string, n string")
    got = [r[0] for r in rows.select(essential_snippet(F.col("c"), F.col("n"))).collect()]
    assert got[0] == 'package com.acme;\n@RestController\n@RequestMapping("/orders")\npublic class OrderController {\n\npublic OrderController(OrderService orderService)\n\npublic Order get(Long id)\npublic List<Order> list()\npublic void delete(Long id)\n}'
    assert got[1] == "import { Injectable } from '@nestjs/common';\n@Injectable()\nexport class UserService {\n\nconstructor(private repo: UserRepository, private log: Logger)\n\nasync find(id: string)\n}"
    assert got[2:] == ["\n\n}", None, "\n\n}"]


def test_keywords_and_trim(spark):
    rows = spark.createDataFrame([("create a new order controller",), ("Create a new order-controller, réque service!",), ("to do",), ("",), (None,)], "q string")
    assert [r[0] for r in rows.select(T.keywords(F.col("q"))).collect()] == [["order", "controller"], ["order", "controller", "que", "service"], [], [], []]
    blank = spark.createDataFrame([("﻿ \t a b \r\n",)], "q string")
    assert blank.select(T.trim_all(F.col("q"))).first()[0] == "a b"


def test_tags_preview_language(spark):
    one = spark.createDataFrame([(" a, ,b,", "x" * 503)], "t string, c string")
    row = one.select(T.tag_list(F.col("t")).alias("a"), T.tag_list(F.col("t"), keep_empty=True).alias("b"), T.preview(F.col("c")).alias("p")).first()
    assert row.a == ["a", "b"] and row.b == ["a", "", "b", ""] and row.p == "x" * 500 + "\n\n... [truncated 3 characters]"
    codes = spark.createDataFrame([("package main\nfunc main() {}",), ("import x from 'y'",), ("func add() {}",), ("SELECT 1",), (None,)], "c string")
    assert [r[0] for r in codes.select(C.code_language(F.col("c"))).collect()] == ["java", "python", "go", "java", "java"]


def test_tree_of_any_names(spark, tmp_path):
    rows = [("/ws/a/__generated__/_app.tsx", "a\r\n"), ("/ws/.hidden/b.ts", ""), ("/ws/a/deep/er/and/deeper/C.java", "é"), ("/D.js", "d"), ("/ws/a/node_modules/x/E.js", "e"), ("/ws/a/f.py", "f"), ("/ws/a/g.ts", None), (None, "h")]
    df = spark.createDataFrame(rows, "file_path string, content string").selectExpr("*", "'clash' as path")
    corpus.write_source_files(df, str(tmp_path / "tree"))
    got = {(r.file_path.removeprefix(str(tmp_path / "tree")), r.content) for r in corpus.read_source_files(spark, f"file:{tmp_path}/tree").collect()}
    assert got == set(rows[:4])
    assert corpus.read_source_files(spark, str(tmp_path / "none")).collect() == []


def test_extension_and_trim_as_in_the_reference(spark):
    names = [("a/b..ts", "typescript"), (".ts", "unknown"), ("a/.b.ts", "typescript"), ("x.ts/y", "unknown"), ("a.TS", "unknown"), (None, "unknown")]
    got = spark.createDataFrame(names, "p string, want string").select(C.file_language(F.col("p")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    text = spark.createDataFrame([("\x85 a\x85 ",), (" ﻿ b　",)], "t string").select(T.trim_all(F.col("t"))).collect()
    assert [r[0] for r in text] == ["\x85 a\x85", "b"]


def test_previews(spark):
    df = spark.createDataFrame([("x" * 501,), ("x" * 100,), ("",), (None,)], "t string")
    got = df.select(T.confirm_preview(F.col("t")), T.short_preview(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("x" * 500 + "\n\n... [1 more characters]", "x" * 100 + "..."), ("x" * 100,) * 2, ("", ""), (None, None)]
