"""The essential lines of a class: its package, declaration, constructor and first methods."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.textfn import first_match, let, trim_all

METHODS = 3


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def _signature(line: Column) -> Column:
    return trim_all(F.substring_index(line, "{", 1))


def essential_snippet(content: Column, name: Column, methods: int = METHODS) -> Column:
    """Package or injectable import; annotations and class line; constructor; methods; closing brace.

    A line is never given twice before the methods, and a method name only
    once. Parts that are not found leave their place empty. A null content
    gives null; a null name finds no class line and no constructor.
    """
    name = F.coalesce(name, F.lit("\0"))
    none, blank = F.array().cast("array<string>"), F.array(F.lit(""))
    trimmed = F.filter(F.transform(F.split(content, "\n"), trim_all), lambda x: F.length(x) > 0)

    def place(lines: Column) -> Column:
        package = _first(lines, lambda x: x.startswith("package ") | (x.startswith("import ") & x.contains("Injectable")))
        is_class = F.transform(lines, lambda x: x.contains(F.concat(F.lit("class "), name)) | x.contains(F.concat(F.lit("export const "), name)))
        return F.struct(package.alias("package"), F.array_position(is_class, True).cast("int").alias("at"))

    def head(lines: Column, found: Column) -> Column:
        package, at = found["package"], found["at"]
        start = F.greatest(at - 2, F.lit(1))
        before = F.when(at > 1, F.slice(lines, start, at - start)).otherwise(none)
        marks = F.array_distinct(F.filter(before, lambda x: x.startswith("@") & ~x.eqNullSafe(package)))
        class_line = F.when(at > 0, F.get(lines, at - 1))
        return let(F.concat(F.array_compact(F.array(package)), marks), lambda told: F.concat(told, F.array_compact(F.array(F.when(~F.array_contains(told, class_line), class_line)))))

    def maker(lines: Column, told: Column) -> Column:
        line = _first(lines, lambda x: (x.contains("constructor(") | x.contains(F.concat(F.lit("public "), name, F.lit("(")))) & ~F.array_contains(told, x))
        return F.array_compact(F.array(_signature(line)))

    def some_methods(lines: Column) -> Column:
        candidates = F.filter(lines, lambda x: (x.startswith("public ") | x.startswith("async ")) & x.contains("(") & ~x.contains("constructor") & ~x.contains(F.concat(name, F.lit("("))))
        named = F.transform(F.transform(candidates, _signature), lambda x: F.struct(x.alias("text"), first_match(x, r"\b(\w+)\s*\(").alias("name")))
        named = F.filter(named, lambda x: x["name"].isNotNull())
        once = let(named, lambda all_named: F.filter(all_named, lambda x, i: F.array_position(F.transform(all_named, lambda y: y["name"]), x["name"]) == i + 1))
        return F.transform(F.slice(once, 1, methods), lambda x: x["text"])

    def whole(lines: Column) -> Column:
        told = let(place(lines), lambda found: head(lines, found))
        return F.array_join(F.concat(let(told, lambda t: F.concat(t, blank, maker(lines, t))), blank, some_methods(lines), F.array(F.lit("}"))), "\n")

    return F.when(content.isNotNull(), let(trimmed, whole))
