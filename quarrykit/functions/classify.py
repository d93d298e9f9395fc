"""Extraction and classification of code: names, languages, component types, suggestions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.textfn import TAG_STOP_WORDS, contains_any, first_match, first_upper, trim_all

#: Language of a file extension; the comparison minds the case.
LANGUAGES = {".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
#: The patterns of a class name, in order of precedence.
CLASS_NAME = [r"(?:public\s+)?class\s+(\w+)", r"export\s+(?:class|function)\s+(\w+)", r"export\s+const\s+(\w+)\s*[:=]"]
#: The patterns of injected types and the group that holds the type.
DEPENDENCIES = [
    (r"@Autowired[\s\S]*?private\s+(?:final\s+)?(\w+)\s+\w+", 1),
    (r"private\s+final\s+(\w+)\s+\w+", 1),
    (r"constructor\s*\([^)]*?(\w+):\s*(\w+)", 2),
]
#: Component type by parts of the file name, then by patterns of the content.
TYPE_BY_NAME = [("controller", ["controller", "router"]), ("service", ["service"]), ("repository", ["repository", "dao"]), ("config", ["config"])]
TYPE_BY_CONTENT = [("controller", r"@RestController|@Controller|Router\(\)"), ("service", r"@Service|@Injectable"), ("repository", r"@Repository|extends.*Repository")]
#: Language of a code block by what it contains, in order of precedence.
LANGUAGE_BY_CODE = [
    ("java", ["package ", "@RestController", "public class"]),
    ("typescript", ["export class", "@Injectable"]),
    ("python", ["def ", "import "]),
    ("go", ["func ", "package main"]),
]
#: Tags that a code block suggests by what it contains.
TAG_BY_CODE = [("controller", "Controller"), ("service", "Service"), ("repository", "Repository"), ("rest", "@RestController"), ("grpc", "grpc")]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_language(path: Column) -> Column:
    """Language by extension, ``unknown`` for any other and for a null path.

    The extension is what the last dot of the base name begins, unless that dot
    is its first character.
    """
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    extension = F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def class_name(content: Column) -> Column:
    """The name of the first class, else exported function, else exported constant; null if there is none."""
    return F.coalesce(*[first_match(content, p) for p in CLASS_NAME])


def component_type(content: Column, path: Column) -> Column:
    """Type by file name, else by content, else ``component``."""
    name = F.lower(base_name(path))
    kind = None
    for value, parts in TYPE_BY_NAME:
        test = F.coalesce(contains_any(name, parts), F.lit(False))
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    for value, pattern in TYPE_BY_CONTENT:
        kind = kind.when(F.coalesce(content.rlike(pattern), F.lit(False)), value)
    return kind.otherwise("component")


def dependencies(content: Column) -> Column:
    """The distinct injected types, in order of pattern and place; none for a null content."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(g)) for p, g in DEPENDENCIES])
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)), F.array().cast("array<string>"))


def code_language(code: Column) -> Column:
    """Language of a code block by what it contains; java if nothing tells, and for null."""
    kind = None
    for value, signs in LANGUAGE_BY_CODE:
        test = F.coalesce(contains_any(code, signs), F.lit(False))
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    return kind.otherwise("java")


def text_type(text: Column) -> Column:
    """controller, service or repository if the text says so in any case, else component."""
    low = F.lower(text)
    kind = None
    for value in ("controller", "service", "repository"):
        test = F.coalesce(low.contains(value), F.lit(False))
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    return kind.otherwise("component")


def code_blocks(text: Column) -> Column:
    """The trimmed fenced code blocks in order; none for null."""
    found = F.regexp_extract_all(text, F.lit(r"```[\w]*\n([\s\S]*?)```"), F.lit(1))
    return F.coalesce(F.transform(found, trim_all), F.array().cast("array<string>"))


def suggested_name(code: Column, query: Column) -> Column:
    """A pattern name from the class in the code, else from the question's longer words."""
    words = F.filter(F.split(query, " "), lambda w: F.length(w) > 3)
    from_words = F.when(F.size(words) > 0, F.concat(F.array_join(F.transform(words, first_upper), " "), F.lit(" Pattern")))
    from_class = F.concat(first_match(code, r"(?:class|interface)\s+(\w+)"), F.lit(" Pattern"))
    return F.coalesce(from_class, from_words, F.lit("Custom Pattern"))


def suggested_tags(code: Column, query: Column, words: int = 2) -> Column:
    """Comma-separated distinct tags: those that the code suggests, then the question's first longer words."""
    by_code = F.array_compact(F.array(*[F.when(code.contains(sign), tag) for tag, sign in TAG_BY_CODE]))
    stop = F.array(*[F.lit(w) for w in TAG_STOP_WORDS])
    by_query = F.slice(F.filter(F.split(F.lower(query), " "), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)), 1, words)
    none = F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.concat(F.coalesce(by_code, none), F.coalesce(by_query, none))), ", ")
