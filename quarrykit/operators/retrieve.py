"""Which classes and patterns concern a question, and the prompt made of them.

Questions and haystacks are both large. No question is held against every
class: each distinct needle meets only the rows that share its rarest gram of
characters, and only the first rows of each needle travel on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.textfn import STOP_WORDS, keywords, let
from quarrykit.operators.snippet import essential_snippet
from quarrykit.session import cut_lineage

#: Gram sizes; a needle uses the greatest that is not longer than itself.
GRAMS = (1, 3, 12)
KEYWORD_GRAMS = (3, 6)
FIRST = 2
#: Headings and closing words of a prompt, which its summary reads again.
KB_HEADING = "Saved patterns from Knowledge Base:"
WORKSPACE_AFTER_KB = "Current workspace code:"
WORKSPACE_ALONE = "Context from workspace:"
CLOSING = "Follow the patterns shown above."
#: Lines of a summary.
SUMMARY_KB = "📚 From Knowledge Base:"
SUMMARY_WORKSPACE = "💻 From Workspace:"
SUMMARY_NONE = "  • No patterns found\n  • Asking the model directly"


def _grams_of(texts: str, size: int) -> Column:
    """The grams of all texts of an array that are long enough."""
    return F.expr(f"flatten(transform(filter({texts}, t -> length(t) >= {size}), t -> transform(sequence(1, length(t) - {size} + 1), i -> substring(t, i, {size}))))")


def _cover(needle: str, size: str) -> Column:
    """Grams side by side that cover a needle; a row that has it has them all."""
    last = f"greatest(length({needle}) - {size} + 1, 1)"
    return F.expr(f"array_distinct(transform(array_append(sequence(1, {last}, {size}), {last}), i -> substring({needle}, i, {size})))")


def _first_places(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, places): the least ``limit`` places of each key; the window's group limit keeps them before the shuffle."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("rank") <= limit)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("places"))


def first_containing(needles: DataFrame, rows: DataFrame, order: str, texts: str, limit: int = FIRST, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(needle, places): for each distinct needle its first ``limit`` rows, by ``order``, that contain it.

    ``rows`` has ``order`` (unique) and ``texts``, an array of strings of which
    one must contain the needle; ``needles`` has ``needle``. Exact for needles
    of at least the least gram size and for the empty one, which is in every
    row that has a text; shorter needles are not looked up, so the sizes begin
    at 1 unless the needles are known to be longer. Null needles and texts match
    nothing. Needles without a row are not in the result.

    A needle that is a gram itself has the rows of that gram, of which the first
    are kept without a look at their texts, so a word that is everywhere costs a
    few rows a task. A longer one can only be in a row that has the grams that
    cover it, so it meets the rows of the rarest of them. The distinct needles
    and the rows of their grams are written once while the plan is made, and
    only gram sizes that a needle uses are made of the texts.
    """
    rows = rows.select(F.col(order).alias("place"), F.col(texts).alias("texts"))
    size = F.lit(grams[0])
    for g in grams[1:]:
        size = F.when(F.length("needle") >= g, F.lit(g)).otherwise(size)
    needles = cut_lineage(needles.select("needle").where("needle IS NOT NULL").distinct().withColumn("size", size))
    used = sorted(r.size for r in needles.where(F.length("needle") >= grams[0]).select("size").distinct().collect())
    asked = needles.where(F.length("needle") >= grams[0]).select("needle", "size", F.explode(_cover("needle", "size")).alias("gram"))
    held = rows.select("place", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[_grams_of("texts", g) for g in used]))).alias("gram"))
    posted = cut_lineage(held.join(asked.select("gram").distinct(), "gram", "left_semi"))
    whole = needles.where("length(needle) = size").select(F.col("needle").alias("gram"))
    exact = _first_places(posted.join(whole, "gram", "left_semi"), "gram", limit).select(F.col("gram").alias("needle"), "places")
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    longer = asked.where("length(needle) > size")
    rarest = longer.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("least")).where("least.df > 0").select("needle", "least.gram")
    candidates = rarest.join(posted, "gram").select("needle", "place")
    hits = candidates.join(rows, "place").where(F.exists("texts", lambda t: F.coalesce(t.contains(F.col("needle")), F.lit(False)))).select("needle", "place")
    found = exact.unionByName(_first_places(hits, "needle", limit))
    if grams[0] > 1:
        return found
    first = rows.where(F.size(F.filter("texts", lambda t: t.isNotNull())) > 0).select("place").orderBy("place").limit(limit).agg(F.array_sort(F.collect_list("place")).alias("places"))
    empty = needles.where("needle = ''").select("needle").withColumn("places", first.scalar())
    return found.unionByName(empty)


def relevant_classes(questions: DataFrame, classes: DataFrame, key: str = "question_id", text: str = "question", order: str = "first_pos", limit: int = FIRST, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, places): each question's first ``limit`` classes, by ``order``.

    A class is relevant if a keyword of the question is part of its name or of
    its path, in any case, or is its type. Questions without keywords or
    without a relevant class are not in the result. Equal keywords of many
    questions are looked up once. Their keywords are written once
    while the plan is made.
    """
    asked = cut_lineage(questions.select(key, F.explode(keywords(F.col(text), stop_words)).alias("needle")))
    classes = classes.select(F.col(order).alias("place"), "class_name", "file_path", "type")
    hay = classes.select("place", F.array(F.lower("class_name"), F.lower("file_path")).alias("texts"))
    by_text = first_containing(asked, hay, "place", "texts", limit, KEYWORD_GRAMS)
    ranked = classes.select("type", "place").where("type IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("place")))
    by_type = ranked.where(F.col("rank") <= limit).groupBy("type").agg(F.collect_list("place").alias("places")).withColumnRenamed("type", "needle")
    places = by_text.unionByName(by_type)
    met = asked.join(places, "needle").select(key, F.explode("places").alias("place")).distinct()
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("rank") <= limit)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("places"))


def relevant_patterns(questions: DataFrame, patterns: DataFrame, key: str = "question_id", text: str = "question", order: str = "seq", limit: int = FIRST) -> DataFrame:
    """(key, places): each question's first ``limit`` patterns that have the whole question in a searched field."""
    asked = questions.select(key, F.lower(text).alias("needle")).where("needle IS NOT NULL")
    none = F.array().cast("array<string>")
    hay = patterns.select(order, F.concat(F.array(F.lower("name"), F.lower("description"), F.lower("type")), F.coalesce(F.transform("tags", F.lower), none)).alias("texts"))
    return asked.join(first_containing(asked, hay, order, "texts", limit), "needle").select(key, "places")


def prompts_without_patterns(questions: DataFrame, classes: DataFrame, key: str = "question_id", text: str = "question", limit: int = FIRST) -> DataFrame:
    """``prompts`` as they were before there were saved patterns: the workspace alone, or the question."""
    return prompts(questions, classes, None, key, text, limit)


def _block(title: Column, kind: Column, language: Column, body: Column) -> Column:
    return F.concat(F.lit("**"), title, F.lit("** ("), kind, F.lit("):\n```"), language, F.lit("\n"), body, F.lit("\n```\n\n"))


def _blocks(places: DataFrame, key: str, rows: DataFrame, order: str, block: Column, name: str) -> DataFrame:
    """One text per key: the blocks of its places in order; at most ``limit`` blocks each."""
    text = rows.select(F.col(order).alias("place"), block.alias("block"))
    met = places.select(key, F.explode("places").alias("place")).join(text, "place")
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return met.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias(name))


def prompts(questions: DataFrame, classes: DataFrame, patterns: DataFrame | None, key: str = "question_id", text: str = "question", limit: int = FIRST) -> DataFrame:
    """(key, prompt, has_context) of every question.

    Patterns come before classes; a question that neither concerns is passed
    on unchanged. A null question keeps a null prompt. Null fields of a pattern
    or class read as empty. Without a table of patterns there are none.
    """
    say = lambda c: F.coalesce(F.col(c), F.lit(""))
    questions = cut_lineage(questions.select(key, text))  # read by each part below
    if patterns is None:
        from_patterns = questions.select(key, F.lit(None).cast("string").alias("kb")).limit(0)
    else:
        from_patterns = _blocks(relevant_patterns(questions, patterns, key, text, limit=limit), key, patterns, "seq", _block(say("name"), say("type"), say("language"), say("code")), "kb")
    snippet = F.coalesce(essential_snippet(F.col("content"), F.col("class_name")), F.lit(""))
    from_classes = _blocks(relevant_classes(questions, classes, key, text, limit=limit), key, classes, "first_pos", _block(say("class_name"), say("type"), say("language"), snippet), "workspace")
    every = questions.select(key, text).join(from_patterns, key, "left").join(from_classes, key, "left")
    kb = F.when(F.col("kb").isNotNull(), F.concat(F.lit(f"{KB_HEADING}\n\n"), "kb")).otherwise("")
    heading = F.when(F.col("kb").isNotNull(), WORKSPACE_AFTER_KB).otherwise(WORKSPACE_ALONE)
    workspace = F.when(F.col("workspace").isNotNull(), F.concat(heading, F.lit("\n\n"), "workspace")).otherwise("")
    has = F.col("kb").isNotNull() | F.col("workspace").isNotNull()
    full = F.concat(kb, workspace, F.lit("---\n\nUser: "), F.col(text), F.lit(f"\n\n{CLOSING}"))
    return every.select(key, F.when(has, full).otherwise(F.col(text)).alias("prompt"), has.alias("has_context"))


def _bullets(section: Column, pattern: str) -> Column:
    found = F.struct(F.regexp_extract_all(section, F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all(section, F.lit(pattern), F.lit(2)).alias("types"))
    return let(found, lambda f: F.zip_with(f["names"], f["types"], lambda n, t: F.concat(F.lit("  • "), n, F.lit(" ("), t, F.lit(")"))))


def summary(prompt: Column, shown: int = 3) -> Column:
    """The names and types that a finished prompt shows, as bullets; null for a null prompt."""
    none = F.array().cast("array<string>")

    def headed(heading: str, bullets: Column) -> Column:
        return let(bullets, lambda b: F.when(F.size(b) > 0, F.concat(F.array(F.lit(heading)), b)).otherwise(none))

    def lines(parts: Column) -> Column:
        kb = F.when(prompt.contains(KB_HEADING), _bullets(F.get(parts, F.lit(0)), r"\*\*(.+?)\*\* \((\w+)\):")).otherwise(none)
        section = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(prompt)
        workspace = F.when(prompt.contains("workspace"), F.slice(_bullets(section, r"\*\*(\w+)\*\* \((\w+)\):"), 1, shown)).otherwise(none)
        return F.concat(headed(SUMMARY_KB, kb), headed(SUMMARY_WORKSPACE, workspace))

    told = let(let(F.split(prompt, WORKSPACE_AFTER_KB, -1), lines), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(SUMMARY_NONE))
    return F.when(prompt.isNotNull(), told)
