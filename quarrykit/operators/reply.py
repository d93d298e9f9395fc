"""Replies: folding their fragments, and the forms and rows made of their code."""
from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.classify import code_blocks, code_language, suggested_name, suggested_tags, text_type
from quarrykit.functions.textfn import non_empty, tag_list, trim_all


def fold_replies(fragments: DataFrame) -> DataFrame:
    """(session_id, request_id, response): the fragments of each request joined in order.

    A fragment delivered again counts once; if copies of a place differ, the
    greatest text is taken. Null fragments add nothing; a request without any
    text has an empty response. A request's fragments meet in one row, which is
    the reply itself.
    """
    once = fragments.groupBy("session_id", "request_id", "fragment_seq").agg(F.max("fragment").alias("fragment"))
    parts = F.array_sort(F.collect_list(F.struct("fragment_seq", "fragment")))
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(x["fragment"], F.lit(""))), "")
    return once.groupBy("session_id", "request_id").agg(joined.alias("response"))


def block_rows(replies: DataFrame, text: str = "response") -> DataFrame:
    """One row per fenced code block, with its place from 0; replies without blocks have none."""
    return replies.withColumn("blocks", code_blocks(F.col(text))).select("*", F.posexplode("blocks").alias("block_no", "code")).drop("blocks")


def save_form(replies: DataFrame, query: str = "query", text: str = "response") -> DataFrame:
    """``status`` and, if it is ``form``, what a save form shows of the first code block.

    ``status`` is ``no_response`` for a null or empty reply and ``no_code`` for
    one without a block. A null question counts as empty.
    """
    asked = F.coalesce(F.col(query), F.lit(""))
    blocks = code_blocks(F.col(text))
    status = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "no_response").when(F.size(blocks) == 0, "no_code").otherwise("form")
    made = replies.withColumn("status", status).withColumn("code", F.when(F.col("status") == "form", F.get(blocks, F.lit(0))))
    shown = F.col("status") == "form"
    return made.withColumns(
        {
            "language": F.when(shown, code_language(F.col("code"))),
            "suggested_name": F.when(shown, suggested_name(F.col("code"), asked)),
            "suggested_description": F.when(shown, asked),
            "suggested_tags": F.when(shown, suggested_tags(F.col("code"), asked)),
        }
    )


def saved_row(query: Column, name: Column, description: Column, tags: Column, code: Column, keep_empty_tags: bool = False) -> dict[str, Column]:
    """The columns of the pattern that a confirmed form saves.

    Language and type are told again from the edited text; a blank description
    falls back to the question. Null texts count as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    described = F.coalesce(non_empty(trim_all(text(description))), text(query))
    return {
        "name": trim_all(text(name)),
        "language": code_language(text(code)),
        "type": text_type(F.concat(text(name), F.lit(" "), text(description), F.lit(" "), text(code))),
        "code": trim_all(text(code)),
        "description": described,
        "query": text(query),
        "tags": tag_list(text(tags), keep_empty_tags),
    }


def unavailable(prompts: list[str]) -> list[str | None]:
    """The offline model: it answers nothing."""
    return [None] * len(prompts)


def answered(prompts: DataFrame, model: Callable[[list[str]], list[str | None]] = unavailable, key: str = "question_id", text: str = "prompt") -> DataFrame:
    """(key, response) of every prompt: what ``model`` makes of a batch, null where it fails or has nothing.

    ``model`` runs in the workers on one batch of texts at a time; an exception
    gives that batch nulls. A null prompt is not sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = batch[text].notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            try:
                out[sent] = model(batch.loc[sent, text].tolist())
            except Exception:  # noqa: BLE001 - a failing model is an unavailable one
                logging.getLogger(__name__).exception("the model failed on a batch")
            yield pd.DataFrame({key: batch[key], "response": out})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, text).mapInPandas(run, f"`{key}` {kind}, response string")
