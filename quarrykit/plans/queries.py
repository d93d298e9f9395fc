"""Registered queries of the retrieval and code-metadata operators, each over whole tables."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import classify as C
from quarrykit.functions import textfn as T
from quarrykit.operators import reply as R
from quarrykit.operators import retrieve, session, store
from quarrykit.operators.snippet import essential_snippet
from quarrykit.plans.oracles import ORACLES
from quarrykit.session import cut_lineage, shared_folder, table
from quarrykit.sources import corpus, kbjson
from quarrykit.streaming import chat

QUERIES: dict = {}
__all__ = ["ORACLES", "QUERIES"]

SEARCHES = ["CONTROLLER", "rest", "locale", "make the", ""]
LEGACY_STOP_WORDS = [w for w in T.STOP_WORDS if w != "new"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "class_info").select("pos", "file_path", "content")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """The class map: last scan of each class name, at its first place."""
    rows = table(spark, d, "class_info").select("pos", "class_name", "file_path", "type", "language", "content")
    return corpus.class_map(rows.where("class_name IS NOT NULL"))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return store.current(table(spark, d, "saved_pattern"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    sent = session.delivered_once(table(spark, d, "chat_event").where("type = 'sendMessage'"))
    named = F.concat_ws(":", "session_id", "seq")
    return sent.select(named.alias("question_id"), session.asked(F.col("message")).alias("question"), "session_id", "seq").where("question IS NOT NULL")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return R.fold_replies(table(spark, d, "reply"))


def _session_query(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).groupBy("session_id").agg(F.max_by("question", "seq").alias("query"))


@query
def source_cap(spark, d):
    """The first files of each extension in path order."""
    files = table(spark, d, "class_info").select("pos", "file_path")
    return corpus.scanned(files, order=["file_path", "pos"]).select("pos", "glob_rank", "file_ord")


@query
def file_exclusion(spark, d):
    """files that are kept by name and folder."""
    files = table(spark, d, "class_info").select("pos", "file_path")
    return corpus.scanned(files, limit=None).where(corpus.kept_name(F.col("file_path"))).select("pos")


@query
def language_by_ext(spark, d):
    """E1, J5."""
    return _files(spark, d).select("pos", C.file_language(F.col("file_path")).alias("language"))


@query
def class_name(spark, d):
    """E2, F3."""
    return _files(spark, d).select("pos", C.class_name(F.col("content")).alias("class_name")).where("class_name IS NOT NULL")


@query
def component_type(spark, d):
    """E3."""
    return _files(spark, d).select("pos", C.component_type(F.col("content"), F.col("file_path")).alias("type"))


@query
def dependencies(spark, d):
    """E4, F12, G6."""
    return _files(spark, d).select("pos", F.array_join(C.dependencies(F.col("content")), ",").alias("dependencies"))


@query
def class_info_extract(spark, d):
    """The whole extraction."""
    made = corpus.extract(corpus.scanned(_files(spark, d), limit=None))
    return made.select("pos", "class_name", "type", "language", F.array_join("dependencies", ",").alias("dependencies"))


@query
def class_map(spark, d):
    """Keep-last per class name at the place of the first."""
    rows = table(spark, d, "class_info").select("pos", "class_name").where("class_name IS NOT NULL")
    return corpus.class_map(rows).select("first_pos", "pos", "class_name")


@query
def class_count(spark, d):
    """G3."""
    return table(spark, d, "class_info").agg(F.count_distinct("class_name").alias("class_count"))


@query
def keyword_extract(spark, d):
    """E5, F7, G6."""
    return _questions(spark, d).select("question_id", F.array_join(T.keywords(F.col("question")), ",").alias("keywords"))


@query
def relevance_top2(spark, d):
    """The first two relevant classes of every question."""
    found = retrieve.relevant_classes(_questions(spark, d), _classes(spark, d).drop("content"))
    return found.select("question_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query
def relevance_legacy_top3(spark, d):
    """V1, V2: three classes, and one stop word less."""
    found = retrieve.relevant_classes(_questions(spark, d), _classes(spark, d).drop("content"), limit=3, stop_words=LEGACY_STOP_WORDS)
    return found.select("question_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query
def kb_search(spark, d):
    """Whole-query substring search, for a few fixed queries."""
    patterns = _patterns(spark, d)
    found = F.array_compact(F.array(*[F.when(store.matches(q), F.lit(q)) for q in SEARCHES]))
    return patterns.select(F.explode(found).alias("query"), "seq")


@query
def kb_search_top2(spark, d):
    """The first two patterns of every question."""
    found = retrieve.relevant_patterns(_questions(spark, d), _patterns(spark, d))
    return found.select("question_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query
def snippet(spark, d):
    """E6, F8, W1, W2, L5."""
    return _classes(spark, d).select("pos", essential_snippet(F.col("content"), F.col("class_name")).alias("snippet"))


@query
def prompt(spark, d):
    """E7, E8, U2, G5."""
    return retrieve.prompts(_questions(spark, d), _classes(spark, d), _patterns(spark, d)).select("question_id", "prompt", "has_context")


@query
def context_summary(spark, d):
    """E9, L3."""
    return prompt(spark, d).select("question_id", retrieve.summary(F.col("prompt")).alias("summary"))


@query
def show_context(spark, d):
    """K5: the prompt of each session's last question."""
    last = _questions(spark, d).groupBy("session_id").agg(F.max_by(F.struct("question_id", "question"), "seq").alias("q")).select("session_id", "q.*")
    last = cut_lineage(last)  # read by each part of the prompt
    made = retrieve.prompts(last, _classes(spark, d), _patterns(spark, d))
    return last.select("session_id", "question_id").join(made, "question_id").select("session_id", "prompt")


@query
def kb_current(spark, d):
    """The log's current rows."""
    return _patterns(spark, d).select("seq", "id", "name")


@query
def kb_delete_view(spark, d):
    """The current rows after every service pattern is deleted."""
    rows = _patterns(spark, d)
    return store.without(rows, rows.where("type = 'service'")).select("seq", "id")


@query
def kb_tombstones(spark, d):
    """K3: deletion as a later row of the log."""
    log = table(spark, d, "saved_pattern").withColumn("op", F.when(F.col("type") == "repository", "delete").otherwise("upsert"))
    return store.current(log).select("seq", "id")


@query
def kb_stats(spark, d):
    """G1."""
    return store.stats(_patterns(spark, d)).select("feature_count", "pattern_count")


@query
def kb_label_counts(spark, d):
    """How many current patterns have each type."""
    return _patterns(spark, d).groupBy(F.coalesce("type", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def list_projection(spark, d):
    """P2."""
    return store.listing(_patterns(spark, d))


@query
def kb_json_round_trip(spark, d):
    """S3, K2: patterns written as JSON objects and read back."""
    written = _patterns(spark, d).select("seq", kbjson.pattern_json().alias("json"))
    read = written.select("seq", F.from_json("json", kbjson.PATTERN_FIELDS).alias("p"))
    return read.select("seq", "p.id", "p.name", "p.savedAt", F.coalesce(F.array_join("p.tags", "|", "<null>"), F.lit("<none>")).alias("tags"))


@query
def reply_text(spark, d):
    """Fragments folded in order."""
    return _replies(spark, d)


@query
def contains_code(spark, d):
    """F9."""
    return _replies(spark, d).select("request_id", T.contains_code(F.col("response")).alias("has_code"))


@query
def code_blocks(spark, d):
    """Every fenced block with its place."""
    return R.block_rows(_replies(spark, d)).select("request_id", "block_no", "code")


@query
def document_blocks(spark, d):
    """E10 over documents."""
    return R.block_rows(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "block_no", "code")


@query
def reply_language(spark, d):
    """E13, E14, E11 over the code of saved patterns."""
    code, asked = F.coalesce("code", F.lit("")), F.coalesce("query", F.lit(""))
    return _patterns(spark, d).select("seq", C.code_language(code).alias("language"), C.text_type(code).alias("type"), C.suggested_name(code, asked).alias("suggested_name"))


@query
def suggest_tags(spark, d):
    """E12, F11, L4."""
    code, asked = F.coalesce("code", F.lit("")), F.coalesce("query", F.lit(""))
    return _patterns(spark, d).select("seq", C.suggested_tags(code, asked).alias("suggested_tags"))


@query
def save_form(spark, d):
    """What the save form shows of each reply, with the session's last question."""
    joined = _replies(spark, d).join(_session_query(spark, d), "session_id", "left")
    return R.save_form(joined).select("request_id", "status", "code", "language", "suggested_name", "suggested_description", "suggested_tags")


@query
def save_projection(spark, d):
    """The patterns that confirmed forms save."""
    made = session.confirmed_patterns(table(spark, d, "chat_event"))
    return made.select("session_id", "seq", "name", "language", "type", "code", "description", "query", F.array_join("tags", "|").alias("tags"))


@query
def tags_legacy(spark, d):
    """V9: trimmed tags with the empty ones kept."""
    forms = session.delivered_once(table(spark, d, "chat_event").where("type = 'confirmSavePattern'"))
    return forms.select("session_id", "seq", F.array_join(T.tag_list(F.col("tags"), keep_empty=True), "|").alias("tags"))


@query
def preview_500(spark, d):
    """L9, V10."""
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query
def context_legacy(spark, d):
    """V3, V4: the first 30 lines and the last three parts of the path."""
    return _classes(spark, d).select("pos", T.first_lines(F.col("content")).alias("head"), F.substring_index("file_path", "/", -3).alias("tail"))


@query
def event_routing(spark, d):
    """Events delivered once, by kind."""
    once = session.delivered_once(table(spark, d, "chat_event"))
    return chat.by_kind(once, "sendMessage", "savePattern", "confirmSavePattern", "cancelSave", "showContext").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def session_last_query(spark, d):
    """J6, W3."""
    return session.last_question(table(spark, d, "chat_event"))


@query
def stream_last_query(spark, d):
    """S6, §2.9: the same state, kept over a stream."""
    folder = shared_folder(spark)
    events = chat.replay(table(spark, d, "chat_event"), folder, ["seq", "session_id"])
    return chat.run_to_end(chat.last_question_stream(events), folder)


def _matched(spark: SparkSession, d: str, made: Column) -> DataFrame:
    """(session_id, seq) and ``made`` of the response of the answered questions; the n-th request of a session answers its n-th question."""
    asked = session.numbered(_questions(spark, d).select("session_id", "seq"))
    requests = table(spark, d, "reply").select("session_id", "request_id").distinct()
    places = session.numbered_by(requests, "request_id")
    answers = _replies(spark, d).select("session_id", "request_id", made.alias("made")).join(places, ["session_id", "request_id"])
    return asked.join(answers, ["session_id", "n"]).select("session_id", "seq", "made")


@query
def view_events(spark, d):
    """K4: what the view is told, requests to save apart."""
    return session.view_events(table(spark, d, "chat_event"), _matched(spark, d, F.col("response")).withColumnRenamed("made", "response"))


@query
def view_save_events(spark, d):
    """What the view is told after a request to save."""
    return session.save_events(table(spark, d, "chat_event"), _matched(spark, d, F.size(C.code_blocks(F.col("response"))) > 0), F.col("made"))


@query
def save_form_at_request(spark, d):
    """What the save form shows after a request to save, with the question that the reply answers."""
    return session.save_forms(table(spark, d, "chat_event"), _matched(spark, d, F.col("response")).withColumnRenamed("made", "response"))


def _asked_of_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Questions that occur in patterns: every pattern's name and every tag."""
    patterns = _patterns(spark, d)
    names = patterns.select(F.concat(F.lit("name:"), F.col("seq").cast("string")).alias("question_id"), T.trim_all(F.col("name")).alias("question"))
    tags = patterns.select(F.explode("tags").alias("tag")).select(T.trim_all(F.col("tag")).alias("question")).distinct()
    return names.unionByName(tags.select(F.concat(F.lit("tag:"), "question").alias("question_id"), "question")).where("question != ''")


@query
def kb_asked_top2(spark, d):
    """The first two patterns that have a name or tag in them."""
    found = retrieve.relevant_patterns(_asked_of_patterns(spark, d), _patterns(spark, d))
    return found.select("question_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query
def kb_prompt(spark, d):
    """Prompts that patterns and classes are part of."""
    return retrieve.prompts(_asked_of_patterns(spark, d), _classes(spark, d), _patterns(spark, d)).select("question_id", "prompt", "has_context")


@query
def kb_summary(spark, d):
    """Summaries of those."""
    return kb_prompt(spark, d).select("question_id", retrieve.summary(F.col("prompt")).alias("summary"))


@query
def prompt_without_kb(spark, d):
    """V5: prompts of the workspace alone."""
    return retrieve.prompts_without_patterns(_questions(spark, d), _classes(spark, d)).select("question_id", "prompt", "has_context")


@query
def block_picks(spark, d):
    """V8: what is shown to pick one of several blocks."""
    rows = R.block_rows(_replies(spark, d).where(F.size(C.code_blocks(F.col("response"))) > 1))
    label = F.concat(F.lit("Code Block "), (F.col("block_no") + 1).cast("string"))
    return rows.select("request_id", label.alias("label"), F.concat(F.length("code").cast("string"), F.lit(" chars")).alias("description"), T.short_preview(F.col("code")).alias("detail"))


@query
def confirm_preview(spark, d):
    """The code of patterns as a save is confirmed."""
    return _patterns(spark, d).select("seq", T.confirm_preview(F.col("code")).alias("preview"))


@query
def kb_append_view(spark, d):
    """A log made anew, every pattern appended, repositories deleted, and the current view read."""
    path = os.path.join(shared_folder(spark), f"log-{uuid.uuid4().hex}")
    kbjson.bootstrap(spark, path)
    store.append_patterns(_patterns(spark, d).drop("seq", "id", "saved_at"), path)
    log = spark.read.schema(kbjson.LOG_SCHEMA).parquet(path)
    store.delete_patterns(log.where("type = 'repository'").select("id"), path)
    now = store.current(spark.read.schema(kbjson.LOG_SCHEMA).parquet(path))
    return now.select("name", "language", "type", "code", "description", "query", F.col("id").rlike("^pattern-[0-9]{13}-[0-9a-z]{9,}$").alias("named"))


@query
def kb_index_read(spark, d):
    """S3, K2, V7: patterns written as index documents, one of an older kind among them, and read back."""
    path = os.path.join(shared_folder(spark), f"index-{uuid.uuid4().hex}")
    patterns = _patterns(spark, d)
    bases = F.lit(-(-patterns.count() // 500) or 1)
    older = spark.range(1).select(F.lit('{"version":"0.9.0","createdAt":"x","featureCount":0}').alias("value"))
    kbjson.index_documents(patterns, F.pmod(F.xxhash64("id"), bases)).unionByName(older).write.text(path)
    index = kbjson.read_index(spark, path, lines=True)
    return index.select("version", F.explode_outer("patterns").alias("p")).select("version", "p.id", "p.name", F.col("p.savedAt").alias("saved_at"))


@query
def source_tree_scan(spark, d):
    """The last scan of every file written out as a tree, and the tree read again."""
    folder = shared_folder(spark)
    scheme, _, place = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("a tree of files needs a mounted folder")
    root = os.path.join("/" + place.lstrip("/"), f"tree-{uuid.uuid4().hex}")
    last = table(spark, d, "class_info").where("content IS NOT NULL AND file_path IS NOT NULL").groupBy("file_path").agg(F.max_by("content", "pos").alias("content"))
    corpus.write_source_files(last, root)
    return corpus.read_source_files(spark, root).select(F.substring("file_path", len(root) + 1, 1 << 20).alias("file_path"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query
def view_all_events(spark, d):
    """K4: what the view is told after every event, all seven kinds."""
    events, replies = table(spark, d, "chat_event"), cut_lineage(_matched(spark, d, F.col("response")).withColumnRenamed("made", "response"))
    return session.view_events(events, replies).unionByName(session.save_events(events, replies))
