"""DuckDB SQL of the registered queries."""
from __future__ import annotations

B = r"[\s\x0B\p{Z}\x{FEFF}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def distinct(x: str) -> str:
    """Distinct elements in order of their first place."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


BASE = "regexp_extract(file_path, '[^/]*$')"
NAME = r"coalesce(nullif(regexp_extract(content, '(?:public\s+)?class\s+(\w+)', 1), ''), nullif(regexp_extract(content, 'export\s+(?:class|function)\s+(\w+)', 1), ''), nullif(regexp_extract(content, 'export\s+const\s+(\w+)\s*[:=]', 1), ''))"
LANGUAGE = rf"coalesce(CASE regexp_extract({BASE}, '.(\.[^.]*)$', 1) WHEN '.java' THEN 'java' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' END, 'unknown')"
TYPE = rf"""CASE WHEN regexp_matches(lower({BASE}), 'controller|router') THEN 'controller' WHEN lower({BASE}) LIKE '%service%' THEN 'service'
 WHEN regexp_matches(lower({BASE}), 'repository|dao') THEN 'repository' WHEN lower({BASE}) LIKE '%config%' THEN 'config'
 WHEN regexp_matches(content, '@RestController|@Controller|Router\(\)') THEN 'controller' WHEN regexp_matches(content, '@Service|@Injectable') THEN 'service'
 WHEN regexp_matches(content, '@Repository|extends.*Repository') THEN 'repository' ELSE 'component' END"""
FOUND = r"list_filter(list_concat(list_concat(regexp_extract_all(content, '@Autowired[\s\S]*?private\s+(?:final\s+)?(\w+)\s+\w+', 1), regexp_extract_all(content, 'private\s+final\s+(\w+)\s+\w+', 1)), regexp_extract_all(content, 'constructor\s*\([^)]*?(\w+):\s*(\w+)', 2)), lambda x: length(x) > 1)"
DEPS = f"coalesce(array_to_string({distinct('found')}, ','), '')"
RANK = rf"CASE regexp_extract({BASE}, '\.([^.]*)$', 1) WHEN 'java' THEN 0 WHEN 'ts' THEN 1 WHEN 'tsx' THEN 2 WHEN 'js' THEN 3 WHEN 'jsx' THEN 4 END"
KEPT = rf"NOT (contains({BASE}, '.test.') OR contains({BASE}, '.spec.') OR contains({BASE}, 'extension.'))"
SCANNED = f"{RANK} IS NOT NULL AND NOT contains(file_path, '/node_modules/')"
STOP = "['how','do','i','the','a','an','to','in','for','create','make','write','add','new']"


def words(text: str, stop: str = STOP) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"


ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY arrived_at) AS rn FROM chat_event) WHERE rn = 1)"
QUESTION = f"{ONCE}, question AS (SELECT session_id || ':' || seq AS question_id, session_id, seq, {trim('message')} AS question FROM once WHERE type = 'sendMessage' AND {trim('message')} <> '')"
CLASSES = "classes AS (SELECT c.*, e.first_pos FROM class_info c JOIN (SELECT class_name, min(pos) AS first_pos, max(pos) AS pos FROM class_info WHERE class_name IS NOT NULL GROUP BY class_name) e USING (pos))"
CURRENT = "pattern AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM saved_pattern) WHERE rn = 1)"
REPLY = """folded AS (SELECT session_id, request_id, coalesce(string_agg(fragment, '' ORDER BY fragment_seq), '') AS response
 FROM (SELECT session_id, request_id, fragment_seq, max(fragment) AS fragment FROM reply GROUP BY ALL) GROUP BY ALL)"""
CODE_BLOCKS = r"regexp_extract_all({}, '```[\w]*\n([\s\S]*?)```', 1)"


def code_language(c: str) -> str:
    any_of = lambda *xs: " OR ".join(f"contains({c}, '{x}')" for x in xs)
    return f"CASE WHEN {any_of('package ', '@RestController', 'public class')} THEN 'java' WHEN {any_of('export class', '@Injectable')} THEN 'typescript' WHEN {any_of('def ', 'import ')} THEN 'python' WHEN {any_of('func ', 'package main')} THEN 'go' ELSE 'java' END"


def text_type(t: str) -> str:
    return f"CASE WHEN contains(lower({t}), 'controller') THEN 'controller' WHEN contains(lower({t}), 'service') THEN 'service' WHEN contains(lower({t}), 'repository') THEN 'repository' ELSE 'component' END"


def suggested_name(code: str, query: str) -> str:
    long_words = f"list_filter(string_split({query}, ' '), lambda w: length(w) > 3)"
    return rf"""coalesce(nullif(regexp_extract({code}, '(?:class|interface)\s+(\w+)', 1), '') || ' Pattern',
 CASE WHEN len({long_words}) > 0 THEN array_to_string(list_transform({long_words}, lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') || ' Pattern' END, 'Custom Pattern')"""


def suggested_tags(code: str, query: str) -> str:
    by_code = "list_filter([" + ", ".join(f"CASE WHEN contains({code}, '{s}') THEN '{t}' END" for t, s in (("controller", "Controller"), ("service", "Service"), ("repository", "Repository"), ("rest", "@RestController"), ("grpc", "grpc"))) + "], lambda x: x IS NOT NULL)"
    by_query = f"list_filter(string_split(lower({query}), ' '), lambda w: length(w) > 3 AND NOT list_contains(['create','make','build','write'], w))[1:2]"
    return f"list_concat({by_code}, {by_query})"


def top(n: int, stop: str) -> str:
    return f"""asked AS (SELECT DISTINCT question_id, unnest({words('question', stop)}) AS k FROM question),
 needle AS (SELECT DISTINCT k FROM asked),
 hit AS (SELECT k, first_pos FROM needle JOIN classes ON contains(lower(class_name), k) OR contains(lower(file_path), k) OR type = k),
 class_place AS (SELECT question_id, first_pos, row_number() OVER (PARTITION BY question_id ORDER BY first_pos) AS n FROM (SELECT DISTINCT question_id, first_pos FROM asked JOIN hit USING (k)) QUALIFY n <= {n})"""


PATTERN_PLACE = """pattern_hit AS (SELECT q, seq FROM (SELECT DISTINCT lower(question) AS q FROM question) JOIN pattern
   ON contains(lower(name), q) OR contains(lower(description), q) OR contains(lower(type), q) OR len(list_filter(tags, lambda t: contains(lower(t), q))) > 0),
 pattern_place AS (SELECT question_id, pattern_hit.seq, row_number() OVER (PARTITION BY question_id ORDER BY pattern_hit.seq) AS n FROM question JOIN pattern_hit ON q = lower(question) QUALIFY n <= 2)"""



def signature(line: str) -> str:
    return trim(f"split_part({line}, '{{', 1)")


SNIPPET = f"""line AS (SELECT pos, first_pos, class_name, list_filter(list_transform(string_split(content, chr(10)), lambda l: {trim('l')}), lambda l: l <> '') AS lines FROM classes WHERE content IS NOT NULL),
 part1 AS (SELECT *, list_filter(lines, lambda x: starts_with(x, 'package ') OR (starts_with(x, 'import ') AND contains(x, 'Injectable')))[1] AS package,
   coalesce(list_position(list_transform(lines, lambda x: contains(x, 'class ' || class_name) OR contains(x, 'export const ' || class_name)), true), 0) AS found_at FROM line),
 part2 AS (SELECT *, CASE WHEN package IS NULL THEN [] ELSE [package] END AS head, list_filter(CASE WHEN found_at > 1 THEN lines[greatest(found_at - 2, 1):found_at - 1] ELSE [] END, lambda x: starts_with(x, '@') AND x IS DISTINCT FROM package) AS marks0, CASE WHEN found_at > 0 THEN lines[found_at] END AS class_line FROM part1),
 part3 AS (SELECT *, list_concat(head, {distinct('marks0')}) AS told0 FROM part2),
 part4 AS (SELECT *, list_concat(told0, CASE WHEN class_line IS NULL OR list_contains(told0, class_line) THEN [] ELSE [class_line] END) AS told FROM part3),
 part5 AS (SELECT *, list_filter(lines, lambda x: (contains(x, 'constructor(') OR contains(x, 'public ' || class_name || '(')) AND NOT list_contains(told, x))[1] AS maker,
   list_transform(list_filter(lines, lambda x: (starts_with(x, 'public ') OR starts_with(x, 'async ')) AND contains(x, '(') AND NOT contains(x, 'constructor') AND NOT contains(x, class_name || '(')), lambda x: {signature('x')}) AS signed FROM part4),
 part6 AS (SELECT *, list_filter(signed, lambda x: regexp_extract(x, '\\b(\\w+)\\s*\\(', 1) <> '') AS method FROM part5),
 part7 AS (SELECT *, list_transform(method, lambda x: regexp_extract(x, '\\b(\\w+)\\s*\\(', 1)) AS names FROM part6),
 snippet AS (SELECT pos, first_pos, array_to_string(list_concat(list_concat(list_concat(list_concat(list_concat(told, ['']), CASE WHEN maker IS NULL THEN [] ELSE [{signature('maker')}] END), ['']),
   list_filter(method, lambda x, i: list_position(names, names[i]) = i)[1:3]), ['}}']), chr(10)) AS snippet FROM part7)"""
PROMPT_OF_QUESTION = f"""{CLASSES}, {top(2, STOP)}, {PATTERN_PLACE}, {SNIPPET},
 kb AS (SELECT question_id, string_agg('**' || coalesce(name, '') || '** (' || coalesce(type, '') || '):' || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(code, '') || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY n) AS kb FROM pattern_place JOIN pattern USING (seq) GROUP BY question_id),
 ws AS (SELECT question_id, string_agg('**' || class_name || '** (' || coalesce(type, '') || '):' || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(s.snippet, '') || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY n) AS ws
   FROM class_place p JOIN classes c USING (first_pos) LEFT JOIN snippet s ON s.pos = c.pos GROUP BY question_id),
 prompt AS (SELECT q.question_id, q.session_id, q.seq, kb IS NOT NULL OR ws IS NOT NULL AS has_context,
   CASE WHEN kb IS NULL AND ws IS NULL THEN question ELSE
     CASE WHEN kb IS NULL THEN '' ELSE 'Saved patterns from Knowledge Base:' || chr(10) || chr(10) || kb END
     || CASE WHEN ws IS NULL THEN '' ELSE CASE WHEN kb IS NULL THEN 'Context from workspace:' ELSE 'Current workspace code:' END || chr(10) || chr(10) || ws END
     || '---' || chr(10) || chr(10) || 'User: ' || question || chr(10) || chr(10) || 'Follow the patterns shown above.' END AS prompt
   FROM question q LEFT JOIN kb USING (question_id) LEFT JOIN ws USING (question_id))"""
PROMPT = f"{QUESTION}, {CURRENT}, {PROMPT_OF_QUESTION}"
#: Questions that occur in patterns: every name and every tag.
KB_QUESTION = f"""{CURRENT}, question AS (SELECT question_id, question, NULL AS session_id, NULL AS seq FROM (
  SELECT 'name:' || seq AS question_id, {trim('name')} AS question FROM pattern
  UNION ALL SELECT DISTINCT 'tag:' || {trim('tag')}, {trim('tag')} FROM (SELECT unnest(tags) AS tag FROM pattern)) WHERE question <> '')"""


def bullets(section: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({section}, '{pattern}'), lambda m: '  • ' || regexp_extract(m, '{pattern}', 1) || ' (' || regexp_extract(m, '{pattern}', 2) || ')')"


SUMMARY_OF_PROMPT = f"""cut AS (SELECT question_id, prompt, string_split(prompt, 'Current workspace code:') AS parts FROM prompt),
 found AS (SELECT question_id,
   CASE WHEN contains(prompt, 'Saved patterns from Knowledge Base:') THEN {bullets('parts[1]', r'\*\*(.+?)\*\* \((\w+)\):')} ELSE [] END AS kb,
   CASE WHEN contains(prompt, 'workspace') THEN ({bullets('CASE WHEN len(parts) > 1 THEN parts[2] ELSE prompt END', r'\*\*(\w+)\*\* \((\w+)\):')})[1:3] ELSE [] END AS ws FROM cut)
 SELECT question_id, CASE WHEN len(kb) + len(ws) = 0 THEN '  • No patterns found' || chr(10) || '  • Asking the model directly' ELSE
   array_to_string(list_concat(CASE WHEN len(kb) > 0 THEN list_concat(['📚 From Knowledge Base:'], kb) ELSE [] END, CASE WHEN len(ws) > 0 THEN list_concat(['💻 From Workspace:'], ws) ELSE [] END), chr(10)) END AS summary FROM found"""
SUMMARY = f"WITH {PROMPT}, {SUMMARY_OF_PROMPT}"
LAST_QUERY = f"""{ONCE}, last_query AS (SELECT *, last_value(CASE WHEN type = 'sendMessage' THEN nullif({trim('message')}, '') END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last_query FROM once)"""
SAVED = f"""WITH {LAST_QUERY}, form AS (SELECT session_id, seq, coalesce(name, '') AS name, coalesce(description, '') AS description, coalesce(tags, '') AS tags, coalesce(code, '') AS code, coalesce(last_query, '') AS query FROM last_query WHERE type = 'confirmSavePattern')
 SELECT session_id, seq, {trim('name')} AS name, {code_language('code')} AS language, {text_type("name || ' ' || description || ' ' || code")} AS type, {trim('code')} AS code,
   coalesce(nullif({trim('description')}, ''), query) AS description, query, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: {trim('t')}), lambda t: t <> ''), '|') AS tags
 FROM form WHERE {trim('name')} <> ''"""
SEARCH = " UNION ALL ".join(
    f"SELECT '{q}' AS query, seq FROM pattern WHERE coalesce(contains(lower(name), '{q.lower()}'), false) OR coalesce(contains(lower(description), '{q.lower()}'), false) OR coalesce(contains(lower(type), '{q.lower()}'), false) OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), '{q.lower()}'))) > 0"
    for q in ("CONTROLLER", "rest", "locale", "make the", "")
)
PLACES = "SELECT question_id, string_agg({0}, ',' ORDER BY {0}) AS places FROM {1} GROUP BY question_id"
FORM_CODE = f"{trim(CODE_BLOCKS.format('response') + '[1]')}"

ORACLES = {
    "source_cap": f"SELECT pos, {RANK} AS glob_rank, row_number() OVER (PARTITION BY {RANK} ORDER BY file_path, pos) AS file_ord FROM class_info WHERE {SCANNED} QUALIFY file_ord <= 200",
    "file_exclusion": f"SELECT pos FROM class_info WHERE {SCANNED} AND {KEPT}",
    "language_by_ext": f"SELECT pos, {LANGUAGE} AS language FROM class_info",
    "class_name": f"SELECT pos, {NAME} AS class_name FROM class_info WHERE {NAME} IS NOT NULL",
    "component_type": f"SELECT pos, {TYPE} AS type FROM class_info",
    "dependencies": f"SELECT pos, {DEPS} AS dependencies FROM (SELECT pos, {FOUND} AS found FROM class_info)",
    "class_info_extract": f"SELECT pos, class_name, type, language, {DEPS} AS dependencies FROM (SELECT pos, {NAME} AS class_name, {TYPE} AS type, {LANGUAGE} AS language, {FOUND} AS found FROM class_info WHERE {SCANNED} AND {KEPT}) WHERE class_name IS NOT NULL",
    "class_map": "SELECT min(pos) AS first_pos, max(pos) AS pos, class_name FROM class_info WHERE class_name IS NOT NULL GROUP BY class_name",
    "class_count": "SELECT count(DISTINCT class_name) AS class_count FROM class_info",
    "keyword_extract": f"WITH {QUESTION}, w AS (SELECT question_id, {words('question')} AS words FROM question) SELECT question_id, array_to_string({distinct('words')}, ',') AS keywords FROM w",
    "relevance_top2": f"WITH {QUESTION}, {CLASSES}, {top(2, STOP)} {PLACES.format('first_pos', 'class_place')}",
    "relevance_legacy_top3": f"WITH {QUESTION}, {CLASSES}, {top(3, STOP.replace(',' + repr('new'), ''))} {PLACES.format('first_pos', 'class_place')}",
    "kb_search": f"WITH {CURRENT} {SEARCH}",
    "kb_search_top2": f"WITH {QUESTION}, {CURRENT}, {PATTERN_PLACE} {PLACES.format('seq', 'pattern_place')}",
    "snippet": f"WITH {CLASSES}, {SNIPPET} SELECT c.pos, s.snippet FROM classes c LEFT JOIN snippet s ON s.pos = c.pos",
    "prompt": f"WITH {PROMPT} SELECT question_id, prompt, has_context FROM prompt",
    "context_summary": SUMMARY,
    "show_context": f"WITH {PROMPT} SELECT session_id, arg_max(prompt, seq) AS prompt FROM prompt GROUP BY session_id",
    "kb_asked_top2": f"WITH {KB_QUESTION}, {PATTERN_PLACE} {PLACES.format('seq', 'pattern_place')}",
    "kb_prompt": f"WITH {KB_QUESTION}, {PROMPT_OF_QUESTION} SELECT question_id, prompt, has_context FROM prompt",
    "kb_summary": f"WITH {KB_QUESTION}, {PROMPT_OF_QUESTION}, {SUMMARY_OF_PROMPT}",
    "prompt_without_kb": f"WITH {QUESTION}, pattern AS (SELECT * FROM saved_pattern WHERE false), {PROMPT_OF_QUESTION} SELECT question_id, prompt, has_context FROM prompt",
    "kb_append_view": f"WITH {CURRENT} SELECT name, language, type, code, description, query, true AS named FROM pattern WHERE type IS DISTINCT FROM 'repository'",
    "kb_index_read": f"WITH {CURRENT} SELECT '1.0.0' AS version, id, name, saved_at FROM pattern UNION ALL SELECT '0.9.0', NULL, NULL, NULL",
    "source_tree_scan": f"SELECT file_path, md5(arg_max(content, pos)) AS digest FROM class_info WHERE content IS NOT NULL AND {SCANNED} GROUP BY file_path",
    "block_picks": f"""WITH {REPLY}, b AS (SELECT request_id, {CODE_BLOCKS.format('response')} AS blocks FROM folded), c AS (SELECT request_id, i, {trim('blocks[i]')} AS code FROM (SELECT request_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM b WHERE len(blocks) > 1))
 SELECT request_id, 'Code Block ' || i AS label, length(code) || ' chars' AS description, CASE WHEN length(code) > 100 THEN substring(code, 1, 100) || '...' ELSE code END AS detail FROM c""",
    "confirm_preview": f"WITH {CURRENT} SELECT seq, CASE WHEN length(code) > 500 THEN substring(code, 1, 500) || chr(10) || chr(10) || '... [' || (length(code) - 500) || ' more characters]' ELSE code END AS preview FROM pattern",
    "kb_current": f"WITH {CURRENT} SELECT seq, id, name FROM pattern",
    "kb_delete_view": f"WITH {CURRENT} SELECT seq, id FROM pattern WHERE type IS DISTINCT FROM 'service'",
    "kb_tombstones": f"WITH {CURRENT} SELECT seq, id FROM pattern WHERE type IS DISTINCT FROM 'repository'",
    "kb_stats": f"WITH {CURRENT} SELECT CAST(0 AS BIGINT) AS feature_count, count(*) AS pattern_count FROM pattern",
    "kb_label_counts": f"WITH {CURRENT} SELECT coalesce(type, '') AS label, count(*) AS n FROM pattern GROUP BY 1",
    "list_projection": f"WITH {CURRENT} SELECT seq, name AS label, concat_ws(' • ', language, type) AS description, description AS detail FROM pattern",
    "kb_json_round_trip": f"WITH {CURRENT} SELECT seq, id, name, saved_at AS savedAt, CASE WHEN tags IS NULL THEN '<none>' ELSE array_to_string(list_transform(tags, lambda t: coalesce(t, '<null>')), '|') END AS tags FROM pattern",
    "reply_text": f"WITH {REPLY} SELECT session_id, request_id, response FROM folded",
    "contains_code": f"WITH {REPLY} SELECT request_id, regexp_matches(response, '```|class |function |public |export ') AS has_code FROM folded",
    "code_blocks": f"WITH {REPLY}, b AS (SELECT request_id, {CODE_BLOCKS.format('response')} AS blocks FROM folded) SELECT request_id, i - 1 AS block_no, {trim('blocks[i]')} AS code FROM (SELECT request_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM b)",
    "document_blocks": f"WITH b AS (SELECT doc_id, {CODE_BLOCKS.format('text')} AS blocks FROM documents) SELECT doc_id, i - 1 AS block_no, {trim('blocks[i]')} AS code FROM (SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM b)",
    "reply_language": f"WITH {CURRENT}, t AS (SELECT seq, coalesce(code, '') AS code, coalesce(query, '') AS query FROM pattern) SELECT seq, {code_language('code')} AS language, {text_type('code')} AS type, {suggested_name('code', 'query')} AS suggested_name FROM t",
    "suggest_tags": f"WITH {CURRENT}, t AS (SELECT seq, {suggested_tags('c', 'q')} AS tags FROM (SELECT seq, coalesce(code, '') AS c, coalesce(query, '') AS q FROM pattern)) SELECT seq, array_to_string({distinct('tags')}, ', ') AS suggested_tags FROM t",
    "save_form": f"""WITH {QUESTION}, {REPLY}, last AS (SELECT session_id, arg_max(question, seq) AS query FROM question GROUP BY session_id),
 r AS (SELECT request_id, response, coalesce(query, '') AS q, CASE WHEN response = '' THEN 'no_response' WHEN len({CODE_BLOCKS.format('response')}) = 0 THEN 'no_code' ELSE 'form' END AS status FROM folded LEFT JOIN last USING (session_id)),
 f AS (SELECT *, CASE WHEN status = 'form' THEN {FORM_CODE} END AS code FROM r), g AS (SELECT *, CASE WHEN status = 'form' THEN {suggested_tags('code', 'q')} END AS tags FROM f)
 SELECT request_id, status, code, CASE WHEN status = 'form' THEN {code_language('code')} END AS language, CASE WHEN status = 'form' THEN {suggested_name('code', 'q')} END AS suggested_name,
  CASE WHEN status = 'form' THEN q END AS suggested_description, CASE WHEN status = 'form' THEN array_to_string({distinct('tags')}, ', ') END AS suggested_tags FROM g""",
    "save_projection": SAVED,
    "tags_legacy": f"WITH {ONCE} SELECT session_id, seq, CASE WHEN length(tags) > 0 THEN array_to_string(list_transform(string_split(tags, ','), lambda t: {trim('t')}), '|') ELSE '' END AS tags FROM once WHERE type = 'confirmSavePattern'",
    "preview_500": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || chr(10) || '... [truncated ' || (length(text) - 500) || ' characters]' ELSE text END AS preview FROM documents",
    "context_legacy": f"WITH {CLASSES} SELECT pos, array_to_string(string_split(content, chr(10))[1:30], chr(10)) AS head, array_to_string(string_split(file_path, '/')[-3:], '/') AS tail FROM classes",
    "event_routing": f"WITH {ONCE} SELECT type, count(*) AS n FROM once WHERE type IN ('sendMessage', 'savePattern', 'confirmSavePattern', 'cancelSave', 'showContext') GROUP BY type",
    "session_last_query": f"WITH {LAST_QUERY} SELECT session_id, seq, type, last_query FROM last_query",
    "stream_last_query": f"WITH {LAST_QUERY} SELECT session_id, seq, type, last_query FROM last_query",
    "view_events": f"""WITH {QUESTION}, {REPLY}, a AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM question),
 b AS (SELECT session_id, response, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS n FROM folded),
 e AS (SELECT o.session_id, o.seq, CASE
   WHEN o.type = 'sendMessage' AND {trim('message')} <> '' AND regexp_matches(b.response, '```|class |function |public |export ') THEN ['addMessage', 'startTyping', 'addMessage', 'addMessage', 'showSaveButton', 'stopTyping']
   WHEN o.type = 'sendMessage' AND {trim('message')} <> '' THEN ['addMessage', 'startTyping', 'addMessage', 'addMessage', 'stopTyping']
   WHEN o.type = 'confirmSavePattern' AND {trim('name')} <> '' THEN ['addMessage', 'hideSaveForm', 'hideSaveButton']
   WHEN o.type = 'cancelSave' THEN ['hideSaveForm'] ELSE [] END AS told
   FROM once o LEFT JOIN a ON a.session_id = o.session_id AND a.seq = o.seq LEFT JOIN b ON b.session_id = a.session_id AND b.n = a.n)
 SELECT session_id, seq, i - 1 AS step, told[i] AS type FROM (SELECT session_id, seq, told, unnest(range(1, len(told) + 1)) AS i FROM e)""",
    "view_save_events": f"""WITH {QUESTION}, {REPLY}, a AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM question),
 b AS (SELECT session_id, response, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS n FROM folded),
 e AS (SELECT o.session_id, o.seq, o.type AS kind, CASE WHEN a.seq IS NOT NULL THEN coalesce(len({CODE_BLOCKS.format('b.response')}), 0) END AS blocks
   FROM once o LEFT JOIN a ON a.session_id = o.session_id AND a.seq = o.seq LEFT JOIN b ON b.session_id = a.session_id AND b.n = a.n),
 f AS (SELECT session_id, seq, kind, last_value(blocks IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS blocks FROM e)
 SELECT session_id, seq, 0 AS step, CASE WHEN blocks > 0 THEN 'showSaveForm' ELSE 'addMessage' END AS type FROM f WHERE kind = 'savePattern'""",
    "save_form_at_request": f"""WITH {QUESTION}, {REPLY}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM question),
 b AS (SELECT session_id, response, row_number() OVER (PARTITION BY session_id ORDER BY request_id) AS n FROM folded),
 known AS (SELECT a.session_id, a.seq, a.question, b.response FROM a LEFT JOIN b ON b.session_id = a.session_id AND b.n = a.n),
 state AS (SELECT o.session_id, o.seq, o.type, last_value(k.seq IGNORE NULLS) OVER (PARTITION BY o.session_id ORDER BY o.seq ROWS UNBOUNDED PRECEDING) AS asked_at FROM once o LEFT JOIN known k ON k.session_id = o.session_id AND k.seq = o.seq),
 f AS (SELECT s.session_id, s.seq, k.question AS q, {FORM_CODE} AS code FROM state s JOIN known k ON k.session_id = s.session_id AND k.seq = s.asked_at WHERE s.type = 'savePattern' AND len({CODE_BLOCKS.format('response')}) > 0),
 g AS (SELECT *, {suggested_tags('code', 'q')} AS tags FROM f)
 SELECT session_id, seq, code, {code_language('code')} AS language, {suggested_name('code', 'q')} AS suggested_name, q AS suggested_description, array_to_string({distinct('tags')}, ', ') AS suggested_tags FROM g""",
}
ORACLES["view_all_events"] = f"SELECT * FROM ({ORACLES['view_events']}) UNION ALL SELECT * FROM ({ORACLES['view_save_events']})"
