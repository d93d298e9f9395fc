"""Queries of the numbered problems, and SQL where SQL can say the same."""
from __future__ import annotations

from quarrykit.llm.bpe import encode
from quarrykit.llm.cooccur import pattern_tag_pairs
from quarrykit.llm.lookalike import comparison_form, look_alike_forms, look_alike_pairs
from quarrykit.llm.neardup import pattern_groups, pattern_pairs
from quarrykit.llm.packing import container_fill, pack_documents
from quarrykit.llm.provenance import file_origins, not_hand_written
from quarrykit.llm.secrets import corpus_credentials, corpus_keys, corpus_redacted
from quarrykit.llm.termfreq import pattern_terms
from quarrykit.session import table


def p1_found(spark, d):
    return pattern_tag_pairs(table(spark, d, "saved_pattern")).select("tag_a", "tag_b")


def p1_pairs(spark, d):
    return pattern_tag_pairs(table(spark, d, "saved_pattern")).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n_records")


def p2_found(spark, d):
    return pattern_pairs(table(spark, d, "saved_pattern"))


def p2_groups(spark, d):
    return pattern_groups(table(spark, d, "saved_pattern"))


def p3_found(spark, d):
    return not_hand_written(table(spark, d, "class_info"))


def p3_origins(spark, d):
    return file_origins(table(spark, d, "class_info"))


def p4_found(spark, d):
    return pattern_terms(table(spark, d, "saved_pattern")).where("mark IS NOT NULL").select("field", "term", "mark")


def p4_terms(spark, d):
    return pattern_terms(table(spark, d, "saved_pattern")).select("field", "term", "uses", "records", "mark")


def p5_found(spark, d):
    return corpus_credentials(table(spark, d, "class_info"), table(spark, d, "saved_pattern"))


def p5_keys(spark, d):
    return corpus_keys(table(spark, d, "class_info"), table(spark, d, "saved_pattern"))


def p5_redacted(spark, d):
    return corpus_redacted(table(spark, d, "class_info"), table(spark, d, "saved_pattern"))


def p6_ids(spark, d):
    return encode(table(spark, d, "documents"))


def p7_containers(spark, d):
    return pack_documents(table(spark, d, "documents"), table(spark, d, "context_budget"))


def p7_fill(spark, d):
    budgets = table(spark, d, "context_budget")
    return container_fill(pack_documents(table(spark, d, "documents"), budgets), budgets)


def p8_found(spark, d):
    return look_alike_pairs(table(spark, d, "documents"))


def p8_forms(spark, d):
    return look_alike_forms(table(spark, d, "documents"))


def p8_comparison(spark, d):
    return comparison_form(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_groups, p3_found, p3_origins, p4_found, p4_terms, p5_found, p5_keys, p5_redacted, p6_ids, p7_containers, p7_fill, p8_found, p8_forms, p8_comparison)}

CURRENT = """current_row AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM saved_pattern) WHERE rn = 1
), used AS (
  SELECT seq, lower(regexp_replace(tag, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS term FROM (SELECT seq, unnest(tags) AS tag FROM current_row) WHERE tag IS NOT NULL
)"""
PAIRS = f"""WITH {CURRENT}, own AS (SELECT DISTINCT seq, term FROM used WHERE term <> ''),
single AS (SELECT term, count(*) AS n FROM own GROUP BY term),
total AS (SELECT count(DISTINCT seq) AS n FROM own),
pair AS (SELECT a.term AS tag_a, b.term AS tag_b, count(*) AS n_ab FROM own a JOIN own b ON a.seq = b.seq AND encode(a.term) < encode(b.term) GROUP BY ALL)
SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, t.n AS n_records
FROM pair JOIN single x ON x.term = tag_a JOIN single y ON y.term = tag_b, total t
WHERE n_ab >= 5 AND n_ab * t.n >= 3 * x.n * y.n"""
TERMS = f"""WITH {CURRENT}, all_terms AS (
  SELECT 'tags' AS field, seq, term FROM used WHERE term <> ''
  UNION ALL
  SELECT 'language', seq, lower(regexp_replace(language, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) FROM current_row WHERE trim(language) <> ''
), counted AS (SELECT field, term, count(*) AS uses, count(DISTINCT seq) AS records FROM all_terms GROUP BY ALL)
SELECT field, term, uses, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 >= (SELECT count(*) FROM current_row) THEN 'common' END AS mark
FROM counted"""

# every two rows that share a run of three words meet on it, so this is for small tables only
NEAR = f"""WITH RECURSIVE {CURRENT.split(", used AS")[0]}, words AS (
  SELECT seq, regexp_extract_all(lower(coalesce(name, '') || chr(10) || code), '[a-z0-9_]+') AS w FROM current_row WHERE code <> ''
), own AS (
  SELECT DISTINCT seq, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words
), size AS (SELECT seq, count(*) AS n FROM own GROUP BY seq),
met AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS n FROM own a JOIN own b ON a.run = b.run AND a.seq < b.seq GROUP BY ALL),
pair AS (
  SELECT seq_a, seq_b FROM met JOIN size x ON x.seq = seq_a JOIN size y ON y.seq = seq_b WHERE 2 * met.n >= x.n + y.n - met.n
)"""
GROUPS = f"""{NEAR}, edge AS (SELECT seq_a AS a, seq_b AS b FROM pair UNION ALL SELECT seq_b, seq_a FROM pair),
reached AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reached r JOIN edge e ON e.a = r.b),
least AS (SELECT a, min(b) AS "group" FROM reached GROUP BY a),
linked AS (SELECT a, count(*) AS links FROM edge GROUP BY a)
SELECT a AS seq, "group", links FROM least JOIN linked USING (a)"""

ORACLES = {
    "p2_found": f"{NEAR} SELECT seq_a, seq_b FROM pair",
    "p2_groups": GROUPS,
    "p1_found": f"SELECT tag_a, tag_b FROM ({PAIRS})",
    "p1_pairs": PAIRS,
    "p4_found": f"SELECT field, term, mark FROM ({TERMS}) WHERE mark IS NOT NULL",
    "p4_terms": TERMS,
}
