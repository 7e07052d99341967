"""The same queries in SQL, for comparison."""

from factloom.plans import knowledge
from factloom.plans.derived import LINE_FACTS, LOGS, PAGES, PROJECT_FACTS

_PATTERN = """lower(trim(regexp_replace(translate(translate(regexp_replace({}, '-[ \\t]*\\n[ \\t]*', '', 'g'), '‘’‚‛“”–—−  ', '''''''''""---  '), '​‌‍﻿', ''), '\\s+', ' ', 'g')))"""


def _form(column: str) -> str:
    """The grounding form of a column."""
    return _PATTERN.replace("{}", column)


_FORM = _form("text")


_ALNUM = "length(regexp_replace(e, '[^\\p{L}\\p{N}]', '', 'g'))"
_REASON = f"""CASE WHEN {_ALNUM} < 4 THEN 'too short' WHEN NOT contains(s, e) THEN 'not in source'
  WHEN length(e) < 24 AND (length(s) - length(replace(s, e, ''))) // length(e) > 4 THEN 'too generic' ELSE 'passed' END"""
_RANKED = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
near AS (
  SELECT a.vec_id AS fact, b.vec_id AS other, list_cosine_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY distance, other)::INTEGER AS rank FROM near),
kept AS (SELECT * FROM ranked WHERE rank <= 8 AND distance <= 0.75),
edges AS (
  SELECT least(fact, other) AS fact_id_a, greatest(fact, other) AS fact_id_b, CASE WHEN (least(fact, other) + greatest(fact, other)) % 3 = 0 THEN 'contradicts' ELSE 'corroborates' END AS type
  FROM kept GROUP BY ALL)"""
_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_CHUNKS = f"""{PAGES},
ck AS (
  SELECT *, {_STRIP} AS body, content_type <> 'empty' AND ({_STRIP} <> '' OR content_type = 'image_only') AS kept FROM paged),
cs AS (
  SELECT *, coalesce(sum(CASE WHEN kept THEN length(body) ELSE length(text) END + 2) OVER w, 0)::INTEGER AS char_start,
    last_value(CASE WHEN kept AND body <> '' THEN body END IGNORE NULLS) OVER w AS before,
    (sum(kept::INTEGER) OVER (PARTITION BY document_id ORDER BY page) - 1)::INTEGER AS chunk_index
  FROM ck WINDOW w AS (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ct AS (SELECT *, right(before, 700) AS t FROM cs WHERE kept),
chunks AS (
  SELECT *, char_start + length(body)::INTEGER AS char_end,
    coalesce(CASE WHEN length(before) <= 700 THEN before WHEN instr(t, ' ') > 0 THEN trim(substr(t, instr(t, ' ') + 1)) ELSE trim(t) END, '') AS context FROM ct)"""
_PAIR = """
pairs AS (
  SELECT a.fact_kind AS kind, a.d0 AS a0, a.d1 AS a1, b.d0 AS b0, b.d1 AS b1, a.basis <> b.basis AS x_basis, a.audited <> b.audited AS x_audited, a.state = b.state AS same_state,
    a.dim AS da, b.dim AS db, a.currency AS ca, b.currency AS cb, a.resolved AND b.resolved AS resolved,
    NOT (a.base_high < b.base_low OR b.base_high < a.base_low OR (a.base_high = b.base_low AND NOT (a.high_closed AND b.low_closed))
      OR (b.base_high = a.base_low AND NOT (b.high_closed AND a.low_closed))) AS meet
  FROM facts a JOIN facts b ON a.fact_kind = b.fact_kind AND a.entity = b.entity AND a.attribute = b.attribute AND a.fact_id < b.fact_id),
checked AS (
  SELECT CASE
    WHEN a1 < b0 OR b1 < a0 THEN 'not_comparable/periods do not meet'
    WHEN NOT (a0 = b0 AND a1 = b1) THEN 'needs_adjudication/periods meet but differ'
    WHEN x_basis OR x_audited THEN 'needs_adjudication/significant qualifiers differ: ' || concat_ws(', ', CASE WHEN x_audited THEN 'audited' END, CASE WHEN x_basis THEN 'basis' END)
    WHEN kind = 'status' AND same_state THEN CASE WHEN resolved THEN 'corroborates/same status' ELSE 'needs_adjudication/an entity was inferred, not stated' END
    WHEN kind = 'status' THEN 'needs_adjudication/status values differ'
    WHEN kind = 'qualitative' THEN 'needs_adjudication/qualitative claims'
    WHEN da <> db AND 'unknown' IN (da, db) AND 'count' IN (da, db) THEN 'needs_adjudication/one unit is unknown'
    WHEN da <> db AND 'unknown' IN (da, db) THEN 'not_comparable/one unit is unknown, the other is concrete'
    WHEN da <> db THEN 'not_comparable/different dimensions'
    WHEN da = 'unknown' THEN 'needs_adjudication/both units are unknown'
    WHEN da = 'currency' AND ca <> cb THEN 'needs_adjudication/different currencies'
    WHEN meet THEN CASE WHEN resolved THEN 'corroborates/intervals overlap' ELSE 'needs_adjudication/an entity was inferred, not stated' END
    ELSE 'needs_adjudication/intervals do not overlap' END AS verdict FROM pairs)"""
_NAMED_PAIR = _PAIR.replace("SELECT a.fact_kind", "SELECT a.fact_id AS fact_id_a, b.fact_id AS fact_id_b, a.fact_kind", 1).replace("SELECT CASE", "SELECT fact_id_a, fact_id_b, CASE", 1)
_FLAGS = """concat_ws(',', CASE WHEN NOT resolved THEN 'entity_inferred' END, CASE WHEN fact_kind = 'quantitative' AND comparator IS NULL THEN 'comparator_unspecified' END,
  CASE WHEN period_kind IN ('fiscal_year', 'quarter', 'half') THEN 'fy_convention_assumed' END)"""
_NFLAGS = "((NOT resolved)::INTEGER + (fact_kind = 'quantitative' AND comparator IS NULL)::INTEGER + (period_kind IN ('fiscal_year', 'quarter', 'half'))::INTEGER)"

SQL = {
    "grounding_benchmark": f"""
WITH i AS (SELECT item_id, {_FORM} AS e FROM benchmark), t AS (SELECT doc_id, lang, {_FORM} AS s FROM documents),
m AS (SELECT item_id, doc_id, lang, {_REASON} AS r FROM i JOIN t ON contains(s, e))
SELECT lang, count(DISTINCT item_id)::BIGINT AS n_items, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_matches FROM m WHERE r = 'passed' GROUP BY lang""",
    "grounding_reasons": f"""
WITH x AS (SELECT {_form("string_split(text, chr(10))[1]")} AS e, {_form("(CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 20) END)")} AS s FROM documents)
SELECT {_REASON} AS outcome, count(*)::BIGINT AS n FROM x GROUP BY 1""",
    "route_pages": f"WITH {PAGES} SELECT document_id, page::INTEGER AS page_number, content_type, round(digits, 9) AS digit_ratio FROM paged",
    "document_profile": f"""
WITH {PAGES}, c AS (
  SELECT document_id, count(*)::BIGINT AS page_count, count(*) FILTER (content_type = 'text_native')::BIGINT AS pages_text_native, 0::BIGINT AS pages_table_heavy,
    count(*) FILTER (content_type = 'image_only')::BIGINT AS pages_image_only, count(*) FILTER (content_type = 'empty')::BIGINT AS pages_empty, count(*) FILTER (image_area >= 0.5)::BIGINT AS image_rich,
    count(*) FILTER (width > 800) AS wide, count(*) FILTER (width > 800 AND width / 800 BETWEEN 1.25 AND 1.95) AS aspect, list_sort(list(char_count))[count(*) // 2 + 1] AS median
  FROM paged GROUP BY 1)
SELECT document_id, page_count, pages_text_native, pages_table_heavy, pages_image_only, pages_empty, image_rich,
  CASE WHEN page_count <= 80 AND wide >= page_count * 0.8 AND aspect >= page_count * 0.6 AND median < 1600 THEN 'slides'
    WHEN pages_image_only / page_count >= 0.6 THEN 'scanned'
    WHEN pages_text_native / page_count >= 0.4 AND (image_rich / page_count >= 0.1 OR pages_image_only >= 2) THEN 'mixed' ELSE 'text_native' END AS content_type FROM c""",
    "chunk_offsets": f"WITH {_CHUNKS} SELECT document_id, page::INTEGER AS page_number, chunk_index, char_start, char_end, length(context)::INTEGER AS context_chars FROM chunks",
    "page_phases": f"""
WITH {PAGES}, n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1)
SELECT document_id, CASE WHEN n > 30 THEN 20 ELSE n END::BIGINT AS fast, CASE WHEN n > 30 THEN n - 20 ELSE 0 END::BIGINT AS later, n::INTEGER AS pages, greatest(600, 8 * n)::INTEGER AS seconds FROM n""",
    "normalize_units": f"WITH {LINE_FACTS} SELECT fact_id, magnitude, dim AS dimension, currency, base_unit FROM facts",
    "half_steps": f"WITH {LINE_FACTS} SELECT fact_id, half FROM facts",
    "value_intervals": f"WITH {LINE_FACTS} SELECT fact_id, base_low AS low, base_high AS high, low_closed, high_closed, dim AS dimension FROM facts",
    "normalize_periods": f"WITH {LINE_FACTS} SELECT DISTINCT label, period_kind AS kind, d0::VARCHAR AS start_date, d1::VARCHAR AS end_date FROM facts",
    "period_relations": f"""
WITH {LINE_FACTS}, l AS (SELECT DISTINCT entity, attribute, label, d0, d1, regexp_extract(entity, '[0-9]+')::BIGINT AS s FROM facts)
SELECT CASE WHEN a.d0 = b.d0 AND a.d1 = b.d1 THEN 'equal' WHEN a.d1 < b.d0 OR b.d1 < a.d0 THEN 'disjoint' WHEN a.d0 <= b.d0 AND a.d1 >= b.d1 THEN 'a_contains_b'
  WHEN b.d0 <= a.d0 AND b.d1 >= a.d1 THEN 'b_contains_a' ELSE 'overlap' END AS relation, count(*)::BIGINT AS n
FROM l a JOIN l b ON a.attribute = b.attribute AND b.s = a.s + 1 GROUP BY 1""",
    "comparator_phrases": """
SELECT ['gt', 'gte', 'lt', 'lte', 'approx', 'range', 'lte', NULL, 'gt', 'lt'][l_partkey % 10 + 1] AS comparator, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""",
    "assumption_flags": f"""
WITH {LINE_FACTS} SELECT fact_id, {_FLAGS} AS flags, round(CASE WHEN {_NFLAGS} = 0 THEN confidence ELSE greatest(0.05, confidence - 0.1::DOUBLE * {_NFLAGS}) END, 9)::DOUBLE AS confidence FROM facts""",
    "significant_qualifiers": f"WITH {LINE_FACTS} SELECT basis, audited, count(*)::BIGINT AS n FROM facts GROUP BY ALL",
    "precheck_outcomes": f"""
WITH {LINE_FACTS}, {_PAIR} SELECT split_part(verdict, '/', 1) AS outcome, split_part(verdict, '/', 2) AS reason, count(*)::BIGINT AS n FROM checked GROUP BY ALL""",
    "open_pairs": f"""
WITH {LINE_FACTS}, {_NAMED_PAIR} SELECT fact_id_a, fact_id_b, split_part(verdict, '/', 1) AS outcome, split_part(verdict, '/', 2) AS reason FROM checked WHERE verdict NOT LIKE 'not_comparable/%'""",
    "knn_candidates": f"WITH {_RANKED} SELECT fact, other, rank, round(distance, 9) AS distance FROM kept",
    "candidates_by_project": f"""
WITH {PROJECT_FACTS},
r AS (
  SELECT a.project_id, a.fact_id AS fact, b.fact_id AS other, list_cosine_distance(a.e, b.e) AS distance
  FROM pf a JOIN pf b ON a.project_id = b.project_id AND a.fact_kind = b.fact_kind AND len(a.e) = len(b.e) AND a.fact_id <> b.fact_id),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, fact ORDER BY distance, other)::INTEGER AS rank FROM r)
SELECT project_id, fact, other, rank, round(distance, 9) AS distance FROM k WHERE rank <= 8 AND distance <= 0.75""",
    "knn_other_kind": """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
r AS (
  SELECT a.vec_id AS fact, b.vec_id AS other, list_cosine_distance(a.e, b.e) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.e, b.e), b.vec_id)::INTEGER AS rank FROM v a JOIN v b ON a.label = 0 AND b.label <> 0)
SELECT fact, other, rank, round(distance, 9) AS distance FROM r WHERE rank <= 3""",
    "edges_deduped": f"WITH {_RANKED} SELECT fact_id_a, fact_id_b, type FROM edges",
    "edges_by_document": f"""
WITH {_RANKED}, x AS (SELECT fact_id_a, fact_id_b, fact_id_a % 20 AS document_id FROM edges UNION SELECT fact_id_a, fact_id_b, fact_id_b % 20 FROM edges)
SELECT document_id, count(*)::BIGINT AS n_edges FROM x GROUP BY 1""",
    "disputed_edges": f"WITH {_RANKED} SELECT fact_id_a, fact_id_b FROM edges WHERE type = 'contradicts'",
    "facts_page": f"""
WITH {LINE_FACTS} SELECT fact_id FROM facts WHERE fact_kind = 'quantitative' AND status = 'verified' ORDER BY created_at DESC, fact_id LIMIT 200 OFFSET 200""",
    "facts_by_status": f"WITH {LINE_FACTS} SELECT 'p' AS project_id, status AS verification_status, count(*)::BIGINT AS n FROM facts GROUP BY ALL",
    "relationships_by_type": f"WITH {_RANKED} SELECT type, count(*)::BIGINT AS n FROM edges GROUP BY 1",
    "hybrid_search": """
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS fact_id, list_cosine_distance(v.embedding::DOUBLE[], q.e) AS d, 0 AS src FROM embeddings v, q ORDER BY d, fact_id LIMIT 8),
w AS (
  SELECT vec_id AS fact_id, 0.0::DOUBLE AS d, 1 AS src FROM embeddings JOIN documents ON doc_id = vec_id
  WHERE source ILIKE '%under the mit license%' OR lang ILIKE '%under the mit license%' OR text ILIKE '%under the mit license%' ORDER BY fact_id LIMIT 8),
u AS (SELECT * FROM s UNION ALL SELECT * FROM w WHERE fact_id NOT IN (SELECT fact_id FROM s))
SELECT row_number() OVER (ORDER BY src, d, fact_id)::INTEGER AS place, fact_id FROM u""",
    "evidence_passages": f"""
WITH {_CHUNKS}, h AS (SELECT document_id, chunk_index, body, instr(lower(body), 'license') AS hit FROM chunks WHERE body ILIKE '%license%')
SELECT document_id, chunk_index, substr(body, greatest(hit - 160, 1), hit + 207 - greatest(hit - 160, 1)) AS snippet FROM h ORDER BY 1, 2 LIMIT 5""",
    "evaluation_overall": f"""
WITH {LOGS} SELECT project_id, count(*) FILTER (is_check)::BIGINT AS grounding_checks, count(*) FILTER (is_check AND is_pass)::BIGINT AS grounding_pass, count(*) FILTER (NOT is_check)::BIGINT AS verify_calls,
  count(*)::BIGINT AS facts_total, round(count(*) FILTER (is_check AND is_pass) / count(*) FILTER (is_check), 9) AS pass_rate, round(count(*) FILTER (status = 'verified') / count(*), 9) AS verified_rate
FROM ev GROUP BY 1""",
    "evaluation_per_document": f"""
WITH {LOGS} SELECT project_id, document_id, facts_total, checks AS grounding_checks, passed AS grounding_pass, checks - passed AS dropped_for_grounding,
  coalesce(round(passed / nullif(checks, 0), 9), 0.0) AS pass_rate FROM pd""",
    "evaluation_timeline": f"""
WITH {LOGS}, w AS (
  SELECT project_id, document_id, count(*) OVER o AS i, sum(facts_total) OVER o AS f, sum(checks) OVER o AS c, sum(passed) OVER o AS p, sum(facts_verified) OVER o AS v, sum(facts_needs_review) OVER o AS r
  FROM pd WINDOW o AS (PARTITION BY project_id ORDER BY created_at, document_id ROWS UNBOUNDED PRECEDING))
SELECT project_id, document_id, i::BIGINT AS index, f::BIGINT AS cumulative_facts, coalesce(round(p / nullif(c, 0), 9), 0.0) AS grounding_pass_rate, round(v / f, 9) AS verified_rate, round(r / f, 9) AS needs_review_rate FROM w""",
    "survivorship": f"""
WITH {LOGS}, x AS (
  SELECT *, document_id % 3 + document_id % 2 AS dropped, CASE WHEN document_id % 4 = 0 THEN 0 ELSE facts_total + 3 END AS returned, CASE WHEN document_id % 4 = 0 THEN 0 ELSE facts_total END AS k FROM pd),
s AS (
  SELECT project_id, sum(CASE WHEN returned <> 0 THEN returned ELSE checks + dropped END)::BIGINT AS considered, sum(CASE WHEN k <> 0 THEN k ELSE checks END)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped_before,
    greatest(0, sum(checks) - sum(passed))::BIGINT AS dropped_for_grounding, sum(passed)::BIGINT AS passed FROM x GROUP BY 1)
SELECT *, round(passed / considered, 9) AS yield_rate FROM s""",
    "mean_embedding": """
WITH x AS (SELECT vec_id % 20 AS document_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, vec_id % 20 * 50 + vec_id // 20 % 50 AS c FROM embeddings),
m AS (SELECT document_id, pos, avg(x) AS x FROM x WHERE c < 48 GROUP BY ALL)
SELECT document_id, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY document_id)), 6) AS x FROM m""",
    "concept_decisions": """
WITH p AS (SELECT DISTINCT p_type, p_size, p_name FROM part),
l AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_name < b.p_name),
n AS (SELECT lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS b FROM l),
t AS (
  SELECT a, b, list_distinct(list_filter(regexp_extract_all(a, '[a-z0-9]+'), lambda w: w NOT IN ('the', 'of', 'a', 'an', 'and', 'for', 'to', 'in', 'on', 's', 'total'))) AS x,
    list_distinct(list_filter(regexp_extract_all(b, '[a-z0-9]+'), lambda w: w NOT IN ('the', 'of', 'a', 'an', 'and', 'for', 'to', 'in', 'on', 's', 'total'))) AS y FROM n)
SELECT CASE WHEN a = b OR (len(x) > 0 AND list_sort(x) = list_sort(y)) THEN 'exact'
  WHEN coalesce(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0), 0) < 0.2 AND NOT (contains(a, b) OR contains(b, a)) THEN 'disjoint' ELSE 'model' END AS method,
  count(*)::BIGINT AS n FROM t GROUP BY 1""",
    "concept_upsert": """
SELECT p_brand AS canonical_name, count(DISTINCT p_name)::INTEGER AS n_aliases, min(p_name) AS first_alias, min(p_partkey)::VARCHAR AS first_seen_document_id FROM part GROUP BY 1""",
    "duplicate_documents": """
SELECT CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'taken' END AS outcome FROM documents""",
    "cascade_delete": f"""
WITH {LOGS}, g AS (SELECT event_id FROM ev WHERE document_id % 5 = 0)
SELECT 'documents' AS name, count(*)::BIGINT AS n FROM pd WHERE document_id % 5 <> 0 UNION ALL SELECT 'chunks', count(*) FROM pd WHERE document_id % 5 <> 0
UNION ALL SELECT 'facts', count(*) FROM ev WHERE document_id % 5 <> 0 UNION ALL SELECT 'verification_logs', count(*) FROM ev WHERE document_id % 5 <> 0
UNION ALL SELECT 'fact_relationships', count(*) FROM ev WHERE event_id NOT IN (FROM g) AND event_id + 7 NOT IN (FROM g)
UNION ALL SELECT 'canonical_concepts', count(*) FROM pd UNION ALL SELECT 'mentions', count(*) FROM pd WHERE document_id % 5 <> 0""",
    "verify_states": """
WITH x AS (
  SELECT l_linenumber <> 7 AS g, CASE WHEN l_orderkey % 7 < 3 THEN 's' WHEN l_orderkey % 7 < 6 THEN 'n' END AS v1, l_discount * 10 AS c1, l_orderkey % 11 = 0 AS e1, l_partkey % 2 = 0 AS fix,
    CASE WHEN l_partkey % 7 < 3 THEN 's' WHEN l_partkey % 7 < 6 THEN 'n' END AS v2, l_tax * 10 AS c2 FROM lineitem),
y AS (
  SELECT CASE WHEN NOT g THEN 'rejected/not grounded' WHEN e1 OR v1 IS NULL THEN 'needs_review/no verdict' WHEN v1 = 's' AND c1 >= 0.5 THEN 'verified' WHEN NOT fix THEN 'needs_review/no safe correction'
    WHEN v2 IS NULL THEN 'needs_review/no second verdict' WHEN v2 = 's' AND c2 >= 0.5 THEN 'auto_corrected/corrected' ELSE 'needs_review/the correction did not help' END AS s FROM x)
SELECT split_part(s, '/', 1) AS verification_status, nullif(split_part(s, '/', 2), '') AS note, count(*)::BIGINT AS n FROM y GROUP BY ALL""",
    "correction_diff": """
SELECT concat_ws(',', CASE WHEN o_custkey % 2 = 1 THEN 'customer' END, CASE WHEN o_orderpriority <> upper(o_orderpriority) THEN 'priority' END, CASE WHEN o_orderstatus <> 'F' THEN 'status' END) AS fields,
  count(*)::BIGINT AS n FROM orders GROUP BY 1""",
    "accounting_figures": """
SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_partkey % 3 < 2 THEN -1 ELSE 1 END * (round(l_extendedprice * 100)::BIGINT / 100))::DOUBLE AS figure FROM lineitem""",
    "tool_trace": """
WITH s AS (
  SELECT conv_id, turn, conv_id + turn AS fact, CASE WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN 'conclude' WHEN turn % 2 = 1 THEN 'get_relationships' ELSE 'search_facts' END AS action FROM conversations),
t AS (
  SELECT *, row_number() OVER w AS place, coalesce(sum((action = 'conclude')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS conversation, turn AS step, action, CASE WHEN action = 'conclude' THEN 'concluded' WHEN action = 'get_relationships' AND fact NOT IN (SELECT vec_id * 2 FROM embeddings) THEN 'unknown fact' ELSE 'ran' END AS outcome
FROM t WHERE place <= 5 AND over_ = 0""",
    "synthesised_answers": f"""
WITH {LINE_FACTS}, o AS (SELECT DISTINCT split_part(fact_id, '-', 1)::BIGINT AS k, fact_id FROM facts), c AS (SELECT k, count(*) AS n FROM o GROUP BY 1),
q AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders),
e AS (SELECT q.k, n, CASE WHEN n IS NULL THEN '' WHEN q.k % 7 = 0 THEN 'missing' WHEN q.k % 5 = 0 THEN 'timeout' WHEN q.k % 11 = 0 THEN 'no JSON object' ELSE '' END AS error FROM q LEFT JOIN c USING (k))
SELECT k AS answer_id, error,
  CASE WHEN n IS NULL THEN 'This project has no verified facts that address that question.' WHEN error <> '' THEN 'The answer could not be synthesised. The relevant facts are cited below.' ELSE 'as [F' || (k % 4 + 1) || '] says' END AS answer,
  coalesce(array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: error <> '' OR i = 2 OR i = k % 4 + 1), lambda i: 'F' || i), ','), '') AS cited,
  CASE WHEN n >= 2 AND k % 6 = 0 THEN 1 ELSE 0 END::INTEGER AS disagreements FROM e""",
    "answer_citations": f"""
WITH {LINE_FACTS}, o AS (SELECT DISTINCT split_part(fact_id, '-', 1)::BIGINT AS answer_id, fact_id FROM facts),
c AS (SELECT answer_id, count(*) AS k FROM o GROUP BY 1)
SELECT answer_id, CASE WHEN answer_id % 5 = 0 THEN k WHEN (k >= 2)::INTEGER + (answer_id % 4 <> 1 AND k >= answer_id % 4 + 1)::INTEGER = 0 THEN k
  ELSE (k >= 2)::INTEGER + (answer_id % 4 <> 1 AND k >= answer_id % 4 + 1)::INTEGER END::BIGINT AS n_cited
FROM c WHERE answer_id IN (SELECT o_orderkey FROM orders)""",
}
SQL["fact_lines"] = f"""
WITH {LINE_FACTS}, w AS (
  SELECT *, CASE WHEN comparator = 'eq' THEN '' WHEN comparator IS NULL THEN '~' ELSE comparator || ' ' END
    || CASE WHEN n = floor(n) THEN n::BIGINT::VARCHAR ELSE rtrim(printf('%.2f', n), '0') END || ' ' || unit AS figure FROM facts)
SELECT fact_id, entity || ' | ' || attribute || ' | ' || CASE fact_kind WHEN 'quantitative' THEN figure WHEN 'status' THEN CASE state WHEN 'sent back' THEN ' Sent  back' WHEN 'accepted' THEN 'Accepted' ELSE state END
  ELSE 'as stated' END || ' | ' || label || ' [' || document_id || ']' AS line FROM w"""
SQL["compare_vectors"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label % 3 AS x, label % 2 AS y FROM embeddings),
near AS (SELECT a.vec_id AS f, b.vec_id AS o, list_cosine_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, o) AS k FROM near),
p AS (SELECT DISTINCT least(f, o) AS a, greatest(f, o) AS b FROM r WHERE k <= 8 AND d <= 0.75),
c AS (
  SELECT CASE WHEN greatest(s.x, 1) <> greatest(t.x, 1) THEN 'not_comparable/different entities' WHEN s.y <> t.y THEN 'not_comparable/different attributes'
    WHEN a % 3 = b % 3 THEN 'corroborates/intervals overlap' ELSE 'needs_adjudication/intervals do not overlap' END AS z FROM p JOIN v s ON s.vec_id = a JOIN v t ON t.vec_id = b)
SELECT split_part(z, '/', 1) AS outcome, split_part(z, '/', 2) AS reason, count(*)::BIGINT AS n FROM c GROUP BY ALL"""
SQL["comparator_repair"] = """
WITH r AS (SELECT ['gt', 'gte', 'lt', 'lte', 'approx', 'eq', 'lte', 'eq', 'eq', 'eq'][l_partkey % 10 + 1] AS c FROM lineitem)
SELECT c AS comparator, c <> 'eq' AS repaired, count(*)::BIGINT AS n FROM r GROUP BY ALL"""
SQL["stream_log_windows"] = """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, count(*) FILTER (value > 0)::BIGINT AS n_positive FROM events GROUP BY ALL"""
SQL["stream_new_documents"] = "SELECT lang, count(*)::BIGINT AS n FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1) JOIN documents USING (doc_id) GROUP BY 1"
SQL["duplicate_documents"] = f"SELECT outcome, count(*)::BIGINT AS n FROM ({SQL['duplicate_documents']}) GROUP BY 1"
SQL["disputed_edges_all"] = f"WITH {_RANKED} SELECT fact_id_a, fact_id_b FROM edges WHERE type = 'contradicts'"
SQL["plan_batches"] = f"""
WITH RECURSIVE {_CHUNKS},
c AS (SELECT document_id, chunk_index, length(body) AS size, page % 9 = 0 AS is_table FROM chunks),
f AS (
  SELECT document_id, chunk_index, 0 AS batch, CASE WHEN is_table THEN 0 ELSE 1 END AS pages, CASE WHEN is_table THEN 0 ELSE size END AS chars FROM c WHERE chunk_index = 0
  UNION ALL
  SELECT c.document_id, c.chunk_index, f.batch + CASE WHEN c.is_table OR f.pages = 0 OR f.pages >= 6 OR f.chars + c.size > 10000 THEN 1 ELSE 0 END,
    CASE WHEN c.is_table THEN 0 WHEN f.pages = 0 OR f.pages >= 6 OR f.chars + c.size > 10000 THEN 1 ELSE f.pages + 1 END,
    CASE WHEN c.is_table THEN 0 WHEN f.pages = 0 OR f.pages >= 6 OR f.chars + c.size > 10000 THEN c.size ELSE f.chars + c.size END
  FROM f JOIN c ON c.document_id = f.document_id AND c.chunk_index = f.chunk_index + 1)
SELECT document_id, chunk_index, batch::INTEGER AS batch FROM f"""
SQL["read_twice"] = f"""
WITH {LINE_FACTS}, d AS (SELECT DISTINCT ON (fact_id) * FROM facts),
r AS (SELECT *, contains(lower(entity || ' ' || attribute), 'metric 49') AS named, row_number() OVER (PARTITION BY document_id ORDER BY contains(lower(entity || ' ' || attribute), 'metric 49') DESC, confidence, fact_id) AS place FROM d)
SELECT document_id, fact_id FROM r WHERE named OR place <= 5"""
_AGREE = _PAIR.replace("a.fact_kind AS kind,", "a.fact_id, a.fact_kind AS kind,").replace(
    "FROM facts a JOIN facts b ON a.fact_kind = b.fact_kind AND a.entity = b.entity AND a.attribute = b.attribute AND a.fact_id < b.fact_id",
    "FROM one a JOIN facts b ON a.fact_kind = b.fact_kind AND split_part(a.fact_id, '-', 1) = split_part(b.fact_id, '-', 1) AND split_part(b.fact_id, '-', 2)::INTEGER % 2 = 0",
)
SQL["dual_reading"] = f"""
WITH {LINE_FACTS}, one AS (SELECT DISTINCT ON (fact_id) * FROM facts WHERE split_part(fact_id, '-', 2)::INTEGER % 2 = 1), {_AGREE.replace("SELECT CASE", "SELECT fact_id, CASE", 1)},
g AS (SELECT fact_id, bool_or(verdict LIKE 'corroborates/%') AS agrees FROM checked GROUP BY 1),
s AS (SELECT coalesce(agrees, FALSE) AS agrees, status FROM one LEFT JOIN g USING (fact_id))
SELECT agrees, CASE WHEN NOT agrees AND status IN ('verified', 'auto_corrected') THEN 'needs_review' ELSE status END AS status, count(*)::BIGINT AS n FROM s GROUP BY ALL"""
SQL |= knowledge.SQL
