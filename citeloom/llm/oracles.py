"""DuckDB SQL for the queries that SQL can express."""

from citeloom.llm.quality import STOP_WORDS

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\e'), '</turn>', '\t'), '### ', '\h'), ': ', '\c') AS esc,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '\e' || replace(replace(replace(replace(role, '\', '\e'), '</turn>', '\t'), '### ', '\h'), ': ', '\c') END AS label,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS lost,
    sum(length('### ' || label || ': ' || esc || '</turn>' || chr(10))) AS formatted_chars,
    string_agg(code, '' ORDER BY turn, role, text) AS codes
  FROM e GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256,
  CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(codes, 's?(ua)+') AS valid
FROM g
"""


def stats_sql(source: str) -> str:
    """CTEs that end in ``m``: the measures of every row of ``source`` (doc_id, text)."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
src AS (SELECT row_number() OVER () AS rid, * FROM {source}),
w0 AS (
  SELECT rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM src
),
w AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w0),
g AS (
  SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
),
l AS (
  SELECT rid, len(x) AS lines, len(x) - len(list_distinct(x)) AS dup FROM (
    SELECT rid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS x FROM src)
),
m AS (
  SELECT src.*, CAST(len(w0.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(l.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, l.lines AS n_lines,
    len(list_filter(w0.w, lambda x: lower(x) IN ({stops}))) AS n_stops
  FROM src JOIN w0 USING (rid) JOIN l USING (rid) LEFT JOIN cov USING (rid)
)"""


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def rules_sql() -> str:
    from citeloom.llm.quality import RULES

    sql = {
        "n_words": "n_words",
        "mean_word_chars": "(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END)",
        "symbol_ratio": "(CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END)",
        "stop_ratio": "(CASE WHEN n_words > 0 THEN n_stops / n_words ELSE 0 END)",
        "dup_line_ratio": "(CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END)",
        "repeat_ratio": "(CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END)",
    }
    tests = [f"{sql[r.measure]} >= {r.least}::DOUBLE" for r in RULES if r.least is not None]
    tests += [f"{sql[r.measure]} <= {r.most}::DOUBLE" for r in RULES if r.most is not None]
    return "(" + " AND ".join(tests) + ")"


ORACLES["op4_quality_rules"] = f"""
WITH {stats_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  (NOT {BASE_FAILED} AND {rules_sql()}) AS kept
FROM m
"""

ORACLES["op8_decontaminate"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT row_number() OVER () AS q, item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark
), ig AS (
  SELECT DISTINCT q, item_id, least(5, len(w)) AS k, unnest([array_to_string(w[i : i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS g
  FROM iw WHERE len(w) > 0
), n AS (SELECT q, count(*) AS n_shingles FROM ig GROUP BY q),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (
  SELECT DISTINCT r, doc_id, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g
  FROM dw, ks WHERE len(w) >= k
), hit AS (
  SELECT r, doc_id, q, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n_shingles AS containment
FROM hit JOIN n USING (q) WHERE n_shared >= 0.8::DOUBLE * n_shingles
"""
