"""DuckDB SQL of the queries that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from textloom.llm import chat_pairs, license_scan, url_filters

OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_filter_sql(rules=url_filters.RULES, rounds: int = url_filters.ROUNDS, damping: float = url_filters.DAMPING, places: int = url_filters.PLACES) -> str:
    """The rules as one CASE, and the iteration unrolled."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))

    def case(value) -> str:
        parts = []
        for action, rule in ordered:
            at, slash, rest = rule.partition("/")
            parts.append(f"WHEN (host = {_quoted(at)} OR ends_with(host, {_quoted('.' + at)})) AND starts_with(path, {_quoted(slash + rest)}) THEN {_quoted(value(action, rule))}")
        return "CASE " + " ".join(parts) + " ELSE NULL END"

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
  SELECT host, {damping} * sum(t) AS t, {damping} * sum(d) AS d FROM (
    SELECT host, t / {damping} AS t, d / {damping} AS d FROM r0
    UNION ALL SELECT s.dst, r.t * s.forth, 0.0 FROM shares s JOIN r{i} r ON r.host = s.src
    UNION ALL SELECT s.src, 0.0, r.d * s.back FROM shares s JOIN r{i} r ON r.host = s.dst) GROUP BY host)""")
    return rf"""
WITH p AS (
  SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (SELECT page_id, html, host, path, {case(lambda a, r: r)} AS rule, {case(lambda a, r: a)} AS act FROM h),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), {_quoted(url_filters.LINK)}, 1)) AS raw FROM j),
edges AS (SELECT src, {lower.format("raw")} AS dst, count(*) AS w FROM links WHERE src <> '' AND raw <> '' AND src <> {lower.format("raw")} GROUP BY 1, 2),
shares AS MATERIALIZED (
  SELECT src, dst, w / (sum(w) OVER (PARTITION BY src)) AS forth, w / (sum(w) OVER (PARTITION BY dst)) AS back FROM edges),
r0 AS MATERIALIZED (
  SELECT * FROM (
    SELECT host, CASE WHEN 2 * count(*) FILTER (WHERE act = 'allow') > count(*) THEN 1.0 ELSE 0.0 END AS t,
           CASE WHEN 2 * count(*) FILTER (WHERE act = 'block') > count(*) THEN 1.0 ELSE 0.0 END AS d
    FROM j WHERE host <> '' GROUP BY host) WHERE t + d > 0),
{", ".join(steps)}
SELECT page_id, j.host, path, rule,
       coalesce(act, CASE WHEN round(coalesce(r.d, 0), {places}) > round(coalesce(r.t, 0), {places}) THEN 'block' ELSE 'allow' END) AS verdict,
       cast(round(coalesce(r.t, 0), {places}) AS double) AS trust, cast(round(coalesce(r.d, 0), {places}) AS double) AS distrust
FROM j LEFT JOIN r{rounds} r ON r.host = j.host
"""


def license_sql(phrases=license_scan.PHRASES, templates=license_scan.TEMPLATES, percent: int = license_scan.PERCENT) -> str:
    """Phrases by position in the word list; lines against every template by plain set intersection."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(
        f"SELECT doc_id, {_quoted(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = {_quoted(x)}" for k, x in enumerate(p.split()))
        + ")) AS pos FROM d"
        for p, label in phrases.items()
    )
    rows = ", ".join(f"({i}, {_quoted(label)}, {_quoted(t)})" for i, (label, t) in enumerate(templates))
    return rf"""
WITH l AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM l),
places AS ({places}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(line, '{word}')) AS b FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS line_no FROM d)),
templates AS (SELECT id, label, list_distinct(string_split(txt, ' ')) AS s FROM (VALUES {rows}) v(id, label, txt)),
met AS (
  SELECT doc_id, line_no, label, len(list_intersect(b, s)) / len(s) AS share
  FROM lines CROSS JOIN templates WHERE 100 * len(list_intersect(b, s)) >= {percent} * len(s)),
found AS (
  SELECT doc_id, max(share) AS share, count(DISTINCT line_no) AS n_blocks, list_distinct(list(label)) AS labels FROM met GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       CASE WHEN base.doc_id IS NOT NULL THEN 1.0::double ELSE coalesce(share, 0)::double END AS score,
       coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def chat_sql(start: str = chat_pairs.START, middle: str = chat_pairs.MIDDLE, end: str = chat_pairs.END) -> str:
    """The query's pairs, their first difference, and the rendered parts."""
    turn = f"{_quoted(start)} || coalesce({{0}}_role, '') || {_quoted(middle)} || coalesce({{0}}_text, '') || {_quoted(end)}"
    return rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, first_value(role) OVER w AS role, first_value(text) OVER w AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST)),
last AS (SELECT conv_id, max(turn) AS last_turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
answers AS (SELECT l.conv_id, t.text AS answer FROM last l JOIN t ON t.conv_id = l.conv_id AND t.turn = l.last_turn),
chosen AS (SELECT t.* FROM t JOIN last l ON l.conv_id = t.conv_id WHERE t.turn <= l.last_turn),
rejected AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn = l.last_turn THEN a.answer ELSE c.text END AS text
  FROM chosen c JOIN last l ON l.conv_id = c.conv_id
  JOIN answers a ON a.conv_id = CASE WHEN c.conv_id % 2 = 0 THEN c.conv_id + 1 ELSE c.conv_id - 1 END),
pairs AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text,
         c.conv_id IS NOT NULL AS has_c, r.conv_id IS NOT NULL AS has_r,
         c.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM chosen c FULL JOIN rejected r ON r.conv_id = c.conv_id AND r.turn = c.turn),
cut AS (SELECT conv_id, min(turn) FILTER (WHERE NOT same) AS first_diff FROM pairs GROUP BY conv_id),
parts AS (
  SELECT p.conv_id, turn, 'prompt' AS part, c_role AS role, {turn.format("c")} AS rendered FROM pairs p JOIN cut USING (conv_id) WHERE first_diff IS NULL OR turn < first_diff
  UNION ALL SELECT p.conv_id, turn, 'chosen', c_role, {turn.format("c")} FROM pairs p JOIN cut USING (conv_id) WHERE has_c AND turn >= first_diff
  UNION ALL SELECT p.conv_id, turn, 'rejected', r_role, {turn.format("r")} FROM pairs p JOIN cut USING (conv_id) WHERE has_r AND turn >= first_diff)
SELECT conv_id, part, turn, role, rendered, part <> 'prompt' AND coalesce(role, '') = 'assistant' AS trained FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter_sql(), "op2_license_scan": license_sql(), "op7_exact_dedup": OP7, "op9_preference_format": chat_sql()}
