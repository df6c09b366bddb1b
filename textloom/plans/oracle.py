"""DuckDB SQL of the library's queries."""

from __future__ import annotations

from textloom.functions import text as tx
from textloom.operators import tagging

LINES = """lines AS MATERIALIZED (
  SELECT doc_id AS book, cast(i AS bigint) AS line_no, line AS text, cast(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS double) AS size
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
  WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '')"""
ROLE = "(['SOURCE', 'GLOSS', 'TRANSLATION', 'OTHER'])[cast(size AS bigint) % 4 + 1]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def _keyword_sql() -> str:
    counts: dict[tuple[str, str], int] = {}
    for tag, words in tagging.FUNCTION_WORDS.items():
        for w in words:
            counts[tag, w] = counts.get((tag, w), 0) + 1
    rows = ", ".join(f"('{t}', '{k}', {n})" for (t, k), n in counts.items())
    token = tx.TOKEN.replace("'", "''")
    return f"""
WITH k AS (SELECT * FROM (VALUES {rows}) v(tag, keyword, m)),
parts AS (
  SELECT doc_id, 1 AS is_head, lower(split_part(text, chr(10), 1)) AS t FROM documents
  UNION ALL SELECT doc_id, 0, lower(regexp_replace(text, '^[^\\n]*\\n?', '')) FROM documents),
w AS (SELECT doc_id, is_head, regexp_extract_all(t, '{token}') AS w FROM parts),
n AS (
  SELECT doc_id, is_head, tag, m AS n FROM (SELECT doc_id, is_head, unnest(w) AS keyword FROM w) x JOIN k USING (keyword) WHERE keyword NOT LIKE '% %'
  UNION ALL SELECT doc_id, is_head, tag, m * len(regexp_extract_all(array_to_string(w, ' '), '\\b' || keyword || '\\b')) FROM w JOIN k ON keyword LIKE '% %'),
s AS (SELECT doc_id, tag, cast(sum(n) FILTER (WHERE is_head = 0) AS bigint) AS b, cast(sum(n) FILTER (WHERE is_head = 1) AS bigint) AS h FROM n GROUP BY 1, 2),
c AS (SELECT doc_id, tag, coalesce(b, 0) AS body, coalesce(h, 0) AS heading, cast(coalesce(b, 0) + 2.0 * coalesce(h, 0) AS double) AS score FROM s)
SELECT *, score >= 4.0 AS strong, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM c WHERE score >= 2.0"""


def _role_sql() -> str:
    off = "IN ('OTHER', '-')"
    steps = [
        (f"r = 'SOURCE' AND n IN ('OTHER', 'SOURCE') AND p = 'OTHER' AND n2 {off}", "'OTHER'"),
        ("r <> 'TRANSLATION' AND n = 'SOURCE' AND n2 = 'GLOSS'", "'SOURCE'"),
        (f"r <> 'GLOSS' AND p = 'SOURCE' AND n = 'TRANSLATION' AND p2 {off}", "'GLOSS'"),
        (f"r = 'TRANSLATION' AND p {off} AND n {off} AND p2 {off} AND n2 {off}", "'OTHER'"),
        ("r = 'TRANSLATION' AND p = 'SOURCE' AND n = 'TRANSLATION'", "'GLOSS'"),
        ("r = 'SOURCE' AND p = 'SOURCE' AND p2 = 'GLOSS' AND n IN ('TRANSLATION', 'SOURCE')", "'GLOSS'"),
        ("r = 'GLOSS' AND p = 'GLOSS' AND n = 'GLOSS'", "'SOURCE'"),
        (f"r = 'GLOSS' AND p {off} AND n = 'GLOSS' AND n2 = 'SOURCE'", "'SOURCE'"),
        ("r = 'SOURCE' AND p = 'SOURCE' AND n = 'SOURCE' AND n2 = 'GLOSS'", "'GLOSS'"),
        (
            "r = 'OTHER'",
            "CASE WHEN n = 'GLOSS' AND n2 IN ('TRANSLATION', 'SOURCE') THEN 'SOURCE' WHEN p = 'SOURCE' AND n = 'TRANSLATION' THEN 'GLOSS' WHEN p = 'GLOSS' AND p2 = 'SOURCE' THEN 'TRANSLATION' "
            "WHEN p = 'SOURCE' AND n = 'SOURCE' THEN 'GLOSS' WHEN p = 'TRANSLATION' AND n = 'TRANSLATION' THEN 'TRANSLATION' ELSE r END",
        ),
        (f"NOT regexp_matches({_strip('text')}, '[^\\pN\\pP\\pS\\pZ\\pM\\pC]') AND {_strip('text')} <> ''", "'OTHER'"),
    ]
    inner = f"""SELECT book, line_no, text, role, role AS r, lag(role, 1, '-') OVER w AS p, lag(role, 2, '-') OVER w AS p2, lead(role, 1, '-') OVER w AS n, lead(role, 2, '-') OVER w AS n2
  FROM (SELECT *, {ROLE} AS role FROM lines) WINDOW w AS (PARTITION BY book ORDER BY line_no)"""
    for condition, to in steps:
        inner = f"SELECT book, line_no, text, role, CASE WHEN {condition} THEN {to} ELSE r END AS r, p, p2, n, n2 FROM ({inner})"
    return f"WITH {LINES} SELECT book, line_no, role, r AS new_role FROM ({inner})"


SECTIONS = """marked AS (
  SELECT *, CASE WHEN size <= 3 THEN cast(size AS bigint) END AS level, count(CASE WHEN size <= 3 THEN 1 END) OVER (PARTITION BY book ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines),
sections AS (
  SELECT book, section, max(CASE WHEN level IS NOT NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS heading, max(level) AS level,
         coalesce(string_agg(CASE WHEN level IS NULL THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, ' ' ORDER BY line_no), '') AS text
  FROM marked WHERE section > 0 GROUP BY book, section)"""

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: cast({0}[i] AS double) * cast({1}[i] AS double)))"


def _cosine(a: str, b: str) -> str:
    return f"round({DOT.format(a, b)} / (sqrt({DOT.format(a, a)}) * sqrt({DOT.format(b, b)})), 6)"


SCORED = f"""scored AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS query_label, i.label AS label, {_cosine("q.embedding", "i.embedding")} AS sim
  FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0)"""
ITEM_WORDS = r"""words AS (SELECT DISTINCT word FROM (SELECT regexp_replace(lower(unnest(regexp_extract_all(text, '\S+'))), '[^\pL\pN_\s]', '', 'g') AS word FROM benchmark) WHERE word <> '')"""
SPANS = """spans AS (SELECT l_orderkey, l_linenumber AS i, l_extendedprice AS x0, l_quantity AS y0, l_linenumber AS height, l_returnflag AS font, l_tax AS size, l_returnflag || l_linestatus AS text FROM lineitem)"""
PIPED = """piped AS (SELECT p_partkey, p_size, p_brand, p_name, p_type FROM part),
middle AS (SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS s, unnest([1, 2, 3]) AS k FROM piped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(s) // 4, k) AS r FROM middle),
short AS (SELECT p_partkey, string_agg(s, ' | ' ORDER BY r) AS m FROM ranked WHERE r <= 2 GROUP BY p_partkey),
trimmed AS (SELECT p.p_partkey, p_size, p_brand, p_brand || m || p_type AS text FROM piped p JOIN short ON short.p_partkey = p.p_partkey)"""


def _gloss_sql() -> str:
    inner = "regexp_replace(g, '\\s+', ' ', 'g')"
    for pattern, to in tx.GLOSS_RULES:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        inner = f"regexp_replace({inner}, '{pattern.removeprefix('(?i)')}', '{to}', '{flags}')"
    return f"""WITH r AS (SELECT p_partkey, 'k.o. ' || p_name || ' (1sg poss); sp. ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' (2pl) excl ,' ELSE ' (sg).' END AS g FROM part)
SELECT p_partkey, trim({inner}, '{tx.GLOSS_EDGE}') AS gloss, CASE WHEN contains(g, '(pl') THEN 'Plur' WHEN contains(g, '(sg') THEN 'Sing' END AS number,
  CASE WHEN contains(g, '3sg') THEN '3' WHEN contains(g, '2sg') THEN '2' WHEN contains(g, '1sg') THEN '1' END AS person, CASE WHEN contains(g, '1sg') THEN true END AS possessive,
  CASE WHEN contains(g, 'excl') THEN 'Exclusive' WHEN contains(g, 'incl') THEN 'Inclusive' END AS clusivity FROM r"""


def oracle_sql() -> dict[str, str]:
    w = _words
    token = tx.TOKEN.replace("'", "''")
    abbreviations = ", ".join(f"'{x}'" for x in tx.GLOSS_ABBREVIATIONS)
    english = ", ".join(f"'{x}'" for x in tx.ENGLISH_WORDS)
    return {
        "keyword_tags": _keyword_sql(),
        "phrase_counts": rf"SELECT doc_id, len(regexp_extract_all(array_to_string(regexp_extract_all(lower(text), '{token}'), ' '), '\bof the\b')) AS n, length(text) // 4 AS tokens FROM documents",
        "line_table": f"WITH {LINES} SELECT * FROM lines",
        "size_histogram": f"WITH {LINES} SELECT size, count(*) AS occurrences, cast(sum(length(text)) AS bigint) AS total_chars, min(book) AS first_book FROM lines GROUP BY size",
        "main_size": f"WITH {LINES}, h AS (SELECT size, cast(sum(length(text)) AS bigint) AS total_chars, min((book, line_no)) AS f FROM lines GROUP BY size) SELECT size AS main_size, total_chars FROM h ORDER BY total_chars DESC, f LIMIT 1",
        "heading_sizes": f"""WITH {LINES}, h AS (SELECT size, count(*) AS occurrences, cast(sum(length(text)) AS bigint) AS total_chars FROM lines GROUP BY size)
SELECT row_number() OVER (ORDER BY size DESC) AS level, * FROM h WHERE size > 20.5 AND total_chars >= 50 AND occurrences >= 2 ORDER BY size DESC LIMIT 4""",
        "sections": f"WITH {LINES}, {SECTIONS} SELECT * FROM sections",
        "sections_collapsed": f"""WITH {LINES}, {SECTIONS},
a AS (SELECT *, trim(text) = '' AS e, lag(level) OVER w AS pl, lag(trim(text) = '', 1, false) OVER w AS pe FROM sections WINDOW w AS (PARTITION BY book ORDER BY section)),
b AS (SELECT *, e AND pe AND level = pl AS goes_on FROM a),
c AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY section) AS run FROM b),
f AS (SELECT *, count(*) OVER (PARTITION BY book, run) AS m FROM c),
g AS (SELECT *, NOT e AND pe AND (lag(m) OVER (PARTITION BY book ORDER BY section) >= 2 OR level = pl) AS taken FROM f),
h AS (SELECT *, sum(CASE WHEN goes_on OR taken THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY section) AS grp FROM g)
SELECT book, min(section) AS section, string_agg(coalesce(heading, ''), ' ' ORDER BY section) AS heading, arg_min(level, section) AS level, arg_max(text, section) AS text FROM h GROUP BY book, grp""",
        "visual_lines": f"""WITH {SPANS}, t AS (SELECT l_orderkey, 0.4 * quantile_cont(height, 0.5) AS reach FROM spans GROUP BY 1),
a AS (SELECT s.*, coalesce(abs(y0 - lag(y0) OVER w) < reach, false) AS near FROM spans s JOIN t ON t.l_orderkey = s.l_orderkey WINDOW w AS (PARTITION BY s.l_orderkey ORDER BY y0, i)),
b AS (SELECT *, cast(sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY y0, i) AS bigint) AS line FROM a),
f AS (SELECT l_orderkey, line, font, size, sum(length(text)) AS c, min((x0, i)) AS f FROM b GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY c DESC, f) AS k FROM f)
SELECT b.l_orderkey, b.line, count(*) AS n, string_agg(text, ' ' ORDER BY x0, i) AS text, min(x0) AS x0, any_value(r.size) AS common_size FROM b JOIN r ON r.l_orderkey = b.l_orderkey AND r.line = b.line AND r.k = 1 GROUP BY 1, 2""",
        "common_size": f"""WITH {SPANS}, c AS (SELECT l_orderkey, size, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(i), size) AS k FROM spans GROUP BY 1, 2) SELECT l_orderkey, size FROM c WHERE k = 1""",
        "quantised_heights": "SELECT l_orderkey, cast(l_linenumber AS bigint) AS i, round_even(l_quantity / 2, 0) * 2 AS row FROM lineitem",
        "continuation_rows": "SELECT user_id, event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - 1.0) < 0.5, false) AS continuation FROM events",
        "rules_kept": f"SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> '' AND NOT contains(lower(text), 'no applicable rule found') AND NOT contains(lower(text), 'no valid rules')",
        "first_items": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_quantity > 10)
SELECT o_orderkey, coalesce(l_returnflag, 'Unknown') AS l_returnflag, coalesce(l_linestatus, 'Unknown') AS l_linestatus FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1""",
        "sections_by_page": f"""WITH {LINES}, {SECTIONS}, p AS (SELECT coalesce(cast(CASE WHEN level > 1 THEN book % 17 END AS varchar), 'Unknown') AS page, book, section, coalesce(heading, '') AS h FROM sections)
SELECT page, count(*) AS n, string_agg(h, '|' ORDER BY book, section) AS headings FROM p GROUP BY page""",
        "usable_sections": f"WITH {LINES}, {SECTIONS} SELECT book, section FROM sections WHERE length(text) >= 10",
        "bullet_lists": "SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS bullets FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
        "trimmed_examples": f"WITH {PIPED} SELECT p_partkey, text FROM trimmed",
        "best_paragraphs": f"""WITH {PIPED}, s AS (SELECT *, length(text) // 4 AS n FROM trimmed WHERE length(text) // 4 <= 14),
b AS (SELECT p_brand, p_size, text, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY n, p_partkey) AS k FROM s),
f AS (SELECT p_brand, text, min(p_size) AS r FROM b WHERE k = 1 GROUP BY 1, 2), o AS (SELECT p_brand, text, row_number() OVER (PARTITION BY p_brand ORDER BY r, text) AS rank FROM f)
SELECT p_brand, rank, text FROM o WHERE rank <= 3""",
        "gap_clusters": """WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS y FROM events),
g AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id) AS gap FROM s),
m AS (SELECT user_id, quantile_cont(gap, 0.5) AS mid FROM g GROUP BY user_id)
SELECT g.user_id, event_id, cast(sum(CASE WHEN gap IS NULL OR gap >= 0.4 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY y, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS cluster FROM g JOIN m ON m.user_id = g.user_id""",
        "column_histogram": """WITH c AS (SELECT l_linenumber, round_even(l_discount, 2) AS position, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, f, position) AS rank FROM c) SELECT l_linenumber, position, n, rank FROM r WHERE rank <= 2""",
        "context_window": f"""WITH {LINES} SELECT book, line_no, 'PREV_3] ' || lag(text, 3, '') OVER w || '[PREV_2] ' || lag(text, 2, '') OVER w || ' [PREV] ' || lag(text, 1, '') OVER w || ' [CURR] ' || text
 || ' [NEXT] ' || lead(text, 1, '') OVER w || ' [NEXT_2] ' || lead(text, 2, '') OVER w || ' [NEXT_3] ' || lead(text, 3, '') OVER w AS context FROM lines WINDOW w AS (PARTITION BY book ORDER BY line_no)""",
        "line_features": rf"""WITH {LINES}, f AS (SELECT book, line_no, text, list_transform({w("text")}, lambda x: cast(length(x) AS double)) AS ls, len(regexp_extract_all(text, '[\x00-\x7F]')) AS a FROM lines)
SELECT book, line_no, cast(length(text) AS double) AS length, cast(len(ls) AS double) AS num_tokens, round(a / length(text), 6) AS ascii_ratio, cast(length(text) - a AS double) AS non_ascii,
  round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) AS digit_ratio, CASE WHEN regexp_matches(text, '[=~-]') THEN 1.0::double ELSE 0.0::double END AS has_marks,
  round(list_sum(ls) / len(ls), 6) AS token_mean, round(sqrt(greatest(0.0, list_sum(list_transform(ls, lambda x: x * x)) / len(ls) - (list_sum(ls) / len(ls)) * (list_sum(ls) / len(ls)))), 6) AS token_std FROM f""",
        "role_rewrite": _role_sql(),
        "parallel_blocks": """WITH l AS (SELECT conv_id AS book, turn, text, CASE role WHEN 'user' THEN 'S' WHEN 'assistant' THEN 'T' ELSE 'O' END AS r FROM conversations),
a AS (SELECT *, sum(CASE WHEN r = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM l),
b AS (SELECT *, CASE WHEN r = 'T' AND lead(r, 1, '-') OVER (PARTITION BY book, run ORDER BY turn) <> 'T' THEN 1 ELSE 0 END AS e FROM a WHERE r <> 'O'),
c AS (SELECT *, sum(e) OVER (PARTITION BY book, run) AS ends, max(CASE WHEN r = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY book, run) AS s,
  coalesce(sum(e) OVER (PARTITION BY book, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
d AS (SELECT *, CASE WHEN ends >= 2 AND s = 1 THEN k ELSE 0 END AS part FROM c)
SELECT book, min(turn) AS block, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE r = 'S') AS source, '' AS gloss, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE r = 'T') AS translation
FROM d GROUP BY book, run, part HAVING bool_or(r = 'S') AND bool_or(r = 'T')""",
        "dictionary_build": f"""WITH {LINES}, h AS (SELECT *, last_value(CASE WHEN size >= 5 THEN ({w("text")})[1] END IGNORE NULLS) OVER (PARTITION BY book ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS headword FROM lines),
p AS (SELECT book, headword, line_no, unnest(string_split(text, ',')) AS s, unnest(range(0, len(string_split(text, ',')))) AS i FROM h WHERE headword IS NOT NULL)
SELECT book, headword, row_number() OVER (PARTITION BY book, headword ORDER BY line_no, i) AS sense_no, {_strip("s")} AS translation FROM p WHERE {_strip("s")} <> ''""",
        "gloss_clean": _gloss_sql(),
        "igt_class": rf"""WITH {LINES}, t AS (SELECT book, line_no, list_filter(regexp_split_to_array(text, '[\s.\-=:/]+'), lambda x: x <> '') AS p, regexp_replace(text, '\[.*?\]', '', 'g') AS bare FROM lines),
u AS (SELECT *, 2 * len(list_filter(p, lambda x: lower(x) IN ({abbreviations}) OR regexp_full_match(lower(x), '[123](sg|pl|du)'))) / greatest(len(p), 1) AS g, regexp_extract_all(lower(bare), '{token}') AS s FROM t),
v AS (SELECT *, len(list_filter(s, lambda x: x IN ({english}))) / greatest(len(s), 1) AS e FROM u)
SELECT book, line_no, CASE WHEN len(p) = 0 THEN 'reject' WHEN g > 0.10 THEN 'IGT' WHEN length(bare) >= 20 AND e >= 0.2 THEN 'English' WHEN length(bare) >= 40 AND e >= 0.15 THEN 'English' ELSE 'unknown' END AS kind FROM v""",
        "distinct_on_text": "WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) SELECT source, count(*) AS n, cast(sum(doc_id) AS bigint) AS ids FROM d WHERE r = 1 GROUP BY source",
        "rule_merge": """WITH j AS (SELECT d.doc_id AS ord, lang, source, quality, toxic, 'n' || (n_chars % 9) AS description, lang || '-n' || (n_chars % 9) AS trig, CASE WHEN n_chars > 500 THEN 'n' || (n_chars % 9) ELSE 'N/A' END AS ctx, n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang AS target_pos, source AS morpheme, quality AS unimorph_feature, toxic AS unimorph_value, source AS category, lang AS application_string,
  array_to_string(list_sort(list_distinct(list(description))), ' | ') AS description, array_to_string(list_sort(list_distinct(list(trig))), ' | ') AS semantic_trigger,
  CASE WHEN count(*) FILTER (WHERE ctx <> 'N/A') = 0 THEN 'N/A' ELSE array_to_string(list_sort(list_distinct(list(ctx) FILTER (WHERE ctx <> 'N/A'))), ' AND ') END AS context_dependency,
  min(ord) AS ord, string_agg(ord || ':' || n_chars, ',' ORDER BY ord) AS refs FROM j GROUP BY lang, source, quality, toxic""",
        "codify_left_join": "SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE source END AS source, coalesce('t' || toxic, '') AS lrl_code FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
        "positional_zip": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM conversations)
SELECT a.conv_id, a.pos, a.turn AS l_turn, a.text AS l_text, b.turn AS r_turn, b.text AS r_text FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.role = 'user' AND b.role = 'assistant'""",
        "paragraph_lookup": f"WITH {LINES} SELECT d.doc_id AS section, d.doc_id % 7 AS index, l.text FROM documents d JOIN lines l ON l.book = d.doc_id AND l.line_no = d.doc_id % 7",
        "semi_sections": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "resume_anti": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "dictionary_lookup": rf"""WITH dict AS (SELECT item_id AS ord, {_strip("split_part(split_part(split_part(text, ',', 1), '/', 1), '(', 1)")} AS tr, unnest(list_distinct(regexp_extract_all(text, '\S+'))) AS word FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord) AS k FROM dict), two AS (SELECT word, string_agg(tr, '; ' ORDER BY ord) AS translations FROM r WHERE k <= 2 GROUP BY word),
t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS t, list_filter(flatten(list_transform(regexp_extract_all(text, '\S+'), lambda x: regexp_split_to_array(x, '[=\-]'))), lambda x: x <> '') AS p FROM documents),
c AS (SELECT doc_id, unnest(list_distinct(list_concat(t, p, list_transform(p, lambda x: '=' || x)))) AS word FROM t),
m AS (SELECT doc_id, word, translations, row_number() OVER (PARTITION BY doc_id ORDER BY word DESC, translations DESC) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM c JOIN two USING (word))
SELECT doc_id, n, word, translations FROM m WHERE k = 1""",
        "item_words": rf"""WITH {ITEM_WORDS}, s AS (SELECT conv_id * 1000 + turn AS id, ' ' || regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || ' ' AS s FROM conversations)
SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, word) AS rank FROM s JOIN words ON contains(s, ' ' || word || ' ')""",
        "pos_predominance": """WITH j AS (SELECT source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits, count(*) FILTER (WHERE quality = 1) / count(*) AS share FROM j GROUP BY source HAVING count(*) FILTER (WHERE quality = 1) / count(*) >= 0.3""",
        "adjacent_cosine": f"""WITH p AS (SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT label, vec_id, {_cosine("a", "b")} AS similarity FROM p WHERE b IS NOT NULL""",
        "rule_topk": f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM scored) SELECT query_id, item_id, sim AS score, rank FROM r WHERE rank <= 3",
        "hybrid_topk": f"""WITH {SCORED}, h AS (SELECT query_id, item_id, round(0.7 * sim + 0.3 * ((CASE WHEN label = query_label THEN 1.0::double ELSE 0 END + CASE WHEN item_id % 2 = query_id % 2 THEN 2.0::double ELSE 0 END) / 4.5), 6) AS score FROM scored WHERE query_id <> item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM h) SELECT * FROM r WHERE rank <= 5""",
        "similar_distinct": f"""WITH {SCORED}, a AS (SELECT query_id, item_id, label, sim AS score, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, item_id) AS k FROM scored WHERE query_id <> item_id),
r AS (SELECT query_id, item_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM a WHERE k = 1) SELECT * FROM r WHERE rank <= 4""",
        "token_chunks": """WITH RECURSIVE d AS (SELECT source, doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
c AS (SELECT source, doc_id, tokens, k, cast(0 AS bigint) AS chunk, tokens AS used FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.doc_id, d.tokens, d.k, CASE WHEN c.used > 0 AND c.used + d.tokens > 5000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.used > 0 AND c.used + d.tokens > 5000 THEN d.tokens ELSE c.used + d.tokens END
  FROM c JOIN d ON d.source = c.source AND d.k = c.k + 1)
SELECT source, doc_id, tokens, chunk FROM c""",
        "modulo_buckets": "WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS index FROM documents) SELECT doc_id, lang, index, cast(b AS bigint) AS bucket FROM d JOIN (VALUES (5), (10), (15), (20)) v(b) ON index % 20 < b",
        "dedup_cap": """WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents), i AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS index, doc_id FROM d WHERE r = 1) SELECT * FROM i WHERE index <= 8000""",
        "fixed_parts": "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 800 AS part FROM documents",
        "quota_backfill": """WITH d AS (SELECT d.doc_id, lang || '/' || source AS g, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS stage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT stage, g, min(doc_id) AS f, row_number() OVER (PARTITION BY g ORDER BY stage) AS k FROM d GROUP BY stage, g HAVING count(*) >= 2),
q AS (SELECT stage, g, row_number() OVER (ORDER BY stage, f, g) AS quota_no FROM s WHERE k = 1),
r AS (SELECT d.stage, d.g, doc_id, quota_no, row_number() OVER (PARTITION BY d.stage, d.g ORDER BY doc_id) AS n FROM d JOIN q ON q.stage = d.stage AND q.g = d.g WHERE quota_no <= 60)
SELECT cast(stage AS bigint) AS stage, g, doc_id, quota_no FROM r WHERE n <= 2""",
        "prompt_jsonl": "SELECT 'conv_' || conv_id || '_' || turn AS key, 'Translate to english from ' || role || ': ' || text AS prompt, 'Translate to english from ' || role || ': ' || text AS sent FROM conversations",
        "parse_outcomes": """WITH c AS (SELECT role, length(text) > 60 AS s, turn > 0 AND text <> '' AS t FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (WHERE NOT s AND NOT t) AS failed, count(*) FILTER (WHERE NOT s AND t) AS no_source, count(*) FILTER (WHERE s AND NOT t) AS no_translation, count(*) FILTER (WHERE s AND t) AS complete FROM c GROUP BY role""",
        "corpus_search_exact": "SELECT doc_id, source, 'text' AS matched_in, 100.0::double AS score FROM documents WHERE contains(lower(text), 'the and') ORDER BY source, doc_id LIMIT 100",
        "corpus_stats": f"""WITH r AS (SELECT lang, len({w("text")}) AS w FROM documents), q AS (SELECT lang, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS q3 FROM r GROUP BY lang)
SELECT r.lang, q1, median, q3, count(*) AS n, cast(min(w) FILTER (WHERE w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS double) AS low, cast(max(w) FILTER (WHERE w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS double) AS high,
  count(*) FILTER (WHERE NOT (w BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers FROM r JOIN q ON q.lang = r.lang GROUP BY r.lang, q1, median, q3""",
        "pos_distribution": """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT source, sum(n) AS t FROM c GROUP BY source ORDER BY t DESC, source LIMIT 7), b AS (SELECT source FROM a WHERE source <> 'UNKNOWN' ORDER BY t DESC, source LIMIT 6),
p AS (SELECT lang, source, n, round(100 * n / sum(n) OVER (PARTITION BY lang), 6) AS percent FROM c) SELECT p.* FROM p JOIN b ON b.source = p.source""",
        "wordcount_filter": f"SELECT doc_id, lang FROM documents WHERE len({w('text')}) BETWEEN 20 AND 200",
        "index_columns": f"WITH {LINES}, {SECTIONS} SELECT book, section, CASE level WHEN 1 THEN '**' || coalesce(heading, '') || '**' WHEN 2 THEN '*' || coalesce(heading, '') || '*' ELSE coalesce(heading, '') END AS line, section % 3 AS col FROM sections",
        "latest_status": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, event_type, CASE WHEN event_type = 'completed' THEN 'download' WHEN event_type IN ('in_progress', 'validating', 'finalizing') THEN 'wait' WHEN event_type IN ('failed', 'expired', 'cancelled') THEN 'retry' ELSE 'submit' END AS step FROM r WHERE k = 1""",
        "corpus_totals": "SELECT source, count(*) AS n FROM documents GROUP BY ROLLUP (source)",
    }
