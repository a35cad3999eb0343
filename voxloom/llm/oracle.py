"""SQL that gives the same rows as the queries, where SQL can express them on whole tables."""

from __future__ import annotations


def _once(name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at) AS rn FROM {name}) WHERE rn = 1)"


def _vectors(name: str, key: str, vec: str) -> str:
    return f"""v AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS u FROM (SELECT {key} AS id, CAST({vec} AS DOUBLE[]) AS x FROM {_once(name, key)} WHERE {vec} IS NOT NULL)
  WHERE len(x) = 64 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND list_dot_product(x, x) > 0)"""


STAMPS = r"(\[\d{1,3}:\d{2}(:\d{2})?([.,]\d+)?\]|\(\d{1,3}:\d{2}(:\d{2})?([.,]\d+)?\)|<\d+([.,]\d+)?\s*s>|\d{1,3}:\d{2}:\d{2}([.,]\d+)?\s*(-->|-(\s|$))|\d{1,3}:\d{2}:\d{2}[.,]\d+)"
WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
TAG = rf"^\s*(\[\s*((speaker|guest|spk|s)[\s_-]*(\d+|{WORDS}))\s*\]|<\s*((speaker|guest|spk|s)[\s_-]*\d+)\s*>|(>>\s*)?((speaker|guest|spk|s)[\s_-]*(\d+|{WORDS}))\s*(:|-(\s|$)))"
SOUNDS = r"\[[^\[\]]*\]|\(\([^()]*\)\)|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|\*[^*]*\*|[♪♫]"
FILLERS = "u+h+|u+h*m+|e+h+|e+r+m*|e+m+|h+m+|m{2,}|a+h+|ä+h*m*|ö+h+"
NUMBERS = "[" + ", ".join(f"'{w}'" for w in WORDS.split("|")) + "]"

_RUNS = f"""
WITH m AS (
  SELECT merged_id, rec_id, cluster_labels AS label, CAST(round(start_times * 1000) AS BIGINT) AS s, CASE WHEN NOT isnan(end_times) THEN CAST(round(end_times * 1000) AS BIGINT) END AS e
  FROM {_once("merged_samples", "merged_id")} WHERE rec_id IS NOT NULL AND cluster_labels IS NOT NULL AND cluster_labels <> -1 AND start_times IS NOT NULL AND NOT isnan(start_times)),
change AS (
  SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY rec_id ORDER BY s, merged_id) THEN 0 ELSE 1 END AS c FROM m),
stretch AS (
  SELECT *, sum(c) OVER (PARTITION BY rec_id ORDER BY s, merged_id) AS k FROM change),
reach AS (
  SELECT *, max(greatest(s, coalesce(e, s))) OVER (PARTITION BY rec_id, k ORDER BY s, merged_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM stretch),
run AS (
  SELECT *, sum(CASE WHEN s - latest <= 1500 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, k ORDER BY s, merged_id) AS r FROM reach)"""

_TURNS = f"""
WITH a AS (
  SELECT az_id, rec_id, CAST(round(start_time * 1000) AS BIGINT) AS s, regexp_replace(transcript, '{STAMPS}', ' ', 'g') AS bare, lower(trim(speaker_id, ' ' || chr(9))) AS field
  FROM {_once("azure_diarization", "az_id")} WHERE rec_id IS NOT NULL AND start_time IS NOT NULL AND NOT isnan(start_time) AND end_time IS NOT NULL AND NOT isnan(end_time) AND transcript IS NOT NULL),
t AS (
  SELECT *, coalesce(nullif(field, ''), lower(concat(regexp_extract(bare, '(?i){TAG}', 2), regexp_extract(bare, '(?i){TAG}', 5), regexp_extract(bare, '(?i){TAG}', 8)))) AS label,
    regexp_extract_all(regexp_replace(regexp_replace(bare, '(?i){TAG}', ' '), '{SOUNDS}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS words FROM a),
u AS (
  SELECT *, CASE WHEN regexp_matches(label, '\\d+\\s*$') THEN CAST(regexp_extract(label, '(\\d+)\\s*$', 1) AS BIGINT)
    ELSE CAST(nullif(list_position({NUMBERS}, regexp_extract(label, '({WORDS})$', 1)), 0) AS BIGINT) END AS no
  FROM t WHERE len(list_filter(words, lambda w: NOT regexp_full_match(lower(w), '{FILLERS}'))) > 0),
c AS (SELECT *, CASE WHEN no = lag(no) OVER (PARTITION BY rec_id ORDER BY s, az_id) THEN 0 ELSE 1 END AS ch FROM u WHERE no IS NOT NULL),
r AS (SELECT *, sum(ch) OVER (PARTITION BY rec_id ORDER BY s, az_id) AS turn FROM c)"""

SQL: dict[str, str] = {
    "p3_found": f"""
WITH e AS (
  SELECT edit_id, rec_id, CAST(round(starttime * 1000) AS BIGINT) AS x FROM {_once("human_edits", "edit_id")} WHERE starttime IS NOT NULL AND NOT isnan(starttime)),
a AS (
  SELECT az_id, rec_id, CAST(round(start_time * 1000) AS BIGINT) AS s FROM {_once("azure_diarization", "az_id")}
  WHERE start_time IS NOT NULL AND NOT isnan(start_time) AND end_time IS NOT NULL AND NOT isnan(end_time)),
near AS (
  SELECT e.edit_id, a.az_id, row_number() OVER (PARTITION BY e.edit_id ORDER BY abs(a.s - e.x), a.s, a.az_id) AS rn
  FROM e JOIN a ON e.rec_id = a.rec_id AND a.s BETWEEN e.x - 400 AND e.x + 400)
SELECT edit_id, az_id FROM near WHERE rn = 1""",
    "p4_found": f"""
WITH {_vectors("recalculated_features", "merged_id", "dvectors")}, p AS (
  SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p)
SELECT DISTINCT least(a, b) AS merged_id_a, greatest(a, b) AS merged_id_b FROM k WHERE r <= 3 AND c >= 0.95""",
    "p4_samples": f"""
WITH {_vectors("samples", "sample_id", "enhanced_features")}, p AS (
  SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM v a JOIN v b ON a.id <> b.id AND a.id % 100 = 0),
k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p)
SELECT a AS sample_id, CAST(r AS INTEGER) AS rank, b AS neighbour_id, round(c, 4) AS sim FROM k WHERE r <= 3""",
    "p4_neighbours": f"""
WITH {_vectors("recalculated_features", "merged_id", "dvectors")}, p AS (
  SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM v a JOIN v b ON a.id <> b.id AND a.id % 100 = 0),
k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p)
SELECT a AS merged_id, CAST(r AS INTEGER) AS rank, b AS neighbour_id FROM k WHERE r <= 3""",
    "p4_narrow": f"""
WITH {_vectors("recalculated_features", "merged_id", "dvectors")}, p AS (
  SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM p)
SELECT DISTINCT least(a, b) AS merged_id_a, greatest(a, b) AS merged_id_b FROM k WHERE r <= 3 AND c >= 0.95""",
    "p5_found": f"""
WITH {_vectors("samples", "sample_id", "enhanced_features")}, p AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON list_dot_product(a.u, b.u) >= 0.72 OR a.id = b.id),
n AS (SELECT a, min(b) AS m, count(*) AS deg FROM p GROUP BY a),
s AS (SELECT p.a, any_value(x.m) AS m, any_value(x.deg) AS deg, bool_and(x.m = y.m AND x.deg = y.deg) AS same FROM p JOIN n x ON p.a = x.a JOIN n y ON p.b = y.a GROUP BY p.a),
g AS (SELECT m FROM s GROUP BY m HAVING bool_and(same) AND count(*) = any_value(deg) AND count(*) >= 5)
SELECT m AS first_sample_id, a AS sample_id FROM s SEMI JOIN g USING (m) WHERE a <> m""",
    "p6_found": _TURNS + """
SELECT rec_id, any_value(no) AS speaker_no, arg_min(az_id, struct_pack(s := s, i := az_id)) AS first_az_id, arg_max(az_id, struct_pack(s := s, i := az_id)) AS last_az_id FROM r GROUP BY rec_id, turn""",
    "p6_speakers": _TURNS + """
SELECT rec_id, az_id, no AS speaker_no, CAST(turn AS BIGINT) AS turn_no FROM r""",
    "p2_check": f"""WITH {_vectors("samples", "sample_id", "enhanced_features")} SELECT least(256, count(*)) AS n, least(256, count(*)) AS n_different, true AS falling, true AS all_valid FROM v""",
    "p9_check": """SELECT DISTINCT lower(replace(trim(source), '-', '_')) AS source, true AS in_budget, true AS used_up, true AS repeats_kept FROM source_targets WHERE source IS NOT NULL""",
    "p10_emails": r"""SELECT DISTINCT doc_id, pii_text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}](?:[\p{L}\p{N}_.+-]*[\p{L}\p{N}])?@[\p{L}\p{N}](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}])?\.[\p{L}]{2,}')) AS pii_text FROM documents)""",
    "p7_found": _RUNS + """
SELECT rec_id, CAST(max(label) AS BIGINT) AS cluster_label, arg_min(merged_id, s) AS first_merged_id, arg_max(merged_id, s) AS last_merged_id
FROM run GROUP BY rec_id, k, r HAVING count(*) >= 2""",
    "p7_runs": _RUNS + """
SELECT rec_id, CAST(max(label) AS BIGINT) AS label, arg_min(merged_id, s) AS first_id, arg_max(merged_id, s) AS last_id, count(*) AS n_events, min(s) AS start_ms,
  max(greatest(s, coalesce(e, s))) AS end_ms, max(greatest(s, coalesce(e, s))) - min(s) AS duration_ms
FROM run GROUP BY rec_id, k, r""",
    "p8_found": """
WITH i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
gi AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
gd AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT DISTINCT item_id, doc_id FROM gi JOIN gd USING (g)""",
    "p8_leaks": """
WITH i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
gi AS (SELECT item_id, k, len(w) - 12 AS runs, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
gd AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
h AS (SELECT item_id, doc_id, k, runs, k - row_number() OVER (PARTITION BY item_id, doc_id ORDER BY k) AS island FROM gi JOIN gd USING (g)),
s AS (SELECT item_id, doc_id, max(runs) AS runs, island, count(*) AS n FROM h GROUP BY item_id, doc_id, island)
SELECT item_id, doc_id, CAST(sum(n) AS INTEGER) AS shared_runs, sum(n) / CAST(max(runs) AS DOUBLE) AS item_share, CAST(max(n) + 12 AS INTEGER) AS longest_words FROM s GROUP BY item_id, doc_id""",
}
