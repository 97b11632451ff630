"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KEY = ASCII_LOWER.format(f"trim(line, {BLANK})")

def op1(min_docs: int, max_percent: int, min_kept_percent: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, source, line, {KEY} AS k FROM l),
f AS (SELECT source, k, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM k WHERE k <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS n_host FROM documents GROUP BY source),
gone AS (SELECT f.source, k, first FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > {min_docs} AND n * 100 > n_host * {max_percent}),
per AS (
  SELECT k.doc_id, CAST(sum(length(k.k)) AS BIGINT) AS line_chars,
         CAST(coalesce(sum(length(k.k)) FILTER (g.k IS NOT NULL AND k.doc_id <> g.first), 0) AS BIGINT) AS removed_chars
  FROM k LEFT JOIN gone g ON k.source IS NOT DISTINCT FROM g.source AND k.k = g.k GROUP BY k.doc_id),
dup AS (SELECT doc_id, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM k WHERE k <> '' GROUP BY ALL) GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win), range(8) t(j) WHERE c > 1 GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, line_chars, removed_chars
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) JOIN per USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (line_chars - removed_chars) * 100 < line_chars * {min_kept_percent} AS depleted FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, line_chars, removed_chars, depleted FROM v
"""

OP4 = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT doc_id, i, line, {KEY} AS k FROM l),
gone AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone g ON k.k = g.k GROUP BY doc_id
"""

TOKENS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(ASCII_LOWER.format("coalesce(text, '')"))

OP10 = f"""
WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents),
i AS (SELECT item_id, {TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS x, least(len(w), 8) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
v AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
m AS (SELECT doc_id, item_id, k, v.n FROM v JOIN p ON v.x = p.x AND v.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

CONTROL = r"(\||/s>|s>|/?INST\])"
OP8 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g') AS body, replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>' || r || '<|body|>' || body || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars,
       CAST(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{N}}|[^\s\p{{L}}\p{{M}}\p{{N}}]'))) AS BIGINT) AS n_words
FROM e GROUP BY conv_id
"""

ESCAPED = r"regexp_replace({}, '([<\[])(\\*)" + CONTROL + r"', '\1\\\2\3', 'g')"
WORDS_AND_MARKS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{M}}]+|\p{{N}}|[^\s\p{{L}}\p{{M}}\p{{N}}]'))"
CHAT_PARTS = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn % 2 = 0 AS many FROM conversations),
o AS (SELECT *, row_number() OVER w AS pos, 3 * (sum(CASE WHEN many THEN 1 ELSE 0 END) OVER w - 1) AS k FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, lpad(CAST(k + 1 AS VARCHAR), 10, '0') AS k1, lpad(CAST(k + 2 AS VARCHAR), 10, '0') AS k2, lpad(CAST(k + 3 AS VARCHAR), 10, '0') AS k3,
        CAST(ceil(100 * (turn + 1) / 336.0) * ceil(500 / 336.0) * 144 AS BIGINT) AS t1, CAST(ceil(turn * 1.5 * 25) AS BIGINT) AS t2, CAST(greatest(turn, 1) * 600 AS BIGINT) AS t3,
        {ESCAPED.format("text")} AS body, {ESCAPED.format("role")} AS rbody, replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') AS r FROM o),
f AS (SELECT *, '<|turn|>' || r || '<|body|>' || CASE WHEN many THEN '<|text|>' || body || '<|image:' || k1 || '|><|text|>' || rbody || '<|audio:' || k2 || '|><|document:' || k3 || '|>' ELSE body END || '<|end|>' || chr(10) AS out,
        CASE WHEN many THEN concat_ws(',', concat_ws(':', k + 1, 'image', 'i' || turn, t1), concat_ws(':', k + 2, 'audio', 'a' || turn, t2), concat_ws(':', k + 3, 'document', 'd' || turn, t3)) END AS refs,
        CASE WHEN many THEN 'text=' || text || chr(10) || 'image=' || (k + 1) || ':i' || turn || chr(10) || 'text=' || role || chr(10) || 'audio=' || (k + 2) || ':a' || turn || chr(10) || 'document=' || (k + 3) || ':d' || turn || chr(10)
             ELSE 'text=' || text || chr(10) END AS parts FROM a)
SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN many THEN 3 ELSE 0 END) AS BIGINT) AS n_attachments, CAST(sum(CASE WHEN many THEN t1 + t2 + t3 ELSE 0 END) AS BIGINT) AS expanded_tokens,
       CAST(sum({WORDS_AND_MARKS.format("text")} + CASE WHEN many THEN {WORDS_AND_MARKS.format("role")} ELSE 0 END) AS BIGINT) AS n_words,
       CAST(length(string_agg(out, '' ORDER BY pos)) AS BIGINT) AS formatted_chars, sha256(string_agg(out, '' ORDER BY pos)) AS formatted_sha256,
       sha256(coalesce(string_agg(refs, ',' ORDER BY pos), '')) AS refs_sha256, sha256(string_agg(parts, '' ORDER BY pos)) AS parts_sha256,
       sha256(coalesce(string_agg(text || CASE WHEN many THEN role ELSE '' END, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM f GROUP BY conv_id
"""

SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(ASCII_LOWER.format("coalesce(text, '')"))
OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPLIT} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p, q FROM c JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
r(doc_id, other) AS (SELECT p, q FROM u UNION SELECT r.doc_id, u.q FROM r JOIN u ON r.other = u.p),
l AS (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

FLAT = "concat_ws('/', source, lang, CAST(doc_id AS VARCHAR))"
NESTED = "concat_ws('/', source, CASE WHEN h[1] < '2' THEN 'LICENSE.' || doc_id WHEN h[1] < '6' THEN h[2] || '/COPYING.' || doc_id ELSE h[2] || '/' || h[3] || '/' || doc_id END)"


def op6(path: str) -> str:
    from .license_scans import CUE, NAMES, TEMPLATES, WORD

    values = ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(TEMPLATES))
    low = ASCII_LOWER.format
    return rf"""
WITH t(number, license, text) AS (VALUES {values}),
tw AS (SELECT number, license, unnest(regexp_extract_all({low("text")}, '{WORD}')) AS word FROM t),
ttf AS (SELECT number, license, word, count(*) AS tf FROM tw GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM ttf GROUP BY word),
w AS (SELECT number, license, word, tf * CAST(floor(ln((SELECT count(*) + 1 FROM t) / CAST(df AS DOUBLE)) * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS weight, df FROM ttf JOIN df USING (word)),
nt AS (SELECT number, sum(weight * weight) AS norm2 FROM w GROUP BY number),
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches({low("x")}, '{CUE}')) AS ls, length(coalesce(text, '')) AS n_text,
        {path} AS path FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)),
r AS (SELECT doc_id, path, n_text, coalesce(array_to_string(ls, chr(10)), '') AS notice FROM l),
dw AS (SELECT doc_id, unnest(regexp_extract_all({low("notice")}, '{WORD}')) AS word FROM r),
dtf AS (SELECT doc_id, word, count(*) AS tf FROM dw GROUP BY ALL),
d AS (SELECT doc_id, word, tf * CAST(floor(ln((SELECT count(*) + 1 FROM t) / CAST(coalesce(df, 1) AS DOUBLE)) * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS dwt FROM dtf LEFT JOIN df USING (word)),
nd AS (SELECT doc_id, sum(dwt * dwt) AS n2 FROM d GROUP BY doc_id),
dot AS (SELECT doc_id, number, license, sum(dwt * weight) AS dot FROM d JOIN w USING (word) GROUP BY ALL),
sc AS (SELECT doc_id, license, CAST(floor(CAST(dot AS DOUBLE) * 100.0 / sqrt(CAST(n2 AS DOUBLE) * CAST(norm2 AS DOUBLE)) + CAST(1e-6 AS DOUBLE)) AS BIGINT) AS score FROM dot JOIN nd USING (doc_id) JOIN nt USING (number)),
b AS (SELECT doc_id, license, score FROM sc WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
o AS (SELECT r.doc_id, path, license, score, regexp_replace(path, '/?[^/]*$', '') AS dir,
        license IS NOT NULL AND (regexp_matches(regexp_extract(path, '[^/]*$'), '{NAMES}') OR length(notice) * 100 >= n_text * 50) AS is_file FROM r LEFT JOIN b USING (doc_id)),
h AS (SELECT dir AS above, min(struct_pack(path := path, license := license)) AS head FROM o WHERE is_file GROUP BY dir),
i AS (SELECT dir, arg_max(head, length(above)) AS head FROM (SELECT DISTINCT dir FROM o) f JOIN h ON above = '' OR dir = above OR starts_with(dir, above || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(license, head.license) AS license, score,
       CASE WHEN is_file THEN 'file' WHEN license IS NOT NULL THEN 'own' WHEN head IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NOT NULL THEN path ELSE head.path END AS license_path
FROM o LEFT JOIN i USING (dir)
"""


ORACLES: dict[str, str] = {"op1_quality_rules": op1(20, 1, 20), "op4_line_dedup": OP4, "op6_license_scans": op6(FLAT), "license_directories": op6(NESTED), "op7_warc": OP7, "op8_chat_formatting": OP8, "op9_ngram_jaccard_join": OP9, "op10_decontamination": OP10, "chat_typed_parts": CHAT_PARTS, "quality_rules_tight": op1(2, 0, 90)}
