"""DuckDB SQL for the numbered operators that SQL can express."""

OP4 = r"""
WITH doc_words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
lists AS (SELECT doc_id, list(word ORDER BY i) AS w FROM doc_words GROUP BY doc_id),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM lists, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, s, spots.n AS n, item_id FROM spots JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR), ',') AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(l.w), 0) AS contaminated
FROM documents d LEFT JOIN lists l USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || '<|im_sep|>' || text || '<|im_end|>' || chr(10)) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP10 = r"""
WITH texts AS (SELECT doc_id, source, text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) >= 3)),
often AS (SELECT r, i FROM windows SEMI JOIN (SELECT r, k FROM windows GROUP BY ALL HAVING count(*) > 1) AS twice USING (r, k)),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM often) GROUP BY r),
lines AS (
  SELECT r, coalesce('h' || source, '') AS host, document, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM (SELECT r, source, coalesce(doc_id::VARCHAR, '#' || r) AS document, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
again AS (SELECT r, (count(*) - count(DISTINCT line)) AS n FROM lines GROUP BY r),
frequent AS (SELECT host, k FROM lines GROUP BY ALL HAVING count(DISTINCT document) > 50),
gone AS (SELECT r, sum(n) AS n FROM lines SEMI JOIN frequent USING (host, k) GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
  FROM texts LEFT JOIN again USING (r) LEFT JOIN repeated USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 10 * n_gone > 7 * n_words AS kept
FROM counts
"""

OP3 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN first USING (k) WHERE low < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS rest FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 75 * (p.n + q.n - m)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = d.doc_id
"""

OP8 = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS raw FROM documents),
windows AS (SELECT r, i, md5(raw[i : i + 199]) AS k FROM (SELECT r, raw, unnest(range(1, octet_length(raw) - 198)) AS i FROM texts WHERE octet_length(raw) >= 200)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
marked AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows WHERE k IN (SELECT k FROM again)),
numbered AS (SELECT r, i, sum((before IS NULL OR i > before + 200)::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, run, min(i) AS a, max(i) + 199 AS b FROM numbered GROUP BY r, run),
lists AS (SELECT r, list({'a': a, 'b': b} ORDER BY a) AS x, sum(b - a + 1) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n IS NULL THEN raw ELSE list_reduce(list_transform(range(0, len(x) + 1), lambda j: raw[CASE WHEN j = 0 THEN 1 ELSE x[j].b + 1 END : CASE WHEN j = len(x) THEN octet_length(raw) ELSE x[j + 1].a - 1 END]), lambda p, q: p || q) END) AS kept_sha256
FROM texts LEFT JOIN lists USING (r)
"""

OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
low AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails
  FROM texts JOIN low USING (t) LEFT JOIN marks USING (doc_id)
),
counted AS (SELECT part, fails, good, toxic, count(*) AS n FROM masked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: instr(filter_order, x)) AS place FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS f,
    list_bool_or(list_transform(range(1, 6), lambda i: fails[i] AND place[i] < step)) AS gone,
    fails[list_position(place, step)] AS failed, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM counted, steps
),
made AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (WHERE NOT gone AND NOT failed) AS kept, sum(n) FILTER (WHERE NOT gone AND failed) AS removed, sum(n) FILTER (WHERE gone AND failed) AS redundant,
    sum(n) FILTER (WHERE failed AND n_fails = 1) AS unique_fails, sum(n) FILTER (WHERE NOT gone AND failed AND good) AS good_lost, sum(n) FILTER (WHERE NOT gone AND failed AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM made
"""

OP12 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS said,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(said || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256(said || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS changed
  FROM texts
), ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, level, idx, n, digest) AS (
  SELECT tree, 0, rank, n, leaf FROM ranked
  UNION ALL SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n
),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, idx, n, digest) AS (
  SELECT 0, rank, n, digest FROM subroots
  UNION ALL SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16, n
),
sides AS (
  SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS "left", coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS "right"
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, idx // 16 ORDER BY idx)
), top_sides AS (
  SELECT level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS "left", coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS "right"
  FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)
),
upper AS (SELECT tree, any_value(s.digest) AS subroot, list({'left': "left", 'cur': '', 'right': "right"} ORDER BY level) FILTER (WHERE level IS NOT NULL) AS above FROM subroots s LEFT JOIN top_sides t ON t.idx = s.rank // (16 ** t.level)::BIGINT GROUP BY tree),
lower AS (SELECT r.tree, r.rank, list({'left': "left", 'cur': '', 'right': "right"} ORDER BY level) FILTER (WHERE level IS NOT NULL) AS above FROM ranked r LEFT JOIN sides s ON s.tree = r.tree AND s.idx = r.rank // (16 ** s.level)::BIGINT GROUP BY r.tree, r.rank),
paths AS (SELECT r.*, subroot, coalesce(l.above, []) || coalesce(u.above, []) AS above FROM ranked r JOIN lower l USING (tree, rank) JOIN upper u USING (tree)),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(array_to_string(list_transform(above, lambda x: x['left'] || x['right']), '')) AS proof_sha256,
    list_reduce(above, lambda x, y: {'left': '', 'cur': sha256(y['left'] || x['cur'] || y['right']), 'right': ''}, {'left': '', 'cur': coalesce(changed, leaf), 'right': ''})['cur'] AS folded_root
  FROM paths
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLES: dict[str, str] = {"op2_chat_format": OP2, "op3_substring_dedup": OP3, "op4_decontaminate": OP4, "op5_near_duplicates": OP5, "op8_suffix_dedup": OP8, "op10_line_rules": OP10, "op11_filter_audit": OP11, "op12_merkle_manifest": OP12}
