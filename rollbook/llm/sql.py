"""DuckDB SQL for operators that SQL can express on whole tables, straight from their definitions."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"'[^\x20\x09-\x0D]+'"

#: The rules' counts by regular expressions and windows of words, and the documents of each host's lines.
LINE_QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, {WORDS}) AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(8)) AS r(k) GROUP BY 1),
raws AS (SELECT doc_id, source, text, parts[n] AS line, n FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM d), unnest(range(1, len(parts) + 1)) AS r(n)),
lines AS (SELECT *, len(regexp_extract_all(line, {WORDS})) AS words,
                 array_to_string(regexp_extract_all(translate(line, '{UPPER}123456789', '{LOWER}000000000'), {WORDS}), ' ') AS norm FROM raws),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY 1),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY 1),
often AS (SELECT l.source, norm FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE words > 0
          GROUP BY l.source, norm, docs HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) * 100 > docs * 2 OR count(DISTINCT doc_id) > 5000)),
taken AS (SELECT doc_id, sum(words) AS n FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm WHERE words > 0 GROUP BY 1),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(taken.n, 0) AS BIGINT) AS frequent_words
      FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN taken USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - frequent_words) >= 30 * n_words AS kept
FROM s
"""

REACH = """reach AS (
  SELECT id, id AS other FROM nodes
  UNION SELECT reach.id, b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) ON a = reach.other)"""

#: All pairs of vectors; the test table has 500 of them.
EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
nodes AS (SELECT id FROM v),
links AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
{REACH},
degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY 1)
SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = id AS kept
FROM reach LEFT JOIN degree USING (id) GROUP BY id
"""

#: All pairs of documents that share a shingle, by counting the shingles that they share.
SETSKETCH = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
shingles AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT w.id, count(s) AS n FROM w LEFT JOIN shingles USING (id) GROUP BY 1),
nodes AS (SELECT id FROM w),
links AS (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY ALL)
          JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
{REACH}
SELECT id AS doc_id, any_value(n) AS n_shingles, min(other) AS component_id, min(other) = id AS kept FROM reach JOIN sizes USING (id) GROUP BY id
"""

#: Every window of 20 words, and whether it starts earlier too.
REPEATED_PHRASES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM w, unnest(range(1, len(w) - 18)) AS r(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM later, unnest(range(20)) AS r(k)),
words AS (SELECT doc_id, j, w[j] AS word FROM w, unnest(range(1, len(w) + 1)) AS r(j)),
left_ AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS kept, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j WHERE gone.j IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)
"""

#: Every string of 400 bytes, by its digest, and whether it starts elsewhere too; then runs of what such strings cover.
REPEATED_BYTES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
windows AS (SELECT doc_id, i, md5(raw[i:i + 399]) AS win FROM d, unnest(range(1, octet_length(raw) - 398)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS new FROM twice),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
stays AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS b FROM runs
          UNION ALL SELECT doc_id, coalesce(max(b), 1), max(octet_length(raw)) + 1 FROM d LEFT JOIN runs USING (doc_id) GROUP BY 1),
left_ AS (SELECT doc_id, sha256(unhex(string_agg(hex(raw[s.a:s.b - 1]), '' ORDER BY s.a))) AS kept_sha256 FROM stays s JOIN d USING (doc_id) WHERE s.b > s.a GROUP BY 1),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
                  max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM q
"""

#: Mail made of the conversations as the query makes it; then levels, passages and lines, their writers, and chains of replies.
QUOTES = r"""
WITH RECURSIVE one AS (SELECT conv_id, turn + 1 AS turn, max(text) AS t1 FROM conversations GROUP BY ALL),
two AS (SELECT conv_id, turn + 2 AS turn, max(text) AS t2 FROM conversations GROUP BY ALL),
mail AS (
  SELECT conv_id, turn, role,
         CASE turn % 6 WHEN 0 THEN coalesce('> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10), '')
                       WHEN 1 THEN coalesce('> ' || replace(t1, chr(10), ' ') || chr(10), '')
                       WHEN 2 THEN coalesce('>> ' || replace(t2, chr(10), chr(10) || '>> ') || chr(10), '') || coalesce('> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10), '')
                       WHEN 3 THEN coalesce('> ' || split_part(t1, chr(10), 1) || chr(10), '')
                       WHEN 4 THEN coalesce('> > ' || replace(t2, chr(10), chr(10) || '> > ') || chr(10), '') || coalesce('> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10), '')
                       ELSE '' END || text AS text
  FROM conversations LEFT JOIN one USING (conv_id, turn) LEFT JOIN two USING (conv_id, turn)),
raws AS (SELECT conv_id, turn, parts[n] AS raw, n
         FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS parts FROM mail), unnest(range(1, len(parts) + 1)) AS r(n)),
lines AS (
  SELECT conv_id, turn, n, raw, length(regexp_replace(mark, '[^>]', '', 'g')) AS level,
         regexp_replace(substr(raw, length(mark) + 1), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT *, regexp_extract(raw, '^([ \t]*>)+') AS mark FROM raws)),
placed AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY conv_id, turn ORDER BY n) AS p, lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM (SELECT *, coalesce(lag(level) OVER w <> level OR line = '' OR lag(line) OVER w = '', true) AS new FROM lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY n))),
passages AS (SELECT conv_id, turn, p, level, string_agg(h, ' ' ORDER BY n) AS h, count(*) AS lines FROM placed WHERE line <> '' GROUP BY ALL),
found AS (
  SELECT q.conv_id, q.turn, q.p, q.level, q.lines, max(w.turn) AS writer
  FROM passages q JOIN passages w ON w.conv_id = q.conv_id AND w.h = q.h AND w.level = 0 AND w.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
long_lines AS (SELECT * FROM placed WHERE len(string_split(h, ' ')) >= 4),
found_lines AS (
  SELECT q.conv_id, q.turn, q.n, q.level, max(w.turn) AS writer
  FROM long_lines q JOIN long_lines w ON w.conv_id = q.conv_id AND w.h = q.h AND w.level = 0 AND w.turn < q.turn
  WHERE q.level > 0 AND NOT EXISTS (FROM found f WHERE f.conv_id = q.conv_id AND f.turn = q.turn AND f.p = q.p) GROUP BY ALL),
votes AS (
  SELECT conv_id, turn, level, writer, sum(lines) AS votes
  FROM (SELECT conv_id, turn, level, writer, lines FROM found UNION ALL SELECT conv_id, turn, level, writer, 1 FROM found_lines) GROUP BY ALL),
best AS (
  SELECT conv_id, turn, writer AS reply_to, all_votes FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, writer DESC) AS rn,
           sum(votes) OVER (PARTITION BY conv_id, turn) AS all_votes FROM votes) WHERE rn = 1),
chain AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM best
  UNION ALL SELECT c.conv_id, c.turn, b.reply_to, c.depth + 1 FROM chain c JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.root),
ends AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(root, depth) AS root FROM chain GROUP BY ALL),
kept AS (
  SELECT conv_id, turn, string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE level = 0) AS text,
         count(*) FILTER (WHERE level > 0 AND line <> '') AS quoted FROM lines GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
       regexp_replace(rtrim(coalesce(k.text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^[\x20\x09-\x0D]*\n', '') AS text,
       CAST(k.quoted AS BIGINT) AS n_quoted_lines, CAST(coalesce(b.all_votes, 0) AS BIGINT) AS n_linked_lines, b.reply_to,
       CAST(coalesce(e.depth, 0) AS BIGINT) AS depth, coalesce(e.root, m.turn) AS root
FROM mail m JOIN kept k USING (conv_id, turn) LEFT JOIN best b USING (conv_id, turn) LEFT JOIN ends e USING (conv_id, turn)
"""

#: Every document's failures, and each of its steps in every order of the filters.
FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {WORDS}) AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
           JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, filter_order[1:s - 1] AS earlier FROM orders, range(1, 6) AS r(s)),
outcomes AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fails, fails = f AS alone, earlier <> '' AND len(translate(fails, earlier, '')) < len(fails) AS gone FROM counts, steps),
told AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost FROM outcomes GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told
"""

VALUES = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
#: The checksum of a decimal id, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: All levels of both kinds of trees, then each leaf's walk to the root.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC32} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS said FROM documents),
leaves AS (SELECT doc_id, lang, sha256({VALUES.replace("{n_chars}", "n_chars")}) AS leaf, sha256({VALUES.replace("{n_chars}", "said")}) AS claimed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, lvl AS height FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS (SELECT h AS root, lvl AS top FROM tops WHERE n = 1),
places AS (SELECT doc_id, leaf, claimed, subroot, root, l.lang, l.pos, s.pos AS of_lang, height, top FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang, root),
steps AS (SELECT doc_id, pos, places.lang, lvl, pos >> lvl AS own, height + top AS total FROM places, range(0, height) AS r(lvl)),
walk AS (SELECT s.doc_id, s.pos, s.lang, s.lvl, own, h FROM steps s LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM s.lang AND n.lvl = s.lvl AND n.pos = xor(own, 1)
  UNION ALL SELECT doc_id, p.pos, lang, height + r.lvl, of_lang >> r.lvl, h FROM places p CROSS JOIN range(0, top) AS r(lvl) LEFT JOIN tops t ON t.lvl = r.lvl AND t.pos = xor(of_lang >> r.lvl, 1)),
proofs AS (SELECT doc_id, pos, lang, list(struct_pack(odd := own & 1 = 1, h := h) ORDER BY lvl) AS path FROM walk GROUP BY ALL),
folded AS (SELECT p.*, path, list_reduce(list_concat([struct_pack(odd := false, h := claimed)], coalesce(path, [])), lambda x, s: struct_pack(odd := false, h := sha256(
    CASE WHEN s.h IS NULL THEN x.h WHEN s.odd THEN s.h || x.h ELSE x.h || s.h END))).h AS folded_root
  FROM places p LEFT JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.pos = p.pos AND q.lang IS NOT DISTINCT FROM p.lang)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.h), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
