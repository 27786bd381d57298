"""SQL for DuckDB with the rows of those text operators that SQL can express on small tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 4) - 1], ' ') AS shingle FROM words, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least_ ON doc_id = a LEFT JOIN sizes USING (doc_id)
"""

DECONTAMINATE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0),
have AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM words, (SELECT DISTINCT n FROM wanted), unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
hits AS (SELECT doc_id, k, n, item_id FROM have JOIN wanted USING (n, g)),
covered AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hits), unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

REPEATS = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, h[2 * p - 1 : 2 * p + 198] AS s FROM bytes, unnest(range(1, len(h) // 2 - 98)) AS t(p)),
later AS (SELECT doc_id, p FROM windows QUALIFY ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT *, p > COALESCE(LAG(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 100 AS head FROM later),
numbered AS (SELECT *, SUM(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, MIN(p) AS a, MAX(p) + 99 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS low, a - 1 AS high FROM runs UNION ALL SELECT doc_id, 2 * MAX(b), MAX(b) + 1, 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN high >= low THEN h[2 * low - 1 : 2 * high] ELSE '' END, '' ORDER BY a) AS h FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, SUM(b - a + 1) AS n_removed, COUNT(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

MIXTURE = r"""
WITH RECURSIVE quality AS (SELECT doc_id AS q_id, AVG(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, COALESCE(w, 1.0) AS weight FROM documents LEFT JOIN quality ON doc_id = q_id),
copies AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, source, size) AS n FROM sized),
keyed AS (SELECT *, -ln((CAST('0x' || md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || n)[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS k FROM copies),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS share FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS k, CAST(SUM(source_size) AS HUGEINT) AS rest, CAST(SUM(share) AS HUGEINT) AS weights, CAST(-1 AS HUGEINT) AS n FROM sources
  UNION ALL
  SELECT k + 1, total - taken, every - gone, found FROM (
    SELECT r.k, r.n, CAST(SUM(source_size) AS HUGEINT) AS total, CAST(SUM(share) AS HUGEINT) AS every, CAST(COALESCE(SUM(3 * source_size) FILTER (rest * share > 3 * source_size * weights), 0) AS HUGEINT) AS taken,
      CAST(COALESCE(SUM(share) FILTER (rest * share > 3 * source_size * weights), 0) AS HUGEINT) AS gone, CAST(COUNT(*) FILTER (rest * share > 3 * source_size * weights) AS HUGEINT) AS found FROM rounds r, sources GROUP BY r.k, r.n, r.rest, r.weights) WHERE found > n),
last AS (SELECT rest, weights FROM rounds ORDER BY k DESC LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN rest * share > 3 * source_size * weights THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest AS DOUBLE) * CAST(share AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM sources, last),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
summed AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY k, doc_id, n, size ROWS UNBOUNDED PRECEDING) - size AS before FROM keyed)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM summed JOIN plan ON summed.source IS NOT DISTINCT FROM plan.source
"""

# `crc` is the table of CRC-32 by byte; each round of `best` puts one row of every conversation behind the cheapest ways to the four states.
CONVERSATIONS = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
named AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
sums AS (SELECT name, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM (SELECT DISTINCT name FROM named), crc),
rows_ AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM named JOIN sums USING (name), range(CASE how WHEN 3 THEN 2 ELSE 1 END) WHERE how <> 0),
ids AS (SELECT conv_id, ROW_NUMBER() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, ROW_NUMBER() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_ JOIN ids ON rows_.conv_id IS NOT DISTINCT FROM ids.conv_id),
seen AS (SELECT *, role[1] AS initial, LAG(role[1]) OVER (PARTITION BY c ORDER BY i) AS last, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, ROW_NUMBER() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM placed),
turns AS (SELECT *, blank OR again AS must, CAST(cut AS INT) AS extra FROM seen),
faults AS (SELECT c, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank, COUNT(*) FILTER (again AND NOT blank) AS duplicate, COUNT(*) FILTER (cut AND NOT must) AS truncated,
  COUNT(*) FILTER (i > 1 AND COALESCE(last, '') || COALESCE(initial, '') NOT IN ('su', 'ua', 'au')) AS illegal, MAX(i) AS n FROM turns GROUP BY c),
runs(p, k, q, lines) AS (VALUES ('E', 0, 'E', []), ('S', 0, 'S', []), ('U', 0, 'U', []), ('A', 0, 'A', []), ('E', 1, 'U', ['user:']), ('S', 1, 'U', ['user:']), ('U', 1, 'A', ['assistant:']), ('A', 1, 'U', ['user:']),
  ('E', 2, 'A', ['user:', 'assistant:']), ('S', 2, 'A', ['user:', 'assistant:']), ('U', 2, 'U', ['assistant:', 'user:']), ('A', 2, 'A', ['user:', 'assistant:'])),
best AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 'E' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM ids
  UNION ALL
  SELECT c, i, state, cost, audit, lines FROM (
    SELECT b.c, t.i, b.audit || repeat('I', r.k) || e.edit AS audit, b.cost + 2 * r.k + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN extra ELSE 2 + extra END AS cost,
      CASE WHEN e.edit = 'D' THEN r.q WHEN must THEN NULL WHEN e.edit = 'R' THEN CASE r.q WHEN 'U' THEN 'A' ELSE 'U' END WHEN initial = 's' AND r.q = 'E' THEN 'S' WHEN initial = 'u' AND r.q <> 'U' THEN 'U' WHEN initial = 'a' AND r.q = 'U' THEN 'A' END AS state,
      b.lines || r.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE r.q WHEN 'U' THEN 'assistant:' ELSE 'user:' END || t.text] END AS lines
    FROM best b JOIN turns t ON t.c = b.c AND t.i = b.i + 1 JOIN runs r ON r.p = b.state, (VALUES ('D'), ('K'), ('R')) e(edit))
  WHERE state IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
ended AS (SELECT b.c, b.cost + 2 * k AS cost, b.audit || repeat('I', k) AS audit, b.lines || r.lines AS lines FROM best b JOIN faults f ON f.c = b.c AND f.n = b.i JOIN runs r ON r.p = b.state WHERE r.q = 'A' OR (b.state = 'E' AND k = 0)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY b.c ORDER BY b.cost + 2 * k, b.audit || repeat('I', k)) = 1)
SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(cost, 0) AS cost, COALESCE(audit, '') AS audit,
  sha256(COALESCE(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN faults USING (c) LEFT JOIN ended USING (c)
"""
