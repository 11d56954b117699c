"""DuckDB twins of the queries that SQL can express, over the whole tables."""

from .sharding import ROUND_KEYS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

CRC32 = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
checked AS (
  SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table)"""

_ROUNDS = []
for _i, _k in enumerate(ROUND_KEYS):
    _key = (_k | 1)
    _x = f"((r{_i} * {_key} + {_key >> 3}) & {(1 << 62) - 1})"
    _y = f"(xor({_x}, {_x} >> 29) & {(1 << 31) - 1}) * {_key ^ 0x2545F491}"
    _ROUNDS.append(f"LATERAL (SELECT r{_i} AS l{_i + 1}, (l{_i} + ((({_y}) >> 17) & {(1 << 31) - 1}) % side) % side AS r{_i + 1})")
FEISTEL = f"LATERAL (SELECT p // side AS l0, p % side AS r0), {', '.join(_ROUNDS)}"
_LAST = len(ROUND_KEYS)

OP2 = f"""
WITH RECURSIVE {CRC32},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS row, count(*) OVER () AS n,
         CAST(floor(sqrt(count(*) OVER () - 1)) AS BIGINT) + 1 AS side FROM checked),
walk AS (
  SELECT row, n, side, l{_LAST} * side + r{_LAST} AS p FROM (SELECT row, n, side, row AS p FROM numbered) s, {FEISTEL}
  UNION ALL
  SELECT row, n, side, l{_LAST} * side + r{_LAST} AS p FROM (SELECT row, n, side, p FROM walk WHERE p >= n) s, {FEISTEL})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard, CAST(p // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (row) WHERE p < walk.n"""

OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS x, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
lines AS (
  SELECT row, source, y AS line, lower(array_to_string({WORDS.format("y")}, ' ')) AS norm, len({WORDS.format("y")}) AS n
  FROM (SELECT row, source, unnest(string_split(x, chr(10))) AS y FROM docs) WHERE len({WORDS.format("y")}) > 0),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY row),
hosts AS (SELECT source, count(*) AS d FROM docs GROUP BY source),
often AS (SELECT source, norm, count(DISTINCT row) AS c FROM lines GROUP BY source, norm),
common AS (SELECT o.source, o.norm FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE c > 50 OR (c > 2 AND c > d * 0.05)),
cut AS (SELECT row, sum(n) AS cut FROM lines l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY row),
windows AS (SELECT row, i, array_to_string(ws[i:i + 4], ' ') AS k FROM docs, unnest(range(1, len(ws) - 3)) t(i)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT row, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(5) r(o) GROUP BY row),
rules AS (
  SELECT docs.*, len(ws) AS n_words, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) - coalesce(cut, 0) AS n_left
  FROM docs LEFT JOIN dup USING (row) LEFT JOIN repeats USING (row) LEFT JOIN cut USING (row))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= 10 AND n_left >= n_words * 0.3 AS kept, CAST(n_left AS BIGINT) AS n_left
FROM rules"""

OP3_LARGE_HOSTS = OP3.replace("c > 50 OR (c > 2 AND c > d * 0.05)", "c > 50 AND c > d * 0.05")

OP4 = f"""
WITH docs AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM docs, unnest(range(1, len(ws) - 18)) t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(20) r(o)),
words AS (SELECT doc_id, i, ws[i] AS w FROM docs, unnest(range(1, len(ws) + 1)) t(i)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS x, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

OP7 = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
sources AS (SELECT source, sum(size) AS s, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
filling AS (
  SELECT *, sum(s) OVER () AS total, row_number() OVER (ORDER BY s / w, source) AS place, coalesce(sum(3 * s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM sources),
levels AS (SELECT arg_min((total - full_before) / open, place) AS level FROM filling WHERE (total - full_before) / open <= 3 * s / w),
targets AS (SELECT source, s, least(3.0 * s, w * level) AS target FROM sources, levels),
lots AS (
  SELECT doc_id, size, s, target, CAST(round(target) AS BIGINT) AS goal,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY md5(doc_id || ':7')[1:15], doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, CAST(round(target, 6) AS DOUBLE) AS target,
       CAST(CASE WHEN s > 0 THEN goal // s ELSE 0 END * size + greatest(0, least(size, CASE WHEN s > 0 THEN goal % s ELSE 0 END - before)) AS BIGINT) AS taken
FROM lots"""

OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM docs, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, b FROM reach r JOIN ends ON r.other = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM docs d JOIN reach r USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY 1, 2"""

OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
terms AS (SELECT row, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
sized AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM docs) g),
counted AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, v, coalesce(sum(n), 0) AS total FROM groups g JOIN sized USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
share AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + t.v)::HUGEINT AS p
  FROM totals t JOIN kept k ON k.lang = t.lang LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (SELECT sum(total) + any_value(v) FROM totals t WHERE t.lang = s.lang)::HUGEINT AS q
  FROM share s GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
found AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM share s JOIN of_lang o ON o.lang = s.lang AND o.term = s.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM found) WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""

OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM words, range(1, 5) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
parts AS MATERIALIZED (
  SELECT lang, phrase, k, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM grams, range(1, 4) c(j) WHERE j < k),
cuts AS (
  SELECT p.lang, p.phrase, p.k, p.a, j, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * p.a // (l.a + r.a)::HUGEINT AS BIGINT) AS score
  FROM parts p JOIN grams l ON l.lang = p.lang AND l.phrase = p.head JOIN grams r ON r.lang = p.lang AND r.phrase = p.tail),
candidates AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM grams, range(2, 4) t(m), range(1, 4) u(s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
ranked AS (
  SELECT c.lang, c.phrase, a, l, r, score, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank
  FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * a::HUGEINT, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
