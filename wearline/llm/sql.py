"""DuckDB SQL of the contract queries that SQL can express."""

OP1 = r"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       CASE WHEN page_id <> first_id THEN 0 ELSE payload_bytes END AS stored_bytes
FROM f
"""

OP3 = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM split
), solid AS (
  SELECT doc_id, pos, trim(raw, ' ') AS line FROM line WHERE trim(raw, ' ') <> ''
), run AS (
  SELECT doc_id, pos,
         lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM run WHERE pos3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos2, pos3]) AS pos FROM ranked WHERE nth > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT s.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed_lines,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), raw_line AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw_line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), norm AS (
  SELECT doc_id, host, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line FROM raw_line
), counted AS (
  SELECT host, line, count(DISTINCT {'id': doc_id, 'text': text}) AS docs, count(DISTINCT text) AS texts FROM norm WHERE line <> '' GROUP BY host, line
), hosts AS (
  SELECT host, count(DISTINCT {'id': doc_id, 'text': text}) AS docs FROM d GROUP BY host
), frequent AS (
  SELECT c.host, c.line FROM counted c JOIN hosts h ON c.host = h.host 
  WHERE c.docs >= 10 AND c.texts >= 10 AND c.docs >= least(0.1 * h.docs, 1000)
), lost AS (
  SELECT n.doc_id, sum(CASE WHEN f.line IS NULL THEN 0 ELSE len(string_split(n.line, ' ')) END) AS lost, sum(len(string_split(n.line, ' '))) AS n
  FROM norm n LEFT JOIN frequent f ON n.host = f.host AND n.line = f.line WHERE n.line <> '' GROUP BY n.doc_id
), base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words, coalesce(l.n, 0) AS n_all
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_lost_words > 0.5 * n_all) AS kept
FROM base
"""

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = (r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(""" + _FOLDED.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(""" + _FOLDED.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(words), 13) AS m, array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS w
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(words[i : i + m - 1], ' ') AS w
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, sizes WHERE len(words) >= m)
), hit AS (SELECT doc_id, item, dw.m AS m, i FROM dw JOIN bw ON dw.m = bw.m AND dw.w = bw.w),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")

OP9 = (r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(""" + _FOLDED.format("coalesce(text, '')") + r""", '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
""")

OP11 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), counted AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM gram GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 30
), cut AS (
  SELECT c.lang, c.phrase, c.a, c.first, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS first FROM candidate) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.first], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.first + 1 : c.k], ' ')
), weakest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) = 1
), inner_phrase AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS i
        FROM candidate, (SELECT unnest([2, 3]) AS size) WHERE size < k) GROUP BY ALL
), kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inner_phrase p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.longer IS NULL OR 100::HUGEINT * p.longer < 80::HUGEINT * w.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

def _field(col: str, value: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def _leaf_sql(n_chars: str) -> str:
    fields = [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", n_chars), ("text", "text")]
    return "sha256(" + " || ".join(_field(c, v) for c, v in fields) + ")"


#: Unsigned CRC-32 of the decimal doc_id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)), 4294967295), 4294967295)"""

OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN crc32_of % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed
  FROM (SELECT *, {_CRC} AS crc32_of FROM documents)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), node AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaf
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), lang_root AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top_pos, count(*) OVER () AS top_n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS lvl, top_pos AS pos, top_n AS n, subroot AS h FROM lang_root
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
), sibling AS (
  SELECT l.tree, l.pos, t.lvl, t.h FROM leaf l JOIN node t ON t.tree = l.tree AND t.n > 1 AND t.pos = xor(l.pos >> t.lvl, 1)
), top_sibling AS (
  SELECT r.tree, t.lvl, t.h FROM lang_root r JOIN top t ON t.n > 1 AND t.pos = xor(r.top_pos >> t.lvl, 1)
), proof AS (
  SELECT tree, pos, string_agg(h, '' ORDER BY part, lvl) AS path FROM (
    SELECT tree, pos, 0 AS part, lvl, h FROM sibling
    UNION ALL SELECT l.tree, l.pos, 1, s.lvl, s.h FROM leaf l JOIN top_sibling s USING (tree)) GROUP BY tree, pos
), fold AS (
  SELECT tree, pos, 0 AS lvl, pos AS at, n, coalesce(changed, leaf) AS h FROM leaf
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, f.at // 2, (f.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.at % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f LEFT JOIN sibling s ON s.tree = f.tree AND s.pos = f.pos AND s.lvl = f.lvl WHERE f.n > 1
), top_fold AS (
  SELECT f.tree, f.pos, 0 AS lvl, r.top_pos AS at, r.top_n AS n, f.h FROM fold f JOIN lang_root r USING (tree) WHERE f.n = 1
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, f.at // 2, (f.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.at % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM top_fold f LEFT JOIN top_sibling s ON s.tree = f.tree AND s.lvl = f.lvl WHERE f.n > 1
)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, sha256(coalesce(p.path, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaf l JOIN lang_root r USING (tree) JOIN top_fold f ON f.tree = l.tree AND f.pos = l.pos AND f.n = 1
JOIN (SELECT h FROM top WHERE n = 1) t ON true LEFT JOIN proof p ON p.tree = l.tree AND p.pos = l.pos
"""

ORACLES: dict[str, str] = {
    "op1_warc": OP1,
    "op3_line_dedup": OP3,
    "op6_quality": OP6,
    "op8_decontaminate": OP8,
    "op9_near_duplicates": OP9,
    "op11_phrases": OP11,
    "op12_merkle": OP12,
}
