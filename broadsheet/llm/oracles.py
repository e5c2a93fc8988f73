"""SQL for the same rows, for DuckDB over the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS place
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM totals
), staged AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS wanted,
         coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS free,
         row_number() OVER (ORDER BY cap / weight, place) AS rank
  FROM weighted
  WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((wanted - capped) / free, rank) FILTER (WHERE (wanted - capped) / free <= cap / weight) AS level FROM staged
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target
  FROM staged, level
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM taken
"""

ORACLES["op7_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN
           translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id
           ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM best WHERE place = 1
"""

ORACLES["op8_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY content)::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS kept,
       sha256(content) AS text_sha256
FROM bare
"""

#: Rounds of merging templates that the SQL spells out; further ones change nothing in the given tables.
MERGES = 4


def _merge(k: int) -> str:
    """Templates after round ``k`` from those before it: a place opens where those that agree elsewhere differ."""
    return f"""
), place{k} AS (
  SELECT DISTINCT n, lead, t, p, t[p] AS token, list_concat(t[1 : p - 1], [NULL], t[p + 1 :]) AS rest
  FROM (SELECT DISTINCT n, lead, t FROM template{k - 1}), unnest(range(1, n + 1)) AS r(p)
), agree{k} AS (
  SELECT n, lead, p, rest FROM place{k} GROUP BY n, lead, p, rest
  HAVING count(*) >= 3 OR (count(*) > 1 AND bool_or(token = '<*>'))
), opened{k} AS (
  SELECT o.n, o.lead, o.t, list(CASE WHEN a.p IS NULL THEN o.token ELSE '<*>' END ORDER BY o.p) AS new
  FROM place{k} o LEFT JOIN agree{k} a ON o.n = a.n AND o.lead = a.lead AND o.p = a.p AND o.rest = a.rest
  GROUP BY o.n, o.lead, o.t
), template{k} AS (
  SELECT v.tokens, v.n, v.lead,
         CASE WHEN len(list_filter(o.new, lambda x: x <> '<*>')) >= 0.75 * v.n THEN o.new ELSE v.t END AS t
  FROM template{k - 1} v JOIN opened{k} o ON v.n = o.n AND v.lead = o.lead AND v.t = o.t"""


ORACLES["op3_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, i, trim(regexp_replace(parts[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS clean
  FROM raw, unnest(range(1, len(parts) + 1)) AS r(i)
), lines AS (
  SELECT doc_id, i, tokens, len(tokens) AS n, tokens[1:3] AS lead FROM (
    SELECT doc_id, i, list_transform(string_split(clean, ' '),
             lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
    FROM numbered WHERE clean <> '')
), variants AS (
  SELECT tokens, n, lead, count(DISTINCT doc_id) AS documents, min(doc_id) AS owner FROM lines GROUP BY ALL
), leaves AS (
  SELECT n, lead FROM variants WHERE n >= 6 GROUP BY ALL HAVING count(*) > 1
), taken AS (
  SELECT v.tokens, v.n, v.lead, p, v.tokens[p] AS token
  FROM variants v JOIN leaves l ON v.n = l.n AND v.lead = l.lead, unnest(range(1, v.n + 1)) AS r(p)
), shared AS (
  SELECT n, lead, p, token FROM taken GROUP BY ALL HAVING count(*) > 1
), template0 AS (
  SELECT t.tokens, t.n, t.lead, list(CASE WHEN c.p IS NULL THEN '<*>' ELSE t.token END ORDER BY t.p) AS t
  FROM taken t LEFT JOIN shared c ON t.n = c.n AND t.lead = c.lead AND t.p = c.p AND t.token = c.token
  GROUP BY t.tokens, t.n, t.lead
  HAVING count(*) FILTER (c.p IS NOT NULL AND t.token <> '<*>') >= 0.75 * t.n""" + "".join(
    _merge(k) for k in range(1, MERGES + 1)
) + f"""
), generalised AS (
  SELECT tokens, n, lead, t AS template FROM template{MERGES} WHERE list_contains(t, '<*>')""" + r"""
), recurring AS (
  SELECT g.n, g.lead, g.template, min(l.doc_id) AS owner
  FROM generalised g JOIN lines l ON g.tokens = l.tokens
  GROUP BY g.n, g.lead, g.template HAVING count(DISTINCT l.doc_id) >= 5
), owners AS (
  SELECT v.tokens, coalesce(r.owner, CASE WHEN v.documents >= CASE WHEN v.n < 6 THEN 10 ELSE 2 END THEN v.owner END) AS owner
  FROM variants v LEFT JOIN generalised g ON v.tokens = g.tokens
  LEFT JOIN recurring r ON g.n = r.n AND g.lead = r.lead AND g.template = r.template
), dropped AS (
  SELECT l.doc_id, list(l.i) AS gone FROM lines l JOIN owners o ON l.tokens = o.tokens
  WHERE o.owner <> l.doc_id GROUP BY l.doc_id
)
SELECT r.doc_id, coalesce(len(r.parts), 0)::BIGINT AS n_lines, coalesce(len(d.gone), 0)::BIGINT AS n_dropped,
       CASE WHEN d.gone IS NULL THEN r.text ELSE coalesce(array_to_string(
         [r.parts[i] FOR i IN range(1, len(r.parts) + 1) IF NOT list_contains(d.gone, i)], chr(10)), '') END AS text
FROM raw r LEFT JOIN dropped d ON r.doc_id = d.doc_id
"""

ORACLES["op6_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.doc_id
), roots AS (
  SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

# DuckDB has no CRC: it is taken from its table, over the digits of an id.
CRC_TABLE = """crc_table(b, k, v) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) AS r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_table WHERE k < 8
), crc(table_) AS (
  SELECT list(v ORDER BY b) FROM crc_table WHERE k = 8
)"""


def _crc(key: str) -> str:
    """The CRC of a number's decimal digits; needs ``crc`` in the FROM list."""
    digits = f"list_transform(string_split({key}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), "
        "lambda acc, c: xor(acc // 256, table_[xor(acc % 256, c) + 1])), 4294967295)"
    )


# A run has at least five words that equal the one a period before, so
# pairs of three equal words in a row are enough to find it.
ORACLES["op11_periodic_runs"] = "WITH RECURSIVE " + CRC_TABLE + r""", original AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         """ + _crc("doc_id") + r""" AS h
  FROM documents, crc
), placed AS (
  SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a,
         1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p
  FROM original
), rebuilt AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] ELSE w END AS w, n
  FROM placed
), words AS (
  SELECT doc_id, n, i, w[i + 1] AS word, w[i + 1 : i + 3] AS three FROM rebuilt, unnest(range(n)) AS r(i)
), pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.three = y.three AND y.i < x.i
  WHERE 4 * (x.i - y.i) <= x.n AND len(x.three) = 3
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + 2 + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), described AS (
  SELECT doc_id, count(*) AS n_runs,
         first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS r(i)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT r.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length,
       best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM rebuilt r LEFT JOIN described d ON r.doc_id = d.doc_id LEFT JOIN kept k ON r.doc_id = k.doc_id
"""

ORACLES["op12_prefix_trie"] = "WITH RECURSIVE " + CRC_TABLE + r""", own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1 : h], o.turns[h + 1 :]) AS turns
  FROM (SELECT *, """ + _crc("conv_id") + r""" % 6 AS h FROM own, crc) o
  LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, turns[1 : d] AS path, len(turns) = d AS ending
  FROM rebuilt, unnest(range(len(turns) + 1)) AS r(d)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END) AS saved,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending) AS ends
  FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN children c ON n.path = c.path
  LEFT JOIN nodes p ON p.path = n.path[1 : n.d - 1] AND p.d = n.d - 1
), subtrees AS (
  SELECT path[1 : k] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted, unnest(range(d + 1)) AS r(k) GROUP BY path[1 : k]
)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, n.parent_conv_id::BIGINT AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN subtrees s ON n.path = s.path
"""

ORACLES["op13_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS r(i)
), lengths AS (
  SELECT DISTINCT n FROM windows
), spans AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS (
  SELECT s.doc_id, s.i, s.n, v.item_id FROM spans s JOIN windows v ON s.n = v.n AND s.words = v.words
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(l.n_items, 0)::BIGINT AS n_items, sha256(coalesce(l.names, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
