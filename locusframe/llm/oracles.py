"""DuckDB SQL that gives the same rows as the queries it can express."""

LINE_DEDUP = r"""
WITH p AS (
  SELECT page_id, html, row_number() OVER () AS r,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host
  FROM pages
), l AS (
  SELECT r, page_id, host, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b(?:.*?</script>|.*)|<style\b(?:.*?</style>|.*)|<!--(?:.*?-->|.*)', chr(10), 'g'),
    '(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|section|footer|header|title|head|body|table|tr|td|th)\b[^>]*>|[\r\n]+', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS lines
  FROM p
), t AS (SELECT host, count(*) AS total FROM l GROUP BY host),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM (SELECT host, r, unnest(lines) AS line FROM l) GROUP BY host, line),
b AS (SELECT host, list(line) AS dropped FROM c JOIN t USING (host) WHERE n >= 5 AND total >= 5 AND n > 0.3 * total GROUP BY host),
k AS (SELECT page_id, host, coalesce(lines, []) AS lines, list_filter(coalesce(lines, []), lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept
  FROM l LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped,
  coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS k
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)),
pos AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, s, pos.n, item FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""


def mixing(rounds: int, power: float, whole_share: float) -> str:
    """Raking unrolled: one step for each round and dimension."""
    dims = ["source", "lang", "topic"]
    steps, last = [], "c0"
    for i in range(rounds * len(dims)):
        d = dims[i % len(dims)]
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * aim_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
        last = f"c{i + 1}"
    aims = ", ".join(f"pow(t_{d}, {power}) / (SELECT sum(pow(s, {power})) FROM (SELECT sum(tokens) AS s FROM x GROUP BY {d})) AS aim_{d}" for d in dims)
    sums = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS t_{d}" for d in dims)
    return f"""
WITH x AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(text), '') AS draw, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'licensed'
      WHEN contains(text, ' | ') THEN 'tabular' WHEN length(text) < 500 THEN 'short' ELSE 'prose' END AS topic,
    CAST(coalesce(length(text) - length(translate(text, ' ' || chr(10), '')), 0) + 1 AS BIGINT) AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM x GROUP BY ALL),
sums AS (SELECT *, {sums} FROM cells),
c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens AS w, {aims} FROM sums),
{", ".join(steps)},
rates AS (SELECT *, w / tokens AS rate FROM {last}),
r AS (SELECT *, sum(tokens) OVER (ORDER BY rate, source, lang, topic ROWS UNBOUNDED PRECEDING) >= {1 - whole_share} * sum(tokens) OVER () AS enough FROM rates),
p AS (SELECT *, least(1.0, rate / (SELECT min(rate) FROM r WHERE enough)) AS probability FROM r)
SELECT doc_id, source, lang, topic, x.tokens, round(w, 9) AS weight, round(probability, 6) AS probability,
  CAST(CAST('0x' || substr(md5(draw), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < probability AS sampled
FROM x JOIN p USING (source, lang, topic)
"""


_ESCAPE = r"""regexp_replace(replace({}, '␛', '␛␛'), '([<\[])(/?s>|/?ROLE\]|/?INST\]|/?SYS\]|</?SYS>>|\|)', '\1␛\2', 'g')"""

CHAT = f"""
WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')})) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
"""
