"""DuckDB SQL of the word, rule and conversation operators."""

_BLANK = r"\x20\x09-\x0D"

#: The 256 remainders of a CRC-32 (the reversed polynomial is a fixed value), from its rule.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes; needs table crc joined in."""
    octets = f"list_transform(range(1, CAST(octet_length(encode({text})) + 1 AS BIGINT)), lambda p: CAST('0x' || substr(hex(encode({text})), 2 * p - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM each, crc),
words AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS w FROM h)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
gone AS MATERIALIZED (SELECT w, n, i, w[: i - 1] || w[i + 1 :] AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT g.w AS a, words.w AS b FROM gone g JOIN words ON words.w = g.rest UNION SELECT DISTINCT words.w, g.w FROM gone g JOIN words ON words.w = g.rest
  UNION SELECT DISTINCT g.w, k.w FROM gone g JOIN gone k ON g.rest = k.rest AND g.i = k.i AND g.w <> k.w),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM near JOIN words ON words.w = near.b GROUP BY a),
f AS MATERIALIZED (SELECT w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best ON a = w),
chain AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.ahead)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND ahead IS NULL
"""

RULES = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[{_BLANK}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM l)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[{_BLANK}]*[-*•]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{_BLANK}]*$'))) AS cut,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered FROM l LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
  OR 2 * n_dup_lines > n_lines OR 10 * bullets > 9 * n_lines OR 10 * cut > 3 * n_lines OR 10 * lettered < 7 * n_words) AS kept
FROM b
"""


def _plus(element: str, cost: str, letter: str) -> str:
    """A (cost, audit) element, as a text of eight digits and the audit, with one more edit."""
    return f"lpad(CAST(CAST(left({element}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({element}, 9) || '{letter}'"


def _stays(initial: str, element: str, to: str) -> str:
    keep = f"CASE WHEN initial = '{initial}' AND stays THEN {_plus(element, 'cut', 'K')} END"
    return keep if to == "s" else f"{keep}, CASE WHEN stays THEN {_plus(element, '(2 + cut)', 'R')} END"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_crc32("k")} % 20 AS code FROM x, crc),
d AS (SELECT rid, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid, copy) AS i, left(role, 1) AS initial,
  rtrim(text, {_BLANKS}) AS bare FROM d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, initial, fault, fault NOT IN ('b', 'd') AS stays, CAST(fault = 't' AS INT) AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o)),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations),
step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM convs
  UNION ALL
  SELECT z.conv_id, f.i, {_plus('z.n', '3', 'D')}, least({_plus('z.s', '3', 'D')}, {_stays('s', 'z.n', 's')}),
    least({_plus('z.u', '3', 'D')}, {', '.join(_stays('u', e, 'u') for e in ('z.n', 'z.s', 'z.a'))}), least({_plus('z.a', '3', 'D')}, {_stays('a', 'z.u', 'a')})
  FROM (SELECT conv_id, i, n, s, least(u, {_plus('n', '2', 'I')}, {_plus('s', '2', 'I')}, {_plus('a', '2', 'I')}) AS u,
    least(a, {_plus('u', '2', 'I')}, {_plus('n', '4', 'II')}, {_plus('s', '4', 'II')}) AS a FROM step) z
  JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i + 1
),
ends AS (SELECT convs.conv_id, coalesce(n, 0) AS n, gaps, blank, duplicate, truncated, illegal FROM convs LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM convs.conv_id),
best AS (SELECT ends.*, least(step.n, step.a, {_plus('step.u', '2', 'I')}, {_plus('step.s', '4', 'II')}) AS e FROM ends JOIN step ON step.conv_id IS NOT DISTINCT FROM ends.conv_id AND step.i = ends.n),
edits AS (SELECT conv_id, p, substr(e, CAST(p + 8 AS INT), 1) AS edit FROM (SELECT conv_id, e, unnest(range(1, length(e) - 7)) AS p FROM best)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM edits),
said AS (SELECT placed.conv_id, p, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, initial,
    row_number() OVER (PARTITION BY placed.conv_id ORDER BY p) AS rank FROM placed LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM placed.conv_id AND f.i = placed.i AND edit <> 'I' WHERE edit <> 'D'),
named AS (SELECT *, CASE WHEN edit = 'K' THEN role WHEN (rank - CAST(max(CASE WHEN rank = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT)) % 2 = 1
  THEN 'user' ELSE 'assistant' END AS name FROM said),
told AS (SELECT conv_id, string_agg(name || ':' || text, chr(10) ORDER BY p) AS whole FROM named GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(left(e, 8) AS BIGINT) AS cost, substr(e, 9) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM best.conv_id
"""
