"""DuckDB SQL for the operators on pages, conversations and target distributions."""

from __future__ import annotations


def _nibbles() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, half a byte at a time."""
    digits = f"hex(encode({text}))"
    halves = f"flatten(list_transform(range(1, length({digits}), 2), lambda i: [{digits}[i + 1], {digits}[i]]))"
    values = f"list_transform({halves}, lambda d: CAST(instr('0123456789ABCDEF', d) - 1 AS BIGINT))"
    step = f"lambda c, x: xor({_nibbles()}[(xor(c, x) & 15) + 1], c >> 4)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {values}), {step}))"


#: The tables' pages: one article each, of headings and paragraphs.
PAGES = r"""
WITH a AS (SELECT page_id, url, row_number() OVER () AS k, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT k, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT k, regexp_split_to_array(replace(h, '<br>', ' '), '</?(?:h1|p)>') AS x FROM a)),
c AS (SELECT k, i, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b),
d AS (SELECT k, string_agg(t, chr(10) ORDER BY i) FILTER (t <> '') AS text FROM c GROUP BY k)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM a JOIN d USING (k)"""


def _conversations() -> str:
    spaced = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    then = (2, 2, 3, 2)
    after = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    more = lambda letter, cost, v: f"printf('%012d', CAST(left({v}, 12) AS BIGINT) + {cost}) || '{letter}' || substr({v}, 13)"
    option = lambda s: "least(" + ", ".join(
        [more("D", "4", f"v{s}"), f"CASE WHEN fault <> 2 THEN {more('R', '3 + 3 * fault', f'v{then[s]}')} ELSE 'x' END",
         *(f"CASE WHEN fault <> 2 AND initial = '{x}' THEN {more('K', '3 * fault', f'v{t}')} ELSE 'x' END" for x, t in after[s].items())]) + ")"
    insert = lambda s: f"least(b{s}, {more('I', '3', f'b{then[s]}')}, {more('II', '6', f'b{then[then[s]]}')})"
    zeros = "000000000000"
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, {spaced("role")} AS role, {spaced("text")} AS text, {crc32_sql(spaced("conv_id") + " || ':' || " + spaced("turn"))} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) FROM c WHERE fate <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tip FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
f AS MATERIALIZED (SELECT *, CASE WHEN tip = '' OR again THEN 2 WHEN tip NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (tip = '') AS blank, count(*) FILTER (tip <> '' AND again) AS duplicate,
  count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, n AS i, '{zeros}' AS v0, '000000000006II' AS v1, '000000000003I' AS v2, '{zeros}' AS v3 FROM f WHERE i = n
  UNION ALL SELECT conv_id, i - 1, {", ".join(map(insert, range(4)))} FROM (SELECT r.conv_id, r.i, {", ".join(f"{option(s)} AS b{s}" for s in range(4))}
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i WHERE r.i > 0)),
e AS (SELECT conv_id, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM r WHERE i = 0),
w(conv_id, audit, k, i, state, text) AS (SELECT conv_id, audit, 0, 0, 0, NULL::VARCHAR FROM e
  UNION ALL SELECT w.conv_id, audit, k + 1, CASE edit WHEN 'I' THEN w.i ELSE w.i + 1 END,
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    CASE edit WHEN 'D' THEN w.text ELSE concat_ws(chr(10), w.text, CASE edit WHEN 'K' THEN f.role WHEN 'R' THEN due ELSE due END || ':' || CASE edit WHEN 'I' THEN '' ELSE f.text END) END
  FROM (SELECT *, audit[k + 1] AS edit, CASE state WHEN 2 THEN 'assistant' ELSE 'user' END AS due FROM w WHERE k < length(audit)) w
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
t AS (SELECT conv_id, sha256(coalesce(text, '')) AS repaired_sha256 FROM w WHERE k = length(audit))
SELECT i.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""


CONVERSATIONS = _conversations()

RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT k, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
  UNION ALL SELECT -1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
u AS MATERIALIZED (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM n),
b AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM u)),
c AS MATERIALIZED (SELECT k, bucket, count(*) AS n FROM u JOIN b USING (f) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (k > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (k < 0), 0)::DOUBLE AS t FROM c GROUP BY bucket),
z AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain FROM g),
x AS (SELECT k, sum(n) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM c JOIN z USING (bucket) GROUP BY k),
y AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM n LEFT JOIN x USING (k) WHERE n.k > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= able * 25 // 100 THEN place END AS rank FROM r"""
