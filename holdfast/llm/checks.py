"""DuckDB statements for the dealt queries that SQL can express."""

from __future__ import annotations

from holdfast.llm import queries as Q
from holdfast.llm.mixing import WORD
from holdfast.llm.secrets import BASE_RULES


def _top_k() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10"""


def _secrets() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT rid, '{r.kind}' AS kind, {i} AS kno, string_split_regex(t, $${r.pattern}$$) AS p, "
        f"regexp_extract_all(t, $${r.pattern}$$) AS h FROM d"
        for i, r in enumerate(BASE_RULES)
    )
    keeps = " OR ".join(
        f"kno = {i} AND length(regexp_extract(m, $${r.pattern}$$, {r.group})) >= {r.least}"
        for i, r in enumerate(BASE_RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    shown = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
u AS (SELECT rid, kind, kno, p, h, unnest(range(1, len(h) + 1)) AS i FROM k WHERE len(h) > 0),
s AS (SELECT rid, kind, kno, h[i] AS m, length(h[i]) AS size,
        sum(length(p[i]) + length(h[i])) OVER (PARTITION BY rid, kno ORDER BY i) AS stop FROM u),
f AS (SELECT rid, kind, kno, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE {keeps}),
g AS (SELECT rid, {counts},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kno) AS spans FROM f GROUP BY rid)
SELECT doc_id, {shown}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


def _mixing() -> str:
    levels = ["domain", "l", "s"]
    weights = dict(zip(levels, (Q.MIX_WEIGHTS.get(n, {}) for n in ("domain", "lang", "source"))))
    parts = []
    for depth in range(1, 4):
        here, up = levels[:depth], levels[:depth - 1]
        cases = "".join(f" WHEN '{n}' THEN {w}" for n, w in weights[here[-1]].items() if n != "*")
        other = weights[here[-1]].get("*", 1)
        weight = f"CASE {here[-1]}{cases} ELSE {other} END" if cases else str(other)
        group = f"PARTITION BY {', '.join(up)}" if up else ""
        order = f"{group} ORDER BY CASE WHEN weight > 0 THEN CAST(capacity AS DOUBLE) / weight ELSE 'Infinity'::DOUBLE END, {', '.join(here)}"
        given = f"n{depth - 1}.share" if up else (
            f"least((SELECT sum(tokens) * {Q.MIX_PERMILLE} // 1000 FROM leaves), (SELECT sum(capacity) FROM leaves))")
        joined = f"JOIN n{depth - 1} USING ({', '.join(up)})" if up else ""
        cols = ", ".join(here)
        parts.append(f"""
c{depth} AS (SELECT c.*, {weight} AS weight, {given} AS given
  FROM (SELECT {cols}, sum(capacity) AS capacity FROM leaves GROUP BY {cols}) c {joined}),
s{depth} AS (SELECT *,
    given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c{depth}),
f{depth} AS (SELECT *, weight > 0 AND capacity::HUGEINT * weights <= remaining::HUGEINT * weight AS is_full FROM s{depth}),
n{depth} AS (SELECT {cols}, CASE WHEN is_full THEN capacity WHEN weight > 0 THEN
    (given - coalesce(sum(capacity) FILTER (is_full) OVER ({group}), 0)) * weight
      // sum(weight) FILTER (NOT is_full) OVER ({group}) ELSE 0 END AS share FROM f{depth})""")
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, substr(coalesce(source, ''), 1, 4) AS domain, coalesce(lang, '') AS l,
    coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM documents
), leaves AS (SELECT domain, l, s, sum(n) AS tokens, {Q.MIX_EPOCHS} * sum(n) AS capacity FROM d GROUP BY ALL),
{','.join(parts)},
q AS (SELECT *, share - whole * tokens AS rest FROM (
  SELECT domain, l, s, tokens, share,
    CASE WHEN tokens > 0 THEN least({Q.MIX_EPOCHS}, share // tokens) ELSE 0 END AS whole FROM n3 JOIN leaves USING (domain, l, s))),
units AS (SELECT domain, l, s, k, whole, rest, sum(n) AS n, md5('42:' || CAST(whole + 1 AS BIGINT) || ':' || k) AS place
  FROM d JOIN q USING (domain, l, s) GROUP BY ALL),
runs AS (SELECT domain, l, s, k, CAST(whole + CASE WHEN rest > 0 AND
    sum(n) OVER (PARTITION BY domain, l, s ORDER BY place, k) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM units)
SELECT doc_id, domain, lang, source, n AS n_tokens, copies FROM d JOIN runs USING (domain, l, s, k) WHERE copies > 0"""


def _warc() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM g"""


def _collocations() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
m AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
c AS (SELECT lang, k, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM s),
t AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
    CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f) AS BIGINT) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, phrase, max(f) AS cover FROM (
    SELECT lang, f, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
    FROM s, (SELECT unnest([2, 3]) AS n) WHERE n < k) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank" FROM o)
SELECT lang, CAST("rank" AS BIGINT) AS "rank", phrase, a, l, r, n, score FROM q JOIN m USING (lang) WHERE "rank" <= 2000"""


def _fill_in_middle() -> str:
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {draws} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def statements() -> dict[str, str]:
    """The other queries are held against brute force in tests."""
    return {
        "op1_exact_top_k": _top_k(), "op2_secret_scan": _secrets(), "op3_source_mixing": _mixing(), "op9_warc": _warc(),
        "op11_collocations": _collocations(), "op12_fill_in_middle": _fill_in_middle(),
    }
