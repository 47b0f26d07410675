"""SQL of the corpus queries that SQL can express, for checking in DuckDB."""

from __future__ import annotations

from callscope.llm import mixing

#: All links of equal or similar shingle sets, and the least id that they reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 2)) AS g
      FROM w, range(1, greatest(2, len(words) - 1)) r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least ON w.doc_id = least.id LEFT JOIN n ON n.doc_id = w.doc_id"""

SEARCH = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""


def mixing_sql(keep: float = 0.7, rounds: int = 40) -> str:
    """Raking of the cells within their bounds, with more rounds than agree to ten places, and the sampled documents."""
    topic = """CASE WHEN contains(lower(t), 'licen') THEN 'licence' WHEN contains(t, '{') OR contains(t, '</') THEN 'code'
         WHEN contains(t, ' | ') THEN 'table' WHEN length(t) < 400 THEN 'brief' ELSE 'prose' END"""
    parts = [
        f"d AS (SELECT doc_id, lang, source, {topic} AS topic, greatest(1, CAST(ceil(strlen(t) / 4) AS BIGINT)) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for n in mixing.DIMENSIONS:
        parts.append(f"target_{n} AS (SELECT g, held, mass / sum(mass) OVER () AS target FROM (SELECT {n} AS g, sum(tokens) AS held, pow(sum(tokens), {mixing.ALPHAS[n]}) AS mass FROM cells GROUP BY 1))")
        parts.append(f"factor_{n} AS (SELECT g, held, target, ({keep} * sum(held) OVER () - coalesce(sum(held) OVER (ORDER BY held / target, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(target) OVER (ORDER BY held / target, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM target_{n})")
        parts.append(f"goal_{n} AS (SELECT g, least(held, target * max(f) OVER ()) AS goal FROM factor_{n})")
    last = "w0"
    parts.append(f"w0 AS (SELECT *, {keep} * tokens AS w FROM cells)")
    for k in range(rounds):
        for n in mixing.DIMENSIONS:
            parts.append(f"s{k}_{n} AS (SELECT source, lang, topic, tokens, w, goal, sum(w) OVER (PARTITION BY {n}) AS a, sum(CASE WHEN w >= tokens THEN w ELSE 0 END) OVER (PARTITION BY {n}) AS full_ FROM {last} JOIN goal_{n} ON {n} IS NOT DISTINCT FROM g)")
            last = f"w{k}_{n}"
            parts.append(f"{last} AS (SELECT source, lang, topic, tokens, greatest({mixing.LEAST * keep} * tokens, least(tokens, w * CASE WHEN a > goal THEN goal / a WHEN w >= tokens OR a <= full_ THEN 1 ELSE (goal - full_) / (a - full_) END)) AS w FROM s{k}_{n})")
    parts.append(f"p AS (SELECT source, lang, topic, w / tokens AS p FROM {last})")
    uniform = "CAST('0x' || substr(md5('mix' || doc_id), 1, 8) AS BIGINT) / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, d.lang, d.source, round(p, 6) AS probability FROM d JOIN p c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic WHERE {uniform} < p"


#: All orders of five filters and what each step of them removes, by documents' own failures.
AUDIT = r"""
WITH RECURSIVE told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE) AS e FROM t),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, e FROM w),
masked AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM f LEFT JOIN told ON told.doc_id = f.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, CAST(step AS INTEGER) AS step, substr(o, step, 1) AS x, 1 << (ascii(substr(o, step, 1)) - 65) AS bit,
                 list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN 1 << (ascii(substr(o, i, 1)) - 65) ELSE 0 END))::INT AS before
          FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
rows AS (SELECT part, filter_order, step, x,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM rows"""

#: Tokens by the pattern itself, cuts by lists of them.
INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k,
      CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(k) AS BIGINT) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS x, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS y,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(k[1:x], '') AS p, array_to_string(k[x + 1:y], '') AS m, array_to_string(k[y + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

SQL = {"op11_filter_audit": AUDIT, "op13_fill_in_middle": INFILL, "op1_minhash_near_dedup": NEAR_DUPLICATES, "op6_mixing": mixing_sql(), "op10_mtree_search": SEARCH}
