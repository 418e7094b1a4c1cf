"""DuckDB SQL for the training-data queries that SQL can express, by plain counting and ranking."""

from __future__ import annotations

from quarry.llm import licenses, linkgraph, mixing
from quarry.llm.common import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"

MIX = f"""WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
         md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(sqrt(count(*))) AS BIGINT) AS shards FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
o AS (SELECT *, row_number() OVER z AS k,
             CAST(coalesce(sum(3 * source_size) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS given,
             CAST(sum(w) OVER () - coalesce(sum(w) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest
      FROM w WINDOW z AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
f AS (SELECT min(k) AS k, arg_min(given, k) AS given, arg_min(rest, k) AS rest FROM o
      WHERE NOT 3 * source_size * rest < (total - given) * w),
t AS (SELECT o.source, source_size, shards, total, greatest(1, total // {mixing.BLOCKS}) AS block,
             CASE WHEN f.k IS NULL OR o.k < f.k THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST((total - f.given) * w AS DOUBLE) / f.rest END AS target FROM o, f),
q AS (SELECT source, target / (2 * k + 1) AS quotient
      FROM (SELECT *, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + (SELECT count(*) FROM t) + 1)) AS k FROM t WHERE target > 0)),
won AS (SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) AS r FROM q)
        WHERE r <= (SELECT any_value(total // block) FROM t) GROUP BY source),
u AS (SELECT t.*, least(coalesce(won.n, 0), 3 * source_size // block) AS seats
      FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source),
p AS (SELECT d.*, CAST('0x' || substr(digest, 1, 12) AS BIGINT) % u.shards AS shard, source_size, target, block, seats
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
g AS (SELECT source, shard, block, seats, CAST(sum(size) AS BIGINT) AS votes FROM p GROUP BY ALL),
h AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, sum(votes) OVER (PARTITION BY source) AS every FROM g),
c AS (SELECT source, shard, seats, votes / (2 * k + 1) AS quotient
      FROM (SELECT *, unnest(range(0, CAST(ceil(votes * (seats + n / 2) / every) AS BIGINT) + 2)) AS k FROM h WHERE votes > 0)),
e AS (SELECT source, shard, count(*) AS quota FROM
      (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard) AS r FROM c) WHERE r <= seats GROUP BY ALL),
ring AS (SELECT g.source, g.shard, votes, least(coalesce(quota, 0) * block, 3 * votes) AS length,
                CASE WHEN votes > 0 THEN CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(g.source, 'null') || ':' || g.shard), 1, 12) AS BIGINT) % votes
                     ELSE 0 END AS put
         FROM g LEFT JOIN e ON g.source IS NOT DISTINCT FROM e.source AND g.shard = e.shard),
x AS (SELECT p.*, votes, length, put, CASE WHEN votes > 0 THEN length % votes ELSE 0 END AS part,
             coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY digest, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM p JOIN ring ON p.source IS NOT DISTINCT FROM ring.source AND p.shard = ring.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN votes > 0 THEN length // votes * size
  + greatest(0, least(start + size, put + part) - greatest(start, put)) + greatest(0, least(start + size, put + part - votes) - greatest(start, 0))
  ELSE 0 END AS BIGINT) AS taken FROM x"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _license_sql() -> str:
    step = max(len(t.split()) for t in licenses.TEMPLATES)
    places = []
    for phrase, label in licenses.PHRASES.items():
        ws = phrase.split()
        here = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        places.append(f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(0, len(w) - {len(ws) - 1})) AS i FROM d) WHERE {here}")
    templates = ", ".join(f"('{v}', {_list(dict.fromkeys(t.split()))})" for t, v in licenses.TEMPLATES.items())
    return f"""WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.WORD}') AS w FROM documents),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(w[a + 1:a + {2 * step}]) AS tokens FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS a FROM d)),
templates(label, tokens) AS (VALUES {templates}),
shares AS (SELECT doc_id, label, len(list_intersect(blocks.tokens, templates.tokens)) / len(templates.tokens) AS share
           FROM blocks, templates WHERE list_has_any(blocks.tokens, templates.tokens)),
met AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares WHERE share >= {licenses.CONTAINMENT} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)"""


def _url_sql() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in linkgraph.RULES.items())
    quoted = linkgraph.LINK.replace("'", "''")
    stays, moves = repr(1 - linkgraph.DAMPING), repr(linkgraph.DAMPING)

    def rounds(name: str, source: str, target: str, seed: str) -> str:
        out = [f"{name}0 AS (SELECT host, {seed} * {stays}::DOUBLE AS mass FROM hosts WHERE {seed} > 0)"]
        for i in range(linkgraph.ROUNDS):
            out.append(f"{name}{i + 1} AS (SELECT host, sum(mass) AS mass FROM (SELECT {target} AS host, {moves}::DOUBLE * w * mass AS mass "
                       f"FROM edges JOIN {name}{i} ON {source} = host UNION ALL SELECT host, mass FROM {name}0) GROUP BY host)")
        return ",\n".join(out)

    return f"""WITH rest AS (SELECT page_id, html, {rest} AS rest FROM pages),
split AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(name, start, rule, verdict) AS (VALUES {rules}),
ruled AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS said
          FROM split LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (WHERE said = 'allow') AS good, count(*) FILTER (WHERE said = 'block') AS bad
          FROM ruled GROUP BY host),
up AS (SELECT a.host AS src, b.host AS dst FROM hosts a JOIN hosts b ON b.host = substr(a.host, instr(a.host, '.') + 1) AND instr(b.host, '.') > 0),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{quoted}', 1)), '{UPPER}', '{LOWER}') AS dst FROM split
        UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up),
counted AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM counted),
{rounds('trust', 'src', 'dst', 'good')},
{rounds('distrust', 'dst', 'src', 'bad')},
low AS (SELECT host FROM hosts LEFT JOIN trust{linkgraph.ROUNDS} t USING (host) LEFT JOIN distrust{linkgraph.ROUNDS} d USING (host)
        WHERE host <> '' AND coalesce(d.mass, 0) - coalesce(t.mass, 0) >= {linkgraph.THRESHOLD} * {stays}::DOUBLE * pages)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM low) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


ORACLE_SQL = {"op1_mix_sources": MIX, "op2_license_scan": _license_sql(), "op4_url_filter": _url_sql()}
