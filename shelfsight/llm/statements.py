"""SQL beside the queries over whole tables, for those whose result SQL can state."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SOURCE_AUDIT = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
     w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
     langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     own AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
     sums AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source),
     shares AS MATERIALIZED (
         SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
                CAST(1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 1)) // (coalesce(sums.n, 0) + langs.v) AS BIGINT) AS p,
                CAST(1 + (1000000000::HUGEINT * (kept.lang_n + 1)) // (langs.n + langs.v) AS BIGINT) AS q
         FROM g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang
         LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source
         LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
               FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     parts AS (
         SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
         UNION ALL
         SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""


def _vector_codes(rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
     a{k} AS MATERIALIZED (
         SELECT p.rid, p.pos, min(struct_pack(apart := p.square + c.square - 2 * list_inner_product(p.part, c.part), entry := c.entry)) AS near
         FROM p JOIN c{k} c ON p.pos = c.pos GROUP BY p.rid, p.pos)""")
        if k < rounds:
            steps.append(f"""
     s{k} AS (SELECT pos, near.entry AS entry, i, count(*) AS n, CAST(sum(CAST(part[i] AS BIGINT)) AS BIGINT) AS s
              FROM a{k} JOIN p USING (rid, pos), range(1, len(part) + 1) t(i) GROUP BY ALL),
     u{k} AS (SELECT pos, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS part FROM s{k} GROUP BY pos, entry),
     c{k + 1} AS MATERIALIZED (
         SELECT pos, entry, part, list_inner_product(part, part) AS square
         FROM (SELECT c.pos, c.entry, coalesce(u.part, c.part) AS part FROM c{k} c LEFT JOIN u{k} u ON u.pos = c.pos AND u.entry = c.entry))""")
    last = rounds
    return f"""
WITH v AS MATERIALIZED (
         SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
         FROM embeddings
         WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     p AS MATERIALIZED (
         SELECT rid, pos, part, list_inner_product(part, part) AS square
         FROM (SELECT rid, pos, v[pos * (len(v) // 4) + 1 : (pos + 1) * (len(v) // 4)] AS part FROM v, range(4) t(pos))),
     c0 AS MATERIALIZED (SELECT pos, rid - 1 AS entry, part, square FROM p WHERE rid <= 256),{",".join(steps)},
     coded AS (SELECT rid, string_agg(format('{{:02x}}', near.entry), '' ORDER BY pos) AS code, CAST(sum(CAST(near.apart AS BIGINT)) AS BIGINT) AS error
               FROM a{last} GROUP BY rid),
     books AS (SELECT sha256(string_agg(CAST(CAST(part[i] AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, i)) AS told
               FROM c{last}, range(1, len(part) + 1) t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books.told AS codebooks_sha256
FROM coded JOIN v USING (rid), books
"""


VECTOR_CODES = _vector_codes()

NEAR_VECTORS = """
WITH RECURSIVE
     r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v,
                               coalesce(len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                                        AND len([x FOR x IN embedding IF x <> 0]) > 0, false) AS sound FROM embeddings),
     links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM r a JOIN r b ON a.rid <> b.rid AND a.sound AND b.sound
                            WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
     reach AS (SELECT rid AS a, rid AS b FROM r UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
     least AS (SELECT reach.a AS rid, min(r.vec_id) AS component_id FROM reach JOIN r ON r.rid = reach.b GROUP BY reach.a),
     degree AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, least.component_id, r.vec_id IS NOT DISTINCT FROM least.component_id AS kept
FROM r JOIN least USING (rid) LEFT JOIN degree USING (rid)
"""
