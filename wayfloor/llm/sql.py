"""SQL counterparts, for DuckDB, of the queries that SQL can express on whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Components of links ``e(s, t)``, both ways, over ``v(id)``: the least id of each.
COMPONENTS = "cc(id, l) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT e.t, min(c.l) FROM cc c JOIN e ON c.id = e.s JOIN recurring.cc r ON r.id = e.t WHERE c.l < r.l GROUP BY e.t)"

OP9 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM b WHERE len(w) > 0) q),
dw AS (SELECT rid, m, j, array_to_string(w[j:j + m - 1], ' ') AS k FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM bw) s WHERE len(w) >= m) q),
hit AS MATERIALIZED (SELECT DISTINCT rid, j, m, item_id FROM dw JOIN bw USING (m, k)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + m)) AS p FROM hit) q GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, s, len(bin(count(*))) AS u FROM (SELECT doc_id, array_to_string(w[j:j + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM d WHERE len(w) > 0) q
    UNION ALL SELECT doc_id, '#' || trim(text) FROM d WHERE len(w) = 0 AND trim(coalesce(text, '')) <> '') q GROUP BY doc_id, s),
n AS (SELECT doc_id, sum(u) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.u, b.u)) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT unnest([a, b]) AS s, unnest([b, a]) AS t FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 10 >= 8 * (x.n + y.n - k)),
v AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
SELECT doc_id, l AS component_id, doc_id = l AS kept FROM documents JOIN cc ON cc.id = doc_id
"""

OP10 = f"""
WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
e AS MATERIALIZED (SELECT unnest([a, b]) AS s, unnest([b, a]) AS t FROM p), v AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS},
n AS (SELECT s AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, l AS component_id, vec_id = l AS kept FROM embeddings JOIN cc ON cc.id = vec_id LEFT JOIN n USING (vec_id)
"""


OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[j:j + k - 1], ' ') AS phrase
    FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM w, unnest([1, 2, 3, 4]) t(k) WHERE len(w) >= k) q) q GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, i, x.f AS l, y.f AS r, CAST((CAST(c.f AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM cuts) q WHERE nth = 1),
inside AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c) q) q GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _op13(rounds: int = 4) -> str:
    """Rounds of codebooks written out; dot products of doubles are exact below 2^53."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 1024)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, unnest(range(4)) t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM x WHERE rid <= 256)"""
    ]
    assign = "SELECT rid, p, e, x, d FROM (SELECT rid, p, e, x, d, row_number() OVER (PARTITION BY rid, p ORDER BY d, e) AS k FROM (SELECT rid, p, e, x, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM x JOIN b{r} USING (p)) q) q WHERE k = 1"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM (SELECT p, e, i, sum(CAST(y AS BIGINT)) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) q GROUP BY p, e, i) q GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"""
            )
    steps.append(
        f"""books AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS sha FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b{rounds}) q),
coded AS (SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)"""
    )
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM kept JOIN coded USING (rid), books
"""


ORACLES = {"op2_minhash_near_dedup": OP2, "op9_benchmark_decontamination": OP9, "op10_embedding_near_dedup": OP10, "op12_phrase_collocations": OP12, "op13_vector_codes": _op13()}
