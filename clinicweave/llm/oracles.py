"""DuckDB SQL for the training-data queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = """WITH RECURSIVE l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS nr, unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)))) AS line FROM l0 WHERE text IS NOT NULL),
ln AS (SELECT doc_id, nr, line, length(line) AS n FROM l1 WHERE length(line) > 0),
f AS (SELECT line, n, min({'d': doc_id, 'a': nr}) AS pos FROM ln GROUP BY line, n),
k AS (SELECT line, n, pos, m, m // 2 AS p FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= 16)),
h AS (SELECT line, n, pos, m, 0 AS side, substr(line, 1, p) AS part FROM k UNION ALL SELECT line, n, pos, m, 1, substr(line, n - (m - p) + 1) FROM k),
c AS (SELECT DISTINCT a.line AS a, a.n AS na, b.line AS b, b.n AS nb FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.pos < a.pos AND a.line <> b.line),
near AS (SELECT DISTINCT a AS line FROM c WHERE CASE
 WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: substr(a, 1, i - 1) = substr(b, 1, i - 1) AND substr(a, i + 1) = substr(b, i + 1))) > 0
 WHEN na = nb + 1 THEN len(list_filter(range(1, na + 1), lambda i: substr(a, 1, i - 1) || substr(a, i + 1) = b)) > 0
 WHEN nb = na + 1 THEN len(list_filter(range(1, nb + 1), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = a)) > 0 ELSE false END),
gone AS (SELECT doc_id, nr FROM ln JOIN f USING (line) WHERE {'d': doc_id, 'a': nr} <> f.pos UNION SELECT doc_id, nr FROM ln WHERE line IN (SELECT line FROM near)),
g AS (SELECT doc_id, list(nr) AS nrs FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(nrs), 0) AS BIGINT) AS n_removed,
 CASE WHEN nrs IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(nrs, i - 1)), chr(10)), '') END AS text FROM l0 LEFT JOIN g USING (doc_id)"""

OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM m"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
r AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT rep AS v, rep AS c FROM r UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.v = links.a),
home AS (SELECT v, min(c) AS c FROM reach GROUP BY v), t AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_shingles, coalesce(home.c, t.doc_id) AS component_id FROM t LEFT JOIN r ON t.n > 0 AND r.sh = t.sh LEFT JOIN home ON home.v = r.rep"""

OP8 = """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v) AS score FROM x a, x b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

OP12 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS pos FROM c),
s AS (SELECT cut.lang, cut.phrase, a, pos, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1 : pos], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[pos + 1 : cut.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
i AS (SELECT lang, a, ws, k, m, unnest(range(1, k - m + 2)) AS pos FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k), o AS (SELECT lang, array_to_string(ws[pos : pos + m - 1], ' ') AS phrase, max(a) AS over FROM i GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN tot USING (lang) WHERE rank <= 2000"""


def _op13(k: int = 8, rounds: int = 10) -> str:
    """Each round's assignment and centroids as a table of their own."""
    parts = ["""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM x QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x.v, c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))::BIGINT AS d FROM x, c{r} y QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(parts)}, t AS (SELECT c, sum(d)::BIGINT AS t FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, t AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(y.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} y USING (c) JOIN t USING (c)"""


ORACLES = {"op4_line_dedup": OP4, "op6_warc": OP6, "op7_ngram_jaccard": OP7, "op8_ann": OP8, "op12_phrases": OP12, "op13_clusters": _op13()}
