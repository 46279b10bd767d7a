"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), usable AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
), least AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.id = v.vec_id
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS g FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN reach r ON r.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP9_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9)) ELSE [w] END) AS win
  FROM iw WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT len(win) AS m FROM windows
), places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths
), hits AS (
  SELECT p.doc_id, p.i, p.m, x.item FROM (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win FROM places) p JOIN windows x ON x.win = p.win
), words AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)) AS items FROM hits GROUP BY doc_id
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), exact AS (
  SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM counts) * (1000 - (SELECT count(*) FROM counts)) AS x FROM counts
), ranked AS (
  SELECT source, floor(x)::BIGINT AS low, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS r FROM exact
), weights AS (
  SELECT source, low + 1 + CASE WHEN r <= 1000 - (SELECT sum(low + 1) FROM ranked) THEN 1 ELSE 0 END AS q,
         row_number() OVER (ORDER BY source) AS i FROM ranked
), lists AS (
  SELECT list(q ORDER BY i) AS q, count(*) AS m FROM weights
), sched AS (
  SELECT 0 AS t, NULL::BIGINT AS i, list_transform(q, lambda x: 0::BIGINT) AS n FROM lists
  UNION ALL
  SELECT t + 1, i, list_transform(n, lambda v, j: v + CASE WHEN j = i THEN 1 ELSE 0 END)
  FROM (SELECT t, n, list_min(list_filter(list_transform(q, lambda x, j:
            CASE WHEN (n[j] * 1000) // x <= t THEN (((n[j] + 1) * 1000 + x - 1) // x) * 100000 + j END),
            lambda d: d IS NOT NULL)) % 100000 AS i
        FROM sched, lists WHERE t < 1000)
), slots AS (
  SELECT w.source, w.q, s.t - 1 AS at, row_number() OVER (PARTITION BY w.source ORDER BY s.t) - 1 AS k
  FROM sched s JOIN weights w ON w.i = s.i
), ranks AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY coalesce(source, '')
           ORDER BY substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15), doc_id) - 1 AS rk FROM documents
), blocks AS (
  SELECT d.doc_id, d.source, d.rk // 64 AS block, d.rk % 64 AS place, w.q, (d.rk // 64) // w.q AS round, (d.rk // 64) % w.q AS k
  FROM ranks d JOIN weights w ON w.source = coalesce(d.source, '')
)
SELECT b.doc_id, b.source, b.block, b.place, b.round * 1000 + s.at AS slot,
       b.round * 1000 + (b.k * 1000) // b.q AS release, b.round * 1000 + ((b.k + 1) * 1000 + b.q - 1) // b.q AS deadline
FROM blocks b JOIN slots s ON s.source = coalesce(b.source, '') AND s.k = b.k
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS place, {_TERMS} AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), s AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM t WHERE len(w) > 0
), tf AS (
  SELECT doc_id, place, n, term, count(*) AS tf FROM (SELECT doc_id, place, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), x AS (
  SELECT doc_id, place, term, ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))
         * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS v
  FROM tf JOIN df USING (term), s
), scores AS (
  SELECT item_id, doc_id, place, sum(v)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
