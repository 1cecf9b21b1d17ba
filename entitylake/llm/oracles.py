"""SQL for the operators that SQL can express, over the driver tables."""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts JOIN rules
    ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, doc_id::VARCHAR AS id,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), placed AS (
  SELECT *, row_number() OVER w AS place,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM s WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), first AS (
  SELECT place AS p, rest AS r, open AS o FROM placed WHERE weight * rest <= cap * open ORDER BY place LIMIT 1
), shares AS (
  SELECT source, source_size,
         CASE WHEN p IS NULL OR place < p THEN cap::DOUBLE ELSE (weight * r)::DOUBLE / o::DOUBLE END AS target
  FROM placed LEFT JOIN first ON true
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain FROM shares
), wanted AS (
  SELECT *, round(target - certain * source_size)::BIGINT AS wanted FROM rates
), ranked AS (
  SELECT d.*, w.source_size, w.target, w.certain, w.wanted,
         row_number() OVER (PARTITION BY d.source ORDER BY u, d.id, size) AS place,
         sum(size) OVER (PARTITION BY d.source ORDER BY u, d.id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
), cut AS (
  SELECT source AS cs, coalesce(max(upto) FILTER (WHERE upto <= wanted), 0) AS taken FROM ranked GROUP BY source
), filler AS (
  SELECT source AS fs, arg_min(place, (abs(wanted - taken - size), u, id, size, place)) AS fp
  FROM ranked r JOIN cut c ON r.source IS NOT DISTINCT FROM c.cs
  WHERE upto > wanted AND size > 0 AND abs(wanted - taken - size) < wanted - taken GROUP BY source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (certain + CASE WHEN wanted > 0 AND size > 0 AND (upto <= wanted OR coalesce(place = fp, false))
                               THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked LEFT JOIN filler ON source IS NOT DISTINCT FROM fs
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SHARDING = r"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         right(lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT), 64, '0'), 60) AS h
  FROM documents
), nodes AS (
  SELECT depth, left(h, depth) AS shard, sum(n_bytes) AS shard_bytes
  FROM (SELECT h, n_bytes, unnest(range(0, 61))::INT AS depth FROM d) GROUP BY ALL
), fits AS (
  SELECT h, n_bytes, doc_id, min(n.depth) AS depth
  FROM d JOIN nodes n ON left(h, n.depth) = n.shard AND (n.shard_bytes <= 1048576 OR n.depth = 60) GROUP BY ALL
)
SELECT f.doc_id, f.n_bytes, n.shard, f.depth, n.shard_bytes::BIGINT AS shard_bytes, n.shard_bytes > 1048576 AS oversized
FROM fits f JOIN nodes n ON n.depth = f.depth AND n.shard = left(f.h, f.depth)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM g a JOIN g b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * s >= 85 * (a.n + b.n - s)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


def _crc_table() -> list[int]:
    """The table of the checksum CRC-32, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


#: Letters of the runs take one or two bytes in UTF-8; words are near if one has the other's pattern with a letter left out.
SPELLINGS = r"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(CRC_TABLE[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM bytes
), made AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM made GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5
), cuts AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT a, count(*) AS n_near, max(m) AS top FROM near GROUP BY a
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n,
         CASE WHEN top >= 2 * w.n THEN (SELECT min(b) FROM near WHERE near.a = w.word AND near.m = best.top) END AS form
  FROM words w LEFT JOIN best ON best.a = w.word
), paths AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_min(root, n) AS root FROM (SELECT p.word, p.root, -f.n AS n FROM paths p JOIN forms f ON f.word = p.root) GROUP BY word) p USING (word)
""".replace("WITH runs", "WITH RECURSIVE runs").replace("CRC_TABLE", str(_crc_table()))

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
       n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {
    "op2_url_filters": URL_FILTERS,
    "op8_mixing": MIXING,
    "op9_top_k": TOP_K,
    "op10_sharding": SHARDING,
    "op11_jaccard_join": JACCARD_JOIN,
    "op12_spellings": SPELLINGS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
