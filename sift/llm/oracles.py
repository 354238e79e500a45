"""DuckDB SQL for the registered queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM tokens
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id
"""

DECONTAMINATION = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, size, i, item_id FROM places JOIN windows USING (size, s)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) AS escaped,
    coalesce(lag(role) OVER w = role, false) AS goes_on
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN goes_on THEN length('<|im_turn|>') ELSE length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10)) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

LEXICAL_SEARCH = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), size AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM doc WHERE len(w) > 0
), tf AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM doc) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY t, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t), size GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50
"""

RESAMPLING = rf"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), raw AS (
  SELECT doc_id, unnest(w) AS f FROM doc
), target AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), bytes AS (
  SELECT f, list_transform(range(1, 2 * strlen(f), 2), lambda i: CAST('0x' || substr(hex(encode(f)), i, 2) AS BIGINT)) AS b
  FROM (SELECT f FROM raw UNION SELECT f FROM target)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), s AS (
  SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM target JOIN hashed USING (f) GROUP BY bucket
), total AS (
  SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM s) AS s, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM t) AS t
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000) / ((s.n + 1) * (total.t + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), total
), weighed AS (
  SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM raw JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS candidate,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN candidate AND place <= 10 * (SELECT count(*) FROM scored WHERE candidate) // 100 THEN place END AS rank
FROM placed
"""
