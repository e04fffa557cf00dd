"""DuckDB SQL for the results that SQL can express, over whole tables."""

from __future__ import annotations

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents), b AS (SELECT item_id, {_ALNUM.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) l ON len(w) >= n) x),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) x GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PHRASES = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
marked AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY 1) f USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM marked),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE len(x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r(node, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.node = vec_id
"""

# CRC-32 of strings of characters up to 07FF, through a table of its 256 steps
_CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c // 2, (c % 2) * 3988292384))) AS crc_table"
_UTF8 = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] WHEN ord(x) < 2048 THEN [192 + ord(x) // 64, 128 + ord(x) % 64] ELSE [224 + ord(x) // 4096, 128 + ord(x) // 64 % 64, 128 + ord(x) % 64] END))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, {_UTF8}), lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1])))"

RESAMPLE = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents), e AS (SELECT {_ALNUM.format('text')} AS w FROM benchmark), k AS ({_CRC_TABLE}),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
ef AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM e),
known AS (SELECT f, {_CRC.format('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM ef) x) y, k),
db AS (SELECT doc_id, bucket FROM df JOIN known USING (f)), s AS (SELECT bucket, count(*) AS s FROM db GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM ef JOIN known USING (f) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM ef)::DOUBLE AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM db JOIN g USING (bucket) GROUP BY 1),
v AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - (total % n_features + n_features) % n_features) // n_features END AS weight,
  ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM r
"""

SPELLING = f"""
WITH RECURSIVE k AS ({_CRC_TABLE}), r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) x),
g AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY 1, 2), h AS (SELECT run, c, {_CRC.format("doc_id || ':' || run")} AS h FROM g, k),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
s AS (SELECT word, n, substr(word, 1, i) || chr(0) || substr(word, i + 2) AS gap FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w) x),
p AS (SELECT word, n, substr(word, 1, i) || chr(0) || substr(word, i + 1) AS gap FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM w) x),
a AS (SELECT x.word, y.word AS near, y.n FROM s x JOIN s y USING (gap) WHERE x.word <> y.word UNION SELECT x.word, y.word, y.n FROM s x JOIN p y USING (gap) UNION SELECT y.word, x.word, x.n FROM s x JOIN p y USING (gap)),
b AS (SELECT word, near, n AS near_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM w LEFT JOIN (SELECT * FROM b WHERE place = 1) c USING (word)),
z(word, root, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT z.word, f.form, d + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, d) AS root FROM z GROUP BY 1) y USING (word)
"""

COPIES = f"""
WITH d AS (SELECT doc_id, {_FOLD.format('text')} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM d WINDOW same AS (PARTITION BY t)
"""

ORACLE_SQL = {"op5_embedding_dedup": EMBEDDINGS, "op7_phrase_dedup": PHRASES, "op8_decontaminate": DECONTAMINATE, "op11_importance_resample": RESAMPLE, "op12_stream_dedup": COPIES, "op13_spelling_variants": SPELLING}
