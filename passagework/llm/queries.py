"""The operators of this package as queries over the given tables, with SQL twins where SQL can tell."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe_tree, fm_index, hard_negatives, importance, katz, langid, ngram_join, odd_sketch, range_coder, site_quality, wand
from passagework.llm.common import new_path, table
from passagework.llm.decontaminate import RESULTS as JUDGED
from passagework.llm.decontaminate import judge
from passagework.llm.line_windows import remove_repeated_windows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep_text=False)
    return judged.select("doc_id", *JUDGED)


def op2_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return wand.top_k(docs.where("doc_id % 100 = 0"), docs)


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fm_index.remove_repeats(texts(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are of quality 1 and not toxic; the source is the host, source and language the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select(
        F.col("doc_id").alias("label_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    labelled = docs.join(labels, docs["doc_id"] == labels["label_id"]).select("doc_id", "text", "good")
    rated = site_quality.rate(docs, site_quality.train(labelled), F.col("source"), F.concat_ws("/", "source", "lang"))
    return rated.select("doc_id", held_out.alias("held_out"), *site_quality.RESULTS)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = katz.score_texts(texts(spark, sf_dir), ~held_out, order=3)
    return scored.withColumn("held_out", held_out)


def op6_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(texts(spark, sf_dir), size=3, percent=85)


def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    range_coder.write(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return range_coder.read(spark, folder, with_ids=False)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    filters = langid.train(docs.where(~held_out))
    predicted = langid.predict(docs.drop("lang"), filters, keep_text=False)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_tree.encode(texts(spark, sf_dir), path, keep_text=False)
    decoded = bpe_tree.decode(encoded, path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_windows(texts(spark, sf_dir))
    return cut.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep_text=False)
    return drawn.select("doc_id", *importance.RESULTS)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_rows(texts(spark, sf_dir), size=4, percent=85)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_wand": op2_wand,
    "op3_fm_index": op3_fm_index,
    "op4_site_quality": op4_site_quality,
    "op5_katz": op5_katz,
    "op6_odd_sketch": op6_odd_sketch,
    "op7_range_coder": op7_range_coder,
    "op8_langid": op8_langid,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_line_windows": op10_line_windows,
    "op11_cover_tree": op11_cover_tree,
    "op12_importance": op12_importance,
    "op13_ngram_join": op13_ngram_join,
}

SQL = {
    "op1_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM ds),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op2_wand": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size
  FROM (SELECT doc_id, unnest(w) AS term, len(w) AS size FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(
    ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / average))), 6) AS score
  FROM p q JOIN p ON q.term = p.term JOIN f ON f.term = p.term CROSS JOIN n
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""",
    "op3_fm_index": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS win FROM i),
nth AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM win),
cut AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM nth WHERE nth > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_odd_sketch": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, min(y) = d.doc_id AS kept
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op10_line_windows": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS pos FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, pos, l[pos : pos + 2] AS win FROM s
  WHERE len(list_filter(l[pos : pos + 2], lambda x: regexp_matches(x, '[^ \t\r\f\v]'))) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w),
cut AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE nth > 1),
line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM d),
left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n
  FROM line ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(l), 0) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)""",
    "op11_cover_tree": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same,
    CAST(list_sum(list_transform(list_zip(a.p, v.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5""",
    "op12_importance": r"""
WITH x AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
w AS (SELECT side, id, row_number() OVER () AS nr, coalesce(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM x),
f AS (SELECT side, nr, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
n AS (SELECT side, nr, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(
    list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda a, byte: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, byte)),
    4294967295), 4294967295) % 10000 AS b FROM h),
c AS (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM n JOIN b USING (f) GROUP BY b),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE)
  / (CAST(c.s + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c, z),
m AS (SELECT nr, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM n JOIN b USING (f) JOIN g USING (b) GROUP BY nr),
d AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN m USING (nr) WHERE side = 's'),
r AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) OVER (PARTITION BY n_words >= 20) AS total FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * total // 100 THEN place END AS rank FROM r""",
    "op13_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS ngram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (ngram)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
}
