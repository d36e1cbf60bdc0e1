"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.llm import collocations, crf_toxicity, decontaminate, digest_merge, filter_audit, mcd_outliers, order_minhash, pii_surrogates, ppm_language, rendezvous, rff_quality, source_mix, token_rollups
from arlens.llm.common import crc_fold, read_table, shared_path, ship_package, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: DuckDB SQL of the queries SQL can express; the others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {}


def query(fn):
    """Register ``fn``; the package goes to the Python workers before it runs."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "set a secret key in production") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return pii_surrogates.pseudonymise(docs, key)


@query
def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held = crc_fold(4) == 2
    model = ppm_language.train(docs.filter(~held))
    r = F.col("_r")
    return ppm_language.predict(docs.select("doc_id", "text"), model, into="_r").select(
        "doc_id", held.alias("held_out"), r["lang"].alias("lang_pred"), r["score"].alias("score"),
        r["bits_per_byte"].alias("bits_per_byte"))



@query
def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    rows = rendezvous.assign(docs, [1.0] * 16, new_weight=1.0).drop("text")
    return rendezvous.with_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# The crc of a text is the reflected polynomial 0xEDB88320 byte by byte.
ORACLE["op3_rendezvous"] = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(strlen(text), 0) + 1 AS size,
       xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
         lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM documents, tab),
h AS (SELECT *, list_transform(range(17), lambda s: ('0x' || substr(md5(k || '/' || s), 1, 13))::BIGINT) AS u,
       ('0x' || substr(md5(k || '#' || text_crc32), 1, 13))::BIGINT AS o FROM d),
p AS (SELECT *, list_position(u[1:16], list_max(u[1:16])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard FROM h)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM p
"""


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return order_minhash.near_duplicates(docs).select("doc_id", "class_id", "links", "n_words")


@query
def op5_token_rollups(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Four commits: all documents; the later copies of equal texts leave; the others
    are recounted with runs of blanks collapsed; the second batch comes again."""
    blank = F.regexp_replace("text", "[ \\t]+", " ")
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]).withColumn("clean", F.when(blank != F.col("text"), blank))
    files = {"byte_bpe_50k": f"{folder}/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": f"{folder}/byte_bpe_multi_50k.tiktoken"}
    counted = token_rollups.count_tokens(docs, files)
    counted = token_rollups.count_tokens(counted, files, text="clean", into="_clean_tokens")
    rows = stored(counted.select("doc_id", "lang", "source", F.xxhash64("text").alias("hash"), F.col("clean").isNotNull().alias("revised"), "_tokens",
                                 token_rollups.bytes_of("text").alias("_bytes"), "_clean_tokens", token_rollups.bytes_of("clean").alias("_clean_bytes")), "counted")
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first"))
    rows = stored(rows.join(first, "hash").withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("first"))).drop("hash", "first"), "counted")
    rollup = token_rollups.Rollup(spark, shared_path(spark, "rollup"))
    copies = token_rollups.changes(rows.filter("copy"), -1)
    rollup.commit("1-insert", token_rollups.changes(rows, 1))
    rollup.commit("2-copies", copies)
    rollup.commit("3-blanks", token_rollups.revisions(rows.filter("revised AND NOT copy"), ("_tokens", "_bytes"), ("_clean_tokens", "_clean_bytes")))
    rollup.commit("2-copies", copies)
    return rollup.totals()


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    units = stored(source_mix.keyed(docs).withColumn("size", source_mix.word_count()).select(
        "doc_id", "size", "_mix_source", "_mix_key", "_mix_hash", "_mix_block"), "mix-units")
    return source_mix.apply_plan(units, source_mix.plan(units)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("mix_shards")).alias("taken"))


ORACLE["op6_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
       coalesce(CAST(doc_id AS VARCHAR), '') AS k,
       ('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS h,
       CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS sk FROM documents),
w AS (SELECT sk, sum(size)::BIGINT AS src, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS wt
      FROM d GROUP BY sk, source),
c AS (SELECT *, (SELECT sum(src) FROM w) - coalesce(sum(3 * src) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
       sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum
      FROM w WINDOW o AS (ORDER BY 3.0 * src / wt, sk)),
e AS (SELECT *, 3 * src * wsum <= wt * remain AS capped FROM c),
f AS (SELECT max(wsum) FILTER (WHERE NOT capped) AS wopen,
       max(remain) FILTER (WHERE NOT capped) AS ropen FROM e),
t AS (SELECT sk, src, CASE WHEN capped THEN 3.0 * src ELSE CAST(wt * ropen AS DOUBLE) / wopen END::DOUBLE AS target FROM e, f),
r AS (SELECT *, CASE WHEN src > 0 THEN least(3, floor(target / src)) ELSE 0 END AS times FROM t),
q AS (SELECT *, CASE WHEN src > 0 THEN target - times * src ELSE 0 END AS rest FROM r),
b AS (SELECT sk, h >> 42 AS block, sum(size) AS words, ('0x' || substr(md5('block/' || sk || '/' || (h >> 42)), 1, 13))::BIGINT AS draw
      FROM d GROUP BY sk, h >> 42),
bc AS (SELECT *, sum(words) OVER (PARTITION BY sk ORDER BY draw, block) - words AS before FROM b),
u AS (SELECT sk, h, k, h >> 42 AS block, sum(size) AS usize FROM d GROUP BY sk, h, k),
uc AS (SELECT *, sum(usize) OVER (PARTITION BY sk, block ORDER BY h, k) AS upto FROM u)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(q.src AS BIGINT) AS source_size, q.target,
       CAST(d.size * (q.times + CASE WHEN q.rest > 0 AND 2 * (bc.before + uc.upto) - uc.usize <= 2 * q.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q USING (sk) JOIN uc ON uc.sk = d.sk AND uc.h = d.h AND uc.k = d.k JOIN bc ON bc.sk = d.sk AND bc.block = uc.block
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    items = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontaminate.leaks(docs, items).drop("text_hash")


@query
def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    held = crc_fold(5) == 0
    model = crf_toxicity.train(docs, labels.filter(~held))
    return crf_toxicity.score(docs, model, into="_r").select(
        "doc_id", held.alias("held_out"), F.col("_r")["score"].alias("score"),
        crf_toxicity.is_toxic("_r").cast("int").alias("predicted"), F.col("_r")["spans"].alias("spans"))


@query
def op9_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    held = crc_fold(5) == 0
    rows = rff_quality.measured(docs)
    model = rff_quality.train(rows, labels.filter(~held))
    return rff_quality.score(rows, model, into="score").select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return mcd_outliers.judged(docs)


@query
def op11_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return digest_merge.exact_groups(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op11_digest_merge"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return filter_audit.filter_audit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


ORACLE["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
       coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
       (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
       + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT
       + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * e::INT AS bits FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bs
      FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
s AS (SELECT filter_order, step, bs[step] AS b, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS INTEGER) AS prev FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
k AS (SELECT DISTINCT part FROM c),
r AS (SELECT k.part, s.filter_order, s.step, s.b,
       coalesce(sum(n) FILTER ((bits & (prev | b)) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER ((bits & prev) = 0 AND (bits & b) <> 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER ((bits & prev) <> 0 AND (bits & b) <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (bits = b), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER ((bits & prev) = 0 AND (bits & b) <> 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER ((bits & prev) = 0 AND (bits & b) <> 0), 0)::BIGINT AS toxic_lost
      FROM k JOIN c USING (part), s GROUP BY k.part, s.filter_order, s.step, s.b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents", ["text", "lang"]))


ORACLE["op13_collocations"] = r"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
y AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda z: z <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM x)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM y),
c1 AS (SELECT lang, w[i] AS p, count(*) AS n FROM o GROUP BY ALL),
c2 AS (SELECT lang, w[i] AS u, w[i + 1] AS v, count(*) AS n FROM o WHERE i + 1 <= len(w) GROUP BY ALL),
c3 AS (SELECT lang, w[i] AS u, w[i + 1] AS v, w[i + 2] AS z, count(*) AS n FROM o WHERE i + 2 <= len(w) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM c1 GROUP BY lang),
s2 AS (SELECT c2.lang, c2.u || ' ' || c2.v AS phrase, c2.u, c2.v, c2.n AS a, l.n AS l, r.n AS r,
       (1000000::HUGEINT * c2.n * c2.n // (l.n::HUGEINT * r.n))::BIGINT AS score
       FROM c2 JOIN c1 l ON l.lang = c2.lang AND l.p = c2.u JOIN c1 r ON r.lang = c2.lang AND r.p = c2.v WHERE c2.n >= 10),
s3 AS (SELECT c3.lang, c3.u, c3.v, c3.z, c3.n AS a, l1.n AS l1, r1.n AS r1, l2.n AS l2, r2.n AS r2,
       (1000000::HUGEINT * c3.n * c3.n // (l1.n::HUGEINT * r1.n))::BIGINT AS k1,
       (1000000::HUGEINT * c3.n * c3.n // (l2.n::HUGEINT * r2.n))::BIGINT AS k2
       FROM c3 JOIN c1 l1 ON l1.lang = c3.lang AND l1.p = c3.u JOIN c2 r1 ON r1.lang = c3.lang AND r1.u = c3.v AND r1.v = c3.z
       JOIN c2 l2 ON l2.lang = c3.lang AND l2.u = c3.u AND l2.v = c3.v JOIN c1 r2 ON r2.lang = c3.lang AND r2.p = c3.z WHERE c3.n >= 10),
h AS (SELECT lang, u, v, max(a) AS cover FROM (SELECT lang, u, v, a FROM s3 UNION ALL SELECT lang, v, z, a FROM s3) GROUP BY ALL),
b AS (SELECT s2.lang, phrase, a, l, r, score FROM s2 LEFT JOIN h USING (lang, u, v) WHERE cover IS NULL OR 100 * cover < 50 * a
      UNION ALL SELECT lang, u || ' ' || v || ' ' || z, a, CASE WHEN k1 <= k2 THEN l1 ELSE l2 END, CASE WHEN k1 <= k2 THEN r1 ELSE r2 END, least(k1, k2) FROM s3),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
