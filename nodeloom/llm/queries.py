"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import bytebpe, hnsw, infill, langid, ngram_lm, runs, sharding, simhash, tokencount, toxicity, urlfilter, warc
from nodeloom.llm.decontam import benchmark_matches
from nodeloom.llm.storage import bounded_batches, held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=~held_out(F.col("doc_id"), 4, 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(~held_out(F.col("doc_id"), 7, 2)))
    return ngram_lm.score(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, allowed=~held_out(F.col("doc_id"), 3, 1))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_digests(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages"))
    is_response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(F.col("told_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 4).alias("score"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in the texts whose crc32 h of the doc_id ends in 0, the words from a on repeat the p words there.

    Of n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), with g = floor(h / 10).  A null doc_id has no h.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    origin = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", origin(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    denser = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    rows = rows.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), denser))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("told", infill.digests(F.col("output"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "told.output_sha256", "told.restored_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_simhash_near_dedup,
        op3_toxicity,
        op4_lm_scoring,
        op5_language_id,
        op6_bpe_roundtrip,
        op7_sharding,
        op8_decontamination,
        op9_token_counts,
        op10_warc,
        op11_url_filters,
        op12_periodic_runs,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN parts USING (vec_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op11_url_filters": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN suffix('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN suffix('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN suffix('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN suffix('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN suffix('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM r),
u AS (SELECT DISTINCT url, said FROM v),
g AS (SELECT url, said, unnest(list_transform(range(0, 5 * (length(url) + 2)), lambda k: CASE WHEN k // 5 + k % 5 < length(url) + 2
  THEN substr(chr(2) || url || chr(3), k // 5 + 1, k % 5 + 1) END)) AS gram FROM u),
c AS (SELECT gram, length(gram) AS m, left(gram, length(gram) - 1) AS context, count_if(said = 'allow') AS n1, count_if(said = 'block') AS n0 FROM g
  WHERE said IS NOT NULL AND gram <> chr(2) AND left(md5(url), 1) NOT IN ('0', '4', '8', 'c') GROUP BY gram HAVING count(*) >= 3),
x AS (SELECT context, sum(n1)::BIGINT AS t1, count_if(n1 > 0) AS k1, sum(n0)::BIGINT AS t0, count_if(n0 > 0) AS k0 FROM c GROUP BY context),
s AS (SELECT * FROM c JOIN x USING (context)),
p1 AS (SELECT s.*, 1.0::DOUBLE / 65536 AS a1, 1.0::DOUBLE / 65536 AS a0, CASE WHEN t1 > 0 THEN (n1 + k1 * (1.0::DOUBLE / 65536)) / (t1 + k1) ELSE 1.0::DOUBLE / 65536 END AS b1,
  CASE WHEN t0 > 0 THEN (n0 + k0 * (1.0::DOUBLE / 65536)) / (t0 + k0) ELSE 1.0::DOUBLE / 65536 END AS b0 FROM s WHERE m = 1),
p2 AS (SELECT s.*, q.b1 AS a1, q.b0 AS a0, CASE WHEN s.t1 > 0 THEN (s.n1 + s.k1 * q.b1) / (s.t1 + s.k1) ELSE q.b1 END AS b1,
  CASE WHEN s.t0 > 0 THEN (s.n0 + s.k0 * q.b0) / (s.t0 + s.k0) ELSE q.b0 END AS b0 FROM s JOIN p1 q ON q.gram = right(s.gram, 1) WHERE s.m = 2),
p3 AS (SELECT s.*, q.b1 AS a1, q.b0 AS a0, CASE WHEN s.t1 > 0 THEN (s.n1 + s.k1 * q.b1) / (s.t1 + s.k1) ELSE q.b1 END AS b1,
  CASE WHEN s.t0 > 0 THEN (s.n0 + s.k0 * q.b0) / (s.t0 + s.k0) ELSE q.b0 END AS b0 FROM s JOIN p2 q ON q.gram = right(s.gram, 2) WHERE s.m = 3),
p4 AS (SELECT s.*, q.b1 AS a1, q.b0 AS a0, CASE WHEN s.t1 > 0 THEN (s.n1 + s.k1 * q.b1) / (s.t1 + s.k1) ELSE q.b1 END AS b1,
  CASE WHEN s.t0 > 0 THEN (s.n0 + s.k0 * q.b0) / (s.t0 + s.k0) ELSE q.b0 END AS b0 FROM s JOIN p3 q ON q.gram = right(s.gram, 3) WHERE s.m = 4),
p5 AS (SELECT s.*, q.b1 AS a1, q.b0 AS a0, CASE WHEN s.t1 > 0 THEN (s.n1 + s.k1 * q.b1) / (s.t1 + s.k1) ELSE q.b1 END AS b1,
  CASE WHEN s.t0 > 0 THEN (s.n0 + s.k0 * q.b0) / (s.t0 + s.k0) ELSE q.b0 END AS b0 FROM s JOIN p4 q ON q.gram = right(s.gram, 4) WHERE s.m = 5),
e AS (SELECT context, ln(CASE WHEN t1 > 0 THEN k1 / (t1 + k1) ELSE 1.0 END::DOUBLE) - ln(CASE WHEN t0 > 0 THEN k0 / (t0 + k0) ELSE 1.0 END::DOUBLE) AS w FROM x),
q AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5),
w AS (SELECT gram, sum(w)::BIGINT AS w FROM (SELECT gram, round(((ln(b1) - ln(b0)) - (ln(a1) - ln(a0)) - e.w) * 1000000)::BIGINT AS w FROM q JOIN e USING (context)
  UNION ALL SELECT context, round(w * 1000000)::BIGINT FROM e) GROUP BY gram),
z AS (SELECT url, any_value(said) AS said, (coalesce(sum(w.w), 0)::BIGINT + (length(url) + 1) * coalesce((SELECT w FROM w WHERE gram = ''), 0)) / (length(url) + 1) / 1000000 AS score
  FROM g LEFT JOIN w USING (gram) GROUP BY url),
h AS (SELECT greatest(-2000, least(2000, floor(score * 100)))::INT AS cell, count_if(said = 'allow') AS good, count_if(said = 'block') AS bad FROM z
  WHERE said IS NOT NULL AND left(md5(url), 1) IN ('0', '4', '8', 'c') GROUP BY cell),
k AS (SELECT cell, coalesce((lag(cell) OVER (ORDER BY cell) + 1 + cell) / 2, cell) AS middle, coalesce(sum(bad) OVER up, 0) * sum(good) OVER () - coalesce(sum(good) OVER up, 0) * sum(bad) OVER () AS gain FROM h
  WHERE (SELECT sum(good) > 0 AND sum(bad) > 0 FROM h) WINDOW up AS (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT middle / 100 AS least FROM k ORDER BY gain DESC, cell LIMIT 1)
SELECT page_id, host, path, rule, coalesce(v.said, CASE WHEN score < (SELECT least FROM best) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL AND (SELECT least FROM best) IS NOT NULL THEN round(score, 4) END AS score
FROM v JOIN z USING (url)""",
}
