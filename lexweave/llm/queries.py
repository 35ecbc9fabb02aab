"""The registered query of each operator, with the columns that its contract asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.llm import decontam, katz, packing, pii, prefix_tree, quality, runs, sharding, simhash, topk, toxicity, warc, whitening
from lexweave.llm.common import documents

N_SHARDS = 40


def op1_hash_tree_shards(spark, sf_dir):
    tree = sharding.topology(N_SHARDS)
    placed = sharding.assign(documents(spark, sf_dir), tree, sharding.grown(tree, N_SHARDS))
    return placed.withColumn("law", F.lit("key"))


def op2_line_crf_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.score(docs, field).withColumn("held_out", quality.held_out())
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _changed_body():
    return F.concat(F.col("html"), F.lit("<!-- 2 -->"))


def _bodies(pages):
    """The bodies of the responses of ``_captures``."""
    second = F.when(F.col("page_id") % 3 == 0, F.struct((F.col("page_id") * 5 + 2).alias("body_id"), _changed_body().alias("body")))
    both = F.array(F.struct((F.col("page_id") * 5).alias("body_id"), F.col("html").alias("body")), second)
    return pages.select(F.inline(F.array_compact(both)))


def _captures(pages):
    """Crawl records of the pages: a response, a revisit, for some a changed response, a late and an early revisit."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    # Bodies stay where they are; a response carries its number.
    none = F.lit(None).cast("long")

    def record(number, offset, kind, url, etag, length, payload, cache, kept=F.lit(True)):
        time = F.col("page_id") * 10 + offset
        names = [("cache-control", F.lit(cache)), ("content-length", F.coalesce(length.cast("string"), F.lit("0"))), ("date", time.cast("string")), ("etag", etag)]
        fields = F.filter(F.array(*[F.struct(F.lit(k), v) for k, v in names]), lambda f: f["col2"].isNotNull())
        columns = {"record_id": F.col("page_id") * 5 + number, "url": url, "time": time, "kind": F.lit(kind), "etag": etag, "last_modified": modified, "headers": F.map_from_entries(fields), "payload": payload}
        return F.when(kept, F.struct(*[c.alias(n) for n, c in columns.items()]))

    changed = _changed_body()
    new_tag = F.concat(F.lit('"2-'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    late_tag = F.when(F.col("page_id") % 5 != 0, tag)
    records = F.array(
        record(0, 0, "response", F.col("url"), tag, F.length("html"), F.col("page_id") * 5, "max-age=60"),
        record(1, 3, "revisit", F.concat("url", F.lit("#again")), F.concat(F.lit("W/"), tag), F.lit(None), none, "max-age=600"),
        record(2, 5, "response", F.col("url"), new_tag, F.length(changed), F.col("page_id") * 5 + 2, "no-store", F.col("page_id") % 3 == 0),
        record(3, 7, "revisit", F.regexp_replace("url", "^https?", "http"), late_tag, F.lit(None), none, "max-age=700"),
        record(4, -5, "revisit", F.col("url"), tag, F.lit(None), none, "max-age=800", F.col("page_id") % 7 == 0),
    )
    return pages.select(F.explode(records).alias("r")).where("r IS NOT NULL").select("r.*")


def op3_revisit_resolution(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = warc.attach(warc.resolve(_captures(pages)), _bodies(pages))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(
        "record_id",
        "canonical",
        "status",
        "base_id",
        F.array_join(fields, ";").alias("header_fields"),
        F.md5("payload").alias("payload_md5"),
        F.length("payload").cast("long").alias("payload_chars"),
    )


def op4_vector_best_fit(spark, sf_dir):
    return packing.pack(packing.cut(documents(spark, sf_dir)))


def op5_simhash_components(spark, sf_dir):
    found = simhash.assign(documents(spark, sf_dir).select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_prefix_join_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.hits(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return decontam.digest(found).select(*columns)


def op7_norm_sorted_topk(spark, sf_dir):
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op8_katz_backoff(spark, sf_dir):
    return katz.score(documents(spark, sf_dir).select("doc_id", "text"))


def op9_bootstrapped_contexts(spark, sf_dir):
    return pii.digest(pii.detect(documents(spark, sf_dir).select("doc_id", "text")))


def op10_toxicity_chain(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("junk", (F.col("quality") == 0).cast("int"))
    categories = ("junk", "toxic")
    chain = toxicity.train(docs, labels, categories)
    found = toxicity.score(docs, chain, categories).withColumn("held_out", quality.held_out())
    toxic = (F.col("p_toxic") >= 0.5).cast("int")
    return found.select("doc_id", "held_out", "p_junk", F.col("p_toxic").alias("score"), toxic.alias("predicted"))


def op11_polarised_whitening(spark, sf_dir):
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_prefix_tree_join(spark, sf_dir):
    found = prefix_tree.assign(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_basic_factor_runs(spark, sf_dir):
    return runs.digest(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = (op1_hash_tree_shards, op2_line_crf_quality, op3_revisit_resolution, op4_vector_best_fit, op5_simhash_components, op6_prefix_join_decontamination, op7_norm_sorted_topk, op8_katz_backoff, op9_bootstrapped_contexts, op10_toxicity_chain, op11_polarised_whitening, op12_prefix_tree_join, op13_basic_factor_runs)

ORACLES = {
    "op3_revisit_resolution": r"""
WITH pages_tagged AS (SELECT *, '"' || substr(md5(html), 1, 16) || '"' AS tag, '"2-' || substr(md5(html), 1, 16) || '"' AS new_tag FROM pages),
captures AS (
  SELECT page_id*5 AS record_id, url, page_id*10 AS time, 'response' AS kind, tag AS etag, html AS payload, 'max-age=60' AS cache, page_id FROM pages_tagged
  UNION ALL SELECT page_id*5+1, url || '#again', page_id*10+3, 'revisit', 'W/' || tag, NULL, 'max-age=600', page_id FROM pages_tagged
  UNION ALL SELECT page_id*5+2, url, page_id*10+5, 'response', new_tag, html || '<!-- 2 -->', 'no-store', page_id FROM pages_tagged WHERE page_id % 3 = 0
  UNION ALL SELECT page_id*5+3, regexp_replace(url, '^https?', 'http'), page_id*10+7, 'revisit', CASE WHEN page_id % 5 <> 0 THEN tag END, NULL, 'max-age=700', page_id FROM pages_tagged
  UNION ALL SELECT page_id*5+4, url, page_id*10-5, 'revisit', tag, NULL, 'max-age=800', page_id FROM pages_tagged WHERE page_id % 7 = 0
),
plain AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') AS p FROM captures),
parts AS (SELECT *, regexp_replace(lower(regexp_extract(p, '^[^/?]*')), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_extract(p, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g') AS rest FROM plain),
canon AS (SELECT *, host || regexp_replace(regexp_replace(regexp_replace(rest, '[?&]+$', ''), '([?&])&+', '\1', 'g'), '(\.html|/)$', '') AS canonical FROM parts),
placed AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM canon),
joined AS (SELECT a.*, b.record_id AS b_id, b.etag AS b_etag, b.payload AS b_payload, b.page_id AS b_page,
  CASE WHEN a.kind = 'response' THEN 'full' WHEN b.record_id IS NULL THEN 'orphan'
       WHEN a.etag IS NOT NULL THEN CASE WHEN regexp_replace(a.etag, '^W/', '') = b.etag THEN 'resolved' ELSE 'mismatch' END
       WHEN a.page_id = b.page_id THEN 'resolved' ELSE 'mismatch' END AS status
  FROM placed a LEFT JOIN captures b ON a.kind = 'revisit' AND a.before = b.record_id),
merged AS (SELECT *, CASE WHEN status = 'resolved' THEN b_payload ELSE payload END AS body FROM joined)
SELECT record_id, canonical, status, CASE WHEN status IN ('resolved', 'mismatch') THEN b_id END AS base_id,
  'cache-control=' || cache || ';content-length=' || CASE WHEN status = 'resolved' THEN length(b_payload) ELSE coalesce(length(payload), 0) END
  || ';date=' || time || CASE WHEN coalesce(etag, CASE WHEN status = 'resolved' THEN b_etag END) IS NULL THEN '' ELSE ';etag=' || coalesce(etag, b_etag) END AS header_fields,
  md5(body) AS payload_md5, length(body) AS payload_chars FROM merged
""",
}
