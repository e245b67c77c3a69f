"""Totals on several levels, stored sketches, and the library's functions from SQL alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sqlnames
from ..operators import summaries
from ..sources.tables import saved, shared_dir
from ..sources.versions import VersionedTable
from .registry import _keywords, _t, _tokens, query


@query("""
SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(grouping_id(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS sum_n_chars, count(DISTINCT n_chars) AS distinct_n_chars FROM documents GROUP BY CUBE (source, lang)
""")
def p_audit_totals(spark, sf):
    """Documents and characters by source, by language, by both and in all."""
    out = summaries.totals(_t(spark, sf, "documents"), ["source", "lang"], ["n_chars"], ["n_chars"], every=True)
    return out.withColumns({"level": F.col("level").cast("long"), "source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit(""))})


@query("SELECT lang, count(*) AS n, true AS distinct_near, true AS median_near, true AS tail_near FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def p_stored_sketches(spark, sf):
    """Sketches by source and language, kept and merged by language: distinct texts and quantiles of lengths within the stated errors of the exact values."""
    docs = _t(spark, sf, "documents").where("lang is not null")
    kept = saved(summaries.sketched(docs, ["source", "lang"], {"texts": F.xxhash64("text")}, {"lengths": F.length("text")}))
    merged = summaries.merged(kept, ["lang"], ["texts"], ["lengths"])
    at = {"median": 0.5, "tail": 0.95}
    found = saved(merged.select("lang", summaries.distinct_of("texts").alias("estimate"), *(summaries.quantile_of("lengths", q).alias(k) for k, q in at.items())))
    rows = docs.select("lang", F.length("text").alias("x"), F.xxhash64("text").alias("h")).join(F.broadcast(found), "lang")  # a row for each language
    below = lambda k: [F.avg((F.col("x") < F.col(k)).cast("int")).alias(f"{k}_below"), F.avg((F.col("x") <= F.col(k)).cast("int")).alias(f"{k}_upto")]
    rows = rows.groupBy("lang", "estimate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("distinct"), *(c for k in at for c in below(k)))
    near = lambda k: (F.col(f"{k}_below") <= at[k] + 0.03) & (F.col(f"{k}_upto") >= at[k] - 0.03)
    return rows.select("lang", "n", (F.abs(F.col("estimate") - F.col("distinct")) <= 0.05 * F.col("distinct")).alias("distinct_near"), near("median").alias("median_near"), near("tail").alias("tail_near"))


@query(f"""
SELECT doc_id, len({_tokens("text")})::BIGINT AS n_tokens, len({_keywords("text")})::BIGINT AS n_keywords, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n_words, length(text) // 4 AS n_estimated,
  left(md5(source || '_' || (doc_id % 7)), 16) AS chunk_id, md5(regexp_replace(concat(text, ' www.a.example/', doc_id), 'https?://\\S+|www\\.\\S+', '', 'g')) AS without_urls, length(regexp_replace(concat('  ', text, chr(10)), '^\\s+|\\s+$', '', 'g')) AS stripped FROM documents
""")
def p_sql_functions(spark, sf):
    """The library's functions in one statement of SQL."""
    docs = _t(spark, sf, "documents")
    return sqlnames.register(spark).sql("""
        SELECT doc_id, cast(size(quill_tokens(text)) AS bigint) AS n_tokens, cast(size(quill_keywords(text)) AS bigint) AS n_keywords, quill_words(text) AS n_words, quill_estimated_tokens(text) AS n_estimated,
               quill_chunk_id(source, cast(doc_id % 7 AS int)) AS chunk_id, md5(quill_without_urls(concat(text, ' www.a.example/', doc_id))) AS without_urls, cast(length(quill_strip(concat('  ', text, char(10)))) AS bigint) AS stripped
        FROM {docs}""", docs=docs)


@query("""
WITH v0 AS (SELECT vec_id, label FROM embeddings), v1 AS (SELECT vec_id, CASE WHEN vec_id % 50 = 3 THEN label + 100 ELSE label END AS label FROM v0 UNION ALL SELECT vec_id + 1000000, label FROM v0 WHERE vec_id % 50 = 3),
v2 AS (SELECT * FROM v1 WHERE vec_id % 90 <> 4), v AS (SELECT 0 AS version, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2)
SELECT version, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(label) AS BIGINT) AS labels FROM v GROUP BY version
""")
def b7_versions(spark, sf):
    """Three versions of the vectors: as they are, after an upsert, after a deletion; each is still there to be read."""
    rows = _t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    some = rows.where("vec_id % 50 = 3")
    table = VersionedTable(spark, f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", "vec_id")
    table.create(rows)
    table.upsert(some.withColumn("label", F.col("label") + 100).unionByName(some.withColumn("vec_id", F.col("vec_id") + 1_000_000)))
    table.delete(rows.where("vec_id % 90 = 4"))
    total = lambda v: table.read(v).agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"), F.sum("label").alias("labels")).select(F.lit(v).alias("version"), "*")
    return total(0).unionByName(total(1)).unionByName(total(2))
