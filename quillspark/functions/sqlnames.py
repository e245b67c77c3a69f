"""The library's Column functions under SQL names.

Each name is a SQL function whose body is one expression, inlined into the plan of whatever calls it: built-in
functions only, no Python. register(spark) makes them temporary functions of the session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import answers, text

_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS))
_KEY_STOP = ", ".join(f"'{w}'" for w in sorted(answers.STOPWORDS))

#: name: (arguments, type, body).
FUNCTIONS = {
    "quill_strip": ("x STRING", "STRING", r"regexp_replace(x, '(?U)\\A\\s+|\\s+\\z', '')"),
    "quill_words": ("x STRING", "BIGINT", r"cast(size(filter(split(x, '(?U)\\s+'), w -> w <> '')) as bigint)"),
    "quill_estimated_tokens": ("x STRING", "BIGINT", "cast(length(x) div 4 as bigint)"),
    "quill_tokens": ("x STRING", "ARRAY<STRING>", rf"filter(regexp_extract_all(lower(x), '(?U)[\\w]+', 0), t -> length(t) > 2 AND t NOT IN ({_STOP}))"),
    "quill_keywords": ("x STRING", "ARRAY<STRING>", rf"array_distinct(filter(regexp_extract_all(lower(x), '(?U)[\\w]+', 0), w -> length(w) > 3 AND w NOT IN ({_KEY_STOP})))"),
    "quill_chunk_id": ("source STRING, i INT", "STRING", "substring(md5(concat_ws('_', source, cast(i as string))), 1, 16)"),
    "quill_without_urls": ("x STRING", "STRING", r"regexp_replace(x, '(?U)https?://\\S+|www\\.\\S+', '')"),
    "quill_is_repetitive": ("x STRING", "BOOLEAN", r"x rlike '(?s)(.)\\1{9,}'"),
    "quill_rrf": ("dense_rank INT, sparse_rank INT, alpha DOUBLE", "DOUBLE", "round(coalesce(alpha / (60 + dense_rank), 0) + coalesce((1 - alpha) / (60 + sparse_rank), 0), 12)"),
    "quill_keyword_share": ("answer STRING, question STRING", "DOUBLE", "if(size(quill_keywords(question)) = 0, 1.0D, size(filter(quill_keywords(question), w -> contains(lower(answer), w))) / cast(size(quill_keywords(question)) as double))"),
    "quill_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / greatest(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 1e-300D)"),
}


def register(spark: SparkSession) -> SparkSession:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return spark
