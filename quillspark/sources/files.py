"""Files in and tables out: documents by extension and content hash, a vector table with upserts, query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".html", ".htm", ".pdf", ".doc", ".docx", ".txt", ".md")


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, manifest: DataFrame | None = None) -> DataFrame:
    """path, stem, extension, length, sha256, content; without files that the manifest (path, sha256) has, and PDFs that an HTML file of the same stem replaces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "length", F.sha2("content", 256).alias("sha256"), "content").where(F.col("extension").isin(*extensions))
    html = files.where(F.col("extension").isin(".html", ".htm")).select("stem").distinct()
    files = files.where("extension <> '.pdf'").unionByName(files.where("extension = '.pdf'").join(html, "stem", "left_anti").select(*files.columns))
    return files if manifest is None else files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti").select(*files.columns)


def as_text(files: DataFrame) -> DataFrame:
    """Adds text: UTF-8 where it is valid, else ISO 8859-1."""
    return files.withColumn("text", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").schema("document string, chunks array<struct<chunk_id: string, source_file: string, section: string, content: string>>").json(path)
    return rows.select("document", F.inline("chunks"))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each experiment name, of the file last in order; summaries are left out."""
    schema = "experiment_name string, config map<string, string>, timestamp string, total_questions int, successful_queries int, failed_queries int, aggregated_metrics map<string, double>, individual_results array<struct<question_id: string, question: string, answer_full: string, ground_truth: string, metrics: map<string, double>, category: string, difficulty: string, error: string>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("_file", F.input_file_name()).where(~F.contains("_file", F.lit("summary")))
    return rows.groupBy("experiment_name").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_file", "experiment_name")]), "_file").alias("r")).select("experiment_name", "r.*")


def add(table: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """Rows with ids that the table has are left out."""
    return table.unionByName(new.join(table.select(id), id, "left_anti").select(*new.columns), allowMissingColumns=True)


def update(table: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """Values of new that aren't null replace the table's; unknown ids are left out."""
    fresh = new.select(F.col(id), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != id))
    return table.join(fresh, id, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns and c != id else F.col(c) for c in table.columns))


def delete(table: DataFrame, ids: DataFrame | None = None, where=None, id: str = "id") -> DataFrame:
    if ids is not None:
        table = table.join(ids.select(id), id, "left_anti").select(*table.columns)
    return table if where is None else table.where(~F.coalesce(where, F.lit(False)))


def append_log(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def write_csv(report: DataFrame, path: str, decimals: int = 2, sep: str = ";", comma: bool = True) -> None:
    """Doubles with fixed decimals and a decimal comma."""
    number = lambda c: F.replace(F.format_string(f"%.{decimals}f", F.col(c)), F.lit("."), F.lit("," if comma else "."))
    report.select(*(number(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in report.dtypes)).write.mode("overwrite").option("sep", sep).option("header", "true").csv(path)
