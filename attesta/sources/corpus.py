"""Files as tables: listing under an allow-list, categorisation by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.governance import classify_path, lookup
from attesta.functions.text import extension_of, grade_band_of_folder, title_of_file
from attesta.rules import FOLDER_RULES, GUIDANCE_FILE_NAMES, GUIDANCE_FILE_PREFIXES, SCANNED_FOLDERS


FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def list_corpus(
    spark: SparkSession,
    root: str,
    folders: list[str] | None = None,
    only: str | None = None,
    limit: int | None = None,
    with_content: bool = False,
) -> DataFrame:
    """Files below the allowed top folders, with their path relative to ``root``.

    Only these folders are listed; one that does not exist is left out. File bytes are only read where ``with_content`` asks for them. ``limit`` is the
    listing's own option for trial runs: the first files by path.
    """
    allowed = folders if folders is not None else SCANNED_FOLDERS
    if only is not None:
        allowed = [f for f in allowed if f == only]
    there = [f"{root.rstrip('/')}/{folder}" for folder in allowed if _exists(spark, f"{root.rstrip('/')}/{folder}")]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(there) if there else spark.createDataFrame([], FILE_COLUMNS)
    return narrow(files.withColumn("rel_path", relative_path("path", root)), allowed, limit, with_content)


def relative_path(path: str, root: str):
    """Path below ``root`` without scheme (file URIs carry %-escapes)."""
    from urllib.parse import urlparse

    base = urlparse(root).path.rstrip("/") + "/"
    decoded = F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))
    return F.substring_index(decoded, base, -1)


def narrow(files: DataFrame, folders: list[str], limit: int | None = None, with_content: bool = False) -> DataFrame:
    """Files whose first path segment is allowed."""
    kept = files.filter(F.substring_index("rel_path", "/", 1).isin(folders) & F.contains("rel_path", F.lit("/")))
    if not with_content and "content" in kept.columns:
        kept = kept.drop("content")
    return kept.orderBy("rel_path").limit(limit) if limit is not None else kept


def classify(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Add include, subject, confession and reason by path."""
    return files.withColumn("_c", classify_path(path)).select("*", "_c.*").drop("_c")


def categorize(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Trust, publisher, licence and grade band by top folder; other folders and types vanish."""
    top = F.substring_index(path, "/", 1)
    name = F.substring_index(path, "/", -1)
    segments = F.split(path, "/")
    guidance_file = name.isin(GUIDANCE_FILE_NAMES)
    for prefix in GUIDANCE_FILE_PREFIXES:
        guidance_file = guidance_file | name.startswith(prefix)
    trust = F.when((top == "lehrplaene") & guidance_file, F.lit("OFFICIAL_GUIDANCE")).otherwise(
        lookup(top, {k: v[0] for k, v in FOLDER_RULES.items()})
    )
    band = F.when(
        top == "niveaubestimmende-aufgaben",
        grade_band_of_folder(F.coalesce(F.try_element_at(segments, F.lit(2)), F.lit(""))),
    )
    kept = files.filter(top.isin(list(FOLDER_RULES)) & extension_of(path).isin(".pdf", ".txt"))
    return (
        kept.withColumn("trust_level", trust)
        .withColumn("publisher", lookup(top, {k: v[1] for k, v in FOLDER_RULES.items()}))
        .withColumn("license_info", lookup(top, {k: v[2] for k, v in FOLDER_RULES.items()}))
        .withColumn("grade_band", band)
        .withColumn("title", title_of_file(path))
        .withColumn(
            "content_type", F.when(extension_of(path) == ".pdf", F.lit("application/pdf")).otherwise(F.lit("text/plain"))
        )
    )
