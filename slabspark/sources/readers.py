"""Scans of the lake: JSON Lines, JSON arrays, CSV labels, folders, tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark import schemas as S
from slabspark.functions.text import parse_key, strip
from slabspark.session import materialize
from slabspark.sources.json_array import array_objects


@dataclass(frozen=True)
class Scan:
    """Decoded rows and, apart from them, the lines that did not decode."""

    rows: DataFrame
    rejected: DataFrame

    def bad_lines(self) -> int:
        return self.rejected.count()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> Scan:
    """Tolerant JSON Lines scan: blank and undecodable lines are skipped and countable."""
    full = S.with_corrupt(schema)
    try:
        lines = spark.read.schema(full).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", S.CORRUPT).json(path)
    except AnalysisException as err:
        if not missing_ok or err.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], full)
    # A field of another type only nulls that field; a broken line nulls them all.
    broken = F.col(S.CORRUPT).isNotNull() & ~_any_field(schema)
    return Scan(lines.where(~broken).drop(S.CORRUPT), lines.where(broken).select(S.CORRUPT))


def _any_field(schema: T.StructType) -> Column:
    """True when a field was read.

    Written as a sum so that it stays above the scan: null checks pushed into
    the JSON parser would drop a broken line before its error is seen.
    """
    return reduce(lambda a, b: a + b, [F.col(f.name).isNotNull().cast("int") for f in schema.fields]) > 0


def read_certs(spark: SparkSession, path: str) -> DataFrame:
    """Graded certs; a row without an integer id is dropped."""
    return read_json_lines(spark, path, S.SCRAPED).rows.where(F.col("cert_id").isNotNull())


def read_references(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_lines(spark, path, S.REFERENCES).rows
    return rows.where(F.col("manufacturer").isNotNull() & F.col("variant_id").isNotNull())


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, element_per_line: bool = False) -> DataFrame:
    """Bulk dumps whose top level is a list of objects; other entries are skipped.

    A file of any layout is read by many tasks, in two passes.  Where each
    element has a line of its own, with the brackets on theirs, say so: such a
    file is read once, like any other text.
    """
    if element_per_line:
        line = F.regexp_replace(strip(F.col("value")), r",$", "")
        objects = spark.read.text(path, recursiveFileLookup=True).select(line.alias("entry")).where(F.col("entry").startswith("{"))
    else:
        objects = array_objects(spark, path)
    return objects.select(F.from_json("entry", schema).alias("r")).select("r.*")


LABELS = T.StructType([T.StructField(n, T.StringType()) for n in ("image_path", "ground_truth", "sample_id")])


def check_labels(rows: DataFrame) -> DataFrame:
    """Normalize label rows and add ``problem`` (null when the row is fine)."""
    path = strip(F.coalesce("image_path", F.lit("")))
    label = F.lower(strip(F.coalesce("ground_truth", F.lit(""))))
    given = strip(F.coalesce("sample_id", F.lit("")))
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return rows.select(
        path.alias("image_path"), label.alias("ground_truth"),
        F.when(given != "", given).otherwise(stem).alias("sample_id"),
        F.when(~label.isin("authentic", "counterfeit"), F.concat(F.lit("ground_truth="), label))
        .when(path == "", F.lit("empty image_path")).alias("problem"),
        *[c for c in rows.columns if c not in LABELS.fieldNames()],
    )


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels with a contract check; any bad row is an error naming its line."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted({"image_path", "ground_truth"} - set(header))
    if missing:
        raise ValueError(f"CSV {path} missing required column(s): {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if "sample_id" not in header:
        raw = raw.withColumn("sample_id", F.lit(None).cast("string"))
    checked = check_labels(raw.select(*LABELS.fieldNames()))
    if not checked.where(F.col("problem").isNotNull()).isEmpty():
        raise ValueError(f"CSV {path} {_first_problem(spark, path, schema)}")
    return checked.drop("problem")


def _first_problem(spark: SparkSession, path: str, schema: T.StructType) -> str:
    """Line and fault of the first bad row; only looked up to word the error.

    Lines are counted within each block of a file, and blocks by their offset.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(blocks.withColumn("before", before), ["file", "start"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")
    rows = numbered.where((F.col("line") > 1) & (strip(F.col("value")) != "")).select(
        "file", "line", F.from_csv("value", schema.toDDL()).alias("r")).select("file", "line", "r.*")
    if "sample_id" not in schema.fieldNames():
        rows = rows.withColumn("sample_id", F.lit(None).cast("string"))
    bad = check_labels(rows.select(*LABELS.fieldNames(), "file", "line")).where(F.col("problem").isNotNull())
    found = bad.orderBy("file", "line").select("line", "problem").first()
    return f"line {found['line']}: {found['problem']}" if found else "has a bad row"


def authentic_labels(certs: DataFrame, max_records: int | None = None) -> DataFrame:
    """Every cert with a front image is an authentic sample ``psa-<id>``."""
    rows = certs.where(F.col("cert_id").isNotNull() & (F.coalesce("front_image_path", F.lit("")) != "")).select(
        F.col("front_image_path").alias("image_path"), F.lit("authentic").alias("ground_truth"),
        F.concat(F.lit("psa-"), F.col("cert_id").cast("string")).alias("sample_id"), "cert_id")
    if max_records is not None:
        rows = rows.orderBy("cert_id").limit(max_records)
    return rows.drop("cert_id")


def seed_records(paths: DataFrame) -> DataFrame:
    """Seed images by folder grade; ``mismatch`` marks a differing file grade."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    file_grade = F.regexp_extract(name, r"(?i)^psa(\d{1,2})_\d+\.(jpe?g|png|webp)$", 1)
    folder_grade = F.regexp_extract(folder, r"(?i)^psa(\d{1,2})$", 1)
    return paths.select(
        F.col("path").alias("image_path"),
        folder_grade.try_cast("int").alias("grade"), F.lit("github_seed").alias("source"),
        file_grade.try_cast("int").alias("file_grade"),
    ).where(F.col("grade").between(1, 10) & F.col("file_grade").isNotNull()).withColumn(
        "mismatch", F.col("grade") != F.col("file_grade")).drop("file_grade")


def read_seed_folder(spark: SparkSession, root: str) -> DataFrame:
    """Folder scan; only paths are read, never image bytes."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return seed_records(listing)


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(S.EXEMPLARS).parquet(path)
    return rows.where((F.coalesce("manufacturer", F.lit("")) != "") & (F.coalesce("variant_id", F.lit("")) != ""))


def keyed_vectors(archive: DataFrame) -> DataFrame:
    """Keyed archive rows (key, ix, embedding) -> exemplar rows; malformed keys dropped."""
    return archive.withColumn("_k", parse_key(F.col("key"))).where(F.col("_k").isNotNull()).select(
        "_k.manufacturer", "_k.variant_id", F.col("ix").alias("exemplar_ix"), "embedding")


def lookup_references(exemplars: DataFrame, manufacturer: str, variant_id: str) -> DataFrame:
    """All exemplars of one variant; the equality filters reach the Parquet scan."""
    return exemplars.where((F.col("manufacturer") == manufacturer) & (F.col("variant_id") == variant_id))


def read_catalog(spark: SparkSession, variants_path: str, sets_path: str) -> DataFrame:
    """Variants with their set code; Parquet prunes the columns not used."""
    variants = spark.read.schema(S.CARD_VARIANTS).parquet(variants_path)
    sets = spark.read.schema(S.CARD_SETS).parquet(sets_path)
    return catalog_view(variants, sets)


def catalog_view(variants: DataFrame, sets: DataFrame) -> DataFrame:
    codes = sets.select(F.col("id").alias("set_id"), F.col("code").alias("set_code"))
    return variants.join(codes, "set_id").select(
        F.col("id").alias("variant_id"), "game", "set_code", "card_number", "name", "scryfall_id", "external_ids",
        F.col("canonical_phash").alias("phash"), F.col("canonical_image_embedding").alias("embedding"))


def read_catalog_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int,
                      partitions: int, **options: str) -> DataFrame:
    """Catalog rows from a database, read in parallel over a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high,
        numPartitions=partitions, **options).load()


def normalize_enums(df: DataFrame, *columns: str) -> DataFrame:
    """Stored upper-case member names -> lower-case values."""
    return df.withColumns({c: F.lower(c) for c in columns})


def reread(df: DataFrame, label: str) -> DataFrame:
    """Rewrite a non-splittable input once as Parquet."""
    return materialize(df, label)
