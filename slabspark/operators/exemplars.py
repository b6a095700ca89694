"""Exemplar store: incremental embedding and idempotent accumulation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.operators.hot import row_numbers


def unseen(rows: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows whose key is not stored yet; ``force`` takes them all.

    Put in front of any embedder or parser: Catalyst does not move filters
    through Python functions.
    """
    return rows if force else rows.join(done.select(*keys), keys, "left_anti")


def requested_range(spark, low: int, high: int, stored: DataFrame, column: str) -> DataFrame:
    """Ids low..high (inclusive) that are not stored."""
    wanted = spark.range(low, high + 1).withColumnRenamed("id", column)
    return wanted.join(stored.select(column), column, "left_anti")


def check_dimension(vec: Column, dim: int) -> Column:
    return vec.isNotNull() & (F.size(vec) == dim)


def embed_references(references: DataFrame, stored: DataFrame, encode: Callable[[DataFrame], DataFrame], dim: int,
                     force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new exemplar rows, rows with their outcome).

    ``encode`` is the user's embedder: it receives the rows still to do and
    returns them with an ``embedding`` column (a pandas UDF or ``mapInPandas``).
    """
    keys = ["manufacturer", "variant_id"]
    with_image = F.coalesce("front_image_path", F.lit("")) != ""
    known = stored.select(*keys, F.lit(True).alias("_stored")).distinct()
    marked = references.join(known, keys, "left").withColumn(
        "outcome",
        F.when(F.col("_stored").isNotNull() & F.lit(not force), F.lit("skipped_existing"))
        .when(~with_image, F.lit("skipped_no_image"))).drop("_stored")
    todo = encode(marked.where(F.col("outcome").isNull()))
    labelled = todo.withColumn("outcome", F.when(check_dimension(F.col("embedding"), dim), F.lit("embedded"))
                               .otherwise(F.lit("embedder_failures")))
    skipped = marked.where(F.col("outcome").isNotNull())
    new = labelled.where(F.col("outcome") == "embedded").select(
        *keys, F.lit(0).alias("exemplar_ix"), F.col("embedding").cast("array<float>").alias("embedding"))
    return new, skipped.select(*keys, "outcome").unionByName(labelled.select(*keys, "outcome"))


def label_certs(certs: DataFrame, consumed: DataFrame, decisions: DataFrame, dim: int) -> DataFrame:
    """One outcome per cert, tested in a fixed order.

    ``certs``: cert_id, front_image_path, embedding; ``decisions``: query_id,
    variant_id (source id), manufacturer.
    """
    log = consumed.select("cert_id", F.lit(True).alias("_done")).distinct()
    chosen = decisions.select(F.col("query_id").alias("cert_id"), "variant_id", "manufacturer")
    return certs.join(log, "cert_id", "left").join(chosen, "cert_id", "left").withColumn(
        "outcome",
        F.when(F.col("_done").isNotNull(), F.lit("skipped_already_consumed"))
        .when(F.coalesce("front_image_path", F.lit("")) == "", F.lit("skipped_no_image"))
        .when(F.col("variant_id").isNull(), F.lit("skipped_unidentified"))
        .when(~F.coalesce(check_dimension(F.col("embedding"), dim), F.lit(False)), F.lit("embedder_failures"))
        .otherwise(F.lit("appended"))).drop("_done")


def append_exemplars(store: DataFrame, new: DataFrame, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """New rows numbered after the exemplars a variant already has.

    ``new``: manufacturer, variant_id, embedding and the unique ``order``
    column.  Numbering is hot-group safe: one variant may receive most rows.
    """
    keys = ["manufacturer", "variant_id"]
    last = store.groupBy(*keys).agg(F.max("exemplar_ix").alias("_last"))
    numbered = row_numbers(new, keys, [(order, True)], "_rn")
    return numbered.join(last, keys, "left").select(
        *keys, (F.coalesce("_last", F.lit(-1)) + F.col("_rn")).cast("int").alias("exemplar_ix"),
        F.col("embedding").cast("array<float>").alias("embedding"), *keep)
