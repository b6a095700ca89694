"""Catalog sync: references -> sets and variants, with outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.operators.hot import keep_latest
from slabspark.session import materialize
from slabspark.sources.store import merge_by_key


def game_of(manufacturer: Column) -> Column:
    """Constant dimension as a map lookup; unmapped -> null."""
    pairs = [F.lit(v) for item in P.MANUFACTURER_TO_GAME.items() for v in item]
    return F.element_at(F.create_map(*pairs), manufacturer)


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so a retried task cannot mint another one."""
    return F.md5(F.concat_ws("|", *parts))


def distinct_sets(references: DataFrame, ingest_order: str | None = None, name: Column | None = None) -> DataFrame:
    """One row per (game, code); the first occurrence names it."""
    rows = references.select(
        game_of(F.col("manufacturer")).alias("game"), F.col("set_code").alias("code"),
        (F.upper("set_code") if name is None else name).alias("name"),
        (F.lit(0) if ingest_order is None else F.col(ingest_order)).alias("_o"),
    ).where(F.col("game").isNotNull() & (F.coalesce("code", F.lit("")) != ""))
    return rows.groupBy("game", "code").agg(F.min_by("name", "_o").alias("name"))


def label_references(references: DataFrame) -> DataFrame:
    """Add ``game`` and exactly one ``outcome`` per row, tested in a fixed order."""
    game = game_of(F.col("manufacturer"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return references.withColumn("game", game).withColumn(
        "outcome",
        F.when(F.col("game").isNull(), F.lit("skipped_unmapped_manufacturer"))
        .when(blank("set_code"), F.lit("skipped_missing_set_code"))
        .when(blank("collector_number"), F.lit("skipped_missing_card_number"))
        .otherwise(F.lit("emitted")),
    )


def attach_set_ids(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """(game, code) -> set id; a miss is its own outcome."""
    ids = sets.select(F.col("id").alias("set_id"), "game", F.col("code").alias("set_code"))
    joined = labelled.join(ids, ["game", "set_code"], "left")
    missed = (F.col("outcome") == "emitted") & F.col("set_id").isNull()
    return joined.withColumn("outcome", F.when(missed, F.lit("skipped_missing_set_code")).otherwise(F.col("outcome")))


def provenance(manufacturer: Column, variant_id: Column) -> Column:
    """{"manufacturer": m, "<m>_variant_id": v}; the second entry only with an id."""
    base = F.create_map(F.lit("manufacturer"), manufacturer)
    own = F.create_map(F.concat(manufacturer, F.lit("_variant_id")), variant_id)
    return F.when(variant_id.isNotNull(), F.map_concat(base, own)).otherwise(base)


def variant_rows(labelled: DataFrame, exemplars: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Rows for the variants table.

    ``exemplars`` supplies the canonical vector: a variant with a single
    stored vector uses it, several exemplars leave it null.  ``hashes``
    (front_image_path, phash) holds hashes computed elsewhere.
    """
    rows = labelled.where(F.col("outcome") == "emitted")
    if exemplars is not None:
        single = exemplars.groupBy("manufacturer", "variant_id").agg(
            F.count(F.lit(1)).alias("_n"), F.min_by("embedding", "exemplar_ix").alias("_e"))
        rows = rows.join(single, ["manufacturer", "variant_id"], "left")
        vector = F.when(F.col("_n") == 1, F.col("_e"))
    else:
        vector = F.lit(None).cast("array<float>")
    if hashes is not None:
        rows = rows.join(hashes.select("front_image_path", F.col("phash").alias("_h")), "front_image_path", "left")
        phash = F.col("_h")
    else:
        phash = F.lit(None).cast("bigint")
    return rows.select(
        stable_id(F.col("game"), F.col("set_id"), F.col("collector_number")).alias("id"),
        "game", "set_id", F.col("collector_number").alias("card_number"),
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("Unknown")).alias("name"),
        F.when(F.col("manufacturer") == "mtg", F.col("variant_id")).alias("scryfall_id"),
        provenance(F.col("manufacturer"), F.col("variant_id")).alias("external_ids"),
        phash.alias("canonical_phash"), vector.alias("canonical_image_embedding"),
        *[c for c in ("ingest_order", "front_image_path") if c in rows.columns],
    )


def upsert_sets(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge on (game, code): name refreshed, existing ids kept."""
    source = rows.withColumn("id", stable_id(F.col("game"), F.col("code"))).select(*target.columns)
    return merge_by_key(target, source, ["game", "code"], keep=["id"])


def upsert_variants(target: DataFrame, rows: DataFrame, order: str | None = "ingest_order") -> DataFrame:
    """Merge on (game, set_id, card_number); last row of a key wins, nulls overwrite."""
    ordered = [F.col(order)] if order and order in rows.columns else [F.coalesce("name", F.lit(""))]
    # Read twice by the merge, so the deduplicated source is written once.
    last = materialize(keep_latest(rows, ["game", "set_id", "card_number"], ordered).select(*target.columns), "variants")
    return merge_by_key(target, last, ["game", "set_id", "card_number"], keep=["id"])


def canonical_catalog(references: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Printings that have a vector, each with its first exemplar only."""
    first = exemplars.where(F.col("exemplar_ix") == 0).drop("exemplar_ix")
    return references.join(first, ["manufacturer", "variant_id"])


def sync_stats(labelled: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Counters of one pass, as a single row."""
    funnel = labelled.agg(
        F.count(F.lit(1)).alias("variants_total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in (
            "skipped_unmapped_manufacturer", "skipped_missing_set_code", "skipped_missing_card_number")],
    )
    done = rows.agg(
        F.count(F.lit(1)).alias("variants_upserted"),
        F.count("canonical_phash").alias("variants_with_phash"),
        F.count("canonical_image_embedding").alias("variants_with_embedding"),
        F.count_if((F.coalesce("front_image_path", F.lit("")) != "") & F.col("canonical_phash").isNull())
        .alias("image_load_failures") if "front_image_path" in rows.columns
        else F.lit(0).cast("bigint").alias("image_load_failures"),
    )
    total = sets.agg(F.count(F.lit(1))).scalar()
    extra = done.select(F.struct("*")).scalar()  # one-row scalar subqueries, no join
    return funnel.select(total.alias("sets_total"), "*", extra.alias("_d")).select("*", "_d.*").drop("_d")
