"""Training manifests: filters, group-safe splits, triplets.

Pseudo-random choices come from md5 of a seed and an id, so they are
reproducible on any cluster; they do not repeat the order of another
language's generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.functions.text import group_key
from slabspark.operators.hot import global_positions, hash_cut, row_numbers
from slabspark.session import materialize


def seeded(seed: str, *parts: Column) -> Column:
    """Non-negative 60-bit value of md5(seed|parts)."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def trainable(certs: DataFrame, low: float = 1.0, high: float = 10.0, files: DataFrame | None = None) -> DataFrame:
    """Certs with an id, a front image and a grade in range; ``files`` lists existing paths."""
    rows = certs.where(F.col("cert_id").isNotNull() & (F.coalesce("front_image_path", F.lit("")) != "")
                       & F.col("grade").between(low, high))
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("front_image_path")).distinct(), "front_image_path",
                         "left_semi")
    return rows


def keyed(rows: DataFrame, card: str = "card_name", set_: str = "set_name") -> DataFrame:
    """Add the grouping key of a printing."""
    return rows.withColumn("key", F.concat_ws("\u001f", group_key(F.col(card)), group_key(F.col(set_))))


def drop_singletons(rows: DataFrame, key: str = "key", cert: str = "cert_id") -> DataFrame:
    """Keep keys with two or more distinct certs (minimum differs from maximum)."""
    multi = rows.groupBy(key).agg(F.min(cert).alias("_lo"), F.max(cert).alias("_hi")).where("_lo <> _hi").select(key)
    return rows.join(multi, key, "left_semi")


def singleton_counts(rows: DataFrame, key: str = "key", cert: str = "cert_id") -> DataFrame:
    """Rows kept and dropped by ``drop_singletons``."""
    sizes = rows.groupBy(key).agg(F.min(cert).alias("lo"), F.max(cert).alias("hi"), F.count(F.lit(1)).alias("n"))
    single = F.col("lo") == F.col("hi")
    return sizes.agg(F.coalesce(F.sum(F.when(~single, F.col("n"))), F.lit(0)).alias("kept"),
                     F.coalesce(F.sum(F.when(single, F.col("n"))), F.lit(0)).alias("dropped"))


def split_by_id(rows: DataFrame, column: str, fraction: float = 0.2, seed: str = "49374") -> DataFrame:
    """Add ``split``: max(1, floor(fraction * ids)) ids go to "val" with all their rows.

    Only the cut between the two sides is computed (one hash and id); the rows
    themselves are then labelled in place, without a join or shuffle.
    """
    cut = hash_cut(rows, column, fraction, seed)
    mark = F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(column).cast("string"))).alias("h"),
                    F.col(column).alias("id"))
    labelled = rows.where(F.col(column).isNotNull())
    if cut is None:
        return labelled.withColumn("split", F.lit("train"))
    last = F.struct(F.lit(cut["h"]).alias("h"), F.lit(cut["id"]).cast(rows.schema[column].dataType).alias("id"))
    return labelled.withColumn("split", F.when(mark <= last, F.lit("val")).otherwise(F.lit("train")))


def corner_fan_out(certs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Four rows per cert; explicit corner grades win over the card grade.

    An override of another length is an error.
    """
    rows = certs
    if overrides is not None:
        rows = rows.join(overrides.select("cert_id", F.col("corner_grades").alias("_o")), "cert_id", "left")
    else:
        rows = rows.withColumn("_o", F.lit(None).cast("array<double>"))
    checked = F.when(F.col("_o").isNull(), F.array_repeat("grade", 4)).when(F.size("_o") == 4, F.col("_o")).otherwise(
        F.raise_error(F.concat(F.lit("corner_grades must have 4 values for cert "), F.col("cert_id").cast("string"))))
    return rows.select("cert_id", "front_image_path", F.posexplode(checked).alias("corner_index", "grade"))


def partner_counts(rows: DataFrame, key: str = "key", cert: str = "cert_id") -> DataFrame:
    """Per (key, cert): rows of the cert and possible positive partners.

    The pairs themselves are never built; their number is the key's rows
    minus the cert's own.
    """
    own = rows.groupBy(key, cert).agg(F.count(F.lit(1)).alias("n_own"))
    whole = own.groupBy(key).agg(F.sum("n_own").alias("n_key"))
    return own.join(whole, key).select(key, cert, "n_own", (F.col("n_key") - F.col("n_own")).alias("n_partners"))


def triplets(rows: DataFrame, sample: str, key: str = "key", cert: str = "cert_id", seed: str = "7") -> DataFrame:
    """(anchor, positive, negative) sample ids.

    Within a key, rows are numbered cert by cert, so an anchor's own cert is
    one contiguous run and any other position is a valid positive.  Both picks
    are equi-joins on a position; no pairs are enumerated.
    """
    # 0-based position within the key
    columns = list(dict.fromkeys((sample, key, cert)))  # sample and cert may be one column
    order = [(c, True) for c in dict.fromkeys((cert, sample))]
    numbered = row_numbers(rows.select(*columns), [key], order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    numbered = materialize(numbered, "in-key")  # narrow; read for runs, anchors and positives
    runs = numbered.groupBy(key, cert).agg(F.max("_pos").alias("_end"), F.count(F.lit(1)).alias("_own"))
    runs = runs.join(runs.groupBy(key).agg(F.sum("_own").alias("_n")), key).where("_n > _own")
    where_ = materialize(global_positions(rows, sample, seed), "positions")
    total = where_.agg(F.count(F.lit(1))).scalar()
    anchors = numbered.join(runs, [key, cert]).join(where_, sample).withColumn("_total", total)
    shift = F.pmod(seeded(seed + "+", F.col(sample)), F.col("_n") - F.col("_own"))
    hop = F.pmod(seeded(seed + "-", F.col(sample)), F.col("_total") - 1)
    picks = anchors.select(
        F.col(sample).alias("anchor"), F.col(key).alias("_key"),
        F.pmod(F.col("_end") + 1 + shift, F.col("_n")).alias("_p"),
        F.pmod(F.col("position") + 1 + hop, F.col("_total")).alias("_q"))
    positive = numbered.select(F.col(key).alias("_key"), F.col("_pos").alias("_p"), F.col(sample).alias("positive"))
    negative = where_.select(F.col("position").alias("_q"), F.col(sample).alias("negative"))
    return picks.join(positive, ["_key", "_p"]).join(negative, "_q").select("anchor", "positive", "negative")
