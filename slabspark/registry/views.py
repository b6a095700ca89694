"""Domain tables derived from the driver tables, in Spark and in SQL.

Orders play submissions (customer = identified variant and owner), line items
play grades and measured sides, parts play manufacturer references.  Every
view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.functions.scalars import final_grade
from slabspark.registry.core import Tables

# ------------------------------------------------------------ submissions

SUBMISSIONS_SQL = """
submissions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing'
      ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'rejected_quality' ELSE 'capturing' END END AS status,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_custkey AS VARCHAR) END AS identified_variant_id,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice / 1000000.0 END AS identification_confidence,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'F' THEN 'operator hold' END AS rejection_reason,
    o_orderdate AS created_at, o_orderdate + INTERVAL 90 SECOND AS updated_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 SECOND END AS completed_at
  FROM orders)"""


def submissions(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    created = F.col("o_orderdate").cast("timestamp")
    later = created + F.expr("INTERVAL 90 SECOND")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
        F.when(status == "F", F.lit("completed")).when(status == "O", F.lit("processing"))
        .when(priority == "5-LOW", F.lit("rejected_quality")).otherwise(F.lit("capturing")).alias("status"),
        F.when(priority != "4-NOT SPECIFIED", F.col("o_custkey").cast("string")).alias("identified_variant_id"),
        F.when(priority != "2-HIGH", F.col("o_totalprice") / 1000000.0).alias("identification_confidence"),
        F.when((priority == "3-MEDIUM") & (status != "F"), F.lit("operator hold")).alias("rejection_reason"),
        created.alias("created_at"), later.alias("updated_at"), F.when(status == "F", later).alias("completed_at"))


# ------------------------------------------------------------------ grades

GRADES_SQL = """
raw_grades AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS submission_id,
    CASE l_returnflag WHEN 'R' THEN 'bgs' WHEN 'A' THEN 'psa' ELSE 'trugrade' END AS scheme,
    1.0 + floor(max(l_quantity) / 6) AS centering,
    CASE WHEN max(l_tax) <= 0.07 THEN 10.0 - max(l_tax) * 50 END AS corners,
    10.0 - max(l_discount) * 50 AS edges,
    CASE WHEN count(*) < 4 THEN 10.0 - 0.5 * count(*) END AS surface,
    min(l_quantity) / 50.0 AS confidence
  FROM lineitem GROUP BY 1, 2),
grades AS (
  SELECT *, CASE WHEN corners IS NOT NULL AND surface IS NOT NULL
    THEN round_even(least(centering, corners, edges, surface) * 2, 0) / 2 END AS final
  FROM raw_grades)"""


def grades(t: Tables) -> DataFrame:
    scheme = F.when(F.col("l_returnflag") == "R", F.lit("bgs")).when(F.col("l_returnflag") == "A", F.lit("psa"))
    rows = t.lineitem.groupBy(
        F.col("l_orderkey").cast("string").alias("submission_id"), scheme.otherwise(F.lit("trugrade")).alias("scheme"),
    ).agg(
        (F.lit(1.0) + F.floor(F.max("l_quantity") / 6)).alias("centering"),
        F.when(F.max("l_tax") <= 0.07, F.lit(10.0) - F.max("l_tax") * 50).alias("corners"),
        (F.lit(10.0) - F.max("l_discount") * 50).alias("edges"),
        F.when(F.count(F.lit(1)) < 4, F.lit(10.0) - F.lit(0.5) * F.count(F.lit(1))).alias("surface"),
        (F.min("l_quantity") / 50.0).alias("confidence"))
    return rows.withColumn("final", final_grade(*[F.col(c) for c in ("centering", "corners", "edges", "surface")]))


# ----------------------------------------------------- variants and sets

VARIANTS_SQL = """
variants AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS set_id,
    c_mktsegment AS card_number FROM customer),
sets AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS code FROM nation)"""


def variants(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("set_id"), F.col("c_mktsegment").alias("card_number"))


def sets(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("code"))


# ------------------------------------------------------------ authenticity

AUTH_SQL = """
auth AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS submission_id,
    CASE WHEN o_totalprice > 300000 THEN 'authentic' WHEN o_totalprice > 150000 THEN 'suspicious'
      ELSE 'likely_counterfeit' END AS verdict,
    o_totalprice / 1000000.0 AS confidence
  FROM orders WHERE o_orderpriority <> '1-URGENT')"""


def auth(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.where(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").cast("string").alias("submission_id"),
        F.when(price > 300000, F.lit("authentic")).when(price > 150000, F.lit("suspicious"))
        .otherwise(F.lit("likely_counterfeit")).alias("verdict"),
        (price / 1000000.0).alias("confidence"), F.array(F.col("o_orderpriority")).alias("reasons"))


# -------------------------------------------------------------- references

REFERENCES_SQL = """
refs AS (
  SELECT CAST(p_partkey AS VARCHAR) AS variant_id,
    CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'mtg' WHEN p_type IN ('PROMO', 'LARGE') THEN 'pokemon'
      ELSE lower(p_type) END AS manufacturer,
    p_name AS name, CASE WHEN p_size <> 50 THEN p_brand END AS set_code,
    CASE WHEN p_size <> 49 THEN CAST(p_size AS VARCHAR) ELSE '' END AS collector_number,
    p_partkey AS ingest_order
  FROM part),
labelled AS (
  SELECT *, CASE WHEN manufacturer IN ('mtg', 'pokemon') THEN manufacturer END AS game,
    CASE WHEN manufacturer NOT IN ('mtg', 'pokemon') THEN 'skipped_unmapped_manufacturer'
      WHEN coalesce(set_code, '') = '' THEN 'skipped_missing_set_code'
      WHEN coalesce(collector_number, '') = '' THEN 'skipped_missing_card_number' ELSE 'emitted' END AS outcome
  FROM refs)"""


def references(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    return t.part.select(
        F.col("p_partkey").cast("string").alias("variant_id"),
        F.when(kind.isin("ECONOMY", "STANDARD"), F.lit("mtg")).when(kind.isin("PROMO", "LARGE"), F.lit("pokemon"))
        .otherwise(F.lower(kind)).alias("manufacturer"),
        F.col("p_name").alias("name"), F.when(F.col("p_size") != 50, F.col("p_brand")).alias("set_code"),
        F.when(F.col("p_size") != 49, F.col("p_size").cast("string")).otherwise(F.lit("")).alias("collector_number"),
        F.concat(F.lit("images/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("front_image_path"),
        F.col("p_partkey").alias("ingest_order"))


EXEMPLARS_SQL = """
exemplars AS (
  SELECT r.manufacturer, r.variant_id, e.embedding::DOUBLE[] AS embedding, e.vec_id
  FROM embeddings e JOIN refs r ON r.variant_id = CAST(e.vec_id AS VARCHAR))"""


def exemplars(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("variant_id"), "embedding")
    return vectors.join(references(t).select("variant_id", "manufacturer"), "variant_id").select(
        "manufacturer", "variant_id", F.lit(0).alias("exemplar_ix"), "embedding")
