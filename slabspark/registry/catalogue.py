"""Catalog sync, upserts, resume joins and exemplars over parts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark import schemas as SC
from slabspark.operators import catalog as C
from slabspark.operators import exemplars as X
from slabspark.operators.funnel import outcome_counts
from slabspark.registry import views as V
from slabspark.registry.core import Tables, query
from slabspark.sources.store import merge_by_key

WITH = f"WITH {V.REFERENCES_SQL}"


def _sets(t: Tables) -> DataFrame:
    rows = C.distinct_sets(V.references(t), "ingest_order")
    return rows.withColumn("id", C.stable_id(F.col("game"), F.col("code")))


@query("distinct_sets", sql=f"""{WITH}
SELECT game, set_code AS code, upper(set_code) AS name FROM labelled
WHERE game IS NOT NULL AND coalesce(set_code, '') <> '' GROUP BY 1, 2""")
def distinct_sets(t: Tables) -> DataFrame:
    """One row per (game, code), the first occurrence names it."""
    return C.distinct_sets(V.references(t), "ingest_order")


@query("first_set_name", sql=f"""{WITH}
SELECT game, set_code AS code, arg_min(name, ingest_order) AS name FROM labelled
WHERE game IS NOT NULL AND coalesce(set_code, '') <> '' GROUP BY 1, 2""")
def first_set_name(t: Tables) -> DataFrame:
    """First-seen name per set in ingest order."""
    return C.distinct_sets(V.references(t), "ingest_order", name=F.col("name"))


@query("reference_outcomes", sql=f"{WITH} SELECT outcome, count(*) AS n FROM labelled GROUP BY 1")
def reference_outcomes(t: Tables) -> DataFrame:
    """Exactly one outcome per reference, counted."""
    return outcome_counts(C.attach_set_ids(C.label_references(V.references(t)), _sets(t)))


@query("sync_stats", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT (SELECT count(*) FROM (SELECT DISTINCT game, set_code FROM labelled WHERE game IS NOT NULL AND
    coalesce(set_code, '') <> '')) AS sets_total, count(*) AS variants_total,
  count(*) FILTER (outcome = 'skipped_unmapped_manufacturer') AS skipped_unmapped_manufacturer,
  count(*) FILTER (outcome = 'skipped_missing_set_code') AS skipped_missing_set_code,
  count(*) FILTER (outcome = 'skipped_missing_card_number') AS skipped_missing_card_number,
  count(*) FILTER (outcome = 'emitted') AS variants_upserted, 0 AS variants_with_phash,
  count(*) FILTER (outcome = 'emitted' AND variant_id IN (SELECT variant_id FROM exemplars)) AS variants_with_embedding,
  count(*) FILTER (outcome = 'emitted') AS image_load_failures FROM labelled""")
def sync_stats(t: Tables) -> DataFrame:
    """Counters of one catalog sync, dry run."""
    labelled = C.attach_set_ids(C.label_references(V.references(t)), _sets(t))
    rows = C.variant_rows(labelled, V.exemplars(t))
    return C.sync_stats(labelled, rows, _sets(t))


VARIANT_SQL = f"""{WITH}, {V.EXEMPLARS_SQL},
last_rows AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY game, set_code, collector_number ORDER BY ingest_order DESC) AS rn
  FROM labelled WHERE outcome = 'emitted') WHERE rn = 1)"""


@query("sync_variants", sql=f"""{VARIANT_SQL}
SELECT md5(concat_ws('|', game, md5(concat_ws('|', game, set_code)), collector_number)) AS id, game,
  collector_number AS card_number, name, CASE WHEN manufacturer = 'mtg' THEN variant_id END AS scryfall_id,
  manufacturer, variant_id AS source_id, variant_id IN (SELECT variant_id FROM exemplars) AS has_embedding
FROM last_rows""")
def sync_variants(t: Tables) -> DataFrame:
    """Variants after the sync: last row of a key, provenance, set id, vector."""
    labelled = C.attach_set_ids(C.label_references(V.references(t)), _sets(t))
    empty = t.spark.createDataFrame([], SC.CARD_VARIANTS)
    rows = C.upsert_variants(empty, C.variant_rows(labelled, V.exemplars(t)))
    source = F.coalesce(F.col("external_ids")["mtg_variant_id"], F.col("external_ids")["pokemon_variant_id"])
    return rows.select("id", "game", "card_number", "name", "scryfall_id",
                       F.col("external_ids")["manufacturer"].alias("manufacturer"), source.alias("source_id"),
                       F.col("canonical_image_embedding").isNotNull().alias("has_embedding"))


@query("upsert_sets", sql=f"""{WITH},
target AS (SELECT CASE WHEN game IS NULL THEN 'other' ELSE game END AS game, set_code AS code, 'old ' || set_code AS name,
    manufacturer || '/' || set_code AS id FROM labelled
  WHERE manufacturer <> 'pokemon' AND coalesce(set_code, '') <> '' GROUP BY ALL),
source AS (SELECT DISTINCT game, set_code AS code, upper(set_code) AS name FROM labelled
  WHERE game IS NOT NULL AND coalesce(set_code, '') <> '')
SELECT coalesce(t.id, md5(concat_ws('|', s.game, s.code))) AS id, coalesce(s.game, t.game) AS game,
  coalesce(s.code, t.code) AS code, coalesce(s.name, t.name) AS name
FROM target t FULL JOIN source s ON s.game = t.game AND s.code = t.code""")
def upsert_sets(t: Tables) -> DataFrame:
    """Merge on (game, code): existing ids kept, names refreshed, rest inserted."""
    refs = V.references(t)
    held = refs.where((F.col("manufacturer") != "pokemon") & (F.coalesce("set_code", F.lit("")) != ""))
    target = held.select(
        F.concat_ws("/", "manufacturer", "set_code").alias("id"),
        F.coalesce(C.game_of(F.col("manufacturer")), F.lit("other")).alias("game"),
        F.col("set_code").alias("code"), F.concat(F.lit("old "), F.col("set_code")).alias("name")).distinct()
    return C.upsert_sets(target, C.distinct_sets(refs))


@query("merge_by_key", sql="""WITH target AS (SELECT CASE WHEN s_acctbal > 5000 THEN 'x' ELSE 'n' END || s_nationkey AS k,
    max(s_name) AS name, max(s_acctbal) AS bal FROM supplier GROUP BY 1),
source AS (SELECT CASE WHEN c_acctbal > 5000 THEN 'y' ELSE 'n' END || c_nationkey AS k, max(c_custkey) AS last FROM customer GROUP BY 1),
src AS (SELECT s.k, c.c_name AS name, CASE WHEN c.c_acctbal > 1000 THEN c.c_acctbal END AS bal FROM source s
  JOIN customer c ON c.c_custkey = s.last)
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name,
  CASE WHEN s.k IS NULL THEN t.bal ELSE s.bal END AS bal FROM target t FULL JOIN src s USING (k)""")
def merge_rows(t: Tables) -> DataFrame:
    """Generic upsert: last source row of a key wins, nulls overwrite."""
    key = lambda bal, mark, nation: F.concat(F.when(F.col(bal) > 5000, F.lit(mark)).otherwise(F.lit("n")),
                                             F.col(nation).cast("string")).alias("k")
    target = t.supplier.groupBy(key("s_acctbal", "x", "s_nationkey")).agg(
        F.max("s_name").alias("name"), F.max("s_acctbal").alias("bal"))
    source = t.customer.select(
        key("c_acctbal", "y", "c_nationkey"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("bal"), "c_custkey")
    return merge_by_key(target, source, ["k"], order=[F.col("c_custkey")])


@query("catalog_view", sql=f"""WITH {V.VARIANTS_SQL}
SELECT v.id AS variant_id, v.name, s.code AS set_code, v.card_number FROM variants v JOIN sets s ON s.id = v.set_id""")
def catalog_view(t: Tables) -> DataFrame:
    """Variants joined to their set code."""
    from slabspark.sources.readers import catalog_view as view

    none = lambda kind: F.lit(None).cast(kind)
    variants = V.variants(t).select(
        "*", F.lit("other").alias("game"), none("string").alias("scryfall_id"),
        none("map<string,string>").alias("external_ids"), none("bigint").alias("canonical_phash"),
        none("array<float>").alias("canonical_image_embedding"))
    return view(variants, V.sets(t)).select("variant_id", "name", "set_code", "card_number")


@query("references_with_vectors", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT r.manufacturer, r.variant_id, r.name, e.vec_id IS NOT NULL AS has_vector FROM refs r
LEFT JOIN exemplars e USING (manufacturer, variant_id)""")
def references_with_vectors(t: Tables) -> DataFrame:
    """References keep their row without a vector."""
    has = V.exemplars(t).select("manufacturer", "variant_id", F.lit(True).alias("h"))
    return V.references(t).join(has, ["manufacturer", "variant_id"], "left").select(
        "manufacturer", "variant_id", "name", F.coalesce("h", F.lit(False)).alias("has_vector"))


@query("canonical_catalog", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT r.manufacturer, r.variant_id, r.name, round(list_sum(e.embedding), 4) AS total FROM refs r
JOIN exemplars e USING (manufacturer, variant_id)""")
def canonical(t: Tables) -> DataFrame:
    """Printings with a vector, first exemplar only."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return C.canonical_catalog(V.references(t), V.exemplars(t)).select(
        "manufacturer", "variant_id", "name", F.round(total, 4).alias("total"))


@query("keyed_lookup", sql=f"""{WITH}
SELECT manufacturer || '/' || variant_id AS key, manufacturer, variant_id FROM refs""")
def keyed_lookup(t: Tables) -> DataFrame:
    """Composite keys written and parsed back."""
    from slabspark.functions.text import compose_key, parse_key

    key = V.references(t).select(compose_key(F.col("manufacturer"), F.col("variant_id")).alias("key"))
    return key.withColumn("k", parse_key(F.col("key"))).select("key", "k.manufacturer", "k.variant_id")


@query("resume_range", sql="""SELECT i AS cert_id FROM range((SELECT min(l_orderkey) FROM lineitem),
  (SELECT max(l_orderkey) + 1 FROM lineitem)) r(i) WHERE i NOT IN (SELECT l_orderkey FROM lineitem)""")
def resume_range(t: Tables) -> DataFrame:
    """Requested id range minus the ids already stored."""
    low, high = t.lineitem.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    stored = t.lineitem.select(F.col("l_orderkey").alias("cert_id")).distinct()
    return X.requested_range(t.spark, low, high, stored, "cert_id")


@query("unseen_references", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT manufacturer, variant_id FROM refs WHERE (manufacturer, variant_id) NOT IN
  (SELECT (manufacturer, variant_id) FROM exemplars)""")
def unseen_references(t: Tables) -> DataFrame:
    """Composite-key anti-join in front of the embedder."""
    return X.unseen(V.references(t).select("manufacturer", "variant_id"), V.exemplars(t),
                    ["manufacturer", "variant_id"])


@query("unconsumed_certs", sql="""SELECT o_orderkey AS cert_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def unconsumed_certs(t: Tables) -> DataFrame:
    """Certs that are not in the consumed log."""
    log = t.lineitem.select(F.col("l_orderkey").alias("cert_id")).distinct()
    return X.unseen(t.orders.select(F.col("o_orderkey").alias("cert_id")), log, ["cert_id"])


@query("append_exemplars", sql="""WITH store AS (SELECT label, max(rn) AS last FROM (
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings
    WHERE embedding[1] > 0) GROUP BY 1)
SELECT e.vec_id, e.label, coalesce(s.last, -1) + row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS exemplar_ix
FROM embeddings e LEFT JOIN store s USING (label) WHERE e.embedding[1] <= 0""")
def append_exemplars(t: Tables) -> DataFrame:
    """New exemplars numbered after the stored ones of their variant."""
    from slabspark.operators.hot import row_numbers

    rows = t.embeddings.select(F.lit("vec").alias("manufacturer"), F.col("label").cast("string").alias("variant_id"),
                               "vec_id", "embedding")
    held = row_numbers(rows.where(F.col("embedding")[0] > 0), ["manufacturer", "variant_id"], [("vec_id", True)], "rn")
    store = held.select("manufacturer", "variant_id", (F.col("rn") - 1).cast("int").alias("exemplar_ix"), "embedding")
    new = X.append_exemplars(store, rows.where(F.col("embedding")[0] <= 0), "vec_id", keep=["vec_id"])
    return new.select("vec_id", F.col("variant_id").cast("int").alias("label"), "exemplar_ix")


@query("embedding_outcomes", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT outcome, count(*) AS n FROM (SELECT CASE
  WHEN (manufacturer, variant_id) IN (SELECT (manufacturer, variant_id) FROM exemplars) THEN 'skipped_existing'
  WHEN ingest_order % 7 = 0 THEN 'embedder_failures' ELSE 'embedded' END AS outcome FROM refs) GROUP BY 1""")
def embedding_outcomes(t: Tables) -> DataFrame:
    """Incremental embedding with a supplied encoder: outcomes counted."""
    def encode(rows: DataFrame) -> DataFrame:  # a vector from the id; some of a wrong length
        size = F.when(F.col("ingest_order") % 7 == 0, F.lit(3)).otherwise(F.lit(4))
        return rows.withColumn("embedding", F.array_repeat(F.col("ingest_order").cast("float"), size))

    _, outcomes = X.embed_references(V.references(t), V.exemplars(t), encode, 4)
    return outcome_counts(outcomes)


@query("exemplar_outcomes", sql="""WITH d AS (
  SELECT l.doc_id, l.toxic, l.quality, e.label FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'skipped_already_consumed'
  WHEN toxic = 1 THEN 'skipped_no_image' WHEN quality = 0 THEN 'skipped_unidentified' WHEN label IS NULL
  THEN 'embedder_failures' ELSE 'appended' END AS outcome FROM d) GROUP BY 1""")
def exemplar_outcomes(t: Tables) -> DataFrame:
    """Outcome of every cert in an exemplar accumulation pass."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    certs = t.labels.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("cert_id"), F.when(F.col("toxic") == 0, F.lit("front.png")).alias("front_image_path"),
        "embedding", "quality")
    chosen = certs.where("quality = 1").select(F.col("cert_id").alias("query_id"), F.lit("v").alias("variant_id"),
                                               F.lit("mtg").alias("manufacturer"))
    log = t.benchmark.select(F.col("item_id").alias("cert_id"))
    return outcome_counts(X.label_certs(certs, log, chosen, 64))


@query("sync_catalog", sql=f"""{VARIANT_SQL}
SELECT game, collector_number AS card_number, name || '!' AS name, CASE WHEN manufacturer = 'mtg' THEN variant_id END AS scryfall_id
FROM last_rows""")
def sync_catalog(t: Tables) -> DataFrame:
    """Catalog job run twice with changed names: keys stay, values are refreshed."""
    import uuid

    from slabspark.plans import jobs
    from slabspark.session import scratch_root
    from slabspark.sources.store import TableStore

    store = TableStore(t.spark, f"{scratch_root(t.spark)}/sync-{uuid.uuid4().hex}")
    refs = V.references(t)
    jobs.sync_catalog(store, refs, V.exemplars(t), ingest_order="ingest_order")
    jobs.sync_catalog(store, refs.withColumn("name", F.concat("name", F.lit("!"))), V.exemplars(t), ingest_order="ingest_order")
    return store.read("card_variants", SC.CARD_VARIANTS).select("game", "card_number", "name", "scryfall_id")
