"""Composite jobs: what a user calls end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark import params as P
from slabspark import schemas as S
from slabspark.operators import authenticity, catalog, certs, evaluate, exemplars, grading, normalize, sampling
from slabspark.operators.funnel import outcome_counts
from slabspark.operators.identify import identify
from slabspark.operators.ops import latest_shots, usable_shots
from slabspark.session import materialize
from slabspark.sources.readers import authentic_labels
from slabspark.sources.store import TableStore

# exemplars remember the cert they came from (null for manufacturer references)
STORED_EXEMPLARS = T.StructType([*S.EXEMPLARS.fields, T.StructField("cert_id", T.LongType())])


def sync_catalog(store: TableStore, references: DataFrame, stored_exemplars: DataFrame | None = None,
                 hashes: DataFrame | None = None, dry_run: bool = False, ingest_order: str | None = None) -> DataFrame:
    """References -> card_sets and card_variants; returns the counters.

    Pass one upserts the sets, pass two the variants that need their ids.  A
    dry run counts without writing.
    """
    if ingest_order is not None:
        references = references.withColumn("ingest_order", F.col(ingest_order))
    sets = catalog.distinct_sets(references, "ingest_order" if ingest_order else None)
    merged = catalog.upsert_sets(store.read("card_sets", S.CARD_SETS), sets)
    if not dry_run:
        store.replace("card_sets", merged)
        merged = store.read("card_sets", S.CARD_SETS)
    labelled = catalog.attach_set_ids(catalog.label_references(references), merged)
    rows = catalog.variant_rows(labelled, stored_exemplars, hashes)
    if not dry_run:
        store.replace("card_variants", catalog.upsert_variants(store.read("card_variants", S.CARD_VARIANTS), rows))
    return catalog.sync_stats(labelled, rows, sets)


def embed_new_references(store: TableStore, references: DataFrame, encode, dim: int, force: bool = False) -> DataFrame:
    """Embed references that have no vector yet; returns outcome counts."""
    stored = store.read("exemplars", STORED_EXEMPLARS)
    new, outcomes = exemplars.embed_references(references, stored, encode, dim, force)
    new = materialize(new.withColumn("cert_id", F.lit(None).cast("bigint")), "embedded")  # encode once
    if force:
        kept = stored.join(new.select("manufacturer", "variant_id"), ["manufacturer", "variant_id"], "left_anti")
        store.replace("exemplars", kept.unionByName(new), partition_by=["manufacturer"])
    elif not new.isEmpty():
        store.append("exemplars", new.select(*STORED_EXEMPLARS.fieldNames()), partition_by=["manufacturer"])
    return outcome_counts(outcomes)


def accumulate_exemplars(store: TableStore, cert_rows: DataFrame, catalog_rows: DataFrame, dim: int,
                         added_at: str | None = None, epoch: tuple[str, int] | None = None) -> DataFrame:
    """Identify unseen certs and append their vectors; returns outcome counts.

    ``cert_rows``: cert_id, front_image_path, phash, embedding;
    ``catalog_rows``: variant_id, manufacturer, phash, embedding.
    Exemplars are appended before the log, and certs already present among
    the exemplars count as consumed, so a crash in between loses nothing and
    repeats nothing.  ``epoch`` (stream, number) is committed with the rows.
    """
    stored = store.read("exemplars", STORED_EXEMPLARS)
    log = store.read("consumed_log", S.CONSUMED_LOG)
    known = log.select("cert_id").unionByName(stored.where("cert_id IS NOT NULL").select("cert_id")).distinct()
    todo = exemplars.unseen(cert_rows, known, ["cert_id"]).where(F.coalesce("front_image_path", F.lit("")) != "")
    queries = todo.select(F.col("cert_id").alias("query_id"), "phash", "embedding")
    decisions, _ = identify(queries, catalog_rows, dim=dim)
    decisions = decisions.join(catalog_rows.select("variant_id", "manufacturer"), "variant_id", "left")
    labelled = materialize(exemplars.label_certs(cert_rows, known, decisions, dim), "cert-outcomes")
    new = labelled.where("outcome = 'appended'")
    if not new.isEmpty():
        numbered = exemplars.append_exemplars(stored, new, "cert_id", keep=["cert_id"])
        store.append("exemplars", numbered.select(*STORED_EXEMPLARS.fieldNames()), partition_by=["manufacturer"], epoch=epoch)
        stamp = F.lit(added_at) if added_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        store.append("consumed_log", new.select("cert_id", "manufacturer", F.col("variant_id").cast("string")
                                                .alias("variant_id"), stamp.alias("added_at")), epoch=epoch)
    return outcome_counts(labelled)


def authenticate(store: TableStore, measurements: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Measurements -> one upserted authenticity row per submission."""
    rows = materialize(authenticity.authenticity_rows(measurements), "authenticity")
    schema = schema or rows.schema
    store.upsert_buckets("authenticity_results", rows, ["submission_id"], schema)
    return store.read("authenticity_results", schema)


def measure_embeddings(submissions: DataFrame, references: DataFrame, sub_id: str, ref_id: str, group: str, vec: str,
                       dim: int | None = None) -> DataFrame:
    """Both embedding detectors for every submission, in measurement form."""
    centre = authenticity.centroid_distance(submissions, references, sub_id, group, vec).select(
        F.col(sub_id).cast("string").alias("submission_id"), F.lit("embedding_anomaly").alias("detector"), "score",
        "confidence", "abstain_reason",
        F.create_map(F.lit("distance_from_centroid"), F.col("distance_from_centroid"),
                     F.lit("n_references"), F.col("n_references").cast("double")).alias("metrics"))
    near = authenticity.neighbour_distance(submissions, references, sub_id, ref_id, group, vec, dim=dim).select(
        F.col(sub_id).cast("string").alias("submission_id"), F.lit("knn_reference").alias("detector"), "score",
        "confidence", "abstain_reason",
        F.create_map(F.lit("mean_topk_distance"), F.col("mean_topk_distance"),
                     F.lit("n_references_used"), F.col("n_references_used").cast("double"),
                     F.lit("k"), F.col("k").cast("double")).alias("metrics"))
    return centre.unionByName(near).withColumn("extracted_text", F.lit(None).cast("string"))


def grade(store: TableStore, centering_faces: DataFrame, edge_sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions of all graded submissions, edge measurements without a grade row).

    Both parts are merged at once, and only into the buckets of submissions
    that were measured.
    """
    centred = materialize(grading.centering_from_ratios(centering_faces), "centering")
    edged = materialize(grading.worse_face(grading.edge_face(edge_sides, ["submission_id", "face"])), "edges")
    left: list[DataFrame] = []

    def merge(current: DataFrame) -> DataFrame:
        updated, orphans = grading.upsert_edges(grading.upsert_centering(current, centred), edged)
        left.append(materialize(orphans, "edge-orphans"))
        return updated

    touched = centred.select("submission_id").unionByName(edged.select("submission_id"))
    store.rewrite("grades", touched, ["submission_id"], S.GRADES, merge)
    return grading.regions(store.read("grades", S.GRADES)), left[0]


def certificate_table(submissions: DataFrame, grades: DataFrame, auth: DataFrame, variants: DataFrame,
                      sets: DataFrame, prices: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(certificates with fresh prices, region rows of their primary grade)."""
    base = certs.certificates(submissions, grades, auth, variants, sets).withColumn("_now", now)
    priced = certs.latest_within(
        base.withColumnsRenamed({"card_name": "name"}), prices, ["name", "set_code", "card_number"], "_now",
        "fetched_at", P.PRICE_TTL_SECONDS, "submission_id",
        ["market_price", "low_price", "median_price", "direct_low_price", "product_url"],
    ).withColumnsRenamed({"name": "card_name", "fetched_at": "price_fetched_at"}).drop("_now")
    return priced, grading.regions(certs.primary_grades(grades))


def benchmark(outcomes: DataFrame, with_ensemble: bool = True) -> tuple[DataFrame, DataFrame]:
    """(metrics per detector, one-row report)."""
    rows = evaluate.ensemble_outcomes(outcomes) if with_ensemble else outcomes
    metrics = evaluate.confusion(rows)
    return metrics, evaluate.metrics_report(metrics, rows)


def recalibrate(outcomes: DataFrame, labels: DataFrame, certs_: DataFrame | None = None,
                target_recall: float = P.TARGET_AUTHENTIC_RECALL,
                fpr_budget: float = P.COUNTERFEIT_FPR_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(recommendations, score distributions) from outcomes and labels.

    Certs add authentic labels of their own.
    """
    known = labels.select("sample_id", "ground_truth")
    if certs_ is not None:
        known = known.unionByName(authentic_labels(certs_).select("sample_id", "ground_truth"))
    judged = evaluate.label_outcomes(outcomes.drop("ground_truth"), known)
    return (evaluate.recommendations(judged, target_recall, fpr_budget),
            evaluate.distributions(evaluate.confident_scores(judged)))


def training_manifests(cert_rows: DataFrame, files: DataFrame | None = None, overrides: DataFrame | None = None,
                       fraction: float = 0.2, seed: str = "49374") -> dict[str, DataFrame]:
    """Manifests for identification, corners and surface, each split by cert."""
    base = sampling.trainable(cert_rows, files=files)
    multi = sampling.drop_singletons(sampling.keyed(base))
    return {
        "identification": sampling.split_by_id(multi, "cert_id", fraction, seed),
        "corners": sampling.split_by_id(sampling.corner_fan_out(base, overrides), "cert_id", fraction, seed),
        "surface": sampling.split_by_id(base.select("cert_id", "front_image_path", "grade"), "cert_id", fraction, seed),
    }


def normalize_sources(mtg: DataFrame, pokemon: DataFrame, cert_payloads: DataFrame, cert_html: DataFrame,
                      ) -> dict[str, DataFrame]:
    """Raw payload tables -> references, certs and their outcome counts."""
    refs = normalize.union_references(normalize.mtg_references(mtg), normalize.pokemon_references(pokemon))
    scraped = normalize.cert_rows(normalize.pick_images(cert_payloads, "images")).unionByName(
        normalize.cert_pages(cert_html))
    return {
        "references": refs.where(F.col("outcome") != "parse_errors").drop("outcome"),
        "scraped": scraped.where(F.col("outcome") == "successful").drop("outcome"),
        "reference_outcomes": outcome_counts(refs), "cert_outcomes": outcome_counts(scraped),
    }


def ready_shots(shots: DataFrame) -> DataFrame:
    """Latest usable shot per kind of every submission."""
    return usable_shots(latest_shots(shots))
