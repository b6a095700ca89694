"""Submissions, grades, certificates and workbench views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions import scalars as S
from slabspark.operators import certs, dashboard, ops
from slabspark.operators import grading as G
from slabspark.registry import views as V
from slabspark.registry.core import Tables, query

WITH = f"WITH {V.SUBMISSIONS_SQL}, {V.GRADES_SQL}, {V.VARIANTS_SQL}, {V.AUTH_SQL}"
FRONT = " ".join(f"WHEN off <= {b} THEN {g}" for b, g in P.FRONT_CENTERING_STEPS)
BACK = " ".join(f"WHEN off <= {b} THEN {g}" for b, g in P.BACK_CENTERING_STEPS)
EDGE = " ".join(f"WHEN fraction <= {b} THEN {g}" for b, g in P.EDGE_STEPS)


@query("population_stat", sql=f"""{WITH}
SELECT s.id AS submission_id, s.identified_variant_id AS variant_id,
  count(*) OVER v AS total_graded,
  rank() OVER (PARTITION BY s.identified_variant_id ORDER BY g.final DESC NULLS LAST) AS this_rank,
  max(g.final) OVER v AS max_grade,
  row_number() OVER (PARTITION BY s.identified_variant_id ORDER BY s.completed_at, s.id) AS chronological_index
FROM submissions s JOIN grades g ON g.submission_id = s.id
WHERE s.status = 'completed' AND g.scheme = 'psa' AND s.identified_variant_id IS NOT NULL
WINDOW v AS (PARTITION BY s.identified_variant_id)""")
def population_stat(t: Tables) -> DataFrame:
    """Population rank of every certificate within its variant."""
    done = V.submissions(t).where("status = 'completed' AND identified_variant_id IS NOT NULL")
    return certs.population(certs.graded(done, V.grades(t)),
                            bound=done.select(F.col("identified_variant_id").alias("variant_id")))


@query("graded_submissions", sql=f"""{WITH}
SELECT s.id AS submission_id, s.identified_variant_id AS variant_id, g.final
FROM submissions s JOIN grades g ON g.submission_id = s.id WHERE s.status = 'completed' AND g.scheme = 'psa'""")
def graded_submissions(t: Tables) -> DataFrame:
    """Completed submissions joined to their grade of one scheme."""
    return certs.graded(V.submissions(t), V.grades(t)).drop("completed_at")


@query("primary_grade", sql=f"""{WITH}
SELECT submission_id, scheme, final, round(centering, 6) AS centering FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY scheme <> 'psa', scheme) AS rn FROM grades)
WHERE rn = 1""")
def primary_grade(t: Tables) -> DataFrame:
    """PSA grade when present, else the first one."""
    return certs.primary_grades(V.grades(t)).select(
        "submission_id", "scheme", "final", F.round("centering", 6).alias("centering"))


@query("identified_card", sql=f"""{WITH}
SELECT s.id, v.name AS card_name, t.code AS set_code, v.card_number,
  CASE WHEN v.name IS NOT NULL THEN round(coalesce(s.identification_confidence, 0), 6) END AS match_confidence
FROM submissions s LEFT JOIN variants v ON v.id = s.identified_variant_id LEFT JOIN sets t ON t.id = v.set_id""")
def identified_card(t: Tables) -> DataFrame:
    """Variant and set of each submission, null confidence as zero."""
    return certs.identified_cards(V.submissions(t), V.variants(t), V.sets(t)).select(
        "id", "card_name", "set_code", "card_number", F.round("match_confidence", 6).alias("match_confidence"))


@query("certificates", sql=f"""{WITH},
pop AS (
  SELECT s.id, count(*) OVER v AS total_graded,
    rank() OVER (PARTITION BY s.identified_variant_id ORDER BY g.final DESC NULLS LAST) AS this_rank,
    max(g.final) OVER v AS max_grade,
    row_number() OVER (PARTITION BY s.identified_variant_id ORDER BY s.completed_at, s.id) AS chronological_index
  FROM submissions s JOIN grades g ON g.submission_id = s.id
  WHERE s.status = 'completed' AND g.scheme = 'psa' AND s.identified_variant_id IS NOT NULL
  WINDOW v AS (PARTITION BY s.identified_variant_id)),
listed AS (
  SELECT submission_id, string_agg(scheme || ':' || coalesce(CAST(final AS VARCHAR), 'null'), ',' ORDER BY scheme) AS g
  FROM grades GROUP BY 1)
SELECT s.id AS submission_id, v.name AS card_name, t.code AS set_code, coalesce(l.g, '') AS grades,
  a.verdict AS auth_verdict, round(a.confidence, 6) AS auth_confidence, p.total_graded, p.this_rank, p.max_grade,
  p.chronological_index
FROM submissions s LEFT JOIN variants v ON v.id = s.identified_variant_id LEFT JOIN sets t ON t.id = v.set_id
LEFT JOIN listed l ON l.submission_id = s.id LEFT JOIN auth a ON a.submission_id = s.id LEFT JOIN pop p ON p.id = s.id
WHERE s.status = 'completed'""")
def certificates(t: Tables) -> DataFrame:
    """Certificate assembly for every completed submission."""
    rows = certs.certificates(V.submissions(t), V.grades(t), V.auth(t), V.variants(t), V.sets(t))
    listed = F.array_join(F.transform("grades", lambda g: F.concat(
        g["scheme"], F.lit(":"), F.coalesce(g["final"].cast("string"), F.lit("null")))), ",")
    return rows.select("submission_id", "card_name", "set_code", listed.alias("grades"), "auth_verdict",
                       F.round("auth_confidence", 6).alias("auth_confidence"), "total_graded", "this_rank",
                       "max_grade", "chronological_index")


VIEWS_SQL = f"""{WITH},
pg AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY scheme <> 'psa', scheme) AS rn FROM grades)
  WHERE rn = 1),
joined AS (
  SELECT s.*, v.name AS card_name, t.code AS set_code, v.card_number, g.scheme IS NOT NULL AS has_grade, g.centering,
    g.corners, g.edges, g.surface, g.final, g.confidence AS grade_confidence, a.verdict, a.confidence AS auth_conf
  FROM submissions s LEFT JOIN variants v ON v.id = s.identified_variant_id LEFT JOIN sets t ON t.id = v.set_id
  LEFT JOIN pg g ON g.submission_id = s.id LEFT JOIN auth a ON a.submission_id = s.id),
card_views AS (
  SELECT id, status, 'PG-' || upper(substr(id, 1, 4)) || '-' || upper(substr(id, 10, 4)) AS short_id,
    coalesce(card_name, 'Unidentified card') AS name, coalesce(set_code, '—') AS "set",
    coalesce(card_number, '—') AS number, centering, corners, edges, surface, final,
    coalesce(grade_confidence, 0) AS confidence, coalesce(verdict, 'unverified') AS auth_verdict,
    coalesce(auth_conf, 0) AS auth_confidence,
    CASE WHEN has_grade AND final IS NULL AND (corners IS NULL OR surface IS NULL)
        THEN 'Preliminary — corners/surface heads not trained'
      WHEN status = 'rejected_quality' THEN 'Rejected at quality gate' ELSE rejection_reason END AS flag
  FROM joined)"""


def _views(t: Tables) -> DataFrame:
    primary = certs.primary_grades(V.grades(t)).select(
        F.col("submission_id").alias("id"), F.lit(True).alias("has_grade"), "centering", "corners", "edges", "surface",
        "final", F.col("confidence").alias("grade_confidence"))
    auth = V.auth(t).select(F.col("submission_id").alias("id"), F.col("verdict").alias("auth_verdict"),
                            F.col("confidence").alias("auth_confidence"))
    cards = certs.identified_cards(V.submissions(t), V.variants(t), V.sets(t))
    rows = cards.join(primary, "id", "left").join(auth, "id", "left").withColumn(
        "has_grade", F.coalesce("has_grade", F.lit(False)))
    return dashboard.card_views(rows)


@query("card_views", sql=f"""{VIEWS_SQL}
SELECT id, status, short_id, name, "set", number, final, round(confidence, 6) AS confidence, auth_verdict,
  round(auth_confidence, 6) AS auth_confidence, flag FROM card_views""")
def card_views(t: Tables) -> DataFrame:
    """Workbench rows: primary grade, fallbacks, first flag, short id."""
    return _views(t).select("id", "status", "short_id", "name", "set", "number", "final",
                            F.round("confidence", 6).alias("confidence"), "auth_verdict",
                            F.round("auth_confidence", 6).alias("auth_confidence"), "flag")


@query("workbench_stats", sql=f"""{VIEWS_SQL}
SELECT count(*) AS total, count(*) FILTER (auth_verdict <> 'authentic' OR flag IS NOT NULL) AS flagged,
  count(*) FILTER (corners IS NULL OR surface IS NULL) AS pending_heads, count(*) FILTER (final >= 9) AS top_tier,
  round(avg(final), 6) AS mean_final,
  (SELECT name FROM card_views WHERE final IS NOT NULL ORDER BY final DESC, id DESC LIMIT 1) AS highest_name,
  max(final) AS highest_grade,
  (SELECT name FROM card_views WHERE final IS NOT NULL ORDER BY final, id LIMIT 1) AS lowest_name,
  min(final) AS lowest_grade
FROM card_views""")
def workbench_stats(t: Tables) -> DataFrame:
    """Totals, flags, pending heads, top tier, mean and extremes."""
    return dashboard.workbench_stats(_views(t)).withColumn("mean_final", F.round("mean_final", 6))


@query("workbench_filters", sql=f"""{VIEWS_SQL}
SELECT 'top' AS which, id FROM card_views WHERE final >= 9
UNION ALL SELECT 'pending', id FROM card_views WHERE corners IS NULL OR surface IS NULL
UNION ALL SELECT 'flagged', id FROM card_views WHERE flag IS NOT NULL OR auth_verdict <> 'authentic'
UNION ALL SELECT 'search', id FROM card_views
  WHERE contains(lower(name), 'nation_1') OR contains(lower("set"), 'nation_1') OR contains(lower(id), 'nation_1')""")
def workbench_filters(t: Tables) -> DataFrame:
    """The three workbench filters and the text search."""
    return dashboard.fitting_filters(_views(t), "NATION_1").select("which", "id")


@query("confidence_band", sql=f"""{WITH}
SELECT submission_id, scheme,
  round(greatest(1, least(10, final - (1 - confidence) * 2)), 6) AS lower_bound,
  round(greatest(1, least(10, final + (1 - confidence) * 2)), 6) AS upper_bound
FROM grades WHERE final IS NOT NULL""")
def confidence_band(t: Tables) -> DataFrame:
    """Grade interval from its confidence, clamped to 1..10."""
    low, high = S.confidence_band(F.col("final"), F.col("confidence"))
    return V.grades(t).where(F.col("final").isNotNull()).select(
        "submission_id", "scheme", F.round(low, 6).alias("lower_bound"), F.round(high, 6).alias("upper_bound"))


@query("stage_states", sql=f"""{WITH}
SELECT id, stage_ix, stage, CASE status WHEN 'completed' THEN 'done' WHEN 'processing' THEN 'running'
    WHEN 'failed' THEN 'failed' WHEN 'rejected_quality' THEN CASE WHEN stage_ix = 0 THEN 'failed' ELSE 'pending' END
    ELSE 'pending' END AS stage_status,
  CASE WHEN status = 'completed' THEN 90.0 WHEN status = 'processing'
    THEN epoch(TIMESTAMP '2003-01-01' - created_at) END AS elapsed_seconds
FROM submissions, (VALUES (0, 'detect'), (1, 'identify'), (2, 'counterfeit'), (3, 'grade')) AS st(stage_ix, stage)""")
def stage_states(t: Tables) -> DataFrame:
    """Status and elapsed time per submission and pipeline stage."""
    now = F.lit("2003-01-01 00:00:00").cast("timestamp")
    return dashboard.stage_states(V.submissions(t), now)


@query("regions", sql=f"""{WITH}, dims AS (
  SELECT * FROM (VALUES ('centering', 'whole_card'), ('edge', 'top'), ('edge', 'right'), ('edge', 'bottom'),
    ('edge', 'left'), ('corner', 'top_left'), ('corner', 'top_right'), ('corner', 'bottom_left'),
    ('corner', 'bottom_right'), ('surface', 'whole_card')) AS d(kind, position)),
scored AS (
  SELECT submission_id, scheme, kind, position, CASE kind WHEN 'centering' THEN centering WHEN 'edge' THEN edges
    WHEN 'corner' THEN corners ELSE surface END / 10.0 AS score FROM grades, dims),
bucketed AS (
  SELECT *, CASE WHEN score IS NULL THEN 'unknown' WHEN score > 0.95 THEN 'ok' WHEN score >= 0.85 THEN 'minor'
    ELSE 'major' END AS severity FROM scored)
SELECT submission_id, scheme, kind, position, round(score, 6) AS score, severity,
  CASE WHEN severity = 'unknown' AND kind IN ('corner', 'surface') THEN 'Analysis pending'
    WHEN kind = 'centering' AND severity = 'minor' THEN 'Minor off-center'
    WHEN kind = 'centering' AND severity = 'major' THEN 'Significant off-center crop'
    WHEN kind = 'corner' AND severity = 'minor' THEN 'Minor whitening or wear'
    WHEN kind = 'corner' AND severity = 'major' THEN 'Visible corner damage'
    WHEN kind = 'edge' AND severity = 'minor' THEN 'Minor edge wear'
    WHEN kind = 'edge' AND severity = 'major' THEN 'Edge chipping or notching'
    WHEN kind = 'surface' AND severity = 'minor' THEN 'Light surface marks'
    WHEN kind = 'surface' AND severity = 'major' THEN 'Significant surface damage' ELSE '' END AS reasons
FROM bucketed""")
def regions(t: Tables) -> DataFrame:
    """Ten region rows per grade with severity and reasons."""
    keyed = V.grades(t).withColumn("k", F.struct("submission_id", "scheme"))
    return G.regions(keyed, "k").select("k.submission_id", "k.scheme", "kind", "position",
                                        F.round("score", 6).alias("score"), "severity",
                                        F.array_join("reasons", "|").alias("reasons"))


@query("defects", sql=f"""{WITH}, dims AS (
  SELECT * FROM (VALUES ('centering', 0, 1), ('corner', 1, 4), ('edge', 2, 4), ('surface', 3, 1)) AS d(kind, kind_order, n)),
scored AS (
  SELECT kind, kind_order, n, CASE kind WHEN 'centering' THEN centering WHEN 'edge' THEN edges
    WHEN 'corner' THEN corners ELSE surface END / 10.0 AS score FROM grades, dims)
SELECT kind_order, kind, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.85 THEN 'minor' ELSE 'major' END
    AS severity, CAST(sum(n) AS BIGINT) AS n
FROM scored WHERE (score IS NULL AND kind IN ('corner', 'surface')) OR score <= 0.95 GROUP BY ALL""")
def defects(t: Tables) -> DataFrame:
    """Flagged defects by kind in display order, counted."""
    keyed = V.grades(t).withColumn("k", F.struct("submission_id", "scheme"))
    flagged = G.defect_list(G.regions(keyed, "k"), "k")
    back = {text: sev for (_, sev), text in P.DEFECT_REASONS.items()}
    names = F.create_map(*[F.lit(v) for item in back.items() for v in item])
    return flagged.groupBy("kind_order", "kind", names[F.col("reason")].alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))


@query("final_grade", sql=f"""{WITH}
SELECT submission_id, scheme, CASE WHEN corners IS NOT NULL AND surface IS NOT NULL
  THEN round_even(least(centering, corners, edges, surface) * 2, 0) / 2 END AS final FROM raw_grades""")
def final_grade(t: Tables) -> DataFrame:
    """Null-propagating minimum on the half-step grid."""
    return V.grades(t).select("submission_id", "scheme", "final")


@query("centering_subgrade", sql=f"""WITH faces AS (
  SELECT l_orderkey, CASE WHEN l_linenumber <= 4 THEN 'front' ELSE 'back' END AS face,
    greatest(abs(l_quantity * 2 - 50), abs(l_discount * 500 + l_tax * 500 - 50)) AS off FROM lineitem),
worst AS (SELECT l_orderkey, max(off) FILTER (face = 'front') AS f, max(off) FILTER (face = 'back') AS b
  FROM faces GROUP BY 1)
SELECT l_orderkey, round(f, 6) AS front_offset, least((SELECT CASE {FRONT} ELSE 1.0 END FROM (SELECT f AS off)),
  coalesce((SELECT CASE {BACK} ELSE 1.0 END FROM (SELECT b AS off) WHERE b IS NOT NULL), 10.0)) AS centering
FROM worst WHERE f IS NOT NULL""")
def centering_subgrade(t: Tables) -> DataFrame:
    """Worst axis offset to the front and back step tables."""
    front = F.col("l_linenumber") <= 4
    off = S.centering_offset(F.col("l_quantity") * 2, F.col("l_discount") * 500 + F.col("l_tax") * 500)
    worst = t.lineitem.groupBy("l_orderkey").agg(F.max(F.when(front, off)).alias("f"),
                                                 F.max(F.when(~front, off)).alias("b"))
    return worst.where(F.col("f").isNotNull()).select(
        "l_orderkey", F.round("f", 6).alias("front_offset"),
        S.centering_subgrade(F.col("f"), F.col("b")).alias("centering"))


SIDES_SQL = """sides AS (
  SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'front' ELSE 'back' END AS face,
    CAST(l_discount * 100 AS INT) AS anomaly_count, CAST(l_quantity AS INT) * 10 AS length FROM lineitem)"""


def _sides(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", F.lit("front")).otherwise(F.lit("back")).alias("face"),
        F.round(F.col("l_discount") * 100).cast("int").alias("anomaly_count"),
        (F.col("l_quantity").cast("int") * 10).alias("length"))


EDGES_SQL = f"""WITH {SIDES_SQL},
agg AS (
  SELECT l_orderkey, face, sum(anomaly_count) / sum(length) AS fraction,
    greatest(0.5, 1 - 2 * (max(anomaly_count / length) - min(anomaly_count / length))) AS confidence
  FROM sides GROUP BY 1, 2),
faces AS (SELECT *, CASE {EDGE} ELSE 1.0 END AS subgrade FROM agg)"""


@query("edge_subgrade", sql=f"""{EDGES_SQL}
SELECT l_orderkey, face, round(fraction, 6) AS fraction, subgrade, round(confidence, 6) AS confidence FROM faces""")
def edge_subgrade(t: Tables) -> DataFrame:
    """Anomaly fraction of a face to its step table, spread to confidence."""
    return G.edge_face(_sides(t), ["l_orderkey", "face"]).select(
        "l_orderkey", "face", F.round("fraction", 6).alias("fraction"), "subgrade",
        F.round("confidence", 6).alias("confidence"))


@query("worse_face", sql=f"""{EDGES_SQL}
SELECT l_orderkey, min(subgrade) AS subgrade, arg_min(face, subgrade * 10 + CASE WHEN face = 'front' THEN 0 ELSE 1 END)
  AS worse_face, round(avg(confidence), 6) AS confidence FROM faces GROUP BY 1""")
def worse_face(t: Tables) -> DataFrame:
    """Lower face decides, front on a tie."""
    return G.worse_face(G.edge_face(_sides(t), ["l_orderkey", "face"]), "l_orderkey").withColumn(
        "confidence", F.round("confidence", 6))


@query("grade_upsert", sql=f"""{WITH},
target AS (SELECT * FROM grades WHERE scheme <> 'trugrade'),
measured AS (SELECT submission_id, edges AS new_edges, confidence AS new_confidence FROM grades WHERE scheme = 'trugrade')
SELECT g.submission_id, g.scheme,
  round(CASE WHEN g.scheme = 'psa' AND m.new_edges IS NOT NULL THEN m.new_edges ELSE g.edges END, 6) AS edges,
  round(CASE WHEN g.scheme = 'psa' AND m.new_edges IS NOT NULL THEN least(g.confidence, m.new_confidence)
    ELSE g.confidence END, 6) AS confidence,
  CASE WHEN g.scheme = 'psa' AND m.new_edges IS NOT NULL THEN CASE WHEN corners IS NOT NULL AND surface IS NOT NULL
    THEN round_even(least(centering, corners, m.new_edges, surface) * 2, 0) / 2 END ELSE g.final END AS final
FROM target g LEFT JOIN measured m USING (submission_id)""")
def grade_upsert(t: Tables) -> DataFrame:
    """Edges part merged into existing grades: min confidence, final recomputed."""
    rows = V.grades(t)
    nothing = {c: F.lit(None).cast("double") for c in ("front_centering_lr", "front_centering_tb",
                                                       "back_centering_lr", "back_centering_tb")}
    target = rows.where("scheme <> 'trugrade'").withColumns(
        {**nothing, "model_versions": F.create_map(F.lit("centering"), F.lit(P.GEOMETRIC_VERSION))})
    measured = rows.where("scheme = 'trugrade'").select(
        "submission_id", F.col("edges").alias("subgrade"), "confidence", F.lit("front").alias("worse_face"))
    merged, _ = G.upsert_edges(target, measured)
    return merged.select("submission_id", "scheme", F.round("edges", 6).alias("edges"),
                         F.round("confidence", 6).alias("confidence"), "final")


@query("grade_upsert_orphans", sql=f"""{WITH}
SELECT submission_id FROM grades WHERE scheme = 'trugrade'
  AND submission_id NOT IN (SELECT submission_id FROM grades WHERE scheme = 'psa')""")
def grade_upsert_orphans(t: Tables) -> DataFrame:
    """Edge measurements without a grade row are reported, not inserted."""
    rows = V.grades(t).withColumn("model_versions", F.create_map(F.lit("a"), F.lit("b")))
    measured = rows.where("scheme = 'trugrade'").select(
        "submission_id", F.col("edges").alias("subgrade"), "confidence", F.lit("front").alias("worse_face"))
    return G.upsert_edges(rows.where("scheme <> 'trugrade'"), measured)[1]


QUALITY_SQL = """shots AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
    ['front_full', 'back_full', 'front_full_flash', 'corner_tl', 'tilt_30', 'corner_br', 'other'][l_linenumber] AS kind,
    l_extendedprice / 500 AS blur, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS glare,
    l_linestatus = 'F' AS card_detected, l_quantity / 50 AS card_fill, l_discount * 500 AS perspective FROM lineitem),
judged AS (
  SELECT *, blur < 90 AS r1,
    coalesce(glare > CASE kind WHEN 'front_full_flash' THEN 0.08 WHEN 'tilt_30' THEN 0.05 ELSE 0.012 END, false) AS r2,
    NOT card_detected AND NOT starts_with(kind, 'corner') AS r3,
    card_detected AND card_fill < CASE WHEN starts_with(kind, 'corner') THEN 0.15 ELSE 0.25 END AS r4,
    card_detected AND card_fill > CASE WHEN starts_with(kind, 'corner') THEN 0.6 ELSE 0.95 END AS r5,
    card_detected AND perspective > CASE kind WHEN 'tilt_30' THEN 45 ELSE 20 END AS r6 FROM shots)"""


@query("quality_gate", sql=f"""WITH {QUALITY_SQL}
SELECT kind, NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS passed,
  concat_ws(';', CASE WHEN r1 THEN 'blur' END, CASE WHEN r2 THEN 'glare' END, CASE WHEN r3 THEN 'missing' END,
    CASE WHEN r4 THEN 'small' WHEN r5 THEN 'large' END, CASE WHEN r6 THEN 'tilt' END) AS reasons,
  count(*) AS n, round(sum(l_extendedprice), 2) AS weight
FROM judged GROUP BY ALL""")
def quality_gate(t: Tables) -> DataFrame:
    """Per-kind capture limits, reasons and pass flag, counted."""
    kinds = F.array(*[F.lit(k) for k in ("front_full", "back_full", "front_full_flash", "corner_tl", "tilt_30",
                                         "corner_br", "other")])
    shots = t.lineitem.select(
        F.element_at(kinds, F.col("l_linenumber")).alias("kind"), (F.col("l_extendedprice") / 500).alias("blur"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("glare"),
        (F.col("l_linestatus") == "F").alias("card_detected"), (F.col("l_quantity") / 50).alias("card_fill"),
        (F.col("l_discount") * 500).alias("perspective"), "l_extendedprice")
    names = F.create_map(*[F.lit(v) for k, text in P.QUALITY_REASONS.items() for v in (text, k)])
    gated = G.quality_gate(shots).withColumn("reasons", F.array_join(F.transform("reasons", lambda r: names[r]), ";"))
    return gated.groupBy("kind", "passed", "reasons").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("weight"))


SHOTS_SQL = """shots AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS submission_id, ['front_full', 'back_full', 'tilt_30'][1 + l_linenumber % 3]
    AS kind, l_partkey AS id, l_linestatus = 'F' AS quality_passed, l_shipdate AS created_at FROM lineitem)"""


def _shots(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("front_full", "back_full", "tilt_30")])
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("submission_id"),
        F.element_at(kinds, 1 + F.col("l_linenumber") % 3).alias("kind"), F.col("l_partkey").alias("id"),
        (F.col("l_linestatus") == "F").alias("quality_passed"), F.col("l_shipdate").alias("created_at"))


@query("latest_shots", sql=f"""WITH {SHOTS_SQL}
SELECT submission_id, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, kind
  ORDER BY created_at DESC, id) AS rn FROM shots) WHERE rn = 1""")
def latest_shots(t: Tables) -> DataFrame:
    """Newest shot per submission and kind."""
    return ops.latest_shots(_shots(t)).select("submission_id", "kind", "id")


@query("missing_shots", sql=f"""WITH {SHOTS_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS submission_id, 'front_full' AS kind FROM orders
WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT submission_id FROM shots WHERE quality_passed AND kind = 'front_full')""")
def missing_shots(t: Tables) -> DataFrame:
    """Required kinds without a passing shot."""
    return ops.missing_shots(V.submissions(t), _shots(t))


@query("owner_latest", sql="""SELECT user_id, id, "rank" FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS "rank"
  FROM orders) WHERE "rank" <= 5""")
def owner_latest(t: Tables) -> DataFrame:
    """Every owner's newest five submissions (a top-k report)."""
    from slabspark.operators.hot import top_per_group

    return top_per_group(V.submissions(t), ["user_id"], [F.col("created_at").desc(), F.col("id")], 5).select(
        "user_id", "id", "rank")


@query("owner_page", sql="""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS st FROM orders
WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)
LIMIT 10 OFFSET 2""")
def owner_page(t: Tables) -> DataFrame:
    """One page of one owner's submissions, newest first."""
    owner = str(t.orders.agg(F.max("o_custkey")).first()[0])
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string")
                           .alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("st"))
    return dashboard.owner_page(rows, owner, 10, 2).select("id", "st")


@query("fresh_prices", sql="""WITH price AS (
  SELECT l_partkey AS k, l_shipdate AS t, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
ask AS (SELECT l_orderkey * 10 + l_linenumber AS rid, min(l_partkey) AS k,
    min(l_shipdate + INTERVAL 36 HOUR) AS t FROM lineitem GROUP BY 1)
SELECT a.rid, (SELECT arg_max(p.p, p.t) FROM price p WHERE p.k = a.k AND p.t <= a.t AND p.t > a.t - INTERVAL 48 HOUR)
  AS price FROM ask a""")
def fresh_prices(t: Tables) -> DataFrame:
    """As-of join: newest price of a card within its time to live."""
    price = t.lineitem.groupBy(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("fetched")).agg(
        F.max("l_extendedprice").alias("price"))
    ask = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid")).agg(
        F.min("l_partkey").alias("k"), F.min(F.col("l_shipdate") + F.expr("INTERVAL 36 HOURS")).alias("at"))
    return certs.latest_within(ask, price, ["k"], "at", "fetched", 48 * 3600, "rid", ["price"]).select("rid", "price")
