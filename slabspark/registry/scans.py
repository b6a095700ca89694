"""Scans, sinks and whole jobs: given tables written to the shared folder in a file format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark import schemas as S
from slabspark.operators import grading as G
from slabspark.plans import jobs
from slabspark.registry import views as V
from slabspark.registry.core import Tables, query
from slabspark.registry.grading import BACK, EDGES_SQL, FRONT, _sides
from slabspark.session import scratch_root
from slabspark.sources import readers, store

WITH = f"WITH {V.REFERENCES_SQL}"


def _folder(t: Tables, label: str) -> str:
    return f"{scratch_root(t.spark)}/{label}-{uuid.uuid4().hex}"


def _lines(t: Tables, rows: DataFrame, damaged: Column, label: str) -> str:
    """One JSON document per line; after a damaged row come a blank and a broken line."""
    extra = F.when(damaged, F.array(F.col("line"), F.lit("  "), F.lit('{"cert_id": 1, "name'))).otherwise(F.array("line"))
    path = _folder(t, label)
    rows.select(F.explode(extra).alias("value")).write.text(path)
    return path


def _cert_lines(t: Tables) -> str:
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey").cast("bigint"))
    row = F.struct(key.alias("cert_id"), (F.col("o_custkey") % 11).cast("double").alias("grade"),
                   F.col("o_orderpriority").alias("card_name"))
    return _lines(t, t.orders.select("o_custkey", F.to_json(row).alias("line")), F.col("o_custkey") % 10 == 3, "certs")


@query("cert_lines", sql="""SELECT o_orderkey AS cert_id, o_custkey % 11 AS grade, o_orderpriority AS card_name FROM orders
WHERE o_orderpriority <> '5-LOW'""")
def cert_lines(t: Tables) -> DataFrame:
    """Certs from JSON Lines; blank and broken lines and rows without an id are skipped."""
    return readers.read_certs(t.spark, _cert_lines(t)).select("cert_id", "grade", "card_name")


@query("rejected_lines", sql="SELECT count(*) AS n FROM orders WHERE o_custkey % 10 = 3")
def rejected_lines(t: Tables) -> DataFrame:
    """Lines that did not decode, kept apart and counted."""
    return readers.read_json_lines(t.spark, _cert_lines(t), S.SCRAPED).rejected.agg(F.count("*").alias("n"))


@query("reference_lines", sql=f"""{WITH} SELECT manufacturer, variant_id, name, set_code, collector_number FROM refs
WHERE ingest_order % 9 <> 0""")
def reference_lines(t: Tables) -> DataFrame:
    """References from JSON Lines; a row without a manufacturer is dropped."""
    rows = V.references(t)
    fields = ["variant_id", "name", "set_code", "collector_number"]
    maker = F.when(F.col("ingest_order") % 9 != 0, F.col("manufacturer")).alias("manufacturer")
    lines = rows.select("ingest_order", F.to_json(F.struct(*fields, maker)).alias("line"))
    path = _lines(t, lines, F.col("ingest_order") % 10 == 3, "references")
    return readers.read_references(t.spark, path).select("manufacturer", *fields)


def _dumps(t: Tables) -> str:
    """Bulk dumps of up to 500 objects each, one element per line, with entries that are no objects among them."""
    row = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
                             F.struct(F.col("p_brand").alias("large")).alias("image_uris")))
    parts = t.part.select(F.floor(F.col("p_partkey") / 500).cast("int").alias("dump"), row.alias("entry"))
    noise = F.array(F.lit('"{\\"id\\": \\"0\\"}"'), F.lit("7"), F.lit("null"))
    whole = parts.groupBy("dump").agg(F.concat(noise, F.collect_list("entry")).alias("e"))
    path = _folder(t, "dumps")
    whole.select("dump", F.concat(F.lit("[\n"), F.array_join("e", ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("dump").text(path)
    return path


DUMP_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS large FROM part"


@query("array_dump", sql=DUMP_SQL)
def array_dump(t: Tables) -> DataFrame:
    """Objects of JSON array files, a whole file at a time; other entries are skipped."""
    return readers.read_json_array(t.spark, _dumps(t), S.MTG_PAYLOAD).select("id", "name", "image_uris.large")


@query("array_dump_by_line", sql=DUMP_SQL)
def array_dump_by_line(t: Tables) -> DataFrame:
    """The same files read line by line, so that one large dump is split."""
    rows = readers.read_json_array(t.spark, _dumps(t), S.MTG_PAYLOAD, element_per_line=True)
    return rows.select("id", "name", "image_uris.large")


def _exemplar_files(t: Tables) -> str:
    rows = t.embeddings.select(
        F.when(F.col("vec_id") % 7 != 0, F.lit("vec")).otherwise(F.lit("")).alias("manufacturer"), F.col("label").cast("string").alias("variant_id"),
        F.col("vec_id").cast("int").alias("exemplar_ix"), F.col("embedding").cast("array<float>").alias("embedding"))
    path = _folder(t, "exemplars")
    rows.write.parquet(path)
    return path


@query("exemplar_scan", sql="""SELECT CAST(label AS VARCHAR) AS variant_id, vec_id AS exemplar_ix, len(embedding) AS dim
FROM embeddings WHERE vec_id % 7 <> 0""")
def exemplar_scan(t: Tables) -> DataFrame:
    """All stored exemplars; rows with a blank key part are dropped."""
    return readers.read_exemplars(t.spark, _exemplar_files(t)).select("variant_id", "exemplar_ix", F.size("embedding").alias("dim"))


@query("reference_lookup", sql="""SELECT vec_id AS exemplar_ix, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings
WHERE vec_id % 7 <> 0 AND label = 3""")
def reference_lookup(t: Tables) -> DataFrame:
    """The exemplars of one variant; the key filters reach the scan."""
    found = readers.lookup_references(readers.read_exemplars(t.spark, _exemplar_files(t)), "vec", "3")
    return found.select("exemplar_ix", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("seed_manifest", sql="""SELECT '/seed/psa' || p_size % 12 || '/psa' || p_size % 11 || '_' || p_partkey || '.jpg' AS image_path,
  p_size % 12 AS grade, 'github_seed' AS source FROM part WHERE p_size % 12 BETWEEN 1 AND 10""")
def seed_manifest(t: Tables) -> DataFrame:
    """Seed manifest written and read back."""
    size = F.col("p_size")
    path = F.concat(F.lit("/seed/psa"), (size % 12).cast("string"), F.lit("/psa"), (size % 11).cast("string"), F.lit("_"),
                    F.col("p_partkey").cast("string"), F.lit(".jpg"))
    target = _folder(t, "manifest")
    store.write_seed_manifest(readers.seed_records(t.part.select(path.alias("path"))), target)
    return t.spark.read.schema("image_path string, grade int, source string").json(target)


@query("run_log", sql="""SELECT o_orderpriority AS timestamp, min(o_orderkey) AS starting_cert_id, max(o_orderkey) AS ending_cert_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'ingest_aborted' ELSE 'range_exhausted' END AS stop_reason, count(*) AS n
FROM orders GROUP BY 1""")
def run_log(t: Tables) -> DataFrame:
    """One entry per run appended to the log, and the log read back."""
    path = _folder(t, "runs")
    runs = t.orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count("*").alias("n"))
    why = F.when(F.col("o_orderpriority") == "5-LOW", "ingest_aborted").otherwise("range_exhausted")
    stats = F.create_map(F.lit("n"), F.col("n"))
    own = {"timestamp": F.col("o_orderpriority"), "starting_cert_id": F.col("a"), "ending_cert_id": F.col("b"), "stop_reason": why, "error": F.lit(None), "stats": stats}
    store.append_json(runs.select(*[own[f.name].cast(f.dataType).alias(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in S.RUN_LOG.fields]), path)
    log = store.read_run_log(t.spark, path, S.RUN_LOG)
    return log.select("timestamp", "starting_cert_id", "ending_cert_id", "stop_reason", F.col("stats")["n"].alias("n"))


@query("embed_store", sql=f"""{WITH}, {V.EXEMPLARS_SQL}
SELECT manufacturer, variant_id, len(embedding) AS dim FROM exemplars UNION ALL
SELECT manufacturer, variant_id, 64 AS dim FROM refs WHERE ingest_order % 7 <> 0
  AND (manufacturer, variant_id) NOT IN (SELECT (manufacturer, variant_id) FROM exemplars)""")
def embed_store(t: Tables) -> DataFrame:
    """The embedding job run twice over one store: nothing is embedded again, failures are left out."""
    lake = store.TableStore(t.spark, _folder(t, "embed"))
    lake.append("exemplars", V.exemplars(t).withColumn("cert_id", F.lit(None).cast("bigint")), partition_by=["manufacturer"])

    def encode(rows: DataFrame) -> DataFrame:  # some vectors have a wrong length
        size = F.when(F.col("ingest_order") % 7 == 0, F.lit(3)).otherwise(F.lit(64))
        return rows.withColumn("embedding", F.array_repeat(F.col("ingest_order").cast("float"), size))

    for _ in range(2):
        jobs.embed_new_references(lake, V.references(t), encode, 64)
    return lake.read("exemplars", jobs.STORED_EXEMPLARS).select("manufacturer", "variant_id", F.size("embedding").alias("dim"))


# ----------------------------------------------------------------- grading

CENTERED_SQL = f"""cfaces AS (
  SELECT l_orderkey, l_linenumber, greatest(abs(l_quantity * 2 - 50), abs(l_discount * 500 - 50)) AS off,
    l_quantity / 50 AS confidence FROM lineitem WHERE l_linenumber <= 2),
cworst AS (SELECT l_orderkey, max(off) FILTER (l_linenumber = 1) AS f, max(off) FILTER (l_linenumber = 2) AS b,
  avg(confidence) AS confidence FROM cfaces GROUP BY 1),
centered AS (SELECT l_orderkey, confidence, least((SELECT CASE {FRONT} ELSE 1.0 END FROM (SELECT f AS off)),
  coalesce((SELECT CASE {BACK} ELSE 1.0 END FROM (SELECT b AS off) WHERE b IS NOT NULL), 10.0)) AS centering
  FROM cworst WHERE f IS NOT NULL)"""


def _centering(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber <= 2").select(
        F.col("l_orderkey").cast("string").alias("submission_id"),
        F.when(F.col("l_linenumber") == 1, F.lit("front")).otherwise(F.lit("back")).alias("face"),
        (F.col("l_quantity") * 2).alias("left"), (F.col("l_discount") * 500).alias("top"), (F.col("l_quantity") / 50).alias("confidence"))


@query("centering_upsert", sql=f"""WITH {V.GRADES_SQL}, {CENTERED_SQL},
target AS (SELECT * FROM grades WHERE scheme <> 'trugrade'),
measured AS (SELECT CAST(l_orderkey AS VARCHAR) AS submission_id, centering AS c, confidence AS q FROM centered)
SELECT submission_id, scheme, round(g.centering, 6) AS centering, round(g.confidence, 6) AS confidence, final, round(g.edges, 6) AS edges
FROM target g WHERE scheme <> 'psa' OR submission_id NOT IN (SELECT submission_id FROM measured)
UNION ALL SELECT m.submission_id, 'psa', m.c, round(m.q, 6), CASE WHEN corners IS NOT NULL AND surface IS NOT NULL
  THEN round_even(least(m.c, corners, edges, surface) * 2, 0) / 2 END, round(edges, 6)
FROM measured m LEFT JOIN (SELECT * FROM target WHERE scheme = 'psa') g USING (submission_id)""")
def centering_upsert(t: Tables) -> DataFrame:
    """Centering part inserted or merged into existing grades; the other parts stay, final is recomputed."""
    nothing = {c: F.lit(None).cast("double") for c in ("front_centering_lr", "front_centering_tb", "back_centering_lr", "back_centering_tb")}
    target = V.grades(t).where("scheme <> 'trugrade'").withColumns({**nothing, "model_versions": F.lit(None).cast("map<string,string>")})
    merged = G.upsert_centering(target.select(*S.GRADES.fieldNames()), G.centering_from_ratios(_centering(t)))
    return merged.select("submission_id", "scheme", F.round("centering", 6).alias("centering"), F.round("confidence", 6).alias("confidence"),
                         "final", F.round("edges", 6).alias("edges"))


@query("grade_job", sql=f"""{EDGES_SQL}, {CENTERED_SQL},
edged AS (SELECT l_orderkey, min(subgrade) AS edges FROM faces GROUP BY 1)
SELECT CAST(c.l_orderkey AS VARCHAR) AS submission_id, 'centering' AS kind, 1 AS n, round(c.centering / 10, 6) AS score FROM centered c
UNION ALL SELECT CAST(c.l_orderkey AS VARCHAR), 'edge', 4, round(e.edges / 10, 6) FROM centered c LEFT JOIN edged e USING (l_orderkey)
UNION ALL SELECT CAST(c.l_orderkey AS VARCHAR), 'corner', 4, NULL FROM centered c
UNION ALL SELECT CAST(c.l_orderkey AS VARCHAR), 'surface', 1, NULL FROM centered c""")
def grade_job(t: Tables) -> DataFrame:
    """Both measured parts graded into an empty store: regions of every graded submission, by kind."""
    lake = store.TableStore(t.spark, _folder(t, "grades"))
    sides = _sides(t).withColumn("submission_id", F.col("l_orderkey").cast("string"))
    regions, _ = jobs.grade(lake, _centering(t), sides)
    return regions.groupBy("submission_id", "kind").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"))


@query("stored_report", sql="SELECT l_returnflag AS detector, count(*) AS n, sum(l_linenumber) AS total FROM lineitem GROUP BY 1")
def stored_report(t: Tables) -> DataFrame:
    """A report written as one JSON document per row and read back."""
    path = _folder(t, "report")
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("detector")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
    store.write_report(rows, path)
    kinds = T.StructType([T.StructField("detector", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
    return t.spark.read.schema(kinds).json(path)
