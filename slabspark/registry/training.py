"""Training manifests over documents and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.operators import sampling as S
from slabspark.plans import jobs
from slabspark.registry.core import Tables, query

CERTS_SQL = """certs AS (
  SELECT doc_id AS cert_id, doc_id % 11 + 0.0 AS grade, source AS card_name, upper(lang) || '  x' AS set_name,
    CASE WHEN lang <> 'fr' THEN source || '.png' END AS front_image_path FROM documents),
usable AS (SELECT *, lower(card_name) || chr(31) || replace(lower(set_name), '  ', ' ') AS key FROM certs
  WHERE front_image_path IS NOT NULL AND grade BETWEEN 1 AND 10),
multi AS (SELECT * FROM usable WHERE key IN (SELECT key FROM usable GROUP BY 1 HAVING count(DISTINCT cert_id) > 1))"""
ROW_SQL = f"""WITH {CERTS_SQL}"""


def _certs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("cert_id"), (F.col("doc_id") % 11 + 0.0).alias("grade"), F.col("source").alias("card_name"),
        F.concat(F.upper("lang"), F.lit("  x")).alias("set_name"),
        F.when(F.col("lang") != "fr", F.concat(F.col("source"), F.lit(".png"))).alias("front_image_path"))


def _multi(t: Tables) -> DataFrame:
    return S.drop_singletons(S.keyed(S.trainable(_certs(t))))


@query("trainable_certs", sql=f"{ROW_SQL} SELECT cert_id, grade, key FROM usable")
def trainable_certs(t: Tables) -> DataFrame:
    """Certs with a front image and a grade in range, keyed by printing."""
    return S.keyed(S.trainable(_certs(t))).select("cert_id", "grade", "key")


@query("existing_files", sql=f"""{ROW_SQL} SELECT cert_id FROM usable WHERE front_image_path IN
  (SELECT source || '.png' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def existing_files(t: Tables) -> DataFrame:
    """Certs whose image is in the file listing (semi join)."""
    files = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select(F.concat("source", F.lit(".png")).alias("path"))
    return S.trainable(_certs(t), files=files).select("cert_id")


@query("singleton_keys", sql=f"""{ROW_SQL},
s AS (SELECT key, count(*) AS n, count(DISTINCT cert_id) AS c FROM usable GROUP BY 1)
SELECT CAST(coalesce(sum(n) FILTER (c > 1), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (c = 1), 0) AS BIGINT) AS dropped FROM s""")
def singleton_keys(t: Tables) -> DataFrame:
    """Rows kept and dropped by the two-certs-per-key rule."""
    return S.singleton_counts(S.keyed(S.trainable(_certs(t))))


@query("kept_samples", sql=f"{ROW_SQL} SELECT cert_id, key FROM multi")
def kept_samples(t: Tables) -> DataFrame:
    """Samples whose key has at least two certs."""
    return _multi(t).select("cert_id", "key")


@query("partner_counts", sql=f"""{ROW_SQL}
SELECT key, cert_id, count(*) AS n_own, (SELECT count(*) FROM multi m WHERE m.key = o.key) - count(*) AS n_partners
FROM multi o GROUP BY 1, 2""")
def partner_counts(t: Tables) -> DataFrame:
    """Possible positive partners per cert, without listing pairs."""
    return S.partner_counts(_multi(t))


SPLIT_SQL = """ids AS (SELECT DISTINCT {1} AS id FROM {0}),
placed AS (SELECT id, row_number() OVER (ORDER BY md5('{2}|' || id), id) - 1 AS pos, count(*) OVER () AS n FROM ids)"""


@query("split_by_cert", sql=f"""WITH {SPLIT_SQL.format('lineitem', 'l_orderkey', '49374')}
SELECT l_orderkey, split, count(*) AS n FROM (SELECT l.l_orderkey, CASE WHEN pos < greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split
  FROM lineitem l JOIN placed ON id = l_orderkey) GROUP BY 1, 2""")
def split_by_cert(t: Tables) -> DataFrame:
    """Group-safe split: all rows of an id on one side."""
    return S.split_by_id(t.lineitem.select("l_orderkey"), "l_orderkey").groupBy("l_orderkey", "split").agg(
        F.count(F.lit(1)).alias("n"))


@query("corner_samples", sql=f"""{ROW_SQL},
o AS (SELECT doc_id AS cert_id, [quality + 1.0, toxic + 2.0, 3.0, 4.0] AS g FROM labels)
SELECT cert_id, i - 1 AS corner_index, coalesce(o.g[i], grade) AS grade FROM usable LEFT JOIN o USING (cert_id), range(1, 5) r(i)""")
def corner_samples(t: Tables) -> DataFrame:
    """Four corner rows per cert with per-corner overrides."""
    over = t.labels.select(F.col("doc_id").alias("cert_id"), F.array(
        F.col("quality") + 1.0, F.col("toxic") + 2.0, F.lit(3.0), F.lit(4.0)).alias("corner_grades"))
    return S.corner_fan_out(S.trainable(_certs(t)), over).select("cert_id", "corner_index", "grade")


@query("triplets", sql=f"""{ROW_SQL}, {SPLIT_SQL.format('multi', 'cert_id', '7')},
pos AS (SELECT cert_id, key, row_number() OVER (PARTITION BY key ORDER BY cert_id) - 1 AS p, count(*) OVER (PARTITION BY key) AS n FROM multi),
h AS (SELECT x.cert_id, x.key, x.p, x.n, y.pos, y.n AS total,
    CAST('0x' || substr(md5('7+|' || x.cert_id), 1, 15) AS BIGINT) AS hp, CAST('0x' || substr(md5('7-|' || x.cert_id), 1, 15) AS BIGINT) AS hn
  FROM pos x JOIN placed y ON y.id = x.cert_id)
SELECT h.cert_id AS anchor, q.cert_id AS positive, z.id AS negative FROM h
JOIN pos q ON q.key = h.key AND q.p = (h.p + 1 + h.hp % (h.n - 1)) % h.n
JOIN placed z ON z.pos = (h.pos + 1 + h.hn % (h.total - 1)) % h.total""")
def triplets(t: Tables) -> DataFrame:
    """One positive and one negative per anchor, chosen by seeded hash."""
    return S.triplets(_multi(t), "cert_id")


@query("training_manifests", sql=f"""{ROW_SQL},
m AS (SELECT 'identification' AS manifest, cert_id, count(*) AS n FROM multi GROUP BY ALL
  UNION ALL SELECT 'corners', cert_id, 4 * count(*) FROM usable GROUP BY ALL UNION ALL SELECT 'surface', cert_id, count(*) FROM usable GROUP BY ALL),
placed AS (SELECT manifest, cert_id, n, row_number() OVER (PARTITION BY manifest ORDER BY md5('49374|' || cert_id), cert_id) - 1 AS pos,
  count(*) OVER (PARTITION BY manifest) AS total FROM m)
SELECT manifest, CASE WHEN pos < greatest(1, floor(total * 0.2)) THEN 'val' ELSE 'train' END AS split,
  CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_certs FROM placed GROUP BY 1, 2""")
def training_manifests(t: Tables) -> DataFrame:
    """The three manifests with their splits, counted."""
    out = None
    for name, rows in jobs.training_manifests(_certs(t)).items():
        part = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cert_id").alias("n_certs")).select(
            F.lit(name).alias("manifest"), "split", "n_rows", "n_certs")
        out = part if out is None else out.unionByName(part)
    return out
