"""Normalization of raw payloads, pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.functions import text as X
from slabspark.functions.scalars import as_double
from slabspark.operators import authenticity
from slabspark.operators import normalize as N
from slabspark.operators.funnel import outcome_counts
from slabspark.plans import jobs
from slabspark.registry.core import Tables, query
from slabspark.sources.readers import authentic_labels, check_labels, seed_records

SPACE = r"[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z}]+"


@query("group_key", sql=rf"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))) AS key_hash,
  length(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))) AS key_length FROM documents""")
def group_key(t: Tables) -> DataFrame:
    """Grouping key of whole texts: lower case, collapsed whitespace."""
    key = X.group_key(F.col("text"))
    return t.documents.select("doc_id", F.md5(key).alias("key_hash"), F.length(key).alias("key_length"))


@query("comparison_text", sql=rf"""SELECT doc_id, md5(c) AS text_hash, length(c) AS text_length FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s\x0B\x{{85}}\x{{1C}}-\x{{1F}}\p{{Z}}]', '', 'g'),
    '{SPACE}', ' ', 'g')) AS c FROM documents)""")
def comparison_text(t: Tables) -> DataFrame:
    """Comparison form of whole texts: letters, digits and single blanks."""
    c = X.comparison_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(c).alias("text_hash"), F.length(c).alias("text_length"))


TEXT_SQL = r"""named AS (
  SELECT p_partkey, CASE WHEN p_size > 1 THEN p_name END AS expected,
    CASE p_type WHEN 'PROMO' THEN '  ' WHEN 'LARGE' THEN NULL WHEN 'ECONOMY' THEN upper(p_name)
      WHEN 'STANDARD' THEN replace(p_name, 'e', '3') WHEN 'MEDIUM' THEN p_name || ', the ' || p_brand ELSE p_brand END AS read
  FROM part),
prep AS (SELECT *, trim(regexp_replace(regexp_replace(lower(expected), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS a,
    trim(regexp_replace(regexp_replace(lower(trim(read)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS b FROM named),
typed AS (SELECT *, CASE WHEN expected IS NULL THEN 'no_expected_text' WHEN read IS NULL THEN 'ocr_unavailable' END AS abstain_reason,
    CASE WHEN expected IS NOT NULL AND read IS NOT NULL AND trim(read) <> '' THEN levenshtein(b, a) END AS lev FROM prep),
scored AS (SELECT *, CASE WHEN lev IS NOT NULL THEN lev / greatest(length(a), length(b), 1)
    WHEN abstain_reason IS NULL THEN 1.0 END AS dist,
    CASE WHEN lev IS NOT NULL THEN 0.85 WHEN abstain_reason IS NULL THEN 0.45 ELSE 0.0 END AS confidence FROM typed),
judged AS (SELECT *, CASE WHEN dist IS NULL THEN 0.5 ELSE 1 / (1 + exp(12.0 * (dist - 0.35))) END AS score FROM scored)"""


def _texts(t: Tables) -> DataFrame:
    kind, name = F.col("p_type"), F.col("p_name")
    read = (F.when(kind == "PROMO", F.lit("  ")).when(kind == "LARGE", F.lit(None).cast("string"))
            .when(kind == "ECONOMY", F.upper(name)).when(kind == "STANDARD", F.replace(name, F.lit("e"), F.lit("3")))
            .when(kind == "MEDIUM", F.concat(name, F.lit(", the "), F.col("p_brand"))).otherwise(F.col("p_brand")))
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 1, name).alias("expected"), read.alias("extracted_text"))
    return authenticity.text_match(rows, "expected", "extracted_text")


@query("text_detector", sql=f"""WITH {TEXT_SQL}
SELECT p_partkey, lev AS levenshtein, round(dist, 6) AS normalized_distance, round(score, 6) AS score, confidence,
  abstain_reason, CASE WHEN confidence < 0.4 THEN 'unverified' WHEN score >= 0.65 THEN 'authentic'
    WHEN score < 0.35 THEN 'likely_counterfeit' ELSE 'suspicious' END AS verdict FROM judged""")
def text_detector(t: Tables) -> DataFrame:
    """Recognized text against the expected name, all abstain paths."""
    from slabspark.functions.scalars import verdict_by_detector

    return _texts(t).select(
        "p_partkey", "levenshtein", F.round("normalized_distance", 6).alias("normalized_distance"),
        F.round("score", 6).alias("score"), "confidence", "abstain_reason",
        verdict_by_detector(F.lit("typography"), F.col("score"), F.col("confidence")).alias("verdict"))


@query("text_reasons", sql=f"""WITH {TEXT_SQL}
SELECT p_partkey, CASE
  WHEN abstain_reason = 'no_expected_text' THEN 'card not identified — no expected card name to OCR-compare'
  WHEN abstain_reason = 'ocr_unavailable' THEN 'OCR engine unavailable — typography signal not collected'
  WHEN score >= 0.65 THEN printf('OCR''d title matches identified card name (typography_score=%.2f, levenshtein=%s)',
    score, coalesce(CAST(lev AS VARCHAR), 'None'))
  WHEN score < 0.35 THEN printf('OCR''d title diverges from identified card name (typography_score=%.2f, levenshtein=%s, extracted=%s)',
    score, coalesce(CAST(lev AS VARCHAR), 'None'), '''' || trim(read) || '''')
  ELSE printf('OCR''d title partially matches identified card name (typography_score=%.2f, levenshtein=%s)',
    score, coalesce(CAST(lev AS VARCHAR), 'None')) END AS reason FROM judged""")
def text_reasons(t: Tables) -> DataFrame:
    """Explanation of every text measurement."""
    rows = _texts(t).select(
        "p_partkey", F.lit("typography").alias("detector"), "score", "confidence", "abstain_reason",
        F.when(F.col("levenshtein").isNotNull(), F.create_map(F.lit("levenshtein"), F.col("levenshtein").cast("double")))
        .otherwise(F.create_map().cast("map<string,double>")).alias("metrics"),
        F.trim("extracted_text").alias("extracted_text"))
    return authenticity.with_verdict(rows).select("p_partkey", authenticity.reason_text().alias("reason"))


# ------------------------------------------------------------------ pages

_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(@expr, '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '""" + SPACE + r"""', ' ', 'g'))"""


def _strip(expr: str) -> str:
    return _STRIP.replace("@expr", expr)


H1 = _strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")


@query("cert_pages", sql=f"""SELECT page_id AS cert_id, nullif({H1}, '') AS card_name, '' AS set_name, url AS source_url,
  'parse_errors' AS outcome FROM pages""")
def cert_pages(t: Tables) -> DataFrame:
    """Certificate page parser over raw pages (none of them holds a grade)."""
    return N.cert_pages(t.pages).select("cert_id", "card_name", "set_name", "source_url", "outcome")


@query("page_titles", sql=f"""SELECT page_id, {_strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  TRY_CAST(nullif(regexp_extract(url, '\\b(1[89][0-9][0-9]|20[0-9][0-9]|21[0-9][0-9])\\b', 1), '') AS INT) AS year
FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    """Ordered regex alternatives, tag strip, entity decode and year token."""
    h = F.col("html")
    return t.pages.select(
        "page_id", X.strip_tags(X.first_group(h, [r"(?is)<title>(.*?)</title>"])).alias("title"),
        X.first_group(h, [r'<html lang="([a-z]+)"']).alias("lang"), X.parse_year(F.col("url")).alias("year"))


@query("page_pairs", sql=f"""WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 1) AS l,
    regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 2) AS v FROM pages),
flat AS (SELECT page_id, i, lower(regexp_replace({_strip('l[i]')}, ':+$', '')) AS label, {_strip('v[i]')} AS value
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM found))
SELECT page_id, label, arg_min(value, i) AS value FROM flat WHERE label <> '' AND value <> '' GROUP BY 1, 2""")
def page_pairs(t: Tables) -> DataFrame:
    """Label/value pairs of a page as a map, first label wins."""
    pairs = X.pair_map(F.col("html"), r'(?is)<a href="([^"]*)">(.*?)</a>')
    return t.pages.select("page_id", F.explode(pairs).alias("label", "value"))


@query("absolute_urls", sql="""WITH found AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS target FROM found WHERE href <> ''""")
def absolute_urls(t: Tables) -> DataFrame:
    """Links of a page resolved against its URL."""
    links = t.pages.select("page_id", "url", F.explode(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    target = X.absolute_url(F.col("href"), F.col("url"))
    return links.select("page_id", "href", target.alias("target")).where(F.col("target").isNotNull())


@query("url_checks", sql="""SELECT page_id, starts_with(url, 'https://') AS is_https,
  regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\.(jpg|jpeg|png|webp)$') AS is_image,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages""")
def url_checks(t: Tables) -> DataFrame:
    """Scheme, host and image-extension checks of every page URL."""
    u = F.col("url")
    return t.pages.select("page_id", X.is_https_url(u).alias("is_https"), X.is_image_url(u).alias("is_image"),
                          X.url_part(u, "NETLOC").alias("host"))


# --------------------------------------------------------------- payloads


@query("mtg_payloads", sql="""SELECT CAST(p_partkey AS VARCHAR) AS variant_id, p_name AS name,
  CASE WHEN p_size <> 1 THEN upper(p_brand) END AS set_code, CAST(p_size AS VARCHAR) AS collector_number,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'https://img/' || CASE WHEN p_size % 4 = 1 THEN 'l' WHEN p_size % 4 = 2 THEN 'n' ELSE 'face' END
    || '/' || p_partkey || '.jpg' END AS front_image_path,
  CASE WHEN p_type = 'PROMO' THEN 'https://api.scryfall.com/cards/' || p_partkey ELSE 'https://cards/' || p_partkey END AS source_url,
  CASE WHEN p_size % 4 = 0 THEN 'image_missing' ELSE 'successful' END AS outcome FROM part""")
def mtg_payloads(t: Tables) -> DataFrame:
    """Card payloads of the first manufacturer: image preference, URL fallback."""
    k = F.col("p_partkey").cast("string")
    case = F.col("p_size") % 4
    url = lambda part: F.concat(F.lit("https://img/" + part + "/"), k, F.lit(".jpg"))
    plain = F.concat(F.lit("http://img/x/"), k)
    card = F.to_json(F.struct(
        k.alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") != 1, F.lower("p_brand")).otherwise(F.lit("")).alias("set"),
        F.col("p_size").cast("string").alias("collector_number"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit("https://cards/"), k)).alias("scryfall_uri"),
        F.when(case < 3, F.struct(F.when(case == 1, url("l")).when(case == 2, plain).alias("large"),
                                  F.when(case == 2, url("n")).alias("normal"))).alias("image_uris"),
        F.when(case == 3, F.array(F.struct(F.struct(url("face").alias("png")).alias("image_uris")))).alias("card_faces")))
    return N.mtg_references(t.part.select(card.alias("payload"))).select(
        "variant_id", "name", "set_code", "collector_number", "front_image_path", "source_url", "outcome")


@query("pokemon_payloads", sql="""SELECT CASE WHEN p_size <> 2 THEN CAST(p_partkey AS VARCHAR) END AS variant_id, p_name AS name,
  upper(p_brand) AS set_code, CASE WHEN p_size <> 3 THEN CAST(p_size AS VARCHAR) END AS collector_number,
  'https://img/' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '/' || p_partkey AS front_image_path,
  CASE WHEN p_size <> 2 THEN 'successful' ELSE 'parse_errors' END AS outcome FROM part""")
def pokemon_payloads(t: Tables) -> DataFrame:
    """Card payloads of the second manufacturer: nested set, large over small."""
    k = F.col("p_partkey").cast("string")
    card = F.to_json(F.struct(
        F.when(F.col("p_size") != 2, k).otherwise(F.lit("")).alias("id"), F.col("p_name").alias("name"),
        F.struct(F.lower("p_brand").alias("id")).alias("set"),
        F.when(F.col("p_size") != 3, F.col("p_size").cast("string")).alias("number"),
        F.struct(F.when(F.col("p_size") > 25, F.concat(F.lit("https://img/large/"), k)).alias("large"),
                 F.concat(F.lit("https://img/small/"), k).alias("small")).alias("images")))
    return N.pokemon_references(t.part.select(card.alias("payload"))).select(
        "variant_id", "name", "set_code", "collector_number", "front_image_path", "outcome")


@query("reference_union", sql="""SELECT manufacturer, outcome, count(*) AS n FROM (
  SELECT 'mtg' AS manufacturer, CASE WHEN p_size <> 2 THEN 'image_missing' ELSE 'parse_errors' END AS outcome FROM part
  UNION ALL SELECT 'pokemon', 'image_missing' FROM part) GROUP BY 1, 2""")
def reference_union(t: Tables) -> DataFrame:
    """Both manufacturers in one schema, outcomes counted."""
    k, name = F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")
    mtg = t.part.select(F.to_json(F.struct(k, F.when(F.col("p_size") != 2, F.col("p_name")).alias("name"))).alias("payload"))
    pokemon = t.part.select(F.to_json(F.struct(k, name)).alias("payload"))
    rows = N.union_references(N.mtg_references(mtg), N.pokemon_references(pokemon))
    return rows.groupBy("manufacturer", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _cert_payloads(t: Tables) -> DataFrame:
    size = F.col("p_size")
    grade = F.when(size % 5 == 0, F.lit("N0: AUTHENTIC")).when(size % 5 == 1, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("GEM MT "), (size % 10 + 1).cast("string"), F.when(size % 3 == 0, F.lit(".5")).otherwise(F.lit(""))))
    described = F.when(size % 5 == 1, F.concat(F.lit("MINT "), (size % 9 + 1).cast("string")))
    cert = F.struct(
        grade.alias("CardGrade"), described.alias("GradeDescription"),
        F.concat(F.lit("issued "), (F.lit(1900) + size).cast("string")).alias("Year"),
        F.when(F.col("p_type") != "PROMO", F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).otherwise(F.lit("")).alias("Subject"),
        F.col("p_brand").alias("Brand"), F.when(size != 7, size.cast("string")).otherwise(F.lit("")).alias("CardNumber"),
        (F.col("p_type") == "LARGE").alias("IsDualCert"), F.lit(False).alias("IsPSADNA"))
    k = F.col("p_partkey").cast("string")
    url = lambda side: F.concat(F.lit("https://cdn/"), k, F.lit(f"/{side}.jpg"))
    entry = lambda flag, u: F.struct(F.lit(flag).alias("IsFrontImage"), u.alias("ImageURL"))
    usual = F.to_json(F.array(entry(False, url("b1")), entry(True, F.lit("ftp://x/y.jpg")), entry(True, url("f1")),
                              entry(True, url("f2"))))
    drifted = F.to_json(F.struct(F.struct(F.array(F.struct(url("z").alias("u"))).alias("Shots")).alias("BackSide"),
                                 F.struct(url("y").alias("link"), F.lit("none").alias("note")).alias("FRONT")))
    ordered = F.to_json(F.struct(F.array(url("one"), url("two"), url("three")).alias("pics")))
    images = F.when(size % 4 == 0, F.lit("[]")).when(size % 4 == 1, usual).when(size % 4 == 2, drifted).otherwise(ordered)
    return t.part.select(F.col("p_partkey").alias("cert_id"), F.to_json(F.struct(cert.alias("PSACert"))).alias("payload"),
                         images.alias("images"))


CERT_SQL = """c AS (SELECT p_partkey AS cert_id, p_size, p_name, p_brand, p_type,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN p_size % 9 + 1
      ELSE p_size % 10 + 1 + CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS grade FROM part)"""


@query("cert_payloads", sql=f"""WITH {CERT_SQL}
SELECT cert_id, grade, CASE WHEN p_type <> 'PROMO' THEN p_name ELSE p_brand END AS card_name, p_brand AS set_name,
  1900 + p_size AS year, CASE WHEN p_size <> 7 THEN CAST(p_size AS VARCHAR) END AS card_number,
  CASE WHEN grade IS NULL OR p_type = 'LARGE' THEN 'non_gradeable_skipped' ELSE 'successful' END AS outcome FROM c""")
def cert_payloads(t: Tables) -> DataFrame:
    """Graded-cert payloads: grade and year tokens, name fallback, skip rules."""
    return N.cert_rows(_cert_payloads(t)).select("cert_id", "grade", "card_name", "set_name", "year", "card_number", "outcome")


@query("cert_images", sql="""SELECT p_partkey AS cert_id,
  CASE p_size % 4 WHEN 1 THEN 'https://cdn/' || p_partkey || '/f1.jpg' WHEN 2 THEN 'https://cdn/' || p_partkey || '/y.jpg'
    WHEN 3 THEN 'https://cdn/' || p_partkey || '/one.jpg' END AS front_image_path,
  CASE p_size % 4 WHEN 1 THEN 'https://cdn/' || p_partkey || '/b1.jpg' WHEN 2 THEN 'https://cdn/' || p_partkey || '/z.jpg'
    WHEN 3 THEN 'https://cdn/' || p_partkey || '/two.jpg' END AS back_image_path FROM part""")
def cert_images(t: Tables) -> DataFrame:
    """Front and back image of every payload shape, drifted trees included."""
    return N.pick_images(_cert_payloads(t), "images").select("cert_id", "front_image_path", "back_image_path")


@query("cert_outcomes", sql=f"""WITH {CERT_SQL}
SELECT CASE WHEN grade IS NULL OR p_type = 'LARGE' THEN 'non_gradeable_skipped' ELSE 'successful' END AS outcome,
  count(*) AS n FROM c GROUP BY 1""")
def cert_outcomes(t: Tables) -> DataFrame:
    """Outcome funnel of a payload pass."""
    return outcome_counts(N.cert_rows(_cert_payloads(t)))


@query("normalize_job", sql=f"""WITH {CERT_SQL},
refs AS (SELECT CASE WHEN p_size <> 2 THEN 'image_missing' ELSE 'parse_errors' END AS outcome FROM part UNION ALL SELECT 'image_missing' FROM part),
certs AS (SELECT CASE WHEN grade IS NULL OR p_type = 'LARGE' THEN 'non_gradeable_skipped' ELSE 'successful' END AS outcome FROM c
  UNION ALL SELECT 'parse_errors' FROM pages)
SELECT 'reference' AS kind, outcome, count(*) AS n FROM refs GROUP BY 2 UNION ALL SELECT 'cert', outcome, count(*) FROM certs GROUP BY 2
UNION ALL SELECT 'references', 'kept', count(*) FROM refs WHERE outcome <> 'parse_errors'
UNION ALL SELECT 'scraped', 'kept', count(*) FROM certs WHERE outcome = 'successful'""")
def normalize_job(t: Tables) -> DataFrame:
    """Both card catalogs, graded-cert payloads and cert pages through one pass: outcomes, and the rows that stay."""
    k, name = F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")
    mtg = t.part.select(F.to_json(F.struct(k, F.when(F.col("p_size") != 2, F.col("p_name")).alias("name"))).alias("payload"))
    pokemon = t.part.select(F.to_json(F.struct(k, name)).alias("payload"))
    out = jobs.normalize_sources(mtg, pokemon, _cert_payloads(t), t.pages)
    counted = [out[f"{kind}_outcomes"].select(F.lit(kind).alias("kind"), "outcome", "n") for kind in ("reference", "cert")]
    kept = [out[kind].agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("kept").alias("outcome"), "n") for kind in ("references", "scraped")]
    return counted[0].unionByName(counted[1]).unionByName(kept[0]).unionByName(kept[1])


@query("detector_blob", sql="""SELECT CAST(event_id AS VARCHAR) AS submission_id, 'color' AS detector,
    round(value / 1000, 6) AS score, CASE WHEN value > 20 THEN 'authentic' ELSE 'unverified' END AS verdict,
    0.0 AS confidence, CAST(regexp_extract(props, '[0-9]+') AS VARCHAR) AS k FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 'rosette', 0.0, 'unverified', 0.5, NULL FROM events WHERE event_type = 'view'""")
def detector_blob(t: Tables) -> DataFrame:
    """Detector payload blob to rows; flat legacy values are skipped."""
    k = F.from_json("props", "k INT")["k"]
    color = F.struct((F.col("value") / 1000).alias("score"), F.when(F.col("value") > 20, F.lit("authentic")).alias("verdict"),
                     k.alias("k"))
    blob = F.struct(color.alias("color"), F.col("value").alias("legacy"),
                    F.when(F.col("event_type") == "view", F.struct(F.lit(0.5).alias("confidence"))).alias("rosette"))
    rows = t.events.select(F.col("event_id").cast("string").alias("submission_id"), F.to_json(blob).alias("detector_scores"))
    return authenticity.unpack_detectors(rows).select(
        "submission_id", "detector", F.round("score", 6).alias("score"), "verdict", "confidence",
        F.try_element_at("metadata", F.lit("k")).alias("k"))


@query("price_tiers", sql="""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS market_price,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS low_price,
  'https://www.tcgplayer.com/product/' || p_partkey AS product_url FROM part""")
def price_tiers(t: Tables) -> DataFrame:
    """"Normal" tier first, numbers that do not parse become null."""
    foil = F.struct(F.lit("Foil").alias("subTypeName"), F.col("p_retailprice").cast("string").alias("marketPrice"),
                    F.col("p_size").cast("string").alias("lowPrice"))
    normal = F.struct(F.lit("Normal").alias("subTypeName"), (F.col("p_retailprice") + 1).cast("string").alias("marketPrice"),
                      F.lit("n/a").alias("lowPrice"))
    rows = t.part.select("p_partkey", F.to_json(F.when(F.col("p_size") % 3 == 0, F.array(foil, normal)).otherwise(
        F.array(foil))).alias("tiers"), F.concat(F.lit("/product/"), F.col("p_partkey").cast("string")).alias("u"))
    return N.pick_price(rows, "tiers", "u").select("p_partkey", "market_price", "low_price", "product_url")


@query("numeric_coercion", sql="""SELECT p_partkey, TRY_CAST(CASE WHEN p_type = 'PROMO' THEN p_name WHEN p_type = 'LARGE' THEN ''
  ELSE CAST(p_size AS VARCHAR) || '.25' END AS DOUBLE) AS number FROM part""")
def numeric_coercion(t: Tables) -> DataFrame:
    """Text to number, null on failure."""
    raw = F.when(F.col("p_type") == "PROMO", F.col("p_name")).when(F.col("p_type") == "LARGE", F.lit("")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(".25")))
    return t.part.select("p_partkey", as_double(raw).alias("number"))


KEY_SQL = """SELECT p_partkey, 'images/' || p_partkey || '/front.' || ext AS cert_key,
  'images/mtg/' || p_name || '/back.' || ext AS reference_key FROM (
  SELECT *, CASE p_type WHEN 'PROMO' THEN 'jpg' WHEN 'LARGE' THEN 'png' WHEN 'ECONOMY' THEN 'webp' WHEN 'STANDARD' THEN 'jpg'
    ELSE 'bin' END AS ext FROM part)"""


@query("storage_keys", sql=KEY_SQL)
def storage_keys(t: Tables) -> DataFrame:
    """Content type to extension and the two key layouts."""
    kind = F.create_map(*[F.lit(v) for v in ("PROMO", "image/jpeg; q=1", "LARGE", " IMAGE/PNG ", "ECONOMY", "image/webp",
                                             "STANDARD", "image/jpg", "MEDIUM", "text/html")])
    ctype = F.try_element_at(kind, F.col("p_type"))
    return t.part.select(
        "p_partkey", X.cert_image_key(F.col("p_partkey"), F.lit("front"), ctype).alias("cert_key"),
        X.reference_image_key(F.lit("mtg"), F.col("p_name"), F.lit("back"), ctype).alias("reference_key"))


@query("shot_key_checks", sql="""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'bad_layout' WHEN '2-HIGH' THEN 'id_mismatch'
  WHEN '3-MEDIUM' THEN 'kind_mismatch' END AS key_problem FROM orders""")
def shot_key_checks(t: Tables) -> DataFrame:
    """Object keys checked against submission, shot and kind."""
    hex_ = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(hex_, 1, 8), F.substring(hex_, 9, 4), F.substring(hex_, 13, 4),
                       F.substring(hex_, 17, 4), F.substring(hex_, 21, 12))
    shot = F.concat(F.lit("shot"), F.col("o_custkey").cast("string"))
    p = F.col("o_orderpriority")
    key = F.concat(F.when(p == "1-URGENT", F.lit("uploads/")).otherwise(F.lit("submissions/")), uuid, F.lit("/shots/"),
                   F.when(p == "2-HIGH", F.lit("other")).otherwise(shot), F.lit("/"),
                   F.when(p == "3-MEDIUM", F.lit("tilt_30")).otherwise(F.lit("front_full")), F.lit(".jpg"))
    rows = t.orders.select("o_orderkey", uuid.alias("submission_id"), shot.alias("id"), F.lit("front_full").alias("kind"),
                           key.alias("s3_key"))
    return N.check_shot_keys(rows).select("o_orderkey", "key_problem")


@query("label_contract", sql="""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'authentic' WHEN o_orderstatus = 'O'
  THEN 'counterfeit' ELSE 'unknown' END AS ground_truth, CASE WHEN o_orderpriority = '5-LOW' THEN 'given' || o_orderkey
  ELSE 'card.' || o_orderkey END AS sample_id,
  CASE WHEN o_orderstatus = 'P' THEN 'ground_truth=unknown' END AS problem FROM orders""")
def label_contract(t: Tables) -> DataFrame:
    """Label rows normalized and checked, sample id from the file stem."""
    label = F.when(F.col("o_orderstatus") == "F", F.lit(" Authentic ")).when(
        F.col("o_orderstatus") == "O", F.lit("COUNTERFEIT")).otherwise(F.lit("unknown"))
    k = F.col("o_orderkey").cast("string")
    rows = t.orders.select(
        "o_orderkey", F.concat(F.lit("data/x/card."), k, F.lit(".png ")).alias("image_path"), label.alias("ground_truth"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("given"), k)).otherwise(F.lit(" ")).alias("sample_id"))
    return check_labels(rows).select("o_orderkey", "ground_truth", "sample_id", "problem")


@query("label_union", sql="""SELECT ground_truth, count(*) AS n, min(sample_id) AS first_id FROM (
  SELECT CASE WHEN quality = 1 THEN 'authentic' ELSE 'counterfeit' END AS ground_truth, 'doc-' || doc_id AS sample_id FROM labels
  UNION ALL SELECT 'authentic', 'psa-' || doc_id FROM documents WHERE lang = 'en') GROUP BY 1""")
def label_union(t: Tables) -> DataFrame:
    """File labels united with labels derived from graded certs."""
    given = t.labels.select(F.when(F.col("quality") == 1, F.lit("authentic")).otherwise(F.lit("counterfeit"))
                            .alias("ground_truth"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"))
    certs = t.documents.select(F.col("doc_id").alias("cert_id"), F.when(F.col("lang") == "en", F.col("source"))
                               .alias("front_image_path"))
    rows = given.unionByName(authentic_labels(certs).select("ground_truth", "sample_id"))
    return rows.groupBy("ground_truth").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))


@query("seed_paths", sql="""SELECT p_size % 12 AS grade, count(*) AS n, count(*) FILTER (p_size % 12 <> p_size % 11) AS mismatches
FROM part WHERE p_size % 12 BETWEEN 1 AND 10 AND p_type <> 'PROMO' GROUP BY 1""")
def seed_paths(t: Tables) -> DataFrame:
    """Seed images labelled by folder, mismatching file grades counted."""
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("file:/seed/psa"), (F.col("p_size") % 12).cast("string"), F.lit("/"),
                    F.when(F.col("p_type") == "PROMO", F.lit("readme")).otherwise(F.lit("PSA")),
                    (F.col("p_size") % 11).cast("string"), F.lit("_"), k, F.lit(".JPEG"))
    return seed_records(t.part.select(path.alias("path"))).groupBy("grade").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("mismatch").alias("mismatches"))


