"""Raw payload tables -> reference and cert rows.

Every function adds or returns plain columns; a row that lacks a required
field gets an outcome instead of an exception.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from slabspark import params as P
from slabspark import schemas as S
from slabspark.functions import text as X
from slabspark.functions.scalars import as_double

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def best_url(candidates: list[Column]) -> Column:
    """First https URL in preference order."""
    return F.coalesce(*[F.when(X.is_https_url(c), c) for c in candidates])


def mtg_image_url(card: Column) -> Column:
    face = F.try_element_at(card["card_faces"], F.lit(1))["image_uris"]
    return best_url([u[size] for u in (card["image_uris"], face) for size in P.MTG_IMAGE_SIZES])


def pokemon_image_url(card: Column) -> Column:
    return best_url([card["images"][size] for size in P.POKEMON_IMAGE_SIZES])


def _reference(rows: DataFrame, manufacturer: str, set_code: Column, number: Column, image: Column, url: Column,
               fetched_at: Column) -> DataFrame:
    card = F.col("card")
    vid, name = X.blank_to_null(card["id"]), X.blank_to_null(card["name"])
    return rows.select(
        vid.alias("variant_id"), F.lit(manufacturer).alias("manufacturer"), name.alias("name"),
        X.blank_to_null(F.upper(set_code)).alias("set_code"), X.blank_to_null(number).alias("collector_number"),
        X.blank_to_null(card["rarity"]).alias("rarity"), image.alias("front_image_path"), url.alias("source_url"),
        fetched_at.alias("fetched_at"),
        F.when(vid.isNull() | name.isNull(), F.lit("parse_errors"))
        .when(image.isNull(), F.lit("image_missing")).otherwise(F.lit("successful")).alias("outcome"),
    )


def mtg_references(payloads: DataFrame, column: str = "payload", fetched_at: Column | None = None) -> DataFrame:
    rows = payloads.withColumn("card", F.from_json(column, S.MTG_PAYLOAD))
    card = F.col("card")
    url = F.coalesce(X.blank_to_null(card["scryfall_uri"]), F.concat(F.lit(P.MTG_CARD_URL), card["id"]))
    return _reference(rows, "mtg", card["set"], card["collector_number"], mtg_image_url(card), url,
                      F.date_format(F.current_timestamp(), _ISO) if fetched_at is None else fetched_at)


def pokemon_references(payloads: DataFrame, column: str = "payload", fetched_at: Column | None = None) -> DataFrame:
    rows = payloads.withColumn("card", F.from_json(column, S.POKEMON_PAYLOAD))
    card = F.col("card")
    return _reference(rows, "pokemon", card["set"]["id"], card["number"], pokemon_image_url(card),
                      F.concat(F.lit(P.POKEMON_CARD_URL), card["id"]),
                      F.date_format(F.current_timestamp(), _ISO) if fetched_at is None else fetched_at)


def union_references(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


# ------------------------------------------------------------ graded certs


def cert_images(images: Column) -> Column:
    """Front and back URL of the usual array shape; first valid one of a side."""
    valid = F.filter(F.from_json(images, S.IMAGES_PAYLOAD), lambda e: X.is_image_url(e["ImageURL"]))
    front = F.filter(valid, lambda e: e["IsFrontImage"])
    back = F.filter(valid, lambda e: ~e["IsFrontImage"])
    return F.struct(F.try_element_at(front, F.lit(1))["ImageURL"].alias("front"),
                    F.try_element_at(back, F.lit(1))["ImageURL"].alias("back"))


_LEAVES = ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())]))


@F.pandas_udf(_LEAVES)
def json_text_leaves(documents: pd.Series) -> pd.Series:
    """String leaves of a JSON tree of any depth with their lower-cased path."""

    def leaves(tree):
        found, todo = [], [(tree, "")]
        while todo:  # a stack of its own: nesting has no limit
            node, path = todo.pop()
            if isinstance(node, str):
                found.append({"path": path, "value": node})
            elif isinstance(node, dict):
                todo.extend((child, f"{path}.{key}".lower()) for key, child in reversed(node.items()))
            elif isinstance(node, list):
                todo.extend((child, f"{path}[{at}]") for at, child in reversed(list(enumerate(node))))
        return found

    def parse(doc):
        try:
            return leaves(json.loads(doc))
        except (TypeError, ValueError, RecursionError):  # too deep for the parser: as unreadable as broken text
            return []

    return documents.map(parse)


def _assign_sides(found: Column) -> Column:
    """Sides of an unknown tree: by 'front' / 'back' in the path, else by order.

    A leaf whose path says both is the front while none is taken yet.
    """
    says_front = lambda e: e["path"].contains("front")
    says_back = lambda e: e["path"].contains("back")
    fronts = F.filter(found, says_front)
    front = F.try_element_at(fronts, F.lit(1))
    first_front = F.array_position(F.transform(found, says_front), True)
    backs = F.filter(
        F.transform(found, lambda e, i: F.struct(e["path"].alias("path"), e["value"].alias("value"),
                                                 (i + 1).alias("at"))),
        lambda e: says_back(e) & (~says_front(e) | (e["at"] > first_front)))
    back = F.try_element_at(backs, F.lit(1))
    none = front.isNull() & back.isNull()
    return F.struct(
        F.when(none, F.try_element_at(found, F.lit(1))["value"]).otherwise(front["value"]).alias("front"),
        F.when(none, F.try_element_at(found, F.lit(2))["value"]).otherwise(back["value"]).alias("back"))


def pick_images(rows: DataFrame, column: str) -> DataFrame:
    """Add front_image_path / back_image_path; only drifted rows meet Python."""
    usual = rows.withColumn("_img", cert_images(F.col(column)))
    clear = F.col("_img.front").isNotNull() | F.col("_img.back").isNotNull()
    done = usual.where(clear)
    rest = usual.where(~clear)
    some_url = F.coalesce(F.col(column).rlike(r"(?i)https?:"), F.lit(False))
    walked = rest.where(some_url).withColumn("_leaves", json_text_leaves(F.col(column))).withColumn(
        "_leaves", F.filter("_leaves", lambda e: X.is_image_url(e["value"])))
    rest = walked.withColumn("_img", _assign_sides(F.col("_leaves"))).drop("_leaves").unionByName(rest.where(~some_url))
    return done.unionByName(rest).withColumns(
        {"front_image_path": F.col("_img.front"), "back_image_path": F.col("_img.back")}).drop("_img")


def cert_rows(payloads: DataFrame, column: str = "payload", source_url: Column | None = None,
              scraped_at: Column | None = None) -> DataFrame:
    """Graded-cert payloads -> cert rows with an outcome.

    Expects ``cert_id``, the metadata ``column`` and optionally
    front_image_path / back_image_path from ``pick_images``.
    """
    parsed = payloads.withColumn("c", F.from_json(column, S.CERT_PAYLOAD)["PSACert"])
    c = F.col("c")
    grade = X.parse_grade(c["CardGrade"], c["GradeDescription"])
    subject, brand = (X.strip(F.coalesce(c[n], F.lit(""))) for n in ("Subject", "Brand"))
    name = F.coalesce(X.blank_to_null(subject), X.blank_to_null(brand))
    skip = F.coalesce(c["IsDualCert"], F.lit(False)) | F.coalesce(c["IsPSADNA"], F.lit(False)) | grade.isNull()
    path = lambda n: F.col(n) if n in payloads.columns else F.lit(None).cast("string")
    return parsed.select(
        "cert_id", grade.alias("grade"), name.alias("card_name"), brand.alias("set_name"),
        X.parse_year(c["Year"]).alias("year"), X.blank_to_null(c["CardNumber"]).alias("card_number"),
        path("front_image_path").alias("front_image_path"), path("back_image_path").alias("back_image_path"),
        (F.lit(None).cast("string") if source_url is None else source_url).alias("source_url"),
        (F.date_format(F.current_timestamp(), _ISO) if scraped_at is None else scraped_at).alias("scraped_at"),
        F.when(skip, F.lit("non_gradeable_skipped")).when(name.isNull(), F.lit("parse_errors"))
        .otherwise(F.lit("successful")).alias("outcome"),
    )


def cert_pages(pages: DataFrame, cert_id: str = "page_id", url: str = "url", html: str = "html",
               scraped_at: Column | None = None) -> DataFrame:
    """Certificate HTML pages -> cert rows with an outcome."""
    h, base = F.col(html), F.col(url)
    rows = pages.withColumns({"_meta": X.definition_map(h), "_grade": X.page_grade(h), "_title": X.page_title(h)})
    meta, grade = F.col("_meta"), as_double(F.col("_grade"))
    title = X.blank_to_null(F.col("_title"))
    return rows.select(
        F.col(cert_id).alias("cert_id"), grade.alias("grade"), title.alias("card_name"),
        F.coalesce(X.map_first(meta, P.SET_LABELS), F.lit("")).alias("set_name"),
        X.parse_year(X.map_first(meta, P.YEAR_LABELS)).alias("year"),
        X.map_first(meta, P.NUMBER_LABELS).alias("card_number"),
        X.absolute_url(X.page_image(h, "front"), base).alias("front_image_path"),
        X.absolute_url(X.page_image(h, "back"), base).alias("back_image_path"),
        base.alias("source_url"),
        (F.date_format(F.current_timestamp(), _ISO) if scraped_at is None else scraped_at).alias("scraped_at"),
        F.when(grade.isNull() | ~grade.between(1.0, 10.0) | title.isNull(), F.lit("parse_errors"))
        .otherwise(F.lit("successful")).alias("outcome"),
    )


# ------------------------------------------------------- keys and pricing


def check_shot_keys(shots: DataFrame) -> DataFrame:
    """Parse object keys and say what is wrong with them (null when fine)."""
    pattern = r"^submissions/([0-9a-fA-F-]{36})/"
    prefix = F.concat(F.lit("submissions/"), F.col("submission_id"), F.lit("/shots/"), F.col("id"), F.lit("/"))
    kind = F.split(F.substr("s3_key", F.length(prefix) + 1), r"\.")[0]
    return shots.withColumn("key_submission_id", X.blank_to_null(F.regexp_extract("s3_key", pattern, 1))).withColumn(
        "key_problem",
        F.when(F.col("key_submission_id").isNull(), F.lit("bad_layout"))
        .when(~F.col("s3_key").startswith(prefix), F.lit("id_mismatch"))
        .when(kind != F.col("kind"), F.lit("kind_mismatch")))


def pick_price(payloads: DataFrame, column: str = "tiers", url: str | None = None) -> DataFrame:
    """The "Normal" price tier when there is one, else the first tier."""
    tiers = F.from_json(column, S.PRICE_PAYLOAD)
    normal = F.filter(tiers, lambda t: t["subTypeName"] == "Normal")
    tier = F.coalesce(F.try_element_at(normal, F.lit(1)), F.try_element_at(tiers, F.lit(1)))
    out = payloads.withColumn("_t", tier).withColumns({
        "market_price": as_double(F.col("_t.marketPrice")), "low_price": as_double(F.col("_t.lowPrice")),
        "median_price": as_double(F.col("_t.midPrice")),
        "direct_low_price": as_double(F.col("_t.directLowPrice")),
    }).drop("_t")
    if url is not None:
        out = out.withColumn("product_url", F.when(
            F.col(url).startswith("/"), F.concat(F.lit(P.PRODUCT_URL_BASE), F.col(url))).otherwise(F.col(url)))
    return out
