"""Explicit schemas of the lake tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


LONG, INT, DOUBLE, TEXT, BOOL, TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType())
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCRAPED = _struct(
    cert_id=LONG, grade=DOUBLE, card_name=TEXT, set_name=TEXT, year=INT, card_number=TEXT,
    front_image_path=TEXT, back_image_path=TEXT, source_url=TEXT, scraped_at=TEXT,
)
REFERENCES = _struct(
    variant_id=TEXT, manufacturer=TEXT, name=TEXT, set_code=TEXT, collector_number=TEXT, rarity=TEXT,
    front_image_path=TEXT, source_url=TEXT, fetched_at=TEXT,
)
EXEMPLARS = _struct(
    manufacturer=TEXT, variant_id=TEXT, exemplar_ix=INT, embedding=VECTOR,
)
CONSUMED_LOG = _struct(
    cert_id=LONG, manufacturer=TEXT, variant_id=TEXT, added_at=TEXT,
)
CARD_SETS = _struct(
    id=TEXT, game=TEXT, code=TEXT, name=TEXT,
)
CARD_VARIANTS = _struct(
    id=TEXT, game=TEXT, set_id=TEXT, card_number=TEXT, name=TEXT, scryfall_id=TEXT, external_ids=T.MapType(TEXT,
    TEXT), canonical_phash=LONG, canonical_image_embedding=VECTOR,
)
SUBMISSIONS = _struct(
    id=TEXT, user_id=TEXT, status=TEXT, identified_variant_id=TEXT, identification_confidence=DOUBLE,
    rejection_reason=TEXT, created_at=TIME, updated_at=TIME, completed_at=TIME,
)
SHOTS = _struct(
    id=TEXT, submission_id=TEXT, kind=TEXT, s3_key=TEXT, quality_passed=BOOL, created_at=TIME,
)
GRADES = _struct(
    submission_id=TEXT, scheme=TEXT, centering=DOUBLE, corners=DOUBLE, edges=DOUBLE, surface=DOUBLE,
    final=DOUBLE, front_centering_lr=DOUBLE, front_centering_tb=DOUBLE, back_centering_lr=DOUBLE,
    back_centering_tb=DOUBLE, confidence=DOUBLE, model_versions=T.MapType(TEXT, TEXT),
)
MEASUREMENTS = _struct(
    submission_id=TEXT, detector=TEXT, score=DOUBLE, confidence=DOUBLE, abstain_reason=TEXT,
    metrics=T.MapType(TEXT, DOUBLE), extracted_text=TEXT,
)
AUDIT_LOG = _struct(
    submission_id=TEXT, actor=TEXT, action=TEXT, payload=TEXT, created_at=TIME,
)
OUTCOMES = _struct(
    sample_id=TEXT, ground_truth=TEXT, detector=TEXT, score=DOUBLE, confidence=DOUBLE, verdict=TEXT, error=TEXT,
)
RUN_LOG = _struct(
    timestamp=TEXT, starting_cert_id=LONG, ending_cert_id=LONG, stop_reason=TEXT, error=TEXT,
    stats=T.MapType(TEXT, LONG),
)
PRICES = _struct(
    name=TEXT, set_code=TEXT, card_number=TEXT, fetched_at=TIME, market_price=DOUBLE, low_price=DOUBLE,
    median_price=DOUBLE, direct_low_price=DOUBLE, product_url=TEXT,
)

# Raw payloads (one JSON document per row).
MTG_PAYLOAD = _struct(
    id=TEXT, name=TEXT, set=TEXT, collector_number=TEXT, rarity=TEXT, scryfall_uri=TEXT,
    image_uris=_struct(large=TEXT, normal=TEXT, png=TEXT),
    card_faces=T.ArrayType(_struct(image_uris=_struct(large=TEXT, normal=TEXT, png=TEXT))),
)
POKEMON_PAYLOAD = _struct(
    id=TEXT, name=TEXT, set=_struct(id=TEXT), number=TEXT, rarity=TEXT, images=_struct(large=TEXT, small=TEXT),
)
CERT_PAYLOAD = _struct(
    PSACert=_struct(CardGrade=TEXT, GradeDescription=TEXT, Year=TEXT, Subject=TEXT, Brand=TEXT, CardNumber=TEXT,
    IsDualCert=BOOL, IsPSADNA=BOOL),
)
IMAGES_PAYLOAD = T.ArrayType(_struct(
    IsFrontImage=BOOL, ImageURL=TEXT,
))
PRICE_PAYLOAD = T.ArrayType(
    _struct(
    subTypeName=TEXT, marketPrice=TEXT, lowPrice=TEXT, midPrice=TEXT, directLowPrice=TEXT,
)
)


def with_corrupt(schema: T.StructType) -> T.StructType:
    """Schema plus the column that receives undecodable lines."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
