"""Scans, sinks, the table store, catalog sync and normalization."""

import json

import pytest
from pyspark.sql import functions as F

from slabspark import schemas as SC
from slabspark.operators import catalog as C
from slabspark.operators import normalize as N
from slabspark.plans import jobs
from slabspark.sources import readers as R
from slabspark.sources import store as ST


def _lines(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_json_lines_tolerance(spark, tmp_path):
    good = json.dumps({"cert_id": 5, "grade": 9.5, "card_name": "A", "year": "not a number"})
    path = _lines(tmp_path / "s.jsonl", good, "", json.dumps({"cert_id": "x7", "grade": 1}), json.dumps({"grade": 3.0}), good[:20])
    scan = R.read_json_lines(spark, path, SC.SCRAPED)
    assert scan.rows.count() == 3 and scan.bad_lines() == 1
    rows = R.read_certs(spark, path).collect()
    assert [(r.cert_id, r.card_name, r.year) for r in rows] == [(5, "A", None)]
    assert R.read_json_lines(spark, str(tmp_path / "none.jsonl"), SC.SCRAPED).rows.count() == 0


def test_reference_scan(spark, tmp_path):
    path = _lines(tmp_path / "r.jsonl", json.dumps({"manufacturer": "mtg", "variant_id": "a"}), json.dumps({"manufacturer": "mtg"}))
    assert R.read_references(spark, path).count() == 1


def test_json_array(spark, tmp_path):
    p = tmp_path / "bulk.json"
    p.write_text(json.dumps([{"id": "1", "name": "x"}, 5, "text", {"id": "2", "name": "y", "image_uris": {"large": "https://h/a"}}]))
    rows = R.read_json_array(spark, str(p), SC.MTG_PAYLOAD)
    assert sorted(r.id for r in rows.collect()) == ["1", "2"]
    q = tmp_path / "by_line.json"
    q.write_text('[\n{"id": "1", "name": "x"},\n5,\n"{\\"id\\": \\"9\\"}",\n{"id": "2", "name": "y"}\n]\n')
    assert sorted(r.id for r in R.read_json_array(spark, str(q), SC.MTG_PAYLOAD, element_per_line=True).collect()) == ["1", "2"]
    assert sorted(r.id for r in R.read_json_array(spark, str(q), SC.MTG_PAYLOAD).collect()) == ["1", "2"]


def test_labels_csv(spark, tmp_path):
    ok = _lines(tmp_path / "ok.csv", "image_path,ground_truth,sample_id", "a/b.c.png, Authentic ,", "x.png,counterfeit,z9")
    rows = {r.sample_id: r.ground_truth for r in R.read_labels_csv(spark, ok).collect()}
    assert rows == {"b.c": "authentic", "z9": "counterfeit"}
    two = _lines(tmp_path / "two.csv", "image_path,ground_truth", "q.png,authentic")
    assert R.read_labels_csv(spark, two).first().sample_id == "q"
    with pytest.raises(ValueError, match="missing required"):
        R.read_labels_csv(spark, _lines(tmp_path / "m.csv", "image_path,label", "a,b"))
    with pytest.raises(ValueError, match="line 3.*maybe"):
        R.read_labels_csv(spark, _lines(tmp_path / "b.csv", "image_path,ground_truth", "a.png,authentic", "b.png,maybe"))
    with pytest.raises(ValueError, match="empty image_path"):
        R.read_labels_csv(spark, _lines(tmp_path / "e.csv", "image_path,ground_truth", " ,authentic"))
    # far down a file of many partitions, with its path also in an earlier good row
    many = [f"img{i}.png,authentic" for i in range(20000)]
    many[14998], many[10] = "img7.png,maybe", "x-img7.png,authentic"
    path = _lines(tmp_path / "long.csv", "image_path,ground_truth", *many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        with pytest.raises(ValueError, match="line 15000: ground_truth=maybe"):
            R.read_labels_csv(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_authentic_labels(spark):
    certs = spark.createDataFrame([(2, "f"), (1, "g"), (3, ""), (None, "h")], "cert_id long, front_image_path string")
    assert sorted(r.sample_id for r in R.authentic_labels(certs).collect()) == ["psa-1", "psa-2"]
    assert [r.sample_id for r in R.authentic_labels(certs, 1).collect()] == ["psa-1"]


def test_seed_folder(spark, tmp_path):
    for name in ("psa9/psa9_1.jpg", "psa9/psa8_2.PNG", "psa11/psa11_1.jpg", "psa10/readme.md", "other/psa1_1.jpg", "PSA7/psa7_3.jpeg"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    rows = R.read_seed_folder(spark, str(tmp_path))
    assert sorted((r.grade, r.mismatch) for r in rows.collect()) == [(7, False), (9, False), (9, True)]
    counts = ST.write_seed_manifest(rows, str(tmp_path / "out"))
    assert {r.grade: r.n for r in counts.collect()} == {7: 1, 9: 2}


def test_table_store(spark, tmp_path):
    store = ST.TableStore(spark, str(tmp_path / "lake"))
    schema = SC.CARD_SETS
    assert store.read("t", schema).count() == 0 and not store.exists("t")
    store.append("t", spark.createDataFrame([("1", "mtg", "LEA", "old")], schema))
    store.append("t", spark.createDataFrame([("2", "mtg", "LEB", "b")], schema))
    assert store.read("t", schema).count() == 2
    source = spark.createDataFrame([("9", "mtg", "LEA", "first"), ("8", "mtg", "LEA", None), ("7", "mtg", "NEW", "n")], schema)
    out = store.upsert("t", source, ["game", "code"], schema, order=[F.col("name").isNull()], keep=["id"])
    assert {(r.id, r.code, r.name) for r in out.collect()} == {("1", "LEA", None), ("2", "LEB", "b"), ("7", "NEW", "n")}
    again = store.upsert("t", source, ["game", "code"], schema, order=[F.col("name").isNull()], keep=["id"])
    assert again.count() == 3


def test_replace_reads_its_own_old_version(spark, tmp_path):
    store = ST.TableStore(spark, str(tmp_path / "lake"))
    store.replace("t", spark.createDataFrame([("1", "a", "b", "c")], SC.CARD_SETS))
    store.replace("t", store.read("t", SC.CARD_SETS).unionByName(spark.createDataFrame([("2", "a", "x", "c")], SC.CARD_SETS)))
    assert store.read("t", SC.CARD_SETS).count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish("t", 2)


def test_run_log_and_cursor(spark, tmp_path):
    path = str(tmp_path / "log")
    for ts, start, end, stop in (("1", 10, 20, "budget_exhausted"), ("2", 20, 99, "ingest_aborted")):
        ST.append_run_log(spark, path, SC.RUN_LOG, {"timestamp": ts, "starting_cert_id": start, "ending_cert_id": end,
                                                    "stop_reason": stop, "error": None, "stats": {"ok": 1}})
    row = ST.next_cursor(ST.read_run_log(spark, path, SC.RUN_LOG), 5).first()
    assert (row.next_cert_id, row.runs, row.last_run_at) == (20, 1, "1")
    empty = ST.next_cursor(spark.createDataFrame([], SC.RUN_LOG), 5).first()
    assert (empty.next_cert_id, empty.runs) == (5, 0)


# ------------------------------------------------------------- catalog sync


@pytest.fixture()
def references(spark):
    rows = [("lea-232", "mtg", "Black Lotus", "LEA", "232", 1), ("lea-001", "mtg", "Ancestral Recall", "LEA", "001", 2),
            ("base1-4", "pokemon", "Charizard", "base1", "4", 3), ("ygo-1", "ygo", "Dragon", "LOB", "1", 4)]
    return spark.createDataFrame(rows, "variant_id string, manufacturer string, name string, set_code string, collector_number string, "
                                       "n long").withColumn("front_image_path", F.lit(""))


def test_sync_golden(spark, tmp_path, references):
    store = ST.TableStore(spark, str(tmp_path / "lake"))
    exemplars = spark.createDataFrame([("mtg", "lea-232", 0, [1.0]), ("pokemon", "base1-4", 0, [1.0]), ("mtg", "lea-001", 0, [1.0]),
                                       ("mtg", "lea-001", 1, [2.0])], SC.EXEMPLARS)
    dry = jobs.sync_catalog(store, references, exemplars, dry_run=True, ingest_order="n").first()
    assert (dry.sets_total, dry.variants_total, dry.skipped_unmapped_manufacturer, dry.variants_upserted,
            dry.variants_with_embedding) == (2, 4, 1, 3, 2)
    assert not store.exists("card_sets")
    assert jobs.sync_catalog(store, references, exemplars, dry_run=True, ingest_order="n").first() == dry
    jobs.sync_catalog(store, references, exemplars, ingest_order="n")
    sets = {(r.game, r.code, r.name, r.id) for r in store.read("card_sets", SC.CARD_SETS).collect()}
    assert {s[:3] for s in sets} == {("mtg", "LEA", "LEA"), ("pokemon", "base1", "BASE1")}
    variants = store.read("card_variants", SC.CARD_VARIANTS)
    lotus = variants.where("name = 'Black Lotus'").first()
    assert lotus.scryfall_id == "lea-232" and lotus.external_ids == {"manufacturer": "mtg", "mtg_variant_id": "lea-232"}
    changed = references.withColumn("name", F.concat("name", F.lit("!")))
    jobs.sync_catalog(store, changed, exemplars, ingest_order="n")
    assert {(r.game, r.code, r.name, r.id) for r in store.read("card_sets", SC.CARD_SETS).collect()} == sets
    after = store.read("card_variants", SC.CARD_VARIANTS)
    assert after.count() == 3 and after.where("name = 'Black Lotus!'").first().id == lotus.id


def test_duplicate_variant_keys_keep_the_last(spark, references):
    twice = references.unionByName(references.where("variant_id = 'lea-232'").withColumns({"name": F.lit("Later"), "n": F.lit(9).cast("long")}))
    labelled = C.label_references(twice.withColumn("ingest_order", F.col("n"))).withColumn("set_id", F.col("set_code"))
    out = C.upsert_variants(spark.createDataFrame([], SC.CARD_VARIANTS), C.variant_rows(labelled))
    assert out.where("card_number = '232'").first().name == "Later" and out.count() == 3


def test_outcome_order(spark):
    rows = spark.createDataFrame([("ygo", None, None), ("mtg", None, None), ("mtg", "X", ""), ("mtg", "X", "1"), (None, "X", "1")],
                                 "manufacturer string, set_code string, collector_number string")
    assert [r.outcome for r in C.label_references(rows).collect()] == [
        "skipped_unmapped_manufacturer", "skipped_missing_set_code", "skipped_missing_card_number", "emitted", "skipped_unmapped_manufacturer"]


# ----------------------------------------------------------- normalization

PAGE = """<html><h1 class="item-title big">Black <b>Lotus</b> &amp; co</h1>
<div class="cert-grade"> PSA 9.5 </div><dl><dt>Year:</dt><dd>1993 (ed)</dd><dt>Set Name</dt><dd>Alpha</dd><dt>Card #</dt><dd>232</dd>
<dt>Year</dt><dd>2001</dd></dl><img class="card front" src="/i/f.jpg"><img src="b.jpg" class="back x"></html>"""


def test_cert_page(spark):
    pages = spark.createDataFrame([(1, "https://h.com/cert/1", PAGE), (2, "https://h.com/2", PAGE.replace("9.5", "11")), (3, "u", "<p>no</p>"),
                                   (4, "u", '<i data-grade="8"></i><h1>Plain</h1>')], "page_id long, url string, html string")
    r = {x.cert_id: x for x in N.cert_pages(pages).collect()}
    assert (r[1].grade, r[1].card_name, r[1].set_name, r[1].year, r[1].card_number) == (9.5, "Black Lotus & co", "Alpha", 1993, "232")
    assert (r[1].front_image_path, r[1].back_image_path) == ("https://h.com/i/f.jpg", "https://h.com/cert/b.jpg")
    assert [r[i].outcome for i in (1, 2, 3, 4)] == ["successful", "parse_errors", "parse_errors", "successful"]
    assert (r[4].grade, r[4].card_name, r[4].set_name, r[4].year) == (8.0, "Plain", "", None)


def test_cert_page_attributes_in_any_order_and_quotes(spark):
    html = """<h1>Other</h1><H1 id='t' class='x card-title'>Real</H1><img data-src="no.jpg" src='/b.jpg' alt="" class='back'><img class="upfront" src="/u.jpg">
    <img src="" class="front"><img src="/f.jpg" class="Front big"><span class="grade-num">PSA x</span><b class="big-Grade">psa 10</b><dl><dt>Set<dd>Alpha<dt>Card #</dt> <!-- --><dd><i>7</i></dd></dl>"""
    r = N.cert_pages(spark.createDataFrame([(1, "https://h.com/a/b", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string"))
    r = {x.cert_id: x for x in r.collect()}
    assert (r[1].grade, r[1].card_name, r[1].set_name, r[1].card_number) == (10.0, "Real", "Alpha", "7")
    assert (r[1].front_image_path, r[1].back_image_path) == ("https://h.com/f.jpg", "https://h.com/b.jpg")
    assert [r[i].outcome for i in (2, 3)] == ["parse_errors", "parse_errors"]


@pytest.mark.parametrize("doc,want", [
    ([{"IsFrontImage": True, "ImageURL": "https://h/a.jpg"}, {"IsFrontImage": False, "ImageURL": "https://h/b.png"}], ("https://h/a.jpg", "https://h/b.png")),
    ([{"IsFrontImage": False, "ImageURL": "https://h/b.png"}], (None, "https://h/b.png")),
    ({"x": {"FrontUrl": "https://h/a.jpg"}, "BACK": ["https://h/b.jpg"]}, ("https://h/a.jpg", "https://h/b.jpg")),
    ({"front_back": ["https://h/1.jpg", "https://h/2.jpg"]}, ("https://h/1.jpg", "https://h/2.jpg")),
    ({"a": {"b": {"c": {"d": ["https://h/1.jpg", "https://h/2.webp", "https://h/3.jpg"]}}}}, ("https://h/1.jpg", "https://h/2.webp")),
    ({"a": "ftp://h/1.jpg"}, (None, None)), ([], (None, None)),
])
def test_images_of_any_shape(spark, doc, want):
    rows = spark.createDataFrame([(1, json.dumps(doc))], "cert_id long, images string")
    r = N.pick_images(rows, "images").first()
    assert (r.front_image_path, r.back_image_path) == want


def test_cert_payload_rules(spark):
    def doc(**cert):
        return json.dumps({"PSACert": cert})
    rows = spark.createDataFrame([
        (1, doc(CardGrade="GEM MT 10", Subject=" Lotus ", Brand=" Alpha ", Year="1993", CardNumber="")), (2, doc(CardGrade="N0: AUTHENTIC", Subject="x")),
        (3, doc(GradeDescription="NM-MT+ 8.5", Brand="B")), (4, doc(CardGrade="MINT 9", IsDualCert=True, Subject="x")), (5, doc(CardGrade="MINT 9")), (6, "broken")],
        "cert_id long, payload string")
    r = {x.cert_id: x for x in N.cert_rows(rows).collect()}
    assert (r[1].grade, r[1].card_name, r[1].set_name, r[1].year, r[1].card_number) == (10.0, "Lotus", "Alpha", 1993, None)
    assert (r[3].grade, r[3].card_name) == (8.5, "B")
    assert [r[i].outcome for i in range(1, 7)] == ["successful", "non_gradeable_skipped", "successful", "non_gradeable_skipped",
                                                   "parse_errors", "non_gradeable_skipped"]


def test_card_payloads(spark):
    mtg = [{"id": "a", "name": "A", "set": "lea", "image_uris": {"large": "http://x", "normal": "https://h/n", "png": "https://h/p"}},
           {"id": "b", "name": "B", "card_faces": [{"image_uris": {"png": "https://h/f"}}]}, {"id": "", "name": "C"}, {"id": "d", "name": 5}]
    got = N.mtg_references(spark.createDataFrame([(json.dumps(d),) for d in mtg], "payload string")).collect()
    assert (got[0].front_image_path, got[0].set_code, got[0].source_url) == ("https://h/n", "LEA", "https://api.scryfall.com/cards/a")
    assert got[1].front_image_path == "https://h/f" and got[2].outcome == "parse_errors"
    pk = [{"id": "base1-4", "name": "Z", "set": {"id": "base1"}, "number": "4", "images": {"small": "https://h/s", "large": "https://h/l"}}]
    one = N.pokemon_references(spark.createDataFrame([(json.dumps(d),) for d in pk], "payload string")).first()
    assert (one.set_code, one.collector_number, one.front_image_path, one.source_url) == (
        "BASE1", "4", "https://h/l", "https://pokemontcg.io/cards/base1-4")


def test_normalize_job(spark):
    payload = json.dumps({"PSACert": {"CardGrade": "MINT 9", "Subject": "S"}})
    out = jobs.normalize_sources(
        spark.createDataFrame([('{"id":"a","name":"A"}',)], "payload string"), spark.createDataFrame([('{"id":"p"}',)], "payload string"),
        spark.createDataFrame([(7, payload, "[]")], "cert_id long, payload string, images string"),
        spark.createDataFrame([(1, "https://h.com/cert/1", PAGE)], "page_id long, url string, html string"))
    assert out["references"].count() == 1 and sorted(r.cert_id for r in out["scraped"].collect()) == [1, 7]
    assert {r.outcome: r.n for r in out["reference_outcomes"].collect()} == {"image_missing": 1, "parse_errors": 1}


def test_price_pick(spark):
    t = [{"subTypeName": "Foil", "marketPrice": 9}, {"subTypeName": "Normal", "marketPrice": "3.5", "lowPrice": "x"}]
    rows = spark.createDataFrame([(1, json.dumps(t), "/product/1"), (2, json.dumps(t[:1]), "https://o/2"), (3, "[]", None)], "id int, tiers string, u string")
    r = {x.id: x for x in N.pick_price(rows, "tiers", "u").collect()}
    assert (r[1].market_price, r[1].low_price, r[1].product_url) == (3.5, None, "https://www.tcgplayer.com/product/1")
    assert (r[2].market_price, r[2].product_url) == (9.0, "https://o/2") and r[3].market_price is None


def test_partition_upsert_leaves_other_partitions_alone(spark, tmp_path):
    schema = spark.createDataFrame([], "day string, k long, v string").schema
    store = ST.TableStore(spark, str(tmp_path / "lake"))
    put = lambda rows: store.upsert_partitions("t", spark.createDataFrame(rows, schema), ["day", "k"], schema, ["day"])
    put([("a", 1, "x"), ("b", 1, "y")])
    untouched = sorted((tmp_path / "lake/t/v1/day=b").iterdir())
    for _ in range(2):
        put([("a", 1, None), ("a", 2, "z"), ("c", 1, "n")])
    assert sorted((tmp_path / "lake/t/v1/day=b").iterdir()) == untouched
    assert {tuple(r) for r in store.read("t", schema).select("day", "k", "v").collect()} == {
        ("a", 1, None), ("a", 2, "z"), ("b", 1, "y"), ("c", 1, "n")}
    with pytest.raises(ValueError):
        store.upsert_partitions("t", spark.createDataFrame([], schema), ["k"], schema, ["day"])


def test_exemplar_scan(spark, tmp_path):
    path = str(tmp_path / "ex")
    rows = [("mtg", "a", 0, [1.0]), ("mtg", "a", 1, [2.0]), ("mtg", "", 0, [3.0]), ("pokemon", "b", 0, [4.0])]
    spark.createDataFrame(rows, SC.EXEMPLARS).write.parquet(path)
    found = R.read_exemplars(spark, path)
    assert found.count() == 3
    hits = R.lookup_references(found, "mtg", "a")
    assert hits.count() == 2 and R.lookup_references(found, "mtg", "zz").count() == 0
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(variant_id,a)" in plan
    archive = spark.createDataFrame([("mtg/a/b", 0, [1.0]), ("bad", 0, [1.0]), ("/x", 0, [1.0])], "key string, ix int, embedding array<float>")
    assert [(r.manufacturer, r.variant_id) for r in R.keyed_vectors(archive).collect()] == [("mtg", "a/b")]
