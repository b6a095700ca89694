"""Operators of ``slabspark.llm`` against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from slabspark.llm import bpe, decontaminate, graph, html, langid, lm, neighbours, secrets, simhash, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_docs():
    """Rows every operator has to bear: nulls, blanks, ties, repeats, one very long text, one word."""
    base = prose(1, 200)
    words = base.split()
    return [
        (1, base, "en", "s", None), (2, base, "en", "s", 3), (2, base, "en", "s", 3), (3, None, None, None, None), (4, "", "de", "s", 0), (5, " \n\t ", "de", "s", 4),
        (None, base, "en", None, 1), (None, None, None, None, None), (6, " ".join(words[:199] + ["Other"]), "en", "s", 5), (7, "one", "fr", "s", 3),
        (8, prose(2, 20000), "en", "s", 1), (9, "x" * 30000, "en", "s", 1), (10, "ÄÖ ß 漢字 " * 30, "de", "s", 1), (3, "another text under the same id", "en", "s", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_docs(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """The same rows with extra columns that carry names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "copy", "fp", "keys", "node", "component", "word", "words", "seq", "seed", "h", "c", "spans", "doc", "text_", "score", "row"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- SimHash


def fingerprint(text, size=3):
    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd):
    got = [(r["id"], r["fp"].hex(), r["component"]) for r in simhash.simhash_classes(clash(odd)).collect()]
    docs = [(i, fingerprint(t)) for i, t, *_ in odd_docs()]
    parent = {f: f for _, f in docs}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for f in list(parent):
        for g in list(parent):
            if bin(f ^ g).count("1") <= 3:
                parent[root(f)] = root(g)
    least = {}
    for i, f in docs:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(((i, format(f, "016x"), least.get(root(f))) for i, f in docs), key=key)


@pytest.mark.parametrize("radius,bits", [(0, 64), (1, 64), (3, 64), (7, 128), (20, 128)])
def test_sliced_distances(radius, bits):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 256, (4, bits // 8), dtype=np.uint8)
    fps = centre[rng.integers(0, 4, 300)]
    for i, b in zip(rng.integers(0, 300, 900), rng.integers(0, bits, 900)):
        fps[i, b // 8] ^= 1 << (b % 8)
    group = np.sort(rng.integers(0, 5, 300))
    parent = simhash.spanning_links(group, fps, radius, at_once=40)
    bit = np.unpackbits(fps, axis=1)
    near = ((bit[:, None] != bit[None]).sum(2) <= radius) & (group[:, None] == group[None])
    want = np.arange(300)
    for _ in range(300):
        new = np.array([want[near[i]].min() for i in range(300)])
        if (new == want).all():
            break
        want = new
    assert (parent == want).all()


def test_crowded_keys_lose_no_link(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    fps = [bytes(8)] + [int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))).to_bytes(8, "big") for _ in range(200)]
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(set(fps))], "node long, fp binary").withColumn("keys", simhash.band_keys(F.col("fp"), 3))
    plain, dealt = (rows(graph.components(simhash.links(nodes, 3, crowd))) for crowd in (10_000, 16))
    assert sorted(plain) == sorted(dealt) and len(plain) == len(set(fps)) - 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert dict(rows(graph.components(edges))) == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert rows(graph.components(edges.limit(0))) == []


def test_near_duplicates_keep_one(spark):
    base = [prose(s, 150, 5000) for s in range(12)]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        words = t.split()
        words[40 + i] = "changed"
        docs.append((100 + i, " ".join(words), "en", "s", 1))
    docs += [(200, base[0], "en", "s", 1), (200, base[0], "en", "s", 1), (3, base[3], "en", "s", 1), (None, base[1], "en", "s", 1)]
    kept = simhash.keep_one(clash(spark.createDataFrame(docs, DOCS)))
    assert sorted((r[0] is None, r[0]) for r in rows(kept.select("doc_id"))) == [*((False, i) for i in range(12)), (True, None)]


def test_near_duplicates_are_those_of_exact_similarity(spark):
    """Pairs at and around similarity 0.8, short texts, and a line repeated many times; the exact sets decide."""
    docs, alike, apart = [], [], []

    def pair(a, b):
        sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        (alike if similarity >= 0.8 else apart).append(len(docs))
        docs.extend([(len(docs) + k, t, "en", "s", 1) for k, t in enumerate((a, b))])
        return similarity

    near = []
    for k in range(60):
        for cut in (18, 20, 22):  # of 180 shingles
            words = prose(1000 + k * 100 + cut, 184, 10**6).split()
            near.append(pair(" ".join(words), " ".join(words[:-cut] + prose(20000 + k * 100 + cut, cut, 10**6).split())))
        few = prose(3000 + k, 9, 10**6)
        assert pair(few, few.rsplit(" ", 1)[0]) == 0.8
    assert sorted({round(x, 2) for x in near}) == [0.78, 0.8, 0.82] and len(alike) == 180 and len(apart) == 60
    line = prose(4000, 30, 10**6)
    tail = prose(4001, 300, 10**6)
    assert pair(line + " " + tail, " ".join([line] * 60) + " " + tail) > 0.95
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    component = {r["id"]: r["component"] for r in got}
    assert len(got) == len(docs)
    assert [a for a in alike if component[a + 1] != a] == [] and [a for a in apart if component[a + 1] == a] == []


def test_similar_rows():
    rng = np.random.default_rng(5)
    centre = [rng.choice(1000, 40, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.permutation(centre[rng.integers(4)])[: rng.integers(30, 41)], rng.integers(0, 1000, rng.integers(0, 8))])).astype(np.uint64) for _ in range(80)] + [np.empty(0, np.uint64)]
    want = np.arange(len(sets))
    near = np.array([[len(set(a.tolist()) & set(b.tolist())) >= 0.8 * max(1, len(set(a.tolist()) | set(b.tolist()))) for b in sets] for a in sets]) | np.eye(len(sets), dtype=bool)
    for _ in sets:
        want = np.array([want[near[i]].min() for i in range(len(sets))])
    assert (simhash.similar_rows(sets, 0.8) == want).all() and len(set(want)) > 4


def test_crowded_keys_lose_no_verified_link(spark):
    from pyspark.sql import functions as F

    base = prose(4100, 150, 10**6).split()
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 150, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.fingerprints(df, 5, 512, 10, 3, sets=True)
    nodes = prints.withColumn("text", F.col("copy"))
    docs = df.select(F.xxhash64("text").alias("copy"), "text")
    for crowd, shingles in ((10_000, 10**7), (16, 10**7), (10_000, 2_000)):
        assert graph.components(simhash.verified_links(nodes, docs, 135, 0.8, 5, crowd, shingles)).count() == len(texts) - 1


# --- language


def test_language_of_held_out_texts(spark):
    text = {"aa": "bakodi lumeta sori", "bb": "xyvvu qwrth zkplo", "cc": "ñandú éàü çeñal"}
    docs = []
    for i in range(240):
        lang = list(text)[i % 3]
        rng = random.Random(i)
        docs.append((i, " ".join("".join(rng.choices(text[lang].replace(" ", ""), k=6)) for _ in range(30)), lang, "s", 1))
    got = langid.language_ids(clash(spark.createDataFrame(docs, DOCS))).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["lang_pred"] == list(text)[r["doc_id"] % 3] and 0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, none):
    got = langid.language_ids(clash(odd)).collect()
    assert len(got) == len(odd_docs())
    blank = [r for r in got if r["doc_id"] in (4, 5)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in blank)
    assert langid.language_ids(none).collect() == []
    kept = langid.keep_known(clash(odd))
    assert not {4, 5} & {r["doc_id"] for r in kept.collect()} and kept.columns == clash(odd).columns


def test_pieces_of_a_text_add_up(monkeypatch):
    texts = ["abc déf " * 50, None, "", "123", prose(4, 300)]
    whole = langid.text_vectors(texts)
    monkeypatch.setattr(langid, "_PIECE", 64)
    assert (langid.text_vectors(texts) == whole).all() and not whole[1:4].any()


# --- decontamination


def bench(spark):
    return spark.createDataFrame([(1, prose(50, 30, 5000)), (2, prose(51, 30, 5000)), (3, None), (4, ""), (5, "tiny item"), (2, prose(51, 30, 5000))], "item_id long, text string")


def test_overlaps(spark):
    item, other = prose(50, 30, 5000), prose(51, 30, 5000)
    swapped = item.split()
    swapped[4] = swapped[12] = swapped[20] = "zz"
    docs = [
        (1, prose(7, 80, 5000) + " " + item.upper() + ", " + prose(8, 40, 5000), "", "", 1), (2, prose(9, 50, 5000) + " " + " ".join(swapped), "", "", 1), (3, prose(10, 400, 5000), "", "", 1),
        (4, " ".join(item.split()[:6]) + " " + prose(11, 50, 5000), "", "", 1), (5, None, "", "", 1), (6, item + " x " + other, "", "", 1), (None, other, "", "", 1), (7, "Tiny, item!", "", "", 1), (8, "", "", "", 1),
    ]
    df = clash(spark.createDataFrame(docs, DOCS))
    want = {(1, 1), (2, 1), (6, 1), (6, 2), (None, 2), (7, 5)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench(spark)).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(df, bench(spark), broadcast_seeds=0).collect()} == want
    kept = decontaminate.without_overlaps(df, bench(spark))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (False, 4), (False, 5), (False, 8), (True, None)] and kept.columns == df.columns


def test_overlaps_far_inside_long_texts(spark):
    """Hits next to chunk borders, at both ends, in repeated rows and under a null id: both ways to join agree."""
    passage = prose(50, 30, 5000)
    want, rows = set(), []
    for i, at in enumerate([0, 1, 11, 12, 50, 51, 52, 63, 64, 65, 127, 128, 400]):
        filler = prose(100 + i, 400).split()
        rows.append((i, " ".join(filler[:at] + [passage] + filler[at:])))
        want.add(i)
    rows += [(0, rows[0][1]), (None, rows[5][1]), (77, prose(5, 300)), (78, None), (79, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {tuple(r) for r in decontaminate.overlaps(df, bench(spark)).collect()}
    far = {tuple(r) for r in decontaminate.overlaps(df, bench(spark), broadcast_seeds=0).collect()}
    assert near == far and {r[0] for r in near} == want | {None}


def most_equal(doc, item):
    """Equal words of the best window, by brute force over all alignments; None if too few."""
    width = min(13, len(item))
    best = 0
    for shift in range(1 - len(doc), len(item)):
        equal = [0 <= i - shift < len(doc) and doc[i - shift] == item[i] for i in range(len(item))]
        best = max([best, *(sum(equal[a : a + width]) for a in range(len(item) - width + 1))])
    return best if best and best >= width - width * 3 // 13 else None


def substituted(width, most, rng):
    """An item of ``width`` words, and documents that hold it with every choice of up to ``most`` words substituted."""
    item = [f"i{width}x{k}" for k in range(width)]
    docs = []
    for n in range(most + 1):
        for gone in itertools.combinations(range(width), n):
            left, right = ([f"f{rng.randrange(10**9)}" for _ in range(rng.randrange(20))] for _ in range(2))
            docs.append(left + [f"s{rng.randrange(10**9)}" if k in gone else w for k, w in enumerate(item)] + right)
    return item, docs


def overlaps_by_brute_force(spark, items, docs):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(d, i, n) for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := most_equal(doc, item))}
    for broadcast in (100_000, 0):
        assert {tuple(r) for r in decontaminate.overlaps(df, bench, broadcast_seeds=broadcast).collect()} == want
    return want


def test_overlaps_find_every_pattern_of_substitutions(spark):
    rng = random.Random(13)
    items, docs, want = [], [], 0
    for width in range(9, 14):
        item, own = substituted(width, width * 3 // 13 + 1, rng)
        items.append(item)
        docs += own
        want += sum(math.comb(width, n) for n in range(width * 3 // 13 + 1))
    long = [f"l{k}" for k in range(60)]
    items.append(long)
    for period in (3, 4, 5):
        docs += [[f"p{period}x{k}" if k % period == r else w for k, w in enumerate(long)] for r in range(period)]
    docs += [long[:10], long[50:], long[:9], ["a", *long[20:30], "b"]]
    assert len(overlaps_by_brute_force(spark, items, docs)) == want + 4 + 5 + 3


def test_short_items_inside_longer_documents(spark):
    rng = random.Random(14)
    items, docs, want = [], [], 0
    for width in range(1, 9):
        item, own = substituted(width, width * 3 // 13 + 1, rng)
        items.append(item)
        docs += own + [item]
        want += sum(math.comb(width, n) for n in range(width * 3 // 13 + 1)) + 1
    assert len(overlaps_by_brute_force(spark, items, docs)) == want


@pytest.mark.parametrize("span,misses", [(13, 3), (13, 0), (8, 2), (20, 5)])
def test_masks_fit_into_every_pattern(span, misses):
    for width in range(1, span + 1):
        masks = decontaminate.masks_of(width, span, misses)
        for gone in itertools.combinations(range(width), width * misses // span):
            assert any(all(m[k] == "0" or a + k not in gone for k in range(len(m))) for m in masks for a in range(width - len(m) + 1)), (width, gone)


def test_overlaps_of_nothing(none, odd, spark):
    assert decontaminate.overlaps(none, bench(spark)).collect() == []
    assert decontaminate.overlaps(odd, bench(spark).limit(0)).collect() == []


# --- URLs


def test_url_rules(spark):
    cases = {
        "http://a.example.org/es/x": "example.org/es/", "https://EXAMPLE.org/en/17?q": "example.org/en/1", "http://x.org/en": "org/", "http://org/": "org/", "http://myorg.net/": None,
        "http://b.com/fr/1": "com/fr/", "http://b.com/de/": "com/de/", "http://b.com/DE/": None, "http://xcom/de/": None, "no scheme.org/": None, None: None, "": None, "http://": None, "a://b://c.org/": None,
        "http://example.org": None, "http://example.org#/es/": None, "http://.org/a": "org/", "http://a..org/a": "org/", "http://b.com/de/\n\t": "com/de/",
    }
    pages = [(i, u, None) for i, u in enumerate(cases)] * 2
    got = urls.judged(clash(spark.createDataFrame(pages, "page_id long, url string, html string")).withColumnRenamed("row", "prefix"), urls.rule_table(spark)).collect()
    verdict = {f"{h}{p}": v for v, h, p in urls.RULES}
    assert len(got) == len(pages)
    for r in got:
        rule = list(cases.values())[r["page_id"]]
        assert (r["rule"], r["verdict"]) == (rule, verdict.get(rule, "allow")), r


def test_url_rules_by_shuffle_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urls.judged(pages, urls.rule_table(spark), broadcast_rules=0).first()["rule"] == "org/"
    assert urls.judged(pages, urls.rule_table(spark).limit(0)).first()["verdict"] == "allow"
    assert urls.judged(pages.limit(0), urls.rule_table(spark)).collect() == []


# --- secrets

BASE = {"assign": re.compile(secrets.ASSIGN), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def entropy_spans(text, taken):
    out = []
    for m in re.finditer(secrets.CANDIDATE, text or "", re.ASCII):
        s = m[0]
        if re.search(secrets.ALLOWED, s):
            continue
        for pattern, width, least in secrets.CLASSES.values():
            if re.search(pattern, s):
                best = max(-sum(c / width * math.log2(c / width) for c in Counter(s[i : i + width]).values()) for i in range(len(s) - width + 1))
                if best >= least - 1e-9 and not any(a < m.end() and m.start() < e for a, _, _, e in taken):
                    out.append((m.start(), 3, "entropy", m.end()))
                break
    return out


def test_secret_spans(spark):
    rng = random.Random(5)
    parts = [
        "password", "Token: ", "api_key", "apikey=", " = ", "'", '"', ":", "AKIA", "AKIAIOSFODNN7ABCDEF", "deadbeefdeadbeef01", "abc", "é", "漢", "😀", " ", "\n", "secret=", "K9x2Qm7Lw4Zr8Tn5Vb3Yh6", "aaaaaaaaaaaaaaaaaaaaaaaa1",
        "EXAMPLEK9x2Qm7Lw4Zr8Tn5Vb3", "AB12CD34EF56AB78CD90EF", "passwd:abcdefghijklmnop", "x=y", "Ma9-Zb8_Yc7+Xd6/We5=", "0123456789abcdefgh",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "secret: token : abcdefghijklmnop", "token=" + "a1" * 4000, " ".join(["deadbeefdeadbeef"] * 700)]
    df = clash(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS))
    found = 0
    for r in secrets.secrets(df).collect():
        base = base_spans(texts[r["doc_id"]])
        line = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        extra = entropy_spans(texts[r["doc_id"]], base)
        found += len(extra)
        assert r["spans"] == line(sorted(base + extra)), texts[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for *_, k, _ in base) for x in BASE)
    assert found > 50
    masked = secrets.mask_secrets(df)
    assert masked.columns == df.columns
    for r in masked.collect():
        text = texts[r["doc_id"]]
        for kind, pattern in [*BASE.items(), ("entropy", re.compile(secrets.CANDIDATE, re.ASCII))] if text else []:
            spans = entropy_spans(text, []) if kind == "entropy" else [x for x in base_spans(text) if x[2] == kind]
            for a, _, _, b in reversed(spans):
                text = text[:a] + secrets.MASK + text[b:]
        assert r["text"] == text
        assert (r["text"] is None) == (texts[r["doc_id"]] is None)
        if not base_spans(texts[r["doc_id"]]) and not entropy_spans(texts[r["doc_id"]], []):
            assert r["text"] == texts[r["doc_id"]] and r["n_chars"] is None


# --- substring dedup


def brute_repeats(docs, window):
    first = {}
    for i, t, *_ in docs:
        words = WORD.findall(t or "")
        for j in range(len(words) - window + 1):
            k = tuple(words[j : j + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in docs:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if i is not None and first[tuple(words[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        left = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [prose(900 + k, n) for k, n in enumerate((49, 50, 51, 57, 120, 300))]
    docs = odd_docs()
    for i in range(60):
        parts = [prose(rng.random(), rng.randrange(0, 70)) for _ in range(3)]
        for k in range(2):
            parts.insert(rng.randrange(4), rng.choice(shared))
        docs.append((20 + i, "  ".join(parts), None, None, None))
    docs += [(500, "a " * 400, None, None, None), (501, "a " * 300, None, None, None), (11, docs[-1][1], None, None, None)]
    got = rows(substrings.without_repeats(clash(spark.createDataFrame(docs, DOCS).repartition(7))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(docs, 50), key=key)


def test_substrings_of_nothing(none):
    assert substrings.without_repeats(none).collect() == []
    with pytest.raises(ValueError):
        substrings.without_repeats(none, stride=4)


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="col-{n}"><div class="post-body"><h1>Title&nbsp;&amp;   more</h1><p>First <b>bold<br><p>Second   para &#233; &lt;x&gt; with quite some words to read in it, and then a few more of them.
<p>Third one, which is long enough to count as prose as well, surely.<aside>aside</aside><form>Your name <input></form><ul><li>item one<li>item two</ul><div class="ad-slot">Buy</div></div>
<div id="comments"><p>{comment}</p></div></div><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    body = "Title & more\nFirst bold\nSecond para é <x> with quite some words to read in it, and then a few more of them.\nThird one, which is long enough to count as prose as well, surely.\nitem one\nitem two"
    pages = [(i, f"http://h{i % 2}.net/{i}", PAGE.format(n=i, comment="I disagree. " * 60)) for i in range(6)]
    pages += [(6, None, None), (7, "http://h0.net/", ""), (8, "", "plain text only"), (None, "http://h1.net/e", "<p>a<p>b &amp c"), (9, "http://h0.net/9", "<article><p>short but here</article>"), (10, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (11, "u", "<script>x"), (11, "u", "<script>x")]
    got = html.extracted(clash(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    text = [(r["page_id"], r["text"]) for r in got]
    assert sorted((t for t in text if t[0] is not None)) == sorted([*((i, body) for i in range(6)), (6, ""), (7, ""), (8, "plain text only"), (9, "short but here"), (10, "deep"), (11, ""), (11, "")])
    assert (None, "a\nb & c") in text and all(r["n_chars"] == len(r["text"]) for r in got)


def test_hosts_agree_on_a_path(spark):
    """A page whose sidebar outweighs its article follows the other pages of its host."""
    good = "<body><div class='main{n}'><p>" + "prose and more prose, " * 20 + "</p></div><div class='extra'><p>x</p></div></body>"
    bad = "<body><div class='main9'><p>short</p></div><div class='extra'><p>" + "long list of other things, " * 40 + "</p></div></body>"
    pages = [(i, f"http://a.net/{i}", good.format(n=i)) for i in range(4)] + [(9, "http://a.net/9", bad)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "short"


@pytest.mark.parametrize("page,want", [
    ("<article><h1>Title</h1><p>intro</p><section>{long}</section><p>end</p></article>", "Title\nintro\n{long}\nend"),
    ("<main><div><h1>Title</h1></div><div class=body><p>intro</p><div>{long}</div></div></main>", "Title\nintro\n{long}"),
    ("<div class=post><h2>Title</h2><div class=text>{long}</div></div><div class=x>x</div>", "Title\n{long}"),
    ("<div class=post><p>By me</p><div class=text>{long}</div></div>", "By me\n{long}"),
    ("<div class=post><div class=lead><p>A leading paragraph of a sentence.</p></div><div class=text>{long}</div></div>", "A leading paragraph of a sentence.\n{long}"),
    ("<div class=a><a href=/>Home of many pages and more</a></div><div class=text>{long}</div><p>Imprint</p>", "{long}"),
    ("<div class=a><p>Prose of a neighbour, outside of the article.</p></div><article>{long}</article>", "{long}"),
])
def test_text_beside_a_section_stays(spark, page, want):
    long = ("prose and more prose, " * 40).strip()
    pages = [(i, f"http://a.net/{i}", f"<html><body>{page.format(long=long)}</body></html>") for i in range(3)]
    got = html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == [want.format(long=long)] * 3


# --- language model


def test_scores_against_brute_force(spark, odd):
    got = lm.scored(clash(odd), common_words=20).collect()
    lattice = lm.Lattice(lm.vocabulary_path())
    count = Counter()
    for i, t, *_ in odd_docs():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([w.encode() for w in WORD.findall(low(t or ""))] + [lm.END])
    n, v = sum(count.values()), len(count)
    unseen = min(sum(c == 1 for c in count.values()) / n, 0.5)
    k = n * unseen / (1 - unseen)
    want = []
    for i, t, *_ in odd_docs():
        words = [w.encode() for w in WORD.findall(low(t or ""))] + [lm.END]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10((count[w] + k * max(lattice.entry(w)[1], lm.TINY)) / (n + k)) for w in words)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(count[w] > 0 for w in words), n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_scores_of_words_too_long_for_a_float(spark):
    """Uncovered characters, long words and texts without spaces, unseen and seen, with and without training rows."""
    texts = ["x" * 30000, "x" * 15000, "𓀀" * 20, "𓀀" * 40, "𓀀" * 2000, "agvsbg8gd29ybgq" * 100, "the " + "𓀀" * 60]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][: len(texts)]
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    train = ["the same " * 20, "𓀀" * 40]
    lattice = lm.Lattice(lm.vocabulary_path())
    for extra in ([], list(zip(learned, train))):
        for common in (1, 400_000):
            df = spark.createDataFrame([*zip(ids, texts), *extra], "doc_id long, text string")
            got = {r["doc_id"]: r["score"] for r in lm.scored(df, common_words=common).collect()}
            count = Counter(w.encode() for _, t in extra for w in [*t.split(), ""])
            n, once = sum(count.values()), max(1, sum(c == 1 for c in count.values()))
            unseen = min(once / n, 0.5) if n else 1.0
            k = n * unseen / (1 - unseen) if n else 1.0

            def log10(word):
                ln = lattice.marginal(word) + math.log1p(-lm.END_WEIGHT) if word else math.log(lm.END_WEIGHT)
                c = count[word.encode()]
                return (np.logaddexp(math.log(c), math.log(k) + ln) if c else math.log(k) + ln) / math.log(10) - math.log10(n + k)

            for i, t in zip(ids, texts):
                assert got[i] == pytest.approx(sum(log10(w) for w in [*t.split(), ""]))
            assert got[ids[0]] < got[ids[1]] < -5000 and got[ids[4]] < got[ids[2]] < -450


def test_lattice_adds_up_all_segmentations():
    lattice = lm.Lattice(lm.vocabulary_path())

    def every(text):
        if not text:
            return 1.0
        total = sum(math.exp(w) * every(text[len(p) :]) for p, w in ((text[:i], lattice.pieces.get(text[:i])) for i in range(1, len(text) + 1)) if w is not None)
        return total + (0 if text[0] in lattice.pieces else math.exp(lattice.byte * len(text[0].encode())) * every(text[1:]))

    for word in ("the", "token", "straße", "xqzj", "漢a", "😀"):
        assert math.exp(lattice.marginal(word)) == pytest.approx(every("▁" + word))
    assert sum(map(math.exp, lattice.pieces.values())) == pytest.approx(1 - lm.UNKNOWN_WEIGHT)


def test_scores_of_nothing(none, spark):
    assert lm.scored(none).collect() == []
    alone = lm.scored(spark.createDataFrame([(None, "a b", None, None, None)], DOCS)).first()
    assert alone["train_tokens"] == 0 and alone["score"] < 0


# --- neighbours


def test_neighbours_recall_and_exactness(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[:600] = x[:30].repeat(20, axis=0) + 0.1 * rng.normal(size=(600, 24))
    x *= rng.uniform(0.5, 2, (1500, 1))
    x[900:960] = x[900]
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    data += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (None, data[0][1]), (0, data[0][1]), (2080, [1.0, 2.0]), (2100, [])]
    got = clash(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = neighbours.nearest(got).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    exact = np.array([v for _, v in data[:1500]])
    hits = 0
    for q, part in got.groupby("query_id"):
        score = exact @ exact[q]
        order = [j for j in np.lexsort((np.arange(1500), -score)) if j != q][:20]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and np.allclose(part.score, score[part.vec_id])
        assert (np.diff(part.score) <= 0).all()
        hits += len(set(order) & set(part.vec_id))
    assert hits / (75 * 20) >= 0.9


def test_few_and_equal_vectors(spark):
    data = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.0, -1.0])]
    got = neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    of = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 100)}
    assert of == {0: list(range(1, 21)), 20: list(range(20)), 40: list(range(20)), 100: list(range(20))}
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, -1.0)]


# --- BPE


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(1, 0x250), 0x3A3, 0x3C2, 0x2028, 0x4E00, 0x1F600, 0xAC00, 0x301, 0x660, 0x200D)] + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", " ", " ", "the", "token"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(800)] + [t for _, t, *_ in odd_docs()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encoded(clash(df), full=True).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["decoded"] == decoded and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert bpe.decode(ids, path) == decoded
    assert bpe.encoded(none).collect() == [] and bpe.encoded(odd).count() == len(odd_docs())


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(i, 120, 5000), "en", "s", 1) for i in range(20)]
    leak = prose(50, 30, 5000)
    docs = clean + [(100, clean[0][1], "en", "s", 1), (101, "12 34 !!", "en", "s", 1), (102, None, None, None, None), (103, prose(61, 60, 5000) + " " + leak, "en", "s", 1), (104, prose(62, 90, 5000) + " token = 24be64439e3e49cf46b2d7c90f3602a3", "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, str(tmp_path))
        assert after.columns == df.columns
        after.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    assert set(text) == {*range(20), 104}
    assert text[104].endswith("[SECRET]") and all(text[i] == t for i, t, *_ in clean)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(text)


def test_stages_judge_rows_without_an_id(spark, tmp_path):
    """Copies and leaks among rows without an id go as others do; the stages name them by their text."""
    import corpus_pipeline

    text = [prose(7000 + k, 120, 5000) for k in range(4)]
    near = text[1].rsplit(" ", 2)[0]
    docs = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[1]), (None, near), (None, text[2]), (None, prose(50, 30, 5000)), (2, prose(50, 30, 5000)), (3, text[3])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.without_benchmark(spark, df, str(tmp_path))
    assert clean.columns == df.columns and sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in docs if t not in (docs[6][1],))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.distinct_texts(spark, df, str(tmp_path)).collect()]
    one = [k for k in kept if k[1] in (text[1], near)]
    assert len(one) == 1 and sorted(k for k in kept if k not in one and k[0]) == sorted(k for k in docs if k[0]) and [k for k in kept if k not in one and not k[0]] == [(None, text[2])]
