"""Text, URL and HTML column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabspark import params as P


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_group(text: Column, patterns: Sequence[str]) -> Column:
    """First capture group of the first pattern that matches at all."""
    ladder = None
    for pattern in patterns:
        hit, value = text.rlike(pattern), F.regexp_extract(text, pattern, 1)
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    return ladder


def collapse(c: Column) -> Column:
    """Whitespace runs (Unicode ones too) to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Leading and trailing whitespace of any kind removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def group_key(c: Column) -> Column:
    """Grouping key part: lower case, collapsed whitespace, punctuation kept."""
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def comparison_text(c: Column) -> Column:
    """Lower case letters, digits and single blanks only."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]", "")
    return collapse(kept)


def edit_distance_share(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.levenshtein(a, b) / longest


def parse_grade(*fields: Column) -> Column:
    """First numeric grade token over the fields in order."""
    tokens = [blank_to_null(F.regexp_extract(f, P.GRADE_REGEX, 1)) for f in fields]
    return F.coalesce(*tokens).cast("double")


def parse_year(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, P.YEAR_REGEX, 1)).cast("int")


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)"


def url_part(url: Column, part: str) -> Column:
    """SCHEME, NETLOC or PATH of a URL (lenient: blanks and odd characters are fine)."""
    index = {"SCHEME": 1, "NETLOC": 2, "PATH": 3}[part]
    return F.when(url.rlike(_URL), F.regexp_extract(url, _URL, index))


def is_https_url(url: Column) -> Column:
    return F.coalesce((F.lower(url_part(url, "SCHEME")) == "https") & (url_part(url, "NETLOC") != ""), F.lit(False))


def is_image_url(url: Column) -> Column:
    """http(s) scheme and an image extension on the path (its ;parameters aside)."""
    extensions = "|".join(e.replace(".", r"\.") for e in P.IMAGE_EXTENSIONS)
    path = F.regexp_replace(F.lower(url_part(url, "PATH")), r";[^/]*$", "")
    return F.coalesce(
        F.lower(url_part(url, "SCHEME")).isin("http", "https") & path.rlike(f"(?:{extensions})$"), F.lit(False))


def strip_tags(c: Column) -> Column:
    """Drop tags, decode the common entities, collapse whitespace."""
    out = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in P.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def start_tags(html: Column, name: str = "[a-z][a-z0-9]*", with_text: bool = False) -> Column:
    """All start tags of a kind in page order, with the text right behind each if wanted."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^<>]*>" + r"[^<]*" * with_text), F.lit(0))


def elements(html: Column, name: str) -> Column:
    """All elements of a kind up to their end tags, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the first tag in ``tag``, in quotes of either kind; empty if it isn't there."""
    head = F.regexp_extract(tag, r"^<[^>]*>", 0)
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(head, pattern, 1), F.regexp_extract(head, pattern, 2))


def first_where(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def page_title(html: Column) -> Column:
    """Text of the first heading of a title class, else of the first heading."""
    heads = elements(html, "h1")
    named = first_where(heads, lambda e: attribute(e, "class").rlike("(?i)" + "|".join(P.TITLE_CLASSES)))
    return strip_tags(F.coalesce(named, F.get(heads, F.lit(0))))


def page_grade(html: Column) -> Column:
    """Number right behind a tag whose class speaks of a grade, else of a data-grade attribute; null if none."""
    shown = F.transform(
        F.filter(start_tags(html, with_text=True), lambda t: attribute(t, "class").rlike("(?i)grade")),
        lambda t: F.regexp_extract(F.regexp_replace(t, r"^<[^>]*>", ""), P.GRADE_TEXT, 1))
    stored = F.transform(start_tags(html), lambda t: F.regexp_extract(attribute(t, "data-grade"), r"^(\d{1,2}(?:\.5)?)$", 1))
    return F.coalesce(first_where(shown, lambda g: g != ""), first_where(stored, lambda g: g != ""))


def page_image(html: Column, side: str) -> Column:
    """Source of the first image one of whose class words is ``side``; null if none."""
    own = F.filter(start_tags(html, "img"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "class")), r"[^a-z0-9_]+"), side))
    return first_where(F.transform(own, lambda t: attribute(t, "src")), lambda s: s != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: inside a lambda an outer expression would run anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def definition_map(html: Column) -> Column:
    """Terms of definition lists with the descriptions that follow them; blank parts dropped, first term wins."""
    def pairs(found: Column) -> Column:
        return F.transform(found, lambda e, i: F.struct(
            F.when(e.rlike("(?i)^<dt"), F.lower(F.regexp_replace(strip_tags(e), ":+$", ""))).otherwise(F.lit("")).alias("label"),
            F.when(F.get(found, i + 1).rlike("(?i)^<dd"), strip_tags(F.get(found, i + 1))).otherwise(F.lit("")).alias("value"),
        ))

    # end tags may be missing
    return first_wins_map(let(F.regexp_extract_all(html, F.lit(r"(?is)<d[td]\b[^>]*>.*?(?=</?d[tdl]\b|$)"), F.lit(0)), pairs))


def pair_map(html: Column, pattern: str) -> Column:
    """Label (group 1) and value (group 2) of every match; blank parts dropped, first label wins."""
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(
        F.lower(F.regexp_replace(strip_tags(F.regexp_extract(m, pattern, 1)), ":+$", "")).alias("label"),
        strip_tags(F.regexp_extract(m, pattern, 2)).alias("value"),
    ))
    return first_wins_map(pairs)


def first_wins_map(pairs: Column) -> Column:
    """Array of (label, value) structs -> map that keeps the first of a label.

    Sorted by label and place, a first one differs from the pair before it; so
    the work grows with the pairs, not with their square.
    """
    usable = F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))
    by_label = F.array_sort(F.transform(usable, lambda p, i: F.struct(p["label"].alias("label"), i.alias("at"), p["value"].alias("value"))))
    firsts = let(by_label, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["label"] != e["label"])))
    in_order = F.array_sort(F.transform(firsts, lambda e: F.struct(e["at"].alias("at"), e["label"].alias("label"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(in_order, lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value"))))


def map_first(m: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(F.element_at(m, label)) for label in labels])


def absolute_url(src: Column, base: Column) -> Column:
    """Resolve ``src`` against ``base``; blank and data: sources give null."""
    link = strip(src)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(no_query, r"^([^/]+//[^/]+)$", "$1/"), r"[^/]*$", "")
    return (
        F.when(link.isNull() | (link == "") | link.startswith("data:"), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, _drop_dots(link)))
        .when(link.startswith("?"), F.concat(no_query, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(F.concat(origin, _drop_dots(F.concat(F.substr(folder, F.length(origin) + 1), link))))
    )


def _drop_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of an absolute path."""
    bare = F.regexp_extract(path, r"^([^?#]*)", 1)
    rest = F.substr(path, F.length(bare) + 1)
    parts = F.split(F.substr(bare, F.lit(2)), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(bare.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), tail, rest)).otherwise(path)


def extension(content_type: Column) -> Column:
    """File extension of a content type; parameters ignored, unknown -> bin."""
    primary = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    pairs = [F.lit(v) for item in P.CONTENT_TYPE_TO_EXT.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), primary), F.lit("bin"))


def cert_image_key(cert_id: Column, kind: Column, content_type: Column) -> Column:
    return F.concat(F.lit("images/"), cert_id.cast("string"), F.lit("/"), kind, F.lit("."), extension(content_type))


def reference_image_key(manufacturer: Column, variant_id: Column, kind: Column, content_type: Column) -> Column:
    return F.concat(F.lit("images/"), manufacturer, F.lit("/"), variant_id, F.lit("/"), kind,
                    F.lit("."), extension(content_type))


def compose_key(manufacturer: Column, variant_id: Column) -> Column:
    return F.concat(manufacturer, F.lit("/"), variant_id)


def parse_key(key: Column) -> Column:
    """Split at the first slash; either part empty -> null."""
    pattern = r"(?s)^([^/]+)/(.+)$"
    return F.when(key.rlike(pattern), F.struct(
        F.regexp_extract(key, pattern, 1).alias("manufacturer"),
        F.regexp_extract(key, pattern, 2).alias("variant_id")))
