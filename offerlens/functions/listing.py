"""Listing names and addresses: pack, volume, vintage, package and label parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.numbers import first_group, let, strip, text, when_value
from offerlens.functions.text import canonical_key, normalize_key, squeeze, tokens

# --- fixed values -----------------------------------------------------------------
QUANTITY_PATTERNS = (
    r"bundle[-_\s]?of[-_\s]?(\d+)",
    r"case[-_\s]?of[-_\s]?(\d+)",
    r"\b(\d+)[-_]?(?:bottles?|btls?)\b",
    r"\b(\d+)[-_]?x\b",
    r"\bx[-_\s]?(\d+)\b",
)
GIFT_MARKERS = (
    "gift-box", "gift box", "wooden-box", "wooden box", "2-glasses", "2 glasses",
    "w-gift-box", "w/ gift box", "with gift box",
)
GIFT_IMPORT_TOKENS = ("gift-box", "gift box", "gift-set", "gift set", "2-glasses", "2 glasses")
LISTING_COLOURS = ("red", "white", "rose", "rosé")
IDENTITY_COLOURS = ("red", "white", "rose", "sparkling", "orange")
IN_STOCK_WORDS = ("true", "1", "yes", "y", "in_stock", "in stock", "available")
YEAR_PREFIX = r"(?i)^(?:19|20)\d{2}\s+|^nv\s+"
VALIDATION_GENERIC = (
    "les", "le", "la", "de", "du", "des", "en", "aux", "et", "clos", "cru", "premier", "grand", "1er", "domaine",
    "dom", "chateau", "château", "maison", "tenuta", "cave",
)
# -------------------------------------------------------------------------------------


def in_stock(c: Column) -> Column:
    """Blank counts as in stock."""
    word = F.lower(text(c))
    return (word == "") | word.isin(*IN_STOCK_WORDS)


def extract_quantity(c: Column) -> Column:
    """First pack-size phrase in pattern order, NULL if none."""
    lower = F.lower(c)
    return F.coalesce(*[first_group(lower, p).try_cast("int") for p in QUANTITY_PATTERNS])


def pack_quantity(url: Column, name: Column, in_name: Column | None = None) -> Column:
    """Quantity of the address unless it says nothing or one, then of the name, else 1."""
    in_name = extract_quantity(name) if in_name is None else in_name
    return F.coalesce(when_value(extract_quantity(url), lambda q: q > 1), when_value(in_name, lambda q: q != 0), F.lit(1))


def url_tail(url: Column) -> Column:
    lower = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(F.contains(lower, F.lit("/products/")), F.regexp_extract(lower, r"(?s)^.*?/products/(.*)$", 1))
        .when(F.contains(lower, F.lit("/wines/")), F.regexp_extract(lower, r"(?s)^.*?/wines/(.*)$", 1))
        .otherwise(F.substring_index(lower, "/", -1))
    )


def named_volume(name: Column) -> Column:
    """Size text of a name, NULL if it says none."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(
        F.concat(first_group(lower, r"(\d+(?:\.\d+)?)\s*l\b"), F.lit("l")),
        F.concat(first_group(lower, r"(\d+)\s*ml\b"), F.lit("ml")),
    )


def pack_volume(url: Column, name: Column, tail: Column | None = None, in_name: Column | None = None) -> Column:
    """Size text from the address tail, then from the name; 750ml if neither says."""
    tail = url_tail(url) if tail is None else tail
    litres = first_group(tail, r"(\d+-\d+)-l")
    return F.coalesce(
        F.concat(F.replace(litres, F.lit("-"), F.lit(".")), F.lit("l")),
        F.concat(first_group(tail, r"(\d+)[-_]?ml"), F.lit("ml")),
        named_volume(name) if in_name is None else in_name,
        F.when(F.contains(tail, F.lit("magnum")), F.lit("1.5l")),
        F.lit("750ml"),
    )


def _vintage_text(c: Column) -> Column:
    return first_group(c, r"\b(19\d{2}|20[0-3]\d)\b")


def vintage(url: Column, name: Column, in_name: Column | None = None) -> Column:
    return F.coalesce(_vintage_text(F.lower(url)), _vintage_text(name) if in_name is None else in_name).cast("int")


def package_type(c: Column) -> Column:
    return F.when(F.lower(c).rlike("|".join(GIFT_MARKERS)), "gift_set").otherwise("standard")


def is_gift_listing(name: Column, url: Column) -> Column:
    """Gift flag used at publication: six tokens in the name or the rival address."""
    hit = F.lit(False)
    for marker in GIFT_IMPORT_TOKENS:
        hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(marker))
        hit = hit | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit(marker))
    return hit


def normalize_name(c: Column) -> Column:
    """Lower-case name without colour words, size words, bracketed text and punctuation."""
    out = F.lower(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(out, r"(?U)\b(red|white|rose|rosé)\b", "")
    out = F.regexp_replace(out, r"(?U)\b(\d+(\.\d+)?\s*l|magnum|standard bottle|half bottle|case|bottles|ml)\b", "")
    out = F.regexp_replace(out, r"\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", "")
    return squeeze(out)


def listing_parts(c: Column) -> Column:
    """Non-blank pieces of a " - " separated listing."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), " - "), strip), lambda p: p != "")


def _first_index(parts: Column, predicate) -> Column:
    """One-based position of the first part that satisfies ``predicate``; 0 if none."""
    return F.array_position(F.transform(parts, predicate), True)


def _body(parts: Column, colour_at: Column) -> Column:
    """Parts before the colour; the first one loses its vintage prefix."""
    body = F.when(colour_at > 0, F.slice(parts, F.lit(1), F.greatest(colour_at - 1, F.lit(0)).cast("int"))).otherwise(parts)
    return F.transform(body, lambda p, i: F.when(i == 0, strip(F.regexp_replace(p, YEAR_PREFIX, ""))).otherwise(p))


def label_position(parts: Column) -> Column:
    return _first_index(parts, lambda p: F.lower(p).isin(*LISTING_COLOURS))


def label_text(c: Column, body: Column) -> Column:
    """Last part before the colour, or the whole listing where there is only one part."""
    return F.when(F.size(body) >= 2, F.try_element_at(body, F.lit(-1))).otherwise(c)


def label_name(c: Column) -> Column:
    """Normalised last part before the colour; a one-part listing gives its whole name."""
    parts = listing_parts(c)
    return normalize_name(label_text(c, _body(parts, label_position(parts))))


def prepare_listings(df, name="name", price="price", url="url", stock="in_stock", only_in_stock=True):
    """Typed listing columns for one catalogue; other columns pass through.

    What follows from the name alone is made once per distinct name and joined back.
    """
    if only_in_stock and stock in df.columns:
        df = df.filter(in_stock(F.col(stock)))
    n, u = text(F.col(name)), text(F.col(url))
    out = df.withColumns({name: n, url: u, price: text(F.col(price).cast("string"))})
    n, u = F.col(name), F.col(url)
    # Shared pieces first: each is computed once and later columns only refer to it.
    names = out.select(name).distinct().withColumn("_parts", listing_parts(n)).withColumn("_at", label_position(F.col("_parts")))
    names = names.withColumn("_label", label_text(n, _body(F.col("_parts"), F.col("_at")))).select(
        name,
        extract_quantity(n).alias("_quantity"),
        named_volume(n).alias("_volume"),
        _vintage_text(n).alias("_year"),
        normalize_name(n).alias("_name_clean"),
        normalize_name(F.col("_label")).alias("_label_clean"),
    )
    return (
        out.withColumn("_tail", url_tail(u))
        .join(names, name, "left")
        .withColumns(
            {
                "quantity": pack_quantity(u, n, F.col("_quantity")),
                "volume": pack_volume(u, n, F.col("_tail"), F.col("_volume")),
                "year": vintage(u, n, F.col("_year")),
                "package_type": package_type(F.concat_ws(" ", n, u)),
                "name_clean": F.col("_name_clean"),
                "label_clean": F.col("_label_clean"),
            }
        )
        .drop("_tail", "_quantity", "_volume", "_year", "_name_clean", "_label_clean")
    )


# ---- work-item identities and search text ------------------------------------------


def strip_vintage(c: Column) -> Column:
    """Drop a leading year, then a leading NV."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?i)^(?:19|20)\d{2}\s+", ""), r"(?i)^nv\s+", ""))


def parse_identity(name: Column, year_text: Column) -> dict[str, Column]:
    """Producer, label, colour, year and the two token sets of a work item."""
    from offerlens.functions.text import extract_year

    parts = listing_parts(name)
    primary = F.coalesce(F.try_element_at(parts, F.lit(1)), strip(name))
    year = F.coalesce(extract_year(year_text), extract_year(name))
    stripped = strip_vintage(primary)
    producer = F.when(stripped != "", stripped).otherwise(strip(primary))
    label = F.coalesce(F.try_element_at(parts, F.lit(2)), producer)
    colour_key = normalize_key(F.try_element_at(parts, F.lit(3)))
    colour = F.when(colour_key.isin(*IDENTITY_COLOURS), colour_key).otherwise("")
    target = F.concat_ws(" ", year.cast("string"), F.nullif(producer, F.lit("")), F.nullif(label, F.lit("")))
    return {
        "year": year,
        "producer": producer,
        "label": label,
        "color": colour,
        "target_tokens": tokens(canonical_key(target)),
        "producer_tokens": F.filter(tokens(canonical_key(producer)), lambda t: F.length(t) >= 3),
    }


def product_slug(url: Column) -> Column:
    """Last path piece with dashes as blanks; blank if the address has no path."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    return strip(F.replace(F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1), F.lit("-"), F.lit(" ")))


def build_queries(year, producer, label, colour, rival_url, anchor_url, site: str) -> Column:
    """Up to three distinct search texts, first-seen order."""
    none_if_blank = lambda c: F.nullif(c, F.lit(""))
    slug = F.coalesce(none_if_blank(product_slug(rival_url)), none_if_blank(product_slug(anchor_url)))
    terms = F.array(
        F.concat_ws(" ", year.cast("string"), none_if_blank(producer), none_if_blank(label), F.lit(site)),
        F.concat_ws(" ", none_if_blank(producer), none_if_blank(label), none_if_blank(colour), F.lit(site)),
        F.concat(slug, F.lit(" "), F.lit(site)),
    )
    return F.slice(F.array_distinct(F.filter(F.transform(F.array_compact(terms), squeeze), lambda q: q != "")), 1, 3)


def clean_query(name: Column) -> Column:
    """Listing text without bundle, colour, bottle and size words."""
    out = name
    for pattern in (
        r"(?i)\(bundle of\s+\d+\)",
        r"(?i)\b(red|white|rose)\b",
        r"(?i)\bstandard bottle\b",
        r"(?i)\b\d+(?:\.\d+)?\s*(?:ml|l)\b",
        r" - ",
    ):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def market_search_name(name: Column) -> Column:
    """Producer and label with the vintage moved to the end."""
    out = F.regexp_replace(name, r"\s*-\s*(Red|White|Rose|Rosé|Sparkling)\s*-.*$", "")
    out = strip(F.replace(F.regexp_replace(out, r"\(.*?\)", ""), F.lit(" - "), F.lit(" ")))
    lead = first_group(out, r"^(NV|\d{4})\s+.+")
    rest = F.regexp_extract(out, r"^(?:NV|\d{4})\s+(.+)", 1)
    return strip(F.when(lead.isNotNull(), F.concat_ws(" ", strip(rest), lead)).otherwise(out))


def simplified_name(name: Column) -> Column:
    """Name without the colour tail, vintage and NV."""
    out = F.regexp_replace(name, r"\s*-\s*(Red|White|Rose|Sparkling)\s*-.*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"^\d{4}\s+", ""), r"^NV\s+", "")


def validation_struct(name: Column) -> Column:
    """Raw producer and label of a listing plus its classification flags, with the parts bound once."""
    parts = F.transform(F.split(name, " - "), strip)
    split = lambda p: F.struct(p.alias("parts"), _first_index(p, lambda x: F.lower(x).isin(*LISTING_COLOURS)).alias("at"))

    def raw(s: Column) -> Column:
        parts, colour_at = s["parts"], s["at"]
        second = F.try_element_at(parts, F.lit(2))
        long_form = colour_at >= 3
        producer = F.when(long_form, F.array_join(F.slice(parts, F.lit(1), F.greatest(colour_at - 2, F.lit(0)).cast("int")), " ")).otherwise(
            F.try_element_at(parts, F.lit(1))
        )
        label = F.when(long_form, F.try_element_at(parts, (colour_at - 1).cast("int"))).when(
            (F.size(parts) >= 2) & ~F.lower(second).isin(*LISTING_COLOURS), second
        )
        return F.struct(producer.alias("producer"), label.alias("label"), F.size(parts).alias("n_parts"), F.lower(name).alias("lower"))

    def named(r: Column) -> Column:
        lower = r["lower"]
        fields = {
            "producer_raw": r["producer"],
            "label_raw": r["label"],
            "n_parts": r["n_parts"],
            "producer": strip(F.lower(F.regexp_replace(r["producer"], r"^(NV|\d{4})\s+", ""))),
            "label": strip(F.lower(r["label"])),
            "has_premier_cru": F.contains(lower, F.lit("premier cru")) | F.contains(lower, F.lit("1er cru")),
            "has_grand_cru": F.contains(lower, F.lit("grand cru")),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return let(let(let(parts, split), raw), named)


VALIDATION_FIELDS = ("producer_raw", "label_raw", "n_parts", "producer", "label", "has_premier_cru", "has_grand_cru")


def validation_parts(name: Column) -> dict[str, Column]:
    """The fields of ``validation_struct`` by name."""
    info = validation_struct(name)
    return {k: info[k] for k in VALIDATION_FIELDS}


def retry_query(name: Column, site: str) -> Column:
    """Tighter search text with excluded classifications; NULL for a one-part name."""
    return let(validation_struct(name), lambda info: _retry_query(info, site))


def _retry_query(info: Column, site: str) -> Column:
    vintage_text = first_group(info["producer_raw"], r"^(NV|\d{4})\s+.+")
    producer = strip(F.regexp_replace(info["producer_raw"], r"^(NV|\d{4})\s+(?=.)", ""))
    core = F.concat_ws(
        " ", producer, strip(F.coalesce(info["label_raw"], F.lit(""))), F.nullif(vintage_text, F.lit("NV"))
    )
    query = F.concat_ws(
        " ",
        F.concat(F.lit(f"site:{site} "), core, F.lit(" average price")),
        F.when(~info["has_premier_cru"], F.lit('-"premier cru"')),
        F.when(~info["has_grand_cru"], F.lit('-"grand cru"')),
    )
    return F.when(info["n_parts"] >= 2, query)


def key_terms(c: Column) -> Column:
    """Words of more than two letters that are not generic."""
    return F.filter(
        F.split(F.lower(c), r"[\s\-]+"), lambda t: ~t.isin(*VALIDATION_GENERIC) & (F.length(t) > 2)
    )
