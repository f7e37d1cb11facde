"""Attributes derived from a listing name by ordered containment rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.listing import YEAR_PREFIX, _first_index, listing_parts
from offerlens.functions.numbers import let, strip
from offerlens.functions.text import contains_any, normalize_text


class Rule(NamedTuple):
    """First rule with any pattern inside the text wins."""

    patterns: tuple[str, ...]
    values: tuple


# --- fixed values: origin rules (country, region, latitude, longitude) in priority order ---
ORIGIN_RULES = (
    Rule(("fleur de miraval",), ("France", "Champagne", 49.05, 4.03)),
    Rule(("cotes du jura", "domaine pignier"), ("France", "Jura", 46.78, 5.67)),
    Rule(
        ("champagne", "cote des bar", "la rogerie", "jerome blin", "charles heidsieck", "coutier",
         "william saintot", "louise brison", "adrien renoir", "dhondt", "domaine mumm"),
        ("France", "Champagne", 49.05, 4.03),
    ),
    Rule(("cotes de provence", "miraval"), ("France", "Provence", 43.83, 6.24)),
    Rule(
        ("chateauneuf du pape", "gigondas", "cotes du rhone", "famille perrin", "beaucastel", "perrin et fils"),
        ("France", "Rhone Valley", 44.14, 4.81),
    ),
    Rule(
        ("corton charlemagne", "puligny montrachet", "bonnes mares", "gevrey chambertin", "charmes chambertin",
         "meursault", "auxey duresses", "chassagne montrachet", "chambolle musigny",
         "bourgogne hautes cotes de nuits", "saint romain", "volnay", "domaine xavier monnot",
         "henri et gilles buisson", "pierre boisson", "domaine claude dugat", "hudelot baillet",
         "la croix de brully"),
        ("France", "Burgundy", 47.05, 4.84),
    ),
    Rule(("brauneberger", "markus molitor"), ("Germany", "Mosel", 49.92, 6.95)),
    Rule(("quattro passi", "primitivo", "salento"), ("Italy", "Puglia", 40.79, 17.10)),
    Rule(("brunello di montalcino", "ammiraglia", "frescobaldi"), ("Italy", "Tuscany", 43.33, 11.33)),
    Rule(("guidalberto", "le difese", "tenuta san guido"), ("Italy", "Bolgheri", 43.23, 10.54)),
    Rule(
        ("gattinara", "langhe", "barbera d alba", "dolcetto d alba", "moscato d asti", "freisa", "roagna",
         "vajra", "nervi", "negretti"),
        ("Italy", "Piedmont", 44.70, 8.04),
    ),
    Rule(("sicilia doc", "nero d avola", "baglio le mole"), ("Italy", "Sicily", 37.60, 14.02)),
    Rule(("montepulciano", "collefrisio", "vignaquadra"), ("Italy", "Abruzzo", 42.35, 13.40)),
    Rule(("prosecco", "raboso", "botter"), ("Italy", "Veneto", 45.44, 11.00)),
    Rule(("terlaner", "terlano"), ("Italy", "Alto Adige", 46.53, 11.25)),
    Rule(("sonoma mountain", "paul hobbs"), ("United States", "Sonoma County", 38.44, -122.71)),
    Rule(("blue rock", "baby blue", "alexander valley"), ("United States", "Sonoma County", 38.65, -122.85)),
    Rule(("rhys", "bearwallow", "mt pajaro"), ("United States", "California Central Coast", 36.87, -121.56)),
    Rule(
        ("the hilt", "santa rita hills", "bentrock", "radian vineyard"),
        ("United States", "Santa Barbara County", 34.61, -120.08),
    ),
    Rule(("jonata", "the paring"), ("United States", "Santa Ynez Valley", 34.61, -120.08)),
    Rule(("daou", "perrin dobbs", "ace of spades"), ("United States", "Paso Robles", 35.63, -120.69)),
    Rule(("00 wines", "freya hermann"), ("United States", "Willamette Valley", 45.22, -123.10)),
    Rule(("tahbilk", "nagambie lakes"), ("Australia", "Victoria", -36.79, 145.15)),
    Rule(("marlborough", "black cottage", "two rivers"), ("New Zealand", "Marlborough", -41.51, 173.96)),
    Rule(("caballo loco grand cru limari", "limari"), ("Chile", "Limari Valley", -30.62, -71.20)),
    Rule(("caballo loco grand cru apalta", "apalta"), ("Chile", "Colchagua Valley", -34.61, -71.32)),
    Rule(("caballo loco grand cru sagrada familia", "sagrada familia"), ("Chile", "Lontue Valley", -35.08, -71.28)),
    Rule(("vina valdivieso", "caballo loco"), ("Chile", "Central Valley", -34.60, -70.99)),
    Rule(("castell de sant pau", "cava"), ("Spain", "Catalonia", 41.39, 2.16)),
    Rule(("finca munoz", "felix solis"), ("Spain", "Castilla-La Mancha", 39.28, -2.98)),
)

_LISTING, _REGION, _STYLE, _CUVEE = "listing_keyword", "regional_inference", "style_inference", "winery_cuvee_inference"

# --- fixed values: grape rules (grapes, source, confidence) in priority order ---
GRAPE_RULES = (
    Rule(("grenache shiraz mourvedre",), ("Grenache, Shiraz, Mourvedre", _LISTING, "high")),
    Rule(("cabernet sauvignon",), ("Cabernet Sauvignon", _LISTING, "high")),
    Rule(("sauvignon blanc",), ("Sauvignon Blanc", _LISTING, "high")),
    Rule(("pinot noir",), ("Pinot Noir", _LISTING, "high")),
    Rule(
        ("gevrey chambertin", "chambolle musigny", "bonnes mares", "charmes chambertin", "volnay"),
        ("Pinot Noir", _REGION, "medium"),
    ),
    Rule(("blanc de noirs",), ("Pinot Noir, Pinot Meunier", _STYLE, "medium")),
    Rule(("blanc de blancs",), ("Chardonnay", _STYLE, "medium")),
    Rule(("chardonnay",), ("Chardonnay", _LISTING, "high")),
    Rule(
        ("corton charlemagne", "puligny montrachet", "meursault", "chassagne montrachet", "auxey duresses",
         "saint romain", "bourgogne hautes cotes de nuits blanc"),
        ("Chardonnay", _REGION, "medium"),
    ),
    Rule(("pinot grigio",), ("Pinot Grigio", _LISTING, "high")),
    Rule(("viognier",), ("Viognier", _LISTING, "high")),
    Rule(("shiraz",), ("Shiraz", _LISTING, "high")),
    Rule(("kingpin tinto",), ("Tempranillo, Shiraz, Cabernet Sauvignon", "vivino", "medium")),
    Rule(("montepulciano",), ("Montepulciano", _LISTING, "high")),
    Rule(("primitivo", "quattro passi"), ("Primitivo", _LISTING, "high")),
    Rule(("freisa",), ("Freisa", _LISTING, "high")),
    Rule(("nero d avola",), ("Nero d'Avola", _LISTING, "high")),
    Rule(("barbera",), ("Barbera", _LISTING, "high")),
    Rule(("dolcetto",), ("Dolcetto", _LISTING, "high")),
    Rule(("moscato d asti",), ("Moscato Bianco", _REGION, "medium")),
    Rule(("prosecco",), ("Glera", _REGION, "medium")),
    Rule(("raboso",), ("Raboso", _LISTING, "high")),
    Rule(("brunello di montalcino",), ("Sangiovese", _REGION, "medium")),
    Rule(("barolo",), ("Nebbiolo", _REGION, "high")),
    Rule(("gattinara",), ("Nebbiolo", _REGION, "medium")),
    Rule(("solea",), ("Nascetta", _CUVEE, "high")),
    Rule(("derthona",), ("Timorasso", _CUVEE, "high")),
    Rule(("giramonte",), ("Sangiovese, Merlot", _CUVEE, "high")),
    Rule(("gorgona",), ("Vermentino, Ansonica", _CUVEE, "medium")),
    Rule(("tenuta perano", "perano rialzi"), ("Sangiovese", _CUVEE, "high")),
    Rule(("baby blue",), ("Cabernet Sauvignon", _CUVEE, "medium")),
    Rule(("guidalberto",), ("Cabernet Sauvignon, Merlot", _CUVEE, "medium")),
    Rule(("le difese",), ("Cabernet Sauvignon, Sangiovese", _CUVEE, "medium")),
    Rule(("terlaner classico",), ("Pinot Bianco, Chardonnay, Sauvignon Blanc", _REGION, "medium")),
    Rule(("caballo loco grand cru limari", "grand cru limari"), ("Syrah", "vivino", "high")),
    Rule(
        ("caballo loco grand cru apalta", "grand cru apalta"),
        ("Carmenere, Cabernet Sauvignon, Syrah", "retailer_inference", "medium"),
    ),
    Rule(
        ("caballo loco grand cru sagrada familia", "sagrada familia"),
        ("Merlot, Petit Verdot, Cabernet Sauvignon, Cabernet Franc, Malbec", "vivino", "high"),
    ),
    Rule(("chateauneuf du pape", "gigondas"), ("Grenache Blend", _REGION, "medium")),
    Rule(("cotes du rhone",), ("Rhone White Blend", _REGION, "medium")),
    Rule(("cotes de provence", "fleur de miraval", "rose alie"), ("Rose Blend", _STYLE, "medium")),
    Rule(
        ("todos", "fenix", "langhe rosso", "red wine", "coleccion de la familia"),
        ("Red Blend", _STYLE, "medium"),
    ),
)

# --- fixed values: markers ---
SPARKLING_MARKERS = (
    "champagne", "prosecco", "blanc de blancs", "blanc de noirs", "brut", "zero dosage",
    "cote des bar", "moscato d asti", "fleur de miraval",
)
SWEET_MARKERS = (
    "dessert", "sweet", "late harvest", "ice wine", "vin santo", "sauternes", "tokaji",
    "beerenauslese", "trockenbeerenauslese", "moscato d asti",
)
METADATA_COLOURS = {"red": "Red", "white": "White", "rose": "Rose", "orange": "Orange"}
CONTINENTS = {
    "Austria": "Europe", "France": "Europe", "Germany": "Europe", "Italy": "Europe", "Portugal": "Europe",
    "Spain": "Europe", "Switzerland": "Europe", "Australia": "Oceania", "New Zealand": "Oceania",
    "United States": "North America", "Canada": "North America", "Argentina": "South America",
    "Chile": "South America", "Brazil": "South America", "Uruguay": "South America",
    "South Africa": "Africa", "Lebanon": "Asia", "Israel": "Asia", "Japan": "Asia", "China": "Asia",
    "Georgia": "Asia", "Turkey": "Asia",
}
# -------------------------------------------------------------------------------------


def apply_rules(c: Column, rules, names: tuple[str, ...]) -> Column:
    """Struct of the first matching rule's values, NULL if none matches.

    The rule list is short and fixed, so it becomes one CASE expression: no join, no shuffle.
    """
    chain = None
    for rule in rules:
        value = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule.values)])
        hit = contains_any(c, rule.patterns)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def detect_origin(c: Column) -> Column:
    return apply_rules(c, ORIGIN_RULES, ("country", "region", "latitude", "longitude"))


def detect_grapes(c: Column) -> Column:
    return apply_rules(c, GRAPE_RULES, ("grapes", "source", "confidence"))


def split_struct(name: Column) -> Column:
    """Producer, label, colour, volume label and packaging of a listing name; parts and body are bound once."""
    split = lambda p: F.struct(p.alias("parts"), _first_index(p, lambda x: normalize_text(x).isin(*METADATA_COLOURS)).alias("at"))

    def with_body(s: Column) -> Column:
        parts, colour_at = s["parts"], s["at"]
        body = F.when(colour_at > 0, F.slice(parts, F.lit(1), F.greatest(colour_at - 1, F.lit(0)).cast("int"))).otherwise(parts)
        body = F.transform(body, lambda p, i: F.when(i == 0, strip(F.regexp_replace(p, YEAR_PREFIX, ""))).otherwise(p))
        return F.struct(parts.alias("parts"), colour_at.alias("at"), body.alias("body"))

    def named(s: Column) -> Column:
        parts, colour_at, body = s["parts"], s["at"], s["body"]
        n = F.size(body)
        lead = F.filter(F.slice(body, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda p: p != "")
        producer = F.when(n >= 2, F.array_join(lead, " - ")).otherwise(F.try_element_at(body, F.lit(1)))
        at = lambda shift: F.when(colour_at > 0, F.try_element_at(parts, (colour_at + shift).cast("int")))
        fields = {
            "producer": F.nullif(strip(producer), F.lit("")),
            "label_name": F.when(n >= 2, F.nullif(strip(F.try_element_at(body, F.lit(-1))), F.lit(""))),
            "color": at(0),
            "volume_label": at(1),
            "packaging": at(2),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return let(let(let(listing_parts(name), split), with_body), named)


def split_listing(name: Column) -> dict[str, Column]:
    """The fields of ``split_struct`` by name."""
    s = split_struct(name)
    return {k: s[k] for k in ("producer", "label_name", "color", "volume_label", "packaging")}


def volume_litres(volume: Column) -> Column:
    """Litres of a normalised volume text ("750ml"; a decimal point never survives)."""
    t = normalize_text(volume)
    return (
        F.when(F.endswith(t, F.lit("ml")), F.trim(F.regexp_replace(t, r"ml$", "")).try_cast("double") / 1000.0)
        .when(F.endswith(t, F.lit("l")), F.trim(F.regexp_replace(t, r"l$", "")).try_cast("double"))
    )


def offering_type(quantity: Column, volume: Column, packaging: Column, name: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    seen = F.struct(
        normalize_text(F.concat_ws(" ", blank(packaging), blank(volume), blank(name))).alias("norm"), F.coalesce(volume_litres(volume), F.lit(-1.0)).alias("litres")
    )
    return let(seen, lambda s: _offering_type(quantity, s["norm"], s["litres"]))


def _offering_type(quantity: Column, norm: Column, litres: Column) -> Column:
    return (
        F.when(quantity >= 6, "Case")
        .when(quantity > 1, "Bundle")
        .when(F.contains(norm, F.lit("jeroboam")) | (litres > 1.5), "Large Format")
        .when(F.contains(norm, F.lit("magnum")) | (litres == 1.5), "Magnum")
        .when(F.contains(norm, F.lit("half bottle")) | (litres == 0.375), "Half Bottle")
        .otherwise("Single Bottle")
    )


def wine_type(c: Column, colour: Column) -> Column:
    sparkling = contains_any(c, SPARKLING_MARKERS)
    colour_key = normalize_text(colour)
    chain = F.when(sparkling & (colour_key == "rose"), "Sparkling Rose").when(sparkling, "Sparkling")
    for key, value in METADATA_COLOURS.items():
        chain = chain.when(colour_key == key, value)
    return chain


def style_family(c: Column, kind: Column, region: Column) -> Column:
    return (
        F.when((region == "Champagne") | F.contains(c, F.lit("champagne")), "Champagne")
        .when(contains_any(c, SWEET_MARKERS), "Sweet / Dessert")
        .when(kind.isin("Sparkling", "Sparkling Rose"), "Sparkling")
        .when(kind.isin("Red", "White", "Rose", "Orange"), kind)
    )


def combine_confidence(a: Column, b: Column) -> Column:
    weight = lambda c: F.when(c == "low", 1).when(c == "medium", 2).when(c == "high", 3).otherwise(0)
    total = weight(a) + weight(b)
    return F.when(total >= 5, "high").when(total >= 3, "medium").when(total > 0, "low")


def derive_metadata(df, name: str = "offer_name", quantity: str = "quantity", volume: str = "volume"):
    """Append the seventeen derived attributes; narrow, one pass, no shuffle."""
    parts = ("producer", "label_name", "color", "volume_label", "packaging")
    df = df.withColumn("_split", split_struct(F.col(name))).withColumns({f"_{k}": F.col(f"_split.{k}") for k in parts}).drop("_split")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    df = df.withColumn("_text", normalize_text(F.concat_ws(" ", blank("_producer"), blank("_label_name"), blank("_color"), blank(name))))
    t = F.col("_text")
    df = df.withColumns({"_origin": detect_origin(t), "_grape": detect_grapes(t), "_kind": wine_type(t, F.col("_color"))})
    df = df.withColumn("_style", style_family(t, F.col("_kind"), F.col("_origin.region")))
    no_rule = F.col("_grape").isNull()
    generic = lambda by_kind, champagne: (
        F.when(F.col("_kind") == "Rose", by_kind[0]).when(F.col("_kind") == "Sparkling Rose", by_kind[1])
        .when(F.col("_style") == "Champagne", champagne)
    )
    grapes = F.when(~no_rule, F.col("_grape.grapes")).otherwise(
        generic(("Rose Blend", "Sparkling Rose Blend"), "Pinot Noir, Chardonnay, Pinot Meunier"))
    source = F.when(~no_rule, F.col("_grape.source")).otherwise(generic((_STYLE, _STYLE), _STYLE))
    confidence = F.when(~no_rule, F.col("_grape.confidence")).otherwise(generic(("medium", "medium"), "low"))
    known = F.col("_origin").isNotNull()
    df = df.withColumns(
        {
            "producer": F.col("_producer"),
            "label_name": F.col("_label_name"),
            "country": F.col("_origin.country"),
            "region": F.col("_origin.region"),
            "wine_type": F.col("_kind"),
            "style_family": F.col("_style"),
            "grapes": grapes,
            "offering_type": offering_type(F.col(quantity), F.col(volume), F.col("_packaging"), F.col(name)),
            "origin_label": F.when(known, F.concat_ws(", ", F.col("_origin.region"), F.col("_origin.country"))),
            "origin_latitude": F.col("_origin.latitude"),
            "origin_longitude": F.col("_origin.longitude"),
            "origin_precision": F.when(known, "region"),
            "origin_source": F.when(known, "listing_keyword_heuristic"),
            "origin_confidence": F.when(known, "medium"),
            "grape_source": source,
            "grape_confidence": confidence,
        }
    )
    return df.withColumn(
        "metadata_confidence", combine_confidence(F.col("origin_confidence"), F.col("grape_confidence"))
    ).drop("_text", "_origin", "_grape", "_kind", "_style", *[f"_{k}" for k in parts])


def gap_fill(df, grapes: str, region: str):
    """Fill missing grapes, country and region from a rating row ("Country / Region")."""
    parts = F.transform(F.split(F.coalesce(F.col(region), F.lit("")), "/"), strip)
    slashed = F.contains(F.coalesce(F.col(region), F.lit("")), F.lit("/"))
    take_grapes = F.col("grapes").isNull() & (F.coalesce(strip(F.col(grapes)), F.lit("")) != "")
    return df.withColumns(
        {
            "grape_source": F.when(take_grapes, "vivino").otherwise(F.col("grape_source")),
            "grapes": F.when(take_grapes, strip(F.col(grapes))).otherwise(F.col("grapes")),
            "country": F.when(F.col("country").isNull() & slashed, F.try_element_at(parts, F.lit(1))).otherwise(F.col("country")),
            "region": F.when(F.col("region").isNull() & slashed, F.try_element_at(parts, F.lit(2))).otherwise(F.col("region")),
        }
    )


def continent_of(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTINENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, country), F.lit("Europe"))
