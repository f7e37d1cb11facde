"""Cases for per-row expressions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from offerlens.functions import metadata as M
from offerlens.functions import pages as P
from offerlens.functions.numbers import parse_compact_count, parse_float, parse_int, parse_price
from offerlens.functions.pricing import deal_score, resolve_rating_price, scale_to_listing, trend, verdict
from offerlens.functions.text import canonical_key, fold_ascii, normalize_key, tokens
from offerlens.functions.urls import find_text, force_locale, item_id, normalize_item_url, slug_text, strict_item_url


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_fold_ascii_is_nfkd(spark):
    texts = ["Château Réserve", "½ ﬁne ™ ｆｕｌｌ", "Ærøskøbing straße", "Łódź №5 ²", "日本", "", "plain", "é"]
    got = [r[0] for r in one(spark, "t string", [(t,) for t in texts], fold_ascii(F.col("t")))]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_keys(spark):
    rows = [("Moscato d'Asti & Co",), ("2021 Château X - Red - 750 ml - Standard Bottle 12",), (None,), ("   ",)]
    got = one(spark, "t string", rows, normalize_key(F.col("t")), canonical_key(F.col("t")), F.size(tokens(F.col("t"))))
    assert [g[0] for g in got] == ["moscato dasti and co", "2021 chateau x red 750 ml standard bottle 12", "", ""]
    assert [g[1] for g in got] == ["moscato dasti co", "2021 chateau x", "", ""]
    assert got[2][2] == got[3][2] == 0


def test_numbers(spark):
    rows = [("$1,200.50",), ("abc",), ("12.7 pts",), ("-3",), ("N/A",), (None,), ("4.5k",), ("1M",)]
    c = F.col("t")
    got = one(spark, "t string", rows, parse_price(c), parse_float(c), parse_int(c), parse_compact_count(c))
    assert got[0][:2] == (1200.5, None) or got[0][0] == 1200.5
    assert got[2] == (None, 12.7, 12, None) and got[3][:3] == (-3.0, -3.0, 3)
    assert got[1] == got[4] == got[5] == (None, None, None, None)
    assert (got[6][3], got[7][3]) == (4500, 1000000)


# raw, quantity, volume, anchor, rival, source, url, expected
PRICES = [
    (527.67, 6, "750ml", 630.0, 660.0, "override", "u", 527.67),
    (210.0, 3, "750ml", 600.0, 630.0, "override", "u", 630.0),
    (210.0, 3, "750ml", 600.0, 630.0, "base", "u", 630.0),
    (1199.95, 3, "750ml", 600.0, 555.0, "override", "u", None),
    (75.0, 1, "1.5l", 380.0, 445.0, "override", "u", None),
    (42.94, 1, "750ml", 110.0, 113.0, "override", "u", None),
    (100.0, 1, "750ml", 100.0, 100.0, "override", "", None),
    (100.0, 1, "750ml", 100.0, 100.0, "override", "u", 100.0),
]


def test_rating_price_resolution(spark):
    schema = "raw double, q int, v string, a double, r double, s string, u string, want double"
    got = one(spark, schema, PRICES, resolve_rating_price(*[F.col(x) for x in ("raw", "q", "v", "a", "r", "s", "u")]), F.col("want"))
    assert all(a == b for a, b in got)
    scaled = one(spark, "p double, q int, v string", [(210.0, 3, "750ml"), (75.0, 1, "1.5l"), (0.0, 1, "750ml")], scale_to_listing(F.col("p"), F.col("q"), F.col("v")))
    assert scaled == [(630.0,), (150.0,), (None,)]


LISTINGS = [
    ("2021 Château de Beaucastel - Châteauneuf du Pape - Red - 750 ml - Standard Bottle", "France", "Rhone Valley", "Grenache Blend", "Red"),
    ("NV Charles Heidsieck - Brut Réserve - White - 750 ml - Standard Bottle", "France", "Champagne", "Pinot Noir, Chardonnay, Pinot Meunier", "Champagne"),
    ("2020 Nervi - Gattinara - Red - 750 ml - Standard Bottle", "Italy", "Piedmont", "Nebbiolo", "Red"),
    ("2022 Nobody - Plain - Rose - 750 ml - Standard Bottle", None, None, "Rose Blend", "Rose"),
    ("2022 Nobody - Moscato d'Asti - White - 750 ml", "Italy", "Piedmont", "Moscato Bianco", "Sweet / Dessert"),
]


def test_metadata(spark):
    df = spark.createDataFrame([(n, 1, "750ml", c, r, g, s) for n, c, r, g, s in LISTINGS], "offer_name string, quantity int, volume string, wc string, wr string, wg string, ws string")
    for row in M.derive_metadata(df).collect():
        assert (row["country"], row["region"], row["grapes"], row["style_family"]) == (row["wc"], row["wr"], row["wg"], row["ws"])


def test_offering_types(spark):
    rows = [(6, "750ml", "x", "Case"), (3, "750ml", "x", "Bundle"), (1, "1.5l", "x Magnum", "Magnum"), (1, "1.5l", "x", "Single Bottle"), (1, "375ml", "x", "Half Bottle"), (1, "3000ml", "x", "Large Format"), (None, None, None, "Single Bottle")]
    got = one(spark, "q int, v string, n string, want string", rows, M.offering_type(F.col("q"), F.col("v"), F.lit(None).cast("string"), F.col("n")), F.col("want"))
    assert all(a == b for a, b in got)


def test_verdict_and_trend(spark):
    rows = [("Anchor Cheaper", 4.2, 150, "Strong Credit Spend"), ("Anchor Cheaper", 4.2, 99, "Solid Value"), ("Same Price", None, None, "Retail Match"), ("Same Price", 4.1, None, "Quality Buy"), ("Rival Cheaper", 5.0, 900, "Anchor Markup"), ("No Match", 4.0, 80, "Quality Only"), (None, None, None, "Needs Review")]
    got = one(spark, "s string, r double, n int, want string", rows, verdict(F.col("s"), F.col("r"), F.col("n"))["value_verdict"], F.col("want"))
    assert all(a == b for a, b in got)
    assert one(spark, "x double", [(-1.0,), (1.0,), (0.0,), (None,), (-0.01,)], trend(F.col("x"))) == [("down",), ("up",), ("flat",), ("unknown",), ("down",)]


def test_deal_score(spark):
    rows = [(-20.0, 4.0, 999, 80.0, 100.0), (None, None, None, None, None), (-50.0, 6.0, 10**9, 10.0, 100.0)]
    got = one(spark, "a double, b double, c long, d double, e double", rows, deal_score(*[F.col(x) for x in "abcde"]))
    assert got == [(75.0,), (0.0,), (100.0,)]


def test_urls(spark):
    rows = [("https://www.vivino.com/SG/en/foo-bar/w/12/?year=2010#x",), ("https://x.example/a?b=1",), ("",), (None,)]
    c = F.col("u")
    got = one(spark, "u string", rows, normalize_item_url(c), strict_item_url(c), item_id(c), slug_text(F.coalesce(c, F.lit(""))))
    assert got[0] == ("https://www.vivino.com/SG/en/foo-bar/w/12", "https://www.vivino.com/SG/en/foo-bar/w/12", "12", "foo bar")
    assert got[1] == ("https://x.example/a?b=1", "", None, "a") and got[2][:2] == (None, "") and got[3][:2] == (None, "")
    assert one(spark, "u string", [("https://www.vivino.com/en/x/w/1",), ("https://vivino.com/US/en/x/w/1",)], force_locale(c)) == [("https://www.vivino.com/SG/en/x/w/1",), ("https://vivino.com/SG/en/x/w/1",)]
    assert one(spark, "u string", [("https://h/find/ch%C3%A2teau+x-y/2010",), ("https://h/else",)], find_text(c)) == [("château x y",), ("",)]


def test_page_rating_forms(spark):
    rows = [('{"aggregateRating": {"a": 1, "ratingValue": "4.2", "ratingCount": "1,234"}}',), ('"ratingValue": 3.9 ... "reviewCount": "7"',), ("none",)]
    got = one(spark, "h string", rows, *P.rating_from_page(F.col("h")).values())
    assert got == [("4.2", "1234"), ("3.9", "7"), ("", "")]


@pytest.mark.parametrize("raw,value", [('```json\n{"a": 1}\n```', "1"), ('{"a": 1,', "1"), ("nothing", None)])
def test_lenient_json(spark, raw, value):
    assert one(spark, "j string", [(raw,)], F.get_json_object(P.lenient_json(F.col("j")), "$.a")) == [(value,)]
