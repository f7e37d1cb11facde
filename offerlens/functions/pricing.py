"""Price comparison, scaling, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.functions.numbers import let, round2, round4
from offerlens.settings import SIDES, SideLabels

# --- fixed values -----------------------------------------------------------------
DOUBLE_VOLUMES = ("1.5l", "1500ml", "magnum")
QUADRUPLE_VOLUMES = ("3l", "3000ml", "double magnum", "jeroboam")
GOOD_RATING = 4.0
CONFIDENT_COUNT = 100
TREND_EPSILON = 0.01
OUTLIER_LOW, OUTLIER_HIGH = 0.40, 2.0
# -------------------------------------------------------------------------------------


def compare_prices(anchor: Column, rival: Column, qty_anchor: Column, qty_rival: Column, sides: SideLabels = SIDES) -> dict[str, Column]:
    """Bring the rival total to the anchor's pack and derive gap, per cent and side."""
    qa = F.greatest(F.coalesce(qty_anchor, F.lit(1)), F.lit(1))
    qr = F.greatest(F.coalesce(qty_rival, F.lit(1)), F.lit(1))
    rival_total = round2(rival / qr * qa)
    diff = round2(anchor - rival_total)
    pct = F.when(rival_total != 0, round2(diff / rival_total * 100))
    side = (
        F.when(rival_total.isNull(), sides.none)
        .when(diff.isNull() | (diff == 0), sides.same)
        .when(diff < 0, sides.anchor)
        .otherwise(sides.rival)
    )
    return {"rival_price": rival_total, "price_diff": diff, "price_diff_pct": pct, "cheaper_side": side}


def backfill_gap(anchor: Column, rival: Column, diff: Column, pct: Column) -> tuple[Column, Column]:
    """Gap and per cent from the two prices where the input lacks them."""
    diff = F.coalesce(diff, round2(anchor - rival))
    pct = F.coalesce(pct, F.when(rival != 0, round2(diff / rival * 100.0)))
    return diff, pct


def volume_factor(volume: Column) -> Column:
    v = F.lower(F.coalesce(volume, F.lit("")))
    return F.when(v.isin(*DOUBLE_VOLUMES), 2).when(v.isin(*QUADRUPLE_VOLUMES), 4).otherwise(1)


def scale_to_listing(price: Column, quantity: Column, volume: Column) -> Column:
    """Bottle price to listing total by volume and pack; non-positive is NULL."""
    pack = F.greatest(F.coalesce(quantity, F.lit(1)), F.lit(1))
    return F.when(price > 0, round2(price * volume_factor(volume) * pack))


def price_anchor(a: Column, b: Column) -> Column:
    """Mean of the positive prices."""
    return (
        F.when((a > 0) & (b > 0), (a + b) / 2).when(a > 0, a).when(b > 0, b)
    )


def resolve_rating_price(raw, quantity, volume, anchor_price, rival_price, source, url) -> Column:
    """Listing-level market price of a rating row.

    Base rows scale.  Override rows keep the raw or scaled reading that lies nearer the
    shop prices (tie: raw) and are dropped outside 0.40..2.0 of them.  No address, no price.
    """
    facts = F.struct(
        scale_to_listing(raw, quantity, volume).alias("scaled"), price_anchor(anchor_price, rival_price).alias("ref"), round2(raw).alias("plain")
    )

    def decide(f: Column) -> Column:
        scaled, ref, plain = f["scaled"], f["ref"], f["plain"]
        nearer = ref.isNotNull() & (plain != scaled) & (F.abs(plain - ref) <= F.abs(scaled - ref))
        chosen = F.when(nearer, plain).otherwise(scaled)
        outlier = (ref > 0) & (chosen > 0) & ((chosen / ref < OUTLIER_LOW) | (chosen / ref > OUTLIER_HIGH))
        return (
            F.when((F.coalesce(url, F.lit("")) == "") | scaled.isNull(), None)
            .when(F.coalesce(source, F.lit("base")) != "override", scaled)
            .when(~F.coalesce(outlier, F.lit(False)), chosen)
        )

    return let(facts, decide)


def deal_score(pct: Column, rating: Column, count: Column, anchor_price: Column, rating_price: Column) -> Column:
    """0..100: shop discount 30, market discount 30, rating 25, confidence 10, bonus 5."""
    shop = F.least(F.greatest(-F.coalesce(pct, F.lit(0.0)), F.lit(0.0)), F.lit(30.0))
    usable = (F.coalesce(anchor_price, F.lit(0.0)) != 0) & (rating_price > 0)
    market = F.when(
        usable,
        F.least(F.greatest((rating_price - anchor_price) / rating_price * 100.0, F.lit(0.0)), F.lit(30.0)),
    ).otherwise(0.0)
    stars = F.greatest(F.least(F.coalesce(rating, F.lit(0.0)), F.lit(5.0)), F.lit(0.0)) / 5.0 * 25.0
    sample = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))
    confidence = F.least(F.log10((sample + 1).cast("double")) / 3.0, F.lit(1.0)) * 10.0
    bonus = F.when((shop > 5) & (market > 5), 5.0).otherwise(0.0)
    return round2(shop + market + stars + confidence + bonus)


def verdict(side: Column, rating: Column, count: Column, sides: SideLabels = SIDES) -> dict[str, Column]:
    """Verdict, tone and reason, first matching rule."""
    stars, sample = F.coalesce(rating, F.lit(0.0)), F.coalesce(count, F.lit(0))
    good, sure = stars >= GOOD_RATING, sample >= CONFIDENT_COUNT
    is_anchor = F.coalesce(side == sides.anchor, F.lit(False))
    rules = (
        (is_anchor & good & sure, "Strong Credit Spend", "good", "Good rating, enough ratings and no mark-up at the anchor shop."),
        (is_anchor, "Solid Value", "good", "The anchor shop is currently cheaper."),
        ((side == sides.same) & (stars >= 4.1), "Quality Buy", "calm", "Not cheaper, but well rated."),
        (side == sides.same, "Retail Match", "calm", "Both shops ask the same price."),
        (side == sides.rival, "Anchor Markup", "warn", "The rival shop is currently cheaper."),
        (side == sides.none, "Quality Only", "ghost", "No rival offer to compare with."),
    )
    out = {}
    for position, (name, default) in enumerate(
        (("value_verdict", "Needs Review"), ("value_verdict_tone", "ghost"), ("value_verdict_reason", "Needs a manual look."))
    ):
        chain = F.when(rules[0][0], rules[0][1 + position])
        for rule in rules[1:]:
            chain = chain.when(rule[0], rule[1 + position])
        out[name] = chain.otherwise(default)
    return out


def trend(change: Column) -> Column:
    return (
        F.when(change.isNull(), "unknown")
        .when(change <= -TREND_EPSILON, "down")
        .when(change >= TREND_EPSILON, "up")
        .otherwise("flat")
    )


def recommendation_score(score, side, rating, count, offering, sides: SideLabels = SIDES) -> Column:
    points = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    return (
        F.coalesce(score, F.lit(0.0))
        + points(side == sides.anchor, 20)
        - points(side == sides.rival, 18)
        + points(rating >= 4.2, 8)
        + points(count >= 500, 4)
        + points(offering == "Magnum", 2)
    )


def unit_price(total: Column, quantity: Column, volume: Column) -> Column:
    """Price per standard bottle, only where the listing holds more than one."""
    divisor = volume_factor(volume) * F.greatest(F.coalesce(quantity, F.lit(1)), F.lit(1))
    return F.when(divisor > 1, total / divisor)


def unit_basis(quantity: Column, volume: Column) -> Column:
    divisor = volume_factor(volume) * F.greatest(F.coalesce(quantity, F.lit(1)), F.lit(1))
    return F.when(divisor > 1, F.when(volume_factor(volume) > 1, "/750ml").otherwise("/btl"))


def _whole_pct(pct: Column) -> Column:
    return F.concat(F.floor(pct + 0.5).cast("string"), F.lit("%"))


def market_gap_label(anchor_price: Column, market_price: Column) -> Column:
    """Position against the market price; under one per cent it is the market price."""
    pct = F.abs((anchor_price - market_price) / market_price * 100)
    usable = (F.coalesce(market_price, F.lit(0.0)) != 0) & (F.coalesce(anchor_price, F.lit(0.0)) != 0)
    return (
        F.when(~usable, "")
        .when(pct < 1, "Market price")
        .when(anchor_price < market_price, F.concat(_whole_pct(pct), F.lit(" below market")))
        .otherwise(F.concat(_whole_pct(pct), F.lit(" above market")))
    )


def deal_signals(pct, side, anchor_price, market_price, rating, count, sides: SideLabels = SIDES) -> Column:
    """Signal texts in fixed order: shop gap (5 %), market gap (3 %), rating."""
    gap = F.abs(pct)
    market_gap = F.abs((anchor_price - market_price) / market_price * 100)
    shop = (
        F.when((side == sides.anchor) & (gap >= 5), F.concat(_whole_pct(gap), F.lit(" cheaper")))
        .when((side == sides.rival) & (gap >= 5), F.concat(_whole_pct(gap), F.lit(" more vs rival")))
    )
    market = F.when(
        market_gap.isNotNull(),
        F.when(market_gap < 3, "At market price")
        .when(anchor_price < market_price, F.concat(_whole_pct(market_gap), F.lit(" below mkt")))
        .otherwise(F.concat(_whole_pct(market_gap), F.lit(" above mkt"))),
    )
    # One decimal, built from whole tenths so that no engine-specific formatting is involved.
    tenths = F.floor(rating * 10 + 0.5)
    stars = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    rated = F.when(
        (rating >= GOOD_RATING) & (count >= CONFIDENT_COUNT),
        F.concat(stars, F.lit(" ("), count.cast("string"), F.lit(")")),
    )
    return F.array_compact(F.array(shop, market, rated))


def tone_for_side(side: Column, sides: SideLabels = SIDES) -> Column:
    return F.when(side == sides.anchor, "gain").when(side == sides.rival, "loss").otherwise("flat")


def tone_for_mean(value: Column) -> Column:
    return F.when(value <= -3, "gain").when(value >= 3, "loss").otherwise("flat")


def tone_for_mix(anchor_count: Column, rival_count: Column) -> Column:
    return F.when(anchor_count > rival_count, "gain").when(rival_count > 0, "loss").otherwise("flat")


def short_verdict(label: Column) -> Column:
    # --- fixed values ---
    names = {
        "Strong Credit Spend": "Top Value",
        "Solid Value": "Good Value",
        "Quality Buy": "Worth A Look",
        "Retail Match": "Match",
        "Anchor Markup": "Markup",
        "Quality Only": "No Comp",
        "Needs Review": "Review",
    }
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), label)


def usable_fx_rate(rate: Column, default: float = settings.DEFAULT_FX_RATE) -> Column:
    """A live rate counts only strictly between 1 and 2, to four decimals."""
    return F.coalesce(F.when((rate > 1.0) & (rate < 2.0), round4(rate)), F.lit(default))
