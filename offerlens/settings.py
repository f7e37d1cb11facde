"""Names and limits that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
RATING_HOST = "vivino.com"
MARKET_HOST = "wine-searcher.com"
RATING_SEARCH_URL = "https://www.vivino.com/en/search/wines?q="
RATING_LOCALE = "SG/en"
RATING_DEFAULT_PRICE_CURRENCY = "SGD"
DEFAULT_FX_RATE = 1.30
PAGE_LIMIT = 500
HISTORY_LIMIT = 3650
RETENTION_DAYS = 90
STALE_HOURS = 24
QUERY_CACHE_TTL_HOURS = 168
DATA_CACHE_TTL_DAYS = 30
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SideLabels:
    """Text stored in ``cheaper_side``; a caller with other shop names passes its own."""

    anchor: str = "Anchor Cheaper"
    rival: str = "Rival Cheaper"
    same: str = "Same Price"
    none: str = "No Match"


SIDES = SideLabels()
