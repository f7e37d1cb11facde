"""Web addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.functions.numbers import blank_to_null, first_group, let, strip, text

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _PARTS, 1))


def url_host(c: Column) -> Column:
    """Authority part; blank where there is none."""
    return F.regexp_extract(c, _PARTS, 2)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 3)


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, _PARTS, 4)


def _bare(c: Column) -> Column:
    """Scheme, host and path without query, fragment and trailing slashes."""
    scheme = F.coalesce(F.nullif(url_scheme(c), F.lit("")), F.lit("https"))
    path = F.regexp_replace(url_path(c), r"/+$", "")
    host = url_host(c)
    return F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path)


def _is_item(c: Column, host: str) -> Column:
    return F.contains(url_host(c), F.lit(host)) & F.contains(url_path(c), F.lit("/w/"))


def normalize_item_url(c: Column, host: str = settings.RATING_HOST) -> Column:
    """Bare address of an item page; anything else passes through, blank is NULL."""
    return let(blank_to_null(c), lambda u: F.when(_is_item(u, host), _bare(u)).otherwise(u))


def strict_item_url(c: Column, host: str = settings.RATING_HOST) -> Column:
    """Bare address of an item page; anything else is blank."""
    return let(text(c), lambda u: F.when(_is_item(u, host), _bare(u)).otherwise(""))


def first_item_url(c: Column, host: str = settings.RATING_HOST) -> Column:
    """First address of the rating host in a text (else the text itself), bare."""
    pattern = r"(?i)https?://[^\s\"'<>()]*" + host.replace(".", r"\.") + r"[^\s\"'<>()]*"
    found = let(text(c), lambda u: F.coalesce(first_group(u, pattern, 0), u))
    return let(found, lambda u: F.when(u == "", "").otherwise(_bare(u)))


def clean_url(c: Column) -> Column:
    """Trimmed address, blank as NULL."""
    return blank_to_null(c)


def rewrite_host(c: Column, legacy_hosts: list[str], base: str) -> Column:
    """Move addresses of retired hosts to the current base address."""
    out = blank_to_null(c)
    if not base:
        return out
    moved = out
    for old in reversed(legacy_hosts):
        moved = F.when(F.startswith(out, F.lit(old)), F.concat(F.lit(base.rstrip("/")), F.substr(out, F.lit(len(old) + 1)))).otherwise(moved)
    return moved


def force_locale(c: Column, host: str = settings.RATING_HOST, locale: str = settings.RATING_LOCALE) -> Column:
    """Rewrite a one- or two-part locale in the path to the given one."""
    h = host.replace(".", r"\.")
    once = F.regexp_replace(c, rf"({h}/)([a-z]{{2}})(/)", f"$1{locale}/")
    return F.regexp_replace(once, rf"({h}/)([A-Za-z]{{2}})/([a-z]{{2}})/", f"$1{locale}/")


def item_id(c: Column) -> Column:
    return first_group(c, r"/w/(\d+)")


def slug_text(c: Column) -> Column:
    """Words of the path piece before ``/w/``, else of the last piece."""
    def pick(parts: Column) -> Column:
        at = F.array_position(parts, "w")
        before = F.try_element_at(parts, F.greatest(at - 1, F.lit(1)).cast("int"))
        return F.when(at > 1, before).otherwise(F.try_element_at(parts, F.lit(-1)))

    piece = let(F.filter(F.split(url_path(c), "/"), lambda p: p != ""), pick)
    return F.coalesce(F.replace(piece, F.lit("-"), F.lit(" ")), F.lit(""))


def find_text(c: Column) -> Column:
    """Search words of a ``/find/…`` address, percent-decoded and lower-case."""
    path = F.lower(let(url_path(c), lambda p: F.coalesce(F.try_url_decode(p), p)))
    words = F.regexp_extract(path, r"/find/(.+?)(?:/\d{4})?$", 1)
    return F.translate(words, "+-", "  ")


def search_url(query: Column, base: str = settings.RATING_SEARCH_URL) -> Column:
    q = strip(query)
    return F.when(F.coalesce(q, F.lit("")) != "", F.concat(F.lit(base), F.url_encode(q)))


def query_year(c: Column) -> Column:
    """Value of the ``year`` parameter."""
    return first_group(url_query(c), r"(?:^|&)year=([^&]+)")
