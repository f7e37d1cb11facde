"""Text folding, lookup keys and tokens."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.numbers import first_group, let

# --- fixed values: tokens that carry no identity -------------------------------
DROP_TOKENS = (
    "and", "the", "de", "la", "le", "du", "des", "di", "standard", "bottle", "magnum", "jeroboam", "double",
    "half", "red", "white", "rose", "blanc", "rouge", "ml", "l", "igt", "doc", "docg", "aoc", "aop", "vdt",
)
# ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every code point, kept where ASCII remains.

    Built by rule from the Unicode database: one-character results go to ``translate``,
    longer ones (ligatures, fractions, units) to a small map.
    """
    source, target, expansions = [], [], {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            expansions[char] = folded
    return "".join(source), "".join(target), expansions


def fold_ascii(c: Column) -> Column:
    """NFKD to ASCII, dropping what does not decompose; stays inside the JVM."""
    source, target, expansions = _fold_tables()
    ascii_only = r"^[\x00-\x7F]*$"
    # One JSON literal that folds to a constant map, instead of one plan node per entry.
    pairs = F.from_json(F.lit(json.dumps(expansions)), "map<string,string>")
    expand = lambda ch: F.when(ch.rlike(ascii_only), ch).otherwise(F.coalesce(F.try_element_at(pairs, ch), F.lit("")))
    expandable = "".join(expansions)
    longer = (
        lambda v: F.when(v.rlike(ascii_only), v)
        .when(F.translate(v, expandable, "") != v, F.array_join(F.transform(F.split(v, ""), expand), ""))
        .otherwise(F.regexp_replace(v, r"[^\x00-\x7F]", ""))
    )
    return let(c, lambda v: F.when(v.rlike(ascii_only), v).otherwise(let(F.translate(v, source, target), longer)))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _words_only(folded: Column) -> Column:
    """Lower-case letters and digits with one blank for everything between; folded text is ASCII."""
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def normalize_key(c: Column) -> Column:
    """Accent-free lower-case words and digits; apostrophes vanish, ``&`` reads "and"."""
    folded = F.lower(fold_ascii(F.coalesce(c, F.lit(""))))
    spelled = F.replace(F.replace(folded, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return _words_only(spelled)


def normalize_text(c: Column) -> Column:
    """``normalize_key`` without the apostrophe rule ("d'Asti" gives "d asti")."""
    folded = F.lower(fold_ascii(F.coalesce(c, F.lit(""))))
    return _words_only(F.replace(folded, F.lit("&"), F.lit(" and ")))


def drop_key_tokens(key: Column) -> Column:
    """Remove stop tokens, sizes and numbers of up to three digits from a normalised key."""
    words = "|".join(DROP_TOKENS)
    return squeeze(F.regexp_replace(key, rf"\b(?:{words}|\d+ml|\d+l|\d{{1,3}})\b", " "))


def canonical_key(c: Column) -> Column:
    return drop_key_tokens(normalize_key(c))


def description_key(c: Column) -> Column:
    """Canonical key, or the plain key where nothing is left of it."""
    return let(normalize_key(c), lambda key: F.coalesce(F.nullif(drop_key_tokens(key), F.lit("")), key))


def extract_year(c: Column) -> Column:
    """First stand-alone 19xx or 20xx."""
    return first_group(c, r"\b(?:19|20)\d{2}\b", 0).cast("int")


def tokens(c: Column) -> Column:
    """Distinct sorted words; blank text gives an empty array."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), "")))


def words(c: Column) -> Column:
    """Words in order, repeats kept."""
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")


def contains_any(c: Column, markers) -> Column:
    """True where any marker is a substring."""
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(c, F.lit(marker))
    return hit


