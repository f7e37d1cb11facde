"""SQL fragments for the DuckDB side, written independently of the Spark expressions."""

from __future__ import annotations

SP = r"'\s+', ' ', 'g'"
DROP = "'and','the','de','la','le','du','des','di','standard','bottle','magnum','jeroboam','double','half','red','white','rose','blanc','rouge','ml','l','igt','doc','docg','aoc','aop','vdt'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {SP}))"


def ascii_of(x: str) -> str:
    return rf"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g'))"


def nkey(x: str) -> str:
    return squeeze(
        rf"regexp_replace(replace(replace({ascii_of(x)}, '&', ' and '), chr(39), ''), '[^a-z0-9\s]', ' ', 'g')"
    )


def ntext(x: str) -> str:
    return squeeze(rf"regexp_replace(replace({ascii_of(x)}, '&', ' and '), '[^a-z0-9\s]', ' ', 'g')")


def ckey(x: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({nkey(x)}, ' '), lambda t: t <> '' AND t NOT IN ({DROP}) "
        r"AND NOT regexp_full_match(t, '\d+ml|\d+l|\d{1,3}')), ' ')"
    )


def toks(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def year_of(x: str) -> str:
    return rf"TRY_CAST({ext(x, r'\b(?:19|20)\d{2}\b', 0)} AS INTEGER)"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE CAST({inter} AS DOUBLE) / (len({a}) + len({b}) - {inter}) END)"


def _nearest(x: str, scale: int) -> str:
    """Half up on the size, sign put back; sums of 64ths that stand exactly between two go to the even one."""
    size = f"(abs({x}) * {scale})"
    tie = f"{size} - floor({size}) = 0.5 AND abs({x}) * 64 = floor(abs({x}) * 64) AND CAST(floor({size} + 0.5) AS BIGINT) % 2 = 1"
    return f"(CASE WHEN ({x}) < 0 THEN -1.0 ELSE 1.0 END * (floor({size} + 0.5) - CASE WHEN {tie} THEN 1 ELSE 0 END) / {scale} + 0.0)"


def r2(x: str) -> str:
    return _nearest(f"CAST({x} AS DOUBLE)", 100)


def r4(x: str) -> str:
    return _nearest(f"CAST({x} AS DOUBLE)", 10000)


def mean2(x: str, where: str = "") -> str:
    return f"(floor(CAST(sum(CAST({x} * 100 AS DECIMAL(26, 8))) AS DOUBLE) / count({x}) + 0.5) / 100)"


QTY = (
    r"bundle[-_\s]?of[-_\s]?(\d+)", r"case[-_\s]?of[-_\s]?(\d+)", r"\b(\d+)[-_]?(?:bottles?|btls?)\b", r"\b(\d+)[-_]?x\b", r"\bx[-_\s]?(\d+)\b",
)


def qty(x: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST({ext(f'lower({x})', p)} AS INTEGER)" for p in QTY) + ")"


def name_clean(x: str) -> str:
    s = rf"regexp_replace(lower({x}), '\b(red|white|rose)\b', '', 'g')"
    s = rf"regexp_replace({s}, '\b(\d+(\.\d+)?\s*l|magnum|standard bottle|half bottle|case|bottles|ml)\b', '', 'g')"
    s = rf"regexp_replace({s}, '\([^)]*\)', '', 'g')"
    return squeeze(rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')")


def prepared(source: str) -> str:
    """Listing columns with pack, volume, year, package and clean names."""
    tail = "lower(url)"
    vol = (
        rf"coalesce(replace({ext(tail, r'/products/.*?(\d+-\d+)-l')}, '-', '.') || 'l', {ext(tail, r'(\d+)[-_]?ml')} || 'ml', "
        rf"{ext('lower(name)', r'(\d+(?:\.\d+)?)\s*l\b')} || 'l', {ext('lower(name)', r'(\d+)\s*ml\b')} || 'ml', "
        f"CASE WHEN contains({tail}, 'magnum') THEN '1.5l' END, '750ml')"
    )
    gift = " OR ".join(
        f"contains(lower(name || ' ' || url), '{m}')" for m in ("gift-box", "gift box", "wooden-box", "wooden box", "2-glasses", "2 glasses")
    )
    yr = rf"TRY_CAST(coalesce({ext('lower(url)', r'\b(19\d{2}|20[0-3]\d)\b')}, {ext('name', r'\b(19\d{2}|20[0-3]\d)\b')}) AS INTEGER)"
    return f"""(
SELECT *, CASE WHEN len(body) >= 2 THEN {name_clean('body[-1]')} ELSE {name_clean('name')} END AS label_clean FROM (
SELECT *, CASE WHEN pos > 0 THEN parts[:pos - 1] ELSE parts END AS body FROM (
SELECT *, coalesce(list_position(list_transform(parts, lambda p: lower(p) IN ('red', 'white', 'rose', 'rosé')), true), 0) AS pos FROM (
SELECT *, CASE WHEN coalesce(nullif({qty('url')}, 0), 1) = 1 THEN coalesce(nullif({qty('name')}, 0), 1) ELSE {qty('url')} END AS quantity,
  {vol} AS volume, {yr} AS year, CASE WHEN {gift} THEN 'gift_set' ELSE 'standard' END AS package_type,
  {name_clean('name')} AS name_clean, list_filter(list_transform(string_split(name, ' - '), lambda p: trim(p)), lambda p: p <> '') AS parts
FROM {source}))))"""


STOCK = "(trim(coalesce(in_stock, '')) = '' OR lower(trim(in_stock)) IN ('true','1','yes','y','in_stock','in stock','available'))"


def rating_url(x: str) -> str:
    """Item address without query, fragment and trailing slash."""
    return rf"nullif(regexp_replace(regexp_replace(trim({x}), '[?#].*$', ''), '/+$', ''), '')"
