"""DuckDB SQL of the operators that SQL can express, written independently of the Spark code."""

from __future__ import annotations

from offerlens.llm.quality_rules import STOP_FORMS
from offerlens.llm.url_filter import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ---- op3: rules, then beta-binomial shrinkage from corpus to suffix, domain and host --------

_FITS = "((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{start}'))"


def _rule(field: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    cases = " ".join("WHEN " + _FITS.format(host=r[1].split("/")[0], start=r[1].split("/", 1)[1]) + f" THEN '{r[field]}'" for r in ordered)
    return f"CASE {cases} END"


_LONG = "array_to_string(p[-2:], '.') IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz')"


def _strength(level: str) -> str:
    """Prior strength of the children in ``level`` (n, k and the parent's mean m), between 2 and 2000."""
    return f"""(SELECT CASE WHEN coalesce(room, 0) = 0 OR over_ / room <= 0 THEN 2000.0 ELSE least(greatest((1 - over_ / room) / (over_ / room), 2.0), 2000.0) END
  FROM (SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) AS over_, sum(n * (n - 1) * m * (1 - m)) AS room FROM {level} WHERE n > 0))"""


OP3 = f"""WITH seen AS (SELECT doc_id AS id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS k FROM labels
    WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
  cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
  hosts AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS p FROM p LEFT JOIN seen ON id = page_id GROUP BY host),
  h AS (SELECT host, n, k, CASE WHEN {_LONG} THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix, CASE WHEN {_LONG} THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM hosts),
  s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (1.0 + sum(k)) / (2.0 + sum(n)) FROM h) AS m FROM h GROUP BY suffix),
  s AS (SELECT suffix, (k + c * m) / (n + c) AS mean FROM (SELECT *, {_strength('s0')} AS c FROM s0)),
  d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS m FROM h JOIN s USING (suffix) GROUP BY domain),
  d AS (SELECT domain, (k + c * m) / (n + c) AS mean FROM (SELECT *, {_strength('d0')} AS c FROM d0)),
  h0 AS (SELECT host, n, k, mean AS m FROM h JOIN d USING (domain)),
  b AS (SELECT host, (k + c * m) / (n + c) AS mean, n + c AS size FROM (SELECT *, {_strength('h0')} AS c FROM h0))
SELECT page_id, host, path, {_rule(1)} AS rule,
  coalesce({_rule(0)}, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict FROM p LEFT JOIN b USING (host)"""

# ---- op4 -----------------------------------------------------------------------------------

_GAP = r"\x20\x09-\x0D"
_QUOTED = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
OP4 = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^{_GAP}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_GAP}]')) AS ls FROM t),
  g AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
  twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
  rep AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM twice WHERE n > 1) GROUP BY r),
  c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, greatest(len(ws), 1) AS n, greatest(len(ls), 1) AS l,
    len(regexp_extract_all(t, '[^\pL\pN{_GAP}.,;:''"-]')) AS marks, len(regexp_extract_all(t, '\p{{Lu}}{{3,}}')) AS uppers, len(list_filter(ws, lambda x: x IN ({_QUOTED}))) AS stops,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[{_GAP}]*[-*•+][{_GAP}]'))) AS bullets, len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS ellipses
    FROM w LEFT JOIN rep USING (r)),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n BETWEEN 2 AND 14 AND n_symbols / n <= 0.3 AND marks / n <= 0.6
  AND stops / n >= 0.02 AND uppers / n <= 0.4 AND n_dup_lines / l <= 0.4 AND n_repeat_words / n <= 0.3 AND bullets / l <= 0.9 AND ellipses / l <= 0.3 AS kept FROM f"""

# ---- op8 -----------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
  win AS (SELECT DISTINCT item, w[i:i + least(10, len(w)) - 1] AS g FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
  placed AS (SELECT r, n, i, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT len(g) AS n FROM win) WHERE len(w) >= n)),
  hit AS (SELECT r, i, n, item FROM placed JOIN win USING (g)),
  hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
  hi AS (SELECT r, list_sort(list_distinct(list(item))) AS items FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""

OP12 = """
WITH RECURSIVE coded AS (
  SELECT row_number() OVER () AS row_no, doc_id, lang,
         CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END
         || CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END
         || CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END AS head,
         n_chars,
         CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS tail,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN other ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS pos
  FROM (SELECT *, sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END, tail)) AS leaf,
               sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1) END, tail)) AS other
        FROM coded)
), levels AS (
  SELECT lang, 0 AS level, pos AS spot, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, spot // 2, sha256(string_agg(digest, '' ORDER BY spot)), any_value((n + 1) // 2)
  FROM levels WHERE n > 1 GROUP BY lang, level, spot // 2
), subroots AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos AS spot, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, spot // 2, sha256(string_agg(digest, '' ORDER BY spot)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, spot // 2
), steps AS (
  SELECT l.lang, l.pos, v.level, (l.pos >> v.level) % 2 = 1 AS is_right, coalesce(s.digest, '') AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM levels WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = v.level AND s.spot = xor(l.pos >> v.level, 1)
  UNION ALL
  SELECT l.lang, l.pos, r.height + v.level, (r.pos >> v.level) % 2 = 1, coalesce(s.digest, '')
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) v
  LEFT JOIN tops s ON s.level = v.level AND s.spot = xor(r.pos >> v.level, 1)
), proofs AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, l.shown,
         coalesce(string_agg(s.sibling, '' ORDER BY s.level), '') AS proof,
         list_prepend({'r': false, 's': l.shown}, coalesce(list({'r': s.is_right, 's': s.sibling} ORDER BY s.level) FILTER (s.level IS NOT NULL), [])) AS way
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos
  GROUP BY l.lang, l.pos, l.doc_id, l.leaf, r.subroot, l.shown
), checked AS (
  SELECT *, list_reduce(way, lambda acc, x: {'r': false, 's': sha256(CASE WHEN x.r THEN concat(x.s, acc.s) ELSE concat(acc.s, x.s) END)}).s AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM checked
"""

OP13 = """
WITH whole AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
         coalesce(CAST(list_sum(list_transform(list_zip(q.cells, c.cells), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT), 0) AS score
  FROM whole q JOIN whole c ON q.row_no <> c.row_no
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
