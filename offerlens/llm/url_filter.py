"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) are counted per host and shrunk through beta-binomial priors:
the corpus mean is the prior of a suffix, the suffix that of its registered domains, the domain that
of its hosts.  The strength of each prior is estimated by moments from the spread of the children.  A
host passes if the lower bound of its posterior reaches the threshold.

Everything is column functions, aggregations with map-side partial sums (a host that holds a third of
all pages combines before the shuffle) and equality joins on the host, which AQE splits when skewed.
Counts per host are written once and all levels come from that table, so pages are scanned twice: for
the counts and for the verdicts.  The driver sees one row of sums per level, never hosts or pages.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the
verdict of the empty host; ids without a label add no outcome; several labels of an id count one by
one towards the reputation but never multiply pages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.session import materialize

#: The rules of the registered query, (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Public suffixes of more than one label that the registered domain steps over.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain: the suffix with one label before it."""
    name = F.regexp_replace(host, r":\d*$", "")
    long = F.substring_index(name, ".", -2).isin(*long_suffixes)
    suffix = F.when(long, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame, least: float, most: float) -> float:
    """Prior strength by moments: how much more the children vary than chance about their parents' means."""
    spare = F.col("m") * (1 - F.col("m"))
    sums = children.filter("n > 0").agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * spare).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spare).alias("room"),
    ).first()
    if not sums["room"]:
        return most
    rho = (sums["over"] or 0.0) / sums["room"]
    return most if rho <= 0 else min(max((1 - rho) / rho, least), most)


def reputation(hosts: DataFrame, z: float = 1.645, strength: tuple[float, float] = (2.0, 2000.0)) -> DataFrame:
    """Posterior of each host from ``host, n, k`` (outcomes and good ones): adds ``mean`` and ``bound``."""
    suffix, domain = registered_domain(F.col("host"))
    h = hosts.select("host", "n", "k", suffix.alias("suffix"), domain.alias("domain"))
    domains = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (1.0 + (total["k"] or 0)) / (2.0 + (total["n"] or 0))

    def shrunk(level: DataFrame) -> DataFrame:
        kappa = _strength(level, *strength)
        return level.withColumns({"a": F.col("k") + kappa * F.col("m"), "b": F.col("n") - F.col("k") + kappa * (1 - F.col("m"))})

    parent = lambda level, name: level.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    s = shrunk(suffixes.withColumn("m", F.lit(mean)))
    d = shrunk(domains.join(parent(s, "suffix"), "suffix"))
    out = shrunk(h.join(parent(d, "domain"), "domain"))
    size = F.col("a") + F.col("b")
    m = F.col("a") / size
    return out.select("host", "n", "k", m.alias("mean"), (m - z * F.sqrt(m * (1 - m) / (size + 1))).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.6, z: float = 1.645
) -> DataFrame:
    """Host, path, rule and verdict of every page.

    ``outcomes`` has ``page_id`` and ``good`` (0 or 1).
    """
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    counts = p.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")
    )
    bound = reputation(materialize(counts, "host-counts"), z).select("host", "bound")  # all levels read one small table
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return p.join(bound, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bound", 6).alias("bound")
    )
