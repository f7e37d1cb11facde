"""Work that must not grow: partitions of small files, repeated expressions, contacts of the prefix join."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (loads the stand-ins)
from offerlens.functions.listing import prepare_listings, validation_struct
from offerlens.functions.metadata import split_struct
from offerlens.functions.pages import html_to_text
from offerlens.functions.similarity import page_match_confident, ratio_function
from offerlens.operators.cascade import canonical_index, exact_index, url_index
from offerlens.operators.prefixjoin import frequencies, similar_pairs, sized_combinations, with_ordered
from offerlens.operators.resolve import address_issues, best_suggestion, best_suggestions, candidate_words, rank_candidates, rank_readings, score_candidates, shared_readings, suggest_scores, suggestion_keys
from offerlens.registry.base import Inputs


def _uses(spark, column, word):
    """How often a function stands in the plan of one column."""
    df = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string").select(column.alias("x"))
    return df._jdf.queryExecution().analyzed().toString().count(word)


def test_small_tables_use_all_cores(spark, data):
    cores, i = spark.sparkContext.defaultParallelism, Inputs(spark, data)
    assert cores > 1
    for df in (i.part, i.listings, i.rating_base):
        assert df.rdd.getNumPartitions() >= cores


def test_costly_keys_are_bound_once(spark):
    c = F.col
    # Each folded key holds one translate.
    assert _uses(spark, page_match_confident(c("a"), c("b"), c("c")), "translate(") <= 10
    assert _uses(spark, address_issues(c("a"), c("b")), "split(") <= 9
    assert _uses(spark, validation_struct(c("a")), "split(") == 1
    assert _uses(spark, split_struct(c("a")), "split(") <= 2


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(14)]
    sets = {k: (rng.choice("xy"), sorted(rng.sample(words, rng.randint(0, 9)))) for k in range(160)}
    left, right = {k: v for k, v in sets.items() if k < 80}, {k: v for k, v in sets.items() if k >= 80}

    def table(rows, key):
        return spark.createDataFrame([(k, b, w) for k, (b, w) in rows.items()], f"{key} long, blk string, words array<string>")

    a, b = table(left, "lid"), table(right, "rid")
    freq = frequencies((a, "words"), (b, "words"))
    a, b = with_ordered(a, "lid", "words", freq), with_ordered(b, "rid", "words", freq)
    for t in (0.3, 0.6, 0.9):
        want = sorted(
            (i, j) for i, (p, v) in left.items() for j, (q, w) in right.items() if p == q and (v or w) and len(set(v) & set(w)) / len(set(v) | set(w)) >= t
        )
        assert sorted(tuple(r) for r in similar_pairs(a, b, "lid", "rid", t).collect()) == want


def test_frequent_words_alone_make_no_contact(spark):
    """Sets of eight that share their three most frequent words only are never brought together at 0.6."""
    rows = [(k, "", [f"own{k}_{n}" for n in range(5)] + ["red", "wine", "bottle"]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, blk string, words array<string>")
    sets = with_ordered(df, "id", "words", frequencies((df, "words")))
    keys = sized_combinations(sets, "id", [8], 0.6, True)
    assert keys.groupBy("kind", "key").count().agg(F.max("count")).first()[0] == 1


def test_cut_entities_stay(spark):
    """A title cut inside an entity ends in its first letters."""
    rows = [("a&amp;b&eacute;&#65;<p>cut&amp",), ("x&am",), ("&nosuch; &copyx; &amp;copy;",), (None,)]
    df = spark.createDataFrame(rows, "h string").select(html_to_text(F.col("h")))
    assert [r[0] for r in df.collect()] == ["a&bé" + "A\ncut&amp", "x&am", "&nosuch; &copyx; &copy;", None]


def test_ratio_equals_the_matcher():
    rng, ratio = random.Random(7), ratio_function()
    words = "large hot blue cold ring bolt plate domaine cantina pinot noir brut réserve 1995 750 ml the".split()
    for k in range(3000):
        if k % 2:
            a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 25))) for _ in "ab")
        else:
            a, b = (" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in "ab")
        b = b * 9 if k % 100 == 0 else b
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert ratio(None, "a") is None and ratio("a", None) is None


def test_pairs_repeat_no_work_of_their_sides(spark):
    """Scores of pairs read what was made per name and per page; they fold no text again."""
    df = spark.createDataFrame(
        [("1995 a b", "1995 A b", "https://x.example/w/1?year=1995", "q", ["a", "b"], ["a"], 1995, "")],
        "offer_name string, title string, url string, query string, target_tokens array<string>, producer_tokens array<string>, year int, color string",
    )
    count = lambda d: d._jdf.queryExecution().analyzed().toString().count("translate(")
    pages = candidate_words(df)
    assert count(score_candidates(pages)) == count(pages)
    assert score_candidates(pages).collect() == score_candidates(df).collect()
    both = suggestion_keys(suggestion_keys(df, "a", "offer_name"), "b", "title")
    assert count(suggest_scores(both, target="offer_name")) == count(both)
    assert suggest_scores(both, target="offer_name").collect() == suggest_scores(df, target="offer_name").collect()


def _below_an_aggregation(df, word):
    """Is an aggregation the source of the last expression of the plan that holds ``word``?"""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = lambda w: max(k for k, line in enumerate(lines) if w in line)
    return last(word) < last("Aggregate [")


def test_keys_are_made_once_per_distinct_name(spark, data):
    i = Inputs(spark, data)
    ratings = i.ratings
    for df in canonical_index(ratings):
        assert _below_an_aggregation(df, "translate(")
    names = ratings.select(F.explode(F.array("wine_name", "match_name")).alias("t")).filter("t is not null")
    for df, texts in ((exact_index(ratings), names), (url_index(ratings), ratings.selectExpr("url AS t").filter("t is not null"))):
        read = spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0])
        assert texts.select("t").distinct().count() <= read.count() < texts.count()
    assert _below_an_aggregation(prepare_listings(i.anchors), "standard bottle")


def test_a_late_row_of_a_repeated_name_wins(spark):
    """Rows come down to one per text and quality first: the best quality wins, then the last row."""
    rows = [(1, "A b", None, "4", "", "", "", ""), (2, "a B", None, "", "7", "", "u", "9"), (3, "A b", None, "4", "", "", "", ""), (4, "A b", "a-b", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "ord long, wine_name string, match_name string, rating string, num_ratings string, alt_num_ratings string, url string, price string")
    assert [tuple(r) for r in exact_index(df).collect()] == [("a b", 3)]


def test_suggestions_are_scored_only_where_they_can_win(spark, monkeypatch):
    """Bounds choose the same best suggestions, ties included, as scoring every pair; few pairs are scored."""
    from offerlens.operators import resolve

    rng = random.Random(11)
    words = ["rouge", "blanc", "maison", "clos", "vieilles", "vignes", "2001", "1999", "reserve", "cru", "noir", "saint"]
    names = [" ".join(rng.sample(words, rng.randint(2, 6))) for _ in range(25)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 7))) for _ in range(80)] + names[:5] + names[:5] + ["", "é"]
    rows = [(n, t, f"https://x.example/w/{r}" + ("?year=2001" if r % 3 else ""), r) for n in dict.fromkeys(names) for r, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "offer_name string, title string, url string, rank long")
    want = best_suggestion(suggest_scores(df, target="offer_name"), item="offer_name").select("offer_name", "title", "rank", "score").collect()
    scored, plain = [], resolve.suggest_scores

    def counted(pairs, **names):
        scored.append(pairs.count())
        return plain(pairs, **names)

    monkeypatch.setattr(resolve, "suggest_scores", counted)
    keyed = suggestion_keys(suggestion_keys(df, "a", "offer_name"), "b", "title")
    got = best_suggestions(keyed, item="offer_name").select("offer_name", "title", "rank", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want and sum(scored) < len(rows) / 4


def test_ranked_readings_equal_scoring_every_pair(spark, monkeypatch):
    """Pages that read alike are scored once and only where they can be among the two best; results and ties stay."""
    from offerlens.operators import resolve

    rng = random.Random(5)
    words = ["rouge", "maison", "clos", "vieilles", "vignes", "2001", "1999", "reserve", "cru", "noir", "saint", "orange"]
    names = [(k, t, [w for w in t if rng.random() < 0.3], rng.choice([None, 1999, 2001]), rng.choice(["", "orange"])) for k, t in enumerate(sorted(rng.sample(words, rng.randint(1, 6))) for _ in range(30))]
    # Producers that no page has put many scores at or below zero, where the sign is open.
    names += [(40, ["cru", "domaine", "inconnu", "tres", "vieux"], ["domaine"], 1950, ""), (41, [], [], None, ""), (42, ["ailleurs"], [], None, "")]
    titles = [" ".join(rng.sample(words, rng.randint(1, 7))) for _ in range(60)]
    titles += [t.upper() + " - 750 ml" for t in titles[:25]] + [t + " 12" for t in titles[:15]] + ["", "é", "cru 2001"]
    pages = spark.createDataFrame([(1000 - k, t, f"https://www.vivino.com/x/w/7?p={k}" + ("&year=2001" if k % 4 == 0 else ""), 0, "q", "p") for k, t in enumerate(titles)], "seen long, title string, url string, set long, query string, provider string")
    identities = spark.createDataFrame(names, "tid long, target_tokens array<string>, producer_tokens array<string>, year int, color string")
    want = rank_candidates(score_candidates(identities.crossJoin(pages)), item="tid").collect()
    scored, plain = [], resolve.score_candidates

    def counted(pairs):
        scored.append(pairs.count())
        return plain(pairs)

    monkeypatch.setattr(resolve, "score_candidates", counted)
    readings, first_pages = shared_readings(candidate_words(pages))
    met = identities.select("tid").crossJoin(readings.select("cid"))
    got = rank_readings(identities, readings.drop("set"), first_pages, met).select(*want[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 25
    assert readings.count() < len(titles) and sum(scored) < met.count() / 2


def test_queries_rank_names_as_every_pair_does(spark, data):
    """The ranking behind decisions and resolver outputs equals that of all search results, each scored."""
    from offerlens.registry.linkage import _ranked, _results_by_name

    i = Inputs(spark, data)
    want = rank_candidates(score_candidates(_results_by_name(i)), item="offer_name")
    got = _ranked(i).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_suggestions_write_no_texts_of_pairs(spark, data, monkeypatch):
    """Of a pair of name and page only ids and bound are written; the best suggestions equal those of scoring every pair."""
    from offerlens.operators import resolve
    from offerlens.registry.base import QUERIES
    from offerlens.registry.linkage import _offers_by_name, _results_by_name

    i = Inputs(spark, data)
    every = suggest_scores(_results_by_name(i).withColumnRenamed("seen", "rank"), target="offer_name")
    best = best_suggestion(every, item="offer_name").select("offer_name", "title", F.col("score").alias("want"))
    want = {r["item"]: (r["title"], round(r["want"], 4)) for r in _offers_by_name(i).join(best, "offer_name").collect()}
    written, plain = {}, resolve.materialize

    def seen(df, name):
        written[name] = df.dtypes
        return plain(df, name)

    monkeypatch.setattr(resolve, "materialize", seen)
    got = {r["item"]: (r["title"], round(r["score"], 4)) for r in QUERIES["j24_suggestion_scores"](spark, data).collect()}
    assert got == want and len(got) > 10
    for name in ("suggestion-bounds", "open-suggestions"):
        assert {kind for _, kind in written[name]} <= {"bigint", "int", "double"}


def test_names_that_read_alike_share_their_suggestion(spark):
    """Names and titles that differ in what keys leave out are scored once; the earliest page wins."""
    from offerlens.operators import resolve

    names = spark.createDataFrame([(k, f"2001 clos {k} noir", 0) for k in range(9)] + [(9, "1999 clos noir", 0)], "nid long, offer_name string, name_set long")
    titles = [(20 - k, f"2001 Clos {k + 20} Noir", f"https://x.example/w/{k}", 0) for k in range(8)] + [(30, "clos noir", "https://x.example/w/9?year=2001", 0)]
    pages = spark.createDataFrame(titles, "seen long, title string, url string, set long")
    tids, wanted, offered = resolve.suggestion_readings(names, pages)
    assert (wanted.count(), offered.count()) == (2, 2)
    pairs = wanted.select("tid").crossJoin(offered.select("seen"))
    got = tids.join(resolve.best_of_readings(wanted.drop("name_set"), offered.drop("set"), pairs, item="tid"), "tid").select("offer_name", "title", "score").collect()
    every = suggest_scores(names.crossJoin(pages).withColumnRenamed("seen", "rank"), target="offer_name")
    want = best_suggestion(every, item="offer_name").select("offer_name", "title", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 10
