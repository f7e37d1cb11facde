"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is one measured ratio with a lower and an upper bound.  ``measure`` adds the base counts
and the ratios, ``verdict`` turns the table into one boolean column.  Only built-in column functions
run, each row on its own: no shuffle and no state.

Defined results: a null text counts as the empty one (no words, no lines, so ``base_failed``);
repeated rows are judged one by one; an empty table gives an empty result; columns of the input that
clash with result columns are left behind, because only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern and the counted symbols.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "are", "this", "or", "an", "at", "from", "a",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "et", "un", "une", "que", "dans", "pour", "du", "qui", "par", "sur", "pas", "au", "plus", "elle", "il", "ce", "de",
    "el", "los", "y", "del", "se", "las", "por", "con", "no", "su", "para", "al", "lo", "más", "como", "o", "pero", "sus", "una", "en",
)

#: As they stand in running text: small, with a capital, or before a comma or full stop.
STOP_FORMS = tuple(form + end for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())) for end in ("", ",", "."))

#: ratio, least, most (None: open).  A text is kept if every ratio lies within its bounds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.3),
    ("marks_per_word", None, 0.6),
    ("stop_word_share", 0.02, None),
    ("upper_word_share", None, 0.4),
    ("dup_line_share", None, 0.4),
    ("repeat_word_share", None, 0.3),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def repeat_words(ws: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included.

    Texts whose window hashes all differ are settled at once.  In the others, hashes are sorted with
    their positions, so equal windows stand next to each other; neighbours are compared word by word
    and the covered words counted in one walk over the starts in order.
    """
    shifted = F.arrays_zip(*[(F.slice(ws, k + 1, F.size(ws)) if k else ws).alias(f"w{k}") for k in range(size)])
    windows = F.slice(shifted, F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(0)))
    hashes = F.transform(windows, lambda w: F.xxhash64(w))

    def repeated(placed: Column) -> Column:
        def same(a, j):
            b = F.get(placed, j)
            return F.coalesce((a["h"] == b["h"]) & (F.slice(ws, a["i"] + 1, size) == F.slice(ws, b["i"] + 1, size)), F.lit(False))

        return F.sort_array(F.transform(F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + size - F.greatest(acc["end"], i)).alias("n"), (i + size).alias("end")),
            lambda acc: acc["n"],
        )

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(bind(placed, repeated)))

    return bind(hashes, count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, base counts and the ratios that the table names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(text).alias("ws"))
    counted = base.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        repeat_words(F.col("ws")).alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\s.,;:'\"-]")).alias("marks"),
        F.size(F.filter("ws", lambda w: w.isin(*STOP_FORMS))).alias("stops"),
        F.regexp_count("t", F.lit(r"\p{Lu}{3,}")).alias("uppers"),
        bind(lines_with_words(F.col("t")), lambda x: F.struct(
            F.size(x).alias("lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeats"),
            F.size(F.filter(x, lambda y: y.rlike(r"^\s*[-*•+]\s"))).alias("bullets"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("ellipses"),
        )).alias("l"),
    )
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("l.lines"), F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "marks_per_word": F.col("marks") / n,
        "stop_word_share": F.col("stops") / n,
        "upper_word_share": F.col("uppers") / n,
        "dup_line_share": F.col("l.repeats") / lines,
        "repeat_word_share": F.col("n_repeat_words") / n,
        "bullet_line_share": F.col("l.bullets") / lines,
        "ellipsis_line_share": F.col("l.ellipses") / lines,
    }
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("l.repeats").alias("n_dup_lines"), "n_repeat_words", base_failed.alias("base_failed"), *[v.alias(k) for k, v in ratios.items()]
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one condition: true if every ratio lies within its bounds."""
    ok = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Base counts and the verdict ``kept`` of every row."""
    kept = ~F.col("base_failed") & verdict(thresholds)
    return measure(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[t[0] for t in thresholds]
    )
