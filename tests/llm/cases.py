"""Rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row int, w string"

#: Null, empty, blank, one word, repeated rows, a null id, odd white space, and a very long text.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Two words"), (5, "Two words"), (None, "no id here at all"), (6, "x" * 20000),
    (7, "naïve ÉTÉ — 日本語 🙂 a\x1cb"), (8, "same line\nsame line\nsame line\n\nother"), (9, "lorem ipsum " * 9000), (10, "▁ marks ▁▁ and  two  spaces "),
]


def with_columns(rows):
    """Rows of (id, text) with further columns, some named like columns the operators make themselves."""
    return [(i, t, "en", "s", len(t or ""), "h", 1, "w") for i, t in rows]
