"""Rows that every corpus operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, th string, size double, score string, fp string, rank int, name string, _id string, _th long, _p int, row int, found string, lang_pred string, `a.b` string"

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))

TEXTS = [
    "The quick brown fox jumps over the lazy dog while 3 old men watch from the hill and say nothing at all",
    "The quick brown fox jumps over the lazy dog while 3 old men watch from the hill and say nothing at all",
    "the QUICK brown fox jumps over the lazy dog while 3 old men watch from the hill and say nothing at all",
    None,
    "",
    "   \t\n ",
    "one",
    "42 17 !!",
    "Released under the MIT License. cc by nc, CC BY-NC apache license version 2",
    "ein kurzer deutscher Satz mit einigen Wörtern und noch etwas mehr",
    "na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na na",
    LONG,
]


def document_rows():
    rows = []
    for i, text in enumerate(TEXTS):
        lang = None if i % 5 == 4 else ("de" if text and "ein " in text else "en")
        source = None if i % 4 == 3 else f"s{i % 3}"
        rows.append((i, text, lang, source, len(text or ""), 7, "x", 0.5, "s", "f", 1, "n", "u", 2, 3, 4, "v", "w", "z"))
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a text without an id that is long enough to have some shingles in it", "en", None, 3, 7, "x", 0.5, "s", "f", 1, "n", "u", 2, 3, 4, "v", "w", "z"))
    rows.append((None,) * 19)
    return rows
