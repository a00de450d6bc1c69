"""Small frames with every awkward row: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "label string, size int, token long, set_key long, target int, n_words string, kept string, "
    "piece int, length int, rank int, a int, b int, first int, measure string"
)
CLASHES = SCHEMA.count(",") + 1 - 5


def prose(seed: int, words: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(words)]


def edge_rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 400)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:60], *prose(3, 60)]
    text = " ".join
    shared = "A line that several documents share, long enough."
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t \x0b", None, None),
        (4, "Only Two", "en", None),
        (5, text(base), "en", "a"),
        (5, text(base), "en", "a"),
        (5, text(prose(9, 80)), "en", "a"),
        (6, text(near), "en", "b"),
        (7, text(base).upper(), "de", "b"),
        (8, "\n".join([text(other[:200]), shared, text(other[200:])]), "de", "b"),
        (9, f"{shared}\n{shared}\nshort\n  {shared.upper()}  \nshort", "de", ""),
        (10, f"own line of ten\n\n{shared}\n" + text(far), None, "b"),
        (11, text(prose(5, 30) * 400), "fr", "c"),
        (12, "é" * 30 + " x   Ünïcode ẞ İ <b>&amp;</b> #*$%&|<>" + " 𝒳😀" * 60, "fr", "c"),
        (13, "x" * 20_000, "fr", "c"),
        (14, "und " * 500, "de", "c"),
        (None, text(base), "en", "a"),
        (None, "nobody knows this document", None, None),
        (15, "Only Two", "en", "a"),
        (16, "only two", "en", "a"),
        (17, "###%%% $$$ " * 40, "en", "a"),
    ]


def edge_docs(spark, rows: list[tuple] | None = None):
    """``doc_id, text, lang, source, n_chars`` and extra columns whose names operators use too."""
    rows = edge_rows() if rows is None else rows
    full = [
        (*r, len(r[1] or ""), *["x" if " string" in c else 7 for c in SCHEMA.split(", ")[5:]])
        for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def documents(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
