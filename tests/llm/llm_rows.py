"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, bucket int, shard int, fp string, words string, term string, spans string, kind int"


def make(spark, rows):
    """documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", 1, 2, 3, "f", "w", "t", "s", 4) for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé ñß") for _ in range(rng.randint(2, 7))).strip() or "q"
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(45)
    base = prose(120)
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "Two  words\r\nthree"), (6, base), (7, base), (7, base), (8, base.upper()), (9, prose(30) + " " + shared + " " + prose(20)), (10, shared + "\n" + prose(9))]
    rows += [(11, prose(60) + " " + shared[:80]), (12, "a" * 400), (13, "a" * 300 + " " + "ab " * 200), (14, prose(9000)), (None, shared), (None, None), (15, base[:-9] + "xyz"), (16, "\x00\x01 \x1c \x85 　 <|endoftext|> 'S it's"), (17, "İ H̱ Σς " + shared)]
    return rows
