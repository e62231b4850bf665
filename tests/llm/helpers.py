"""Small fixtures shared by the corpus tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba be bi bo da de di do ga ge gi go ka ke ki ko la le li lo ma me mi mo".split()


def prose(seed, n_words, width=3):
    """Invented words, in sentences."""
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, width))) for _ in range(n_words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Nulls, blanks, repeated rows, null ids: what every operator must get through.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (5, "é ü ñ 漢字 \U0001f600 x"), (6, "word " * 30000)]
