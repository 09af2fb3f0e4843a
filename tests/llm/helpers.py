"""Small tables with all that may go wrong: nulls, repeats, ties, long and empty texts, and columns of clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, `order` int, trigger long, _row string, doc long"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); other columns hold rubbish under names that operators use inside."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *("en", "src0")[len(r) - 2 :]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), 7, "k", None, 1, 2, "r", 3))
    return spark.createDataFrame(full, SCHEMA)


def prose(n, seed=0, words=("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "epsilon")):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
