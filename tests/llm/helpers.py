"""Invented prose, and the columns of documents."""

WORDS = "river stone lamp window garden paper bridge winter candle orange silver market forest letter mirror pocket summer ladder engine harbor violin copper meadow basket tunnel saddle planet feather thunder marble".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.integers(100)) * (r.random() < 0.3) for _ in range(n))
