import pytest
from helpers import SCHEMA


@pytest.fixture
def docs(spark):
    """docs(texts, **columns): texts, or (doc_id, text) pairs, as documents."""

    def make(texts, langs=None):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, langs[k] if langs else None, "s", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)

    return make


@pytest.fixture
def odd(docs):
    """Null, empty and wordless texts, a long one, null ids, equal rows, and clashing extra columns."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "?! ..."), (5, "ab cd " * 60_000), (None, "one two three"), (None, None), (6, "one two three"), (6, "one two three"), (7, "x" * 100_000), (8, "😀 é ß ▁ 中文 \x00 a")]
    d = docs(rows)
    for c in ("_key", "_n", "_p", "_sha", "_block", "keep_id", "toxic", "toxicity", "token_ids", "n_tokens", "round_trip", "item_id", "score", "seed", "band", "id", "label", "root", "u", "v"):
        d = d.withColumn(c, F.lit("own"))
    return d


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
