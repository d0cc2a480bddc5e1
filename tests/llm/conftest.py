import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of ``(doc_id, text[, lang])`` tuples with an extra, clashing set of columns on request."""
    def make(rows, extra=False):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("score", "key", "own", "row", "words", "kept", "id", "cid", "component", "t", "length", "page_id", "quality"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def prose():
    """Reproducible sentences of made-up words."""
    import random

    def make(seed, n, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
    return make
