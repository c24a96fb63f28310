import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ",", str(rng.randrange(50)))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rng = random.Random(3)
    long_text = sentence(rng, 60_000)
    texts = [None, "", " \n\t ", "one", "one", "ONE two", long_text, "é ü \U0001f600 x", "a\n\nb\na\nb", sentence(rng, 80)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[6], (None, None, None, None, None), (None, sentence(rng, 70), None, "s", 5), (77, sentence(rng, 60), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for c in ("spans", "items", "row", "key", "id", "n", "component", "label", "score", "drop", "block", "slot", "kept", "kept_id", "low", "before", "removed"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
