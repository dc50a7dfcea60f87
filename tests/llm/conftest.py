import random

import pytest
from pyspark.sql import functions as F

WORDS = ["ein", "the", "Über", "café", "data", "mit", "naïve", "x1", "of", "日本", "and", "zu", "run", "tree", "42"]


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, source: nulls, empties, a long text, ties, copies, near copies, repeated rows."""
    rng = random.Random(7)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    out += [(100 + i, base[i], "s1") for i in range(5)]                                   # copies
    out += [(200 + i, base[i] + " extra", None) for i in range(5)]
    out += [(300, None, "s1"), (301, "", None), (None, "no id here", "s2"), (None, None, None), (302, " \n\t ", "s0")]
    out += [(303, "long " * 30000 + "end", "s3"), (304, "x" * 20000, "s3"), (305, "same same", "s1"), (305, "same same", "s1")]
    out += [(305, "same id, other text", "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with the columns of documents and others whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "score", "row", "fp", "k", "n", "size", "root", "target", "copies", "m", "w", "h", "others", "spans", "bucket", "part"):
        df = df.withColumn(c, F.lit(1))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _, _ in rows if i is not None and i < 40] + [(None, 1, 0), (3, None, 0)],
                                 "doc_id long, quality int, toxic int")
