import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old oak tree near the river bank and sing about rain"


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows."""
    def make(rows, extra: bool = False, parts: int = 3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use for themselves
            from pyspark.sql import functions as F

            for name in ("row", "fp", "key", "size", "spans", "blob", "bad", "kept", "start", "h", "shard", "d", "t", "label", "score", "words"):
                df = df.withColumn(name, F.lit("other"))
        return df.repartition(parts)

    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a very long text."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    return [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE + " extra tail of words"), (None, None),
        (6, long_text), (7, "one"), (8, "two words"), (9, "Ünïcode wörds — ñandú 日本語 " * 5), (10, PROSE.upper()),
    ]
