import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use themselves.
CLASHING = ("row", "id", "text2", "bucket", "doc", "content", "fp", "h", "part", "size", "key", "kind", "rest", "rate")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) or (id, text, source), with further columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        df = df.repartition(parts) if full else df
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return make


@pytest.fixture(scope="session")
def texts():
    """Odd texts: missing, empty, blank, many alphabets, special strings, very long."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdéßñ漢x") for _ in range(r.randint(1, 8))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    return [
        None, "", " ", "\n\n", "a", "one two", "a  b \n c\t\td ", "x" * 5000, "<|endoftext|> a <|endoftext|>b",
        "don't won't 'tis 12.5% né!! ½ ²\r\n end\u2003.", "e\u0301 \u0085 \xa0 \u200b😀😀", long, long, "Wörter. " * 700,
        *(" ".join(r.choice(words) + r.choice(["", ".", ",\n", "!!"]) for _ in range(r.randint(1, 400))) for _ in range(40)),
    ]
