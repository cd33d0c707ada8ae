"""A small table with everything that an operator must stand: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key long, node long, _text string, words string, predicted int"
LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(40_000))
BASE = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brews near the old river bank today"


def documents(spark):
    extra = (0.5, "x", 1, 2, "t", "w", 3)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \t\n ", "en", None, 3), (4, LONG, "en", "a", len(LONG)), (5, BASE, "en", "b", 10), (6, BASE, "de", "b", 10), (6, BASE, "de", "b", 10),
        (7, BASE + " again", None, None, None), (None, BASE, "en", "a", 1), (None, None, None, None, None), (8, "ünï cödé ΣΑΣ 🎉 <|endoftext|> x", "fr", "c", 9), (9, "one", "en", "c", 3),
        (10, "line a\nline a\nline b\n\nline a", "en", "c", 9), (10, "other text under one id", "en", "c", 9),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def sample(spark, n=300):
    """The first n documents of the sample tables, and labels."""
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
