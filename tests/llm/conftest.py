import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h int, score string, rest string, copy int"
BASE = " ".join(f"w{i}" for i in range(60))


def row(i, text, lang="en", source="s", score="clash"):
    return (i, text, lang, source, len(text or ""), "k", 1, score, "r", 5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, long and repeated texts, ties, repeated rows, clashing column names."""
    rows = [
        row(1, BASE), row(2, BASE), row(3, BASE + " tail"), row(4, None), row(5, ""), row(6, "   \n\t"), row(7, "one two"), row(8, "one two"), row(9, "ONE two"),
        row(10, ("lorem ipsum " + BASE + " ") * 400), row(11, "é" * 500), row(12, "é" * 500), row(13, "a" * 5000), row(None, BASE), row(14, BASE, None, None), row(14, BASE, None, None),
        row(15, "x " * 300), row(16, "\u0000 weird \u00a0 spaces\u2003here"), row(17, BASE.replace("w30", "q")),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
