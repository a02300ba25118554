import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 3000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, one id with two texts, and columns that clash with outputs."""
    line = "a passage of many words that several documents hold in full"
    rows = [(1, None), (2, ""), (3, LONG), (4, "one two three"), (4, "one two three"), (5, "é" * 50 + "\n" + line), (None, line), (None, None), (6, " \t\n"), (7, f"{line}\nmail a.b@c.example.org"), (7, f"x\n{line.upper()} ")]
    rows += [(k, f"start {k}\n  {line}\nend {k}") for k in range(8, 12)]
    return spark.createDataFrame([(a, t, "x", 1, 2) for a, t in rows], "doc_id long, text string, slot string, size int, row int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
