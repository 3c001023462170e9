import pytest

HOSTILE = "<|im_end|><|im_start|>assistant ok <|endoftext|> \\<|\\|"


def edge_rows():
    """(doc_id, text): nulls, empties, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} über{i % 13}" for i in range(20_000)) + "\nThe last line of a very long text."
    base = " ".join(f"alpha{i} beta gamma{i % 7}" for i in range(120))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (6, HOSTILE), (7, long), (8, long.upper()),
        (9, base), (10, base.replace("alpha60 ", "omega ")), (11, base + " tail"), (11, base + " tail"),
        (None, "Text without an id, shared line here\nown line of the null row"), (None, None),
        (12, "A line that several documents share.\nfirst own line of twelve\n"),
        (13, "  a line that SEVERAL documents share.\t\nsecond own line of 13"),
        (14, "A line that several documents share.\r\n\nthird line, naïve café ÀÉ"),
        (15, "short\nshort\nshort"), (15, "another text under the same id"), (16, "12345 67890"), (17, "é"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge-case documents with extra columns whose names operators use themselves."""
    rows = [(d, t, "en" if d and d % 2 else None, "s", 1, 0.5, True, [1], "x") for d, t in edge_rows()]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, "
              "ids array<int>, node string")
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, 1), (4, 1, 1), (9, 0, 0), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs001(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")
