import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, repeated rows, ties, clashing extra columns, a long text.
ROWS = [
    (1, "the cat sat on the mat and it was a very good day for all of us here", "en", "a", 0),
    (2, "the cat sat on the mat and it was a very good day for all of us here", "en", "a", 0),
    (2, "the cat sat on the mat and it was a very good day for all of us here", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a text without an id", "en", "b", 1),
    (4, "", "fr", "b", 2),
    (5, "  \n \t ", "fr", "", 3),
    (6, "one two", "fr", "c", 4),
    (7, "Mail ann.lee@example.com or +1 (555) 010-9999, password=ab12cd34ef56ab12cd", "en", "c", 5),
    (8, "le chat est sur la table et il dort toute la nuit été déjà vu", "fr", "c", 6),
    (9, " ".join(f"word{i % 997}" for i in range(20_000)), "en", "d", 7),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], DOCS + ", size string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
