import pytest

SF = "/root/testdata/sf0.001"

#: Null, empty and blank texts, ties, repeated rows and keys, long words, and columns whose names operators also use.
EDGE_TEXTS = [None, "", "   ", "\n\t", "one", "One  two", "One  two", "é ﬁ ① 日本 語 😀", "a " * 300, "x" * 5000, "THE the tHe and,and. 12 #$% 'tis it's", "\x00\x1c\x85\xa0\u2581 y", "l1 a b\nl1 a b\nl1 a b", "<|endoftext|> mid<|endoftext|>dle"]
EDGE_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, fp string, label string, component_id string, range string, `size` string"


def edge_rows():
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(5, "One  two"), (None, "null key text here"), (None, None)]
    return [(i, t, None if i == 3 else "en", None, None, "k", "fp", "l", "c", "r", "s") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EDGE_DDL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_DDL)
