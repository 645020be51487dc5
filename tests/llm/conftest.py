import pytest

#: Rows as operators may meet them: null and empty texts, a null id, repeated rows, ties, a very long text.
EDGES = [(None, "no id at all, but some words to read"), (1, None), (2, ""), (3, "a"), (4, "a b c d e f g h"), (4, "a b c d e f g h"),
         (5, "  \n\t  \n"), (6, "Zürich – 東京 😀 ǅ 12"), (7, "word " * 40_000), (8, "x" * 70_000), (9, "one\ntwo\nthree\nfour\nfive\nsix"),
         (10, "one\ntwo\nthree\nfour\nfive\nsix"), (9, "another text of the same id")]

#: Names that operators use within, as columns of the user's.
CLASHES = "t struct<a:int>, fp string, gone string, _key string, _cut string, _t string, `a.b` string, row string, score string, n string"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with further columns that clash with names used within."""
    extra = (None, "fp", "gone", "key", "cut", "t", "dot", "row", "score", "n")
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), *extra) for i, t in EDGES],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def texts(spark):
    from tests.conftest import DATA
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
