import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


# Names that operators use inside or add, as columns of the input.
CLASHES = (
    "score ids decoded language quality_score fingerprint component_id group sketch shard slot record _key _text _n "
    "_held _first _place _print _chosen row found word rare range guest key_ n"
).split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, repeated and very long texts, equal keys, clashing columns."""
    long = "eine sehr lange Zeile mit vielen Wörtern " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It was here.", "en"),
        (1, "The quick brown fox jumps over the lazy dog. It was here.", "en"),
        (2, "The quick brown fox jumps over the lazy dog. It was here.", None),
        (3, None, "de"),
        (4, "", "de"),
        (5, " \t\n ", "en"),
        (6, long, "de"),
        (7, "\u65e5\u672c\u8a9e <|endoftext|> 🙂 \x00 ..", "ja"),
        (None, "no key here at all, only a text", "en"),
        (None, "no key here at all, only a text", None),
        (8, "1234 5678 !!", None),
        (9, "the and of in to a", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in CLASHES:
        df = df.selectExpr("*", f"doc_id as `{name}`")
    return df.repartition(3)
