import pytest
from llm_data import SF_MID




@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null and repeated ids, null, empty and long texts, and
    columns named like the operators' own."""
    long = "word" + " lorem ipsum dolor sit amet" * 30_000
    rows = [
        (1, "alpha beta gamma delta epsilon", "en"), (1, "alpha beta gamma delta epsilon", "en"), (2, None, None),
        (3, "", "en"), (None, "alpha beta gamma delta epsilon", "en"), (None, None, None), (4, long, "en"), (5, long, "en"),
        (6, "İstanbul Été 한국어 \U0001f600 é", "xx"), (7, "  \n\t ", "en"),
        (8, "secret=hunter2x <|endoftext|> token: abc", "en"), (9, "x" * 5_000, "en"),
    ]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids int, ik string, pos string"
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "f", 1, "k", "p") for i, t, lang in rows], ddl)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
