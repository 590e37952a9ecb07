import pytest

#: null and empty texts, repeated rows, ties, white space of all kinds, a long text
TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "Same line that many hold.\nown line number one",
    "same LINE that many hold.  \n\tshort\nshort",
    "Same line that many hold.\nown line number one",
    "éèà ünïcode lettres — same line\r\nSame line that many hold.",
    "tab\tand  double  blanks \n and trailing ",
    "a <|endoftext|> spelled out",
    "0123 4567 !!! ???",
    "▁ blank sign and 日本語 text 🎉",
    "It is. It was! Will it be? " * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """TEXTS with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i}", 1, "x") for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], "en", "again", 1, "x"), (None, "Same line that many hold.", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, _text string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
