import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(pairs, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, words string, `kept` string, mix_rate string"
        data = [(i, t, more.get("lang"), more.get("source", "s0"), None if t is None else len(t), "x", None, "y", "z") for i, t in pairs]
        return spark.createDataFrame(data, schema)

    return make


#: Nulls, empty texts, white space, repeated rows, ties and a long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (6, "a b c d e f g h " * 5),
    (7, "line\nline\nline"), (8, "émigré ß ﬁ 東京 😀 <|endoftext|> <|ENDOFTEXT|>"), (9, "word " * 30_000), (None, None),
]
