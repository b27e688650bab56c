import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASHES = ["row", "m", "b", "h", "size", "host", "n", "u", "taken", "label", "node", "kept", "shard", "n_words", "a.b", "rid", "whole", "copy"]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    base = "the quick brown fox jumps over a lazy dog while seven wizards watch from the hill and nobody says a word about it".split()
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    near = base.copy()
    near[-1] = "them"
    return [
        (1, " ".join(base), "en", "a", 5), (2, " ".join(base), "en", "a", 5), (2, " ".join(base), "en", "a", 5),
        (3, " ".join(near), None, "b", None), (4, "", "en", "b", 0), (5, None, "en", None, None), (None, "Only null id here, licensed under the MIT License.", "de", None, 3),
        (None, None, None, None, None), (6, long, "en", "a", 7), (7, "one two", "fr", "c", 1), (8, "one two", "fr", "c", 1), (9, " \n\t\n ", "fr", "ç", 1),
        (10, "Zeile 1 ist hier eine ganz normale Zeile mit Text\nzwei\nZeile 1 ist hier eine ganz normale Zeile mit Tex\nzwei", "de", "c", 2),
        (11, "Zeile 2 ist hier eine ganz normale Zeile mit Text\n" + "ab " * 30, "de", "c", 2), (-4, "über straße 中文 🙂 a", "xx", "b", 9),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same, with extra columns of clashing names."""
    schema = DOCS + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
