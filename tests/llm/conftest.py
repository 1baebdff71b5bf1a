import pytest

#: Columns of documents, and names the operators use themselves.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "key string, a int, b int, row string, id int, fp string, component_id int, "
          "lang_pred string, score string, digest string, line int, cut string")


def document_rows(pairs, lang=None):
    return [(i, t, lang, "s", None, "k", 1, 2, "r", 3, "f", 4, "l", "x", "d", 5, "c")
            for i, t in pairs]


@pytest.fixture
def documents(spark):
    def make(pairs, lang=None):
        return spark.createDataFrame(document_rows(pairs, lang), SCHEMA)
    return make


LONG = "the quick brown fox jumps over a lazy dog while many birds sing in old trees " * 3000
ODD = [
    (1, "the cat sat on the mat and the dog ran after it"), (2, None), (3, ""), (4, " \t\n "),
    (None, "a text without an id but with words"), (None, None), (6, LONG), (7, "one"),
    (1, "the cat sat on the mat and the dog ran after it"), (1, "the same id with another text"),
    (8, "12345 !!! ??? 67"), (9, "éa Ünï­ \U0001F600 Σας İx ‑ x\x1cy <|endoftext|> ▁ z"),
    (10, "mail me at a.b@c-d.org or 10.0.0.1, +1 (555) 010-9999; 4111 1111 1111 1111"),
    (11, "mail me at a.b@c-d.org or 10.0.0.1, +1 (555) 010-9999; 4111 1111 1111 1111")]


@pytest.fixture
def odd(documents):
    return documents(ODD, "en")


@pytest.fixture
def none(documents):
    return documents([])
