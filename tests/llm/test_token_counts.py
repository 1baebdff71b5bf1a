import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from parleyframe.llm import token_counts
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = token_counts.PieceCounter(open(PATH, "rb").read())


def test_words_are_used():
    assert COUNTER.by_word


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAbtheé.,|1 \n\t▁🙂<s>\x00")), max_size=40))
def test_words_apart_have_the_count_of_the_whole_text(text):
    assert COUNTER([text]) == [len(LIBRARY.encode(text))]


def test_cache(documents, tmp_path):
    path = str(tmp_path / "cache")
    docs = documents(ODD)
    first = sorted(map(tuple, token_counts.count_tokens(docs, PATH, path, limit=20).collect()), key=repr)
    stored = token_counts.read_cache(docs.sparkSession, path)
    assert stored.count() == len({t or "" for _, t in ODD})
    more = documents([*ODD, (99, "a new text")])
    token_counts.count_tokens(more, PATH, path).collect()
    stored = token_counts.read_cache(docs.sparkSession, path)
    assert stored.count() == len({t or "" for _, t in ODD}) + 1
    expected = sorted(((
        i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 20)
        for i, t in ODD), key=repr)
    assert first == expected
    assert sorted(map(tuple, token_counts.count_tokens(docs, PATH, path, limit=20).collect()),
                  key=repr) == expected


def test_stored_counts_are_believed(documents, tmp_path):
    """A hit is not encoded again; another tokenizer's entry is no hit."""
    path, docs = str(tmp_path / "cache"), documents([(1, "some text")])
    token_counts.count_tokens(docs, PATH, path).collect()
    stored = token_counts.read_cache(docs.sparkSession, path).collect()
    other = str(tmp_path / "other")
    docs.sparkSession.createDataFrame(
        [(stored[0]["version"], stored[0]["digest"], 77), ("another", stored[0]["digest"], 5)],
        token_counts.CACHE).write.parquet(other)
    assert token_counts.count_tokens(docs, PATH, other).collect()[0]["n_tokens"] == 77


def test_empty_table(none, tmp_path):
    assert token_counts.count_tokens(none, PATH, str(tmp_path / "cache")).collect() == []
