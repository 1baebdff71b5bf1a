import pathlib
import string

import numpy as np
from pyspark.sql import functions as F

from parleyframe.llm import language
from tests.llm.conftest import LONG, ODD

FOLDER = "/root/testdata/sf0.001"


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], units=3, seed=1)
    x, sizes, _ = language.pieces_of(["some text", "another, longer one", "ä"])
    label = np.array([0, 2, 1])
    mask = (np.arange(language.PIECE)[:, None] < sizes).astype(np.float32)

    def loss():
        chances, _ = net.positions(x, mask)
        return -(np.log(chances[:, label, np.arange(3)]) * mask).sum() / mask.sum()

    for weight, grad in zip(net.weights(), net.gradients(x, mask, label)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = weight[at], 1e-2
        weight[at] = old + step
        up = loss()
        weight[at] = old - step
        down = loss()
        weight[at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 0.02 * abs(grad[at]) + 1e-4


def test_pooling_step_by_step_is_the_same():
    net = language.Network(["a", "b"], units=4)
    texts = ["short", LONG[:1000], "", "ñandú " * 50]
    x, sizes, owner = language.pieces_of(texts)
    mask = (np.arange(language.PIECE)[:, None] < sizes).astype(np.float32)
    chances, _ = net.positions(x, mask)
    sums = np.einsum("tln,tn->nl", chances, mask)
    expected = np.zeros((4, 2))
    np.add.at(expected, owner, sums)
    lengths = np.array([max(1, len(t.encode())) for t in texts])
    assert np.allclose(net.predict(texts), expected / lengths[:, None], atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.identify(docs, steps=80, batch=96).join(
        docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(odd):
    rows = language.identify(odd, steps=2, batch=8).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        if row["doc_id"] in (2, 3, 4, 8):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        elif row["doc_id"] is not None:
            assert row["lang_pred"] == "en"
        assert row["held_out"] is not None
    kept = language.keep_identified(odd, steps=2, batch=8)
    assert kept.columns == odd.columns
    assert language.keep_identified(odd.limit(0)).collect() == []
    assert {2, 3, 4, 8}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_nothing_to_learn(documents, none):
    rows = language.identify(documents([(1, "text without a label")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert language.identify(none).collect() == []


def test_noise_is_rejected_and_languages_are_kept(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where(language.held_out(F.col("doc_id")) & (F.length("text") > 0))
    network = language.fit(docs, **language.WITH_NOISE)

    def kept(table):
        rows = language.with_language(table.select("text"), network).collect()
        return np.mean([r["lang_pred"] != "und" and r["score"] >= 0.3 for r in rows])

    assert held.count() > 200 and kept(held) == 1
    rng = np.random.default_rng(0)

    def random_words(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(150))

    random = [random_words("abcdefghijklmnopqrstuvwxyz") for _ in range(30)]
    coded = [random_words(string.ascii_letters + string.digits + "+/") for _ in range(30)]
    japanese = ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 5]
    russian = ["Все счастливые семьи похожи друг на друга, каждая несчастлива по-своему. " * 4]
    source = [p.read_text() for p in pathlib.Path(language.__file__).parent.glob("*.py")]
    shuffled = ["".join(rng.permutation(list(r["text"]))) for r in held.limit(60).collect()]
    for texts, most in ((random, 0), (coded, 0), (japanese, 0), (russian, 0), (source, 0.25),
                        (shuffled, 0.25)):
        share = kept(documents(list(enumerate(texts))))
        print(texts[0][:20], share)
        assert share <= most
