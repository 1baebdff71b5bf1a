"""Quality grades by cumulative-link (ordered logistic) regression.

A text's score is a sum of weights, shared by all grades, of the hashed words it
holds and of some shares (capitals, trailing marks, repeats); ordered thresholds
cut the scores into grades: P(grade <= k) = logistic(threshold_k - score).  The
expected grade and the probability of a grade or more follow for every text.

Grades are whole numbers from 0.  A text rated more than once has the smallest
of its grades; null ratings and ratings without a document are ignored.  The
weights are fitted on at most ``sample`` rated documents, the first by a hash of
the id, without the held-out ones.  Null and empty texts hold no words and get
the score their shares give; with nothing to learn from, all probabilities are
null and nothing is selected.  Repeated rows are answered alike.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches
from parleyframe.llm.language import held_out

SLOTS = 1 << 18
_MARKS = "!#*%$&|.,?"
SHARES = len(_MARKS) + 3


def features(text):
    """Slots of the distinct words, and shares."""
    words = text.split()
    distinct = set(words)
    n = max(1, len(distinct))
    plain = {word.strip(_MARKS).lower() for word in distinct}
    slots = np.fromiter(
        (xxhash.xxh32_intdigest(word) & SLOTS - 1 for word in plain), np.int32, len(plain))
    tails = "".join(word[-1] for word in distinct)
    shares = [tails.count(mark) / n for mark in _MARKS]
    shares += [sum(map(str.isupper, distinct)) / n, len(distinct) / max(1, len(words)),
               min(1.0, len(words) / 1000)]
    return np.unique(slots), np.array(shares, np.float32)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(rows, grades, n_grades):
    """Chi-square statistic of every slot against the grades."""
    held = np.array([
        np.bincount(np.concatenate([np.empty(0, np.int32), *(
            r[0] for r, g in zip(rows, grades) if g == k)]), minlength=SLOTS)
        for k in range(n_grades)])
    share = np.bincount(grades, minlength=n_grades)[:, None] / len(grades)
    expected = held.sum(axis=0) * share
    part = held.sum(axis=0) / len(grades)
    return ((held - expected) ** 2 / np.maximum(expected * (1 - part), 1e-9)).sum(axis=0)


class Ordinal:
    """Weights and thresholds; ``grades`` of them, so one threshold fewer."""

    def __init__(self, grades):
        self.words = np.zeros(SLOTS, np.float32)
        self.shares = np.zeros(SHARES, np.float32)
        self.first = np.zeros(1, np.float64)
        self.gaps = np.zeros(grades - 2, np.float64)  # logarithms: thresholds stay ordered

    def thresholds(self):
        return np.concatenate([self.first, self.first + np.cumsum(np.exp(self.gaps))])

    def tails(self, scores):
        """P(grade > k) for every threshold, one row per score."""
        return _logistic(np.asarray(scores)[:, None] - self.thresholds()[None, :])

    def fit(self, rows, grades, epochs=30, batch=64, rate=1.0, decay=1e-3, start=1.0,
            least=25.0, seed=3):
        """Adaptive gradient steps on the likelihood.  Only slots whose texts
        differ in grade from the rest (chi-square of ``least``) get weight."""
        rng = np.random.default_rng(seed)
        grades = np.asarray(grades)
        useful = telling(rows, grades, len(self.gaps) + 2) >= least
        useful = [r[0][useful[r[0]]] for r in rows]
        shares = np.array([r[1] for r in rows])
        squares = [np.full(w.shape, start) for w in (
            self.words, self.shares, self.first, self.gaps)]
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            pace = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                chosen = order[at:at + batch]
                slots = np.concatenate([useful[i] for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), [len(useful[i]) for i in chosen])
                scores = np.bincount(owner, self.words[slots], len(chosen))
                scores = scores + shares[chosen] @ self.shares
                d_score, d_cut = self._slopes(scores, grades[chosen])
                by_slot = np.bincount(slots, d_score[owner], SLOTS)
                steps = np.exp(self.gaps)
                later = np.cumsum(d_cut[::-1])[::-1]
                for k, (w, g) in enumerate((
                        (self.words, by_slot + decay * self.words * (by_slot != 0)),
                        (self.shares, d_score @ shares[chosen]),
                        (self.first, d_cut.sum(keepdims=True)), (self.gaps, later[1:] * steps))):
                    squares[k] += g * g
                    w -= (pace * g / np.sqrt(squares[k])).astype(w.dtype)
        return self

    def _slopes(self, scores, grades):
        """Of the negative log likelihood, by score and by threshold."""
        cuts = np.concatenate([[-np.inf], self.thresholds(), [np.inf]])
        upper, lower = (_logistic(cuts[grades + k] - scores) for k in (1, 0))
        chance = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        d_cut = np.zeros(len(cuts))
        np.add.at(d_cut, grades + 1, -up)
        np.add.at(d_cut, grades, low)
        return up - low, d_cut[1:-1]


def rated(docs, labels, grade, id_column="doc_id", text_column="text", sample=8000):
    """Features and grades of at most ``sample`` rated documents not held out."""
    spark = docs.sparkSession
    named = labels.select(labels[id_column].alias("id"), grade.cast("int").alias("grade"))
    known = named.where(
        F.col("grade").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    ).groupBy("id").agg(F.min("grade").alias("grade"))
    ids = known.orderBy(F.xxhash64(F.lit("rated"), "id"), "id").limit(sample)
    # At most ``sample`` rows, read by every task.
    chosen = spark.createDataFrame(ids.collect(), ids.schema)

    def run(batch):
        rows = [features(text.as_py()) for text in batch["text"]]
        return pa.table({
            "grade": batch["grade"],
            "slots": pa.array([r[0].tobytes() for r in rows], pa.binary()),
            "shares": pa.array([r[1].tobytes() for r in rows], pa.binary())})

    texts = id_and_text(docs, id_column, text_column)
    joined = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"])
    found = map_batches(
        joined.select("doc_id", "grade", "text"), run,
        "grade int, slots binary, shares binary")
    # A hash of all that matters gives one order of learning.
    rows = found.orderBy(F.xxhash64("slots", "shares")).limit(2 * sample).collect()
    return ([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32))
             for r in rows], [r["grade"] for r in rows])


def fit(docs, labels, grade, grades=3, **options):
    rows, targets = rated(docs, labels, grade, **options)
    return Ordinal(grades).fit(rows, targets) if rows else None


def graded(docs, model, level=1, least=0.5, id_column="doc_id", text_column="text"):
    """doc_id, held_out, expected_grade, tail_probability (of ``level`` or more)
    and selected (``least`` tail probability) of every document."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batch):
        model = shipped.value
        if model is None:
            return pa.table({
                "doc_id": batch["doc_id"],
                **{n: pa.nulls(batch.num_rows, pa.float64()) for n in ("grade", "tail")}})
        scores = []
        for text in batch["text"]:
            slots, shares = features(text.as_py())
            scores.append(float(model.words[slots].sum() + shares @ model.shares))
        tails = model.tails(scores)
        return pa.table({"doc_id": batch["doc_id"], "grade": pa.array(tails.sum(axis=1)),
                         "tail": pa.array(tails[:, level - 1])})

    texts = id_and_text(docs, id_column, text_column)
    out = map_batches(
        texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, grade double, tail double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("grade").alias("expected_grade"), F.col("tail").alias("tail_probability"),
        F.coalesce(F.col("tail") >= least, F.lit(False)).alias("selected"))


def rating_grade(labels):
    """0 toxic, 1 neither toxic nor good, 2 good; null where a rating is missing."""
    return F.when(labels["toxic"] == 1, 0).when(
        labels["toxic"].isNotNull() & labels["quality"].isNotNull(), 1 + labels["quality"])


def select_by_grade(docs, labels, **options):
    """Grades of all documents from ratings of quality and toxicity."""
    return graded(docs, fit(docs, labels, rating_grade(labels)), **options)
