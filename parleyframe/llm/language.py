"""Language identification with a bidirectional gated recurrent network on bytes.

Every byte of a text is labelled by one layer of gated units read from left to
right and one read from right to left; a document's probabilities are the mean
over its positions.  Texts are read whole, in pieces of ``PIECE`` bytes that run
side by side through numpy.  The network is trained by backpropagation through
time on a bounded sample: ``per_language`` documents of each label on average,
and ``SAMPLE_CHARS`` characters of each, from a place its id decides.

With ``noise`` one more label is learnt, for what is no language of the sample: its
texts with their characters shuffled, with other letters drawn in place of their
own, and with characters of other scripts.  It is never predicted: a text whose
most probable label it is, is ``und``.

A null text, or one without a letter, is ``und`` with score 0; so is every text
when there is nothing to learn from.  A null id is not held out and not learnt
from; a null label is not learnt from.  Repeated rows are answered alike.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parleyframe.llm.common import column_of, map_batches, packed, with_fields

UNDETERMINED = "und"
PIECE = 128
SAMPLE_CHARS = 1500
#: First characters of the runs of 96 that other scripts are drawn from.
SCRIPTS = (0x370, 0x400, 0x5D0, 0x620, 0x900, 0xE00, 0x3040, 0x4E00, 0x6000, 0xAC00)
#: A network that also knows noise is larger and trained for longer.
WITH_NOISE = {"noise": True, "units": 8, "steps": 240}
#: Pieces that run through the network together.
TOGETHER = 4096


def pieces_of(texts):
    """(PIECE, n) bytes, length of each piece, number of its text."""
    raw = [text.encode() for text in texts]
    counts = [-(-len(x) // PIECE) for x in raw]
    padded = b"".join(x.ljust(n * PIECE, b"\0") for x, n in zip(raw, counts))
    pieces = np.frombuffer(padded, np.uint8).reshape(-1, PIECE).T
    owner = np.repeat(np.arange(len(raw)), counts)
    sizes = np.array([len(x) for x in raw])
    first = np.cumsum([0, *counts])[:-1]
    place = np.arange(len(owner)) - first[owner]
    return pieces, np.minimum(sizes[owner] - place * PIECE, PIECE), owner


def _squash(x):
    """Logistic function, in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Gates:
    """One direction: update, reset and candidate gates of ``h`` units."""

    def __init__(self, h, rng):
        self.h = h
        self.inputs = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.state = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32)

    def weights(self):
        return [self.inputs, self.state]

    def forward(self, x, mask, keep=False):
        """(T, h, n) states; a masked position (padding) resets the state."""
        h, n = self.h, x.shape[1]
        states = np.empty((len(x), h, n), np.float32)
        table = np.ascontiguousarray(self.inputs.T)
        last = np.zeros((h, n), np.float32)
        kept = []
        for t in range(len(x)):
            given = table.take(x[t], axis=1)
            own = self.state @ last
            gates = given[:2 * h]
            gates += own[:2 * h]
            np.clip(gates, -30, 30, out=gates)
            _squash(gates)
            z, r = gates[:h], gates[h:]
            new = given[2 * h:]
            new += r * own[2 * h:]
            np.tanh(new, out=new)
            now = last - new
            now *= z
            now += new
            now *= mask[t]
            if keep:
                kept.append((z, r, new, own[2 * h:], last))
            states[t] = last = now
        return states, kept

    def states(self, x, order, sizes):
        """The same without keeping: (t, state after t), whose array is used again."""
        h, n = self.h, x.shape[1]
        table = np.ascontiguousarray(self.inputs.T)
        given, own = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        state, shortest = np.zeros((h, n), np.float32), sizes.min()
        gates, z, r, new = given[:2 * h], given[:h], given[h:2 * h], given[2 * h:]
        for t in order:
            np.take(table, x[t], axis=1, out=given, mode="clip")
            np.matmul(self.state, state, out=own)
            gates += own[:2 * h]
            np.clip(gates, -30, 30, out=gates)
            _squash(gates)
            own[2 * h:] *= r
            new += own[2 * h:]
            np.tanh(new, out=new)
            state -= new
            state *= z
            state += new
            if t >= shortest:
                state *= t < sizes
            yield t, state

    def backward(self, x, mask, kept, upper):
        """Gradients of the weights, from those of the states (T, h, n)."""
        h = self.h
        d_inputs, d_state = np.zeros_like(self.inputs), np.zeros_like(self.state)
        carried = 0
        for t in reversed(range(len(x))):
            z, r, new, own, last = kept[t]
            d = (upper[t] + carried) * mask[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (last - new) * z * (1 - z)
            d_own = d_new * r
            d_r = d_new * own * r * (1 - r)
            d_given = np.concatenate([d_z, d_r, d_new])
            d_mixed = np.concatenate([d_z, d_r, d_own])
            for unit in range(3 * h):
                d_inputs[:, unit] += np.bincount(x[t], d_given[unit], 256)
            d_state += d_mixed @ last.T
            carried = d * z + self.state.T @ d_mixed
        return [d_inputs, d_state]


class Network:
    """Both directions and the labels' weights."""

    def __init__(self, labels, units=5, seed=7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Gates(units, rng), Gates(units, rng)
        self.out = rng.normal(0, 0.3, (len(labels), 2 * units)).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def weights(self):
        return [*self.ahead.weights(), *self.back.weights(), self.out, self.bias]

    def positions(self, x, mask, keep=False):
        """(T, labels, n) probabilities of every position."""
        ahead, kept_ahead = self.ahead.forward(x, mask, keep)
        back, kept_back = self.back.forward(x[::-1], mask[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], axis=1)
        scores = self.out @ states
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores, (states, kept_ahead, kept_back)

    def gradients(self, x, mask, label):
        chances, (states, kept_ahead, kept_back) = self.positions(x, mask, keep=True)
        d = chances.copy()
        d[:, label, np.arange(x.shape[1])] -= 1
        d *= (mask / mask.sum())[:, None, :]
        d_states = self.out.T @ d
        units = self.ahead.h
        return [
            *self.ahead.backward(x, mask, kept_ahead, d_states[:, :units]),
            *self.back.backward(x[::-1], mask[::-1], kept_back, d_states[::-1, units:]),
            np.einsum("tln,tsn->ls", d, states), d.sum(axis=(0, 2))[:, None]]

    def train(self, x, sizes, label, steps=160, batch=192, rate=0.03, seed=11):
        """Adaptive gradient steps over random pieces, every label as often."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        means = [np.zeros_like(w) for w in weights]
        squares = [np.zeros_like(w) for w in weights]
        members = [np.flatnonzero(label == k) for k in range(len(self.labels))]
        members = [m for m in members if len(m)]
        for step in range(1, steps + 1):
            chosen = np.array([rng.choice(members[k % len(members)]) for k in range(batch)])
            mask = (np.arange(PIECE)[:, None] < sizes[chosen]).astype(np.float32)
            grads = self.gradients(np.ascontiguousarray(x[:, chosen]), mask, label[chosen])
            pace = rate * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, m, s in zip(weights, grads, means, squares):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (pace * (m / (1 - 0.9 ** step))
                      / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts):
        """Pooled probabilities (texts, labels); rows of empty texts are 0."""
        x, sizes, owner = pieces_of(texts)
        total = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(owner), TOGETHER):
            part = slice(at, at + TOGETHER)
            sums = self._pooled(x[:, part].astype(np.intp), sizes[part])
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(owner[part], sums[k], len(texts))
        lengths = np.bincount(owner, sizes, len(texts)) if len(owner) else np.zeros(len(texts))
        return total / np.maximum(lengths, 1)[:, None]

    def _pooled(self, x, sizes):
        """(labels, n) sums over positions of what ``positions`` returns, step by
        step, so that only the states of one direction are kept."""
        ahead = self.ahead.states(x, range(len(x)), sizes)
        kept = np.empty((len(x), self.ahead.h, x.shape[1]), np.float32)
        for t, state in ahead:
            kept[t] = state
        sums = np.zeros((len(self.labels), x.shape[1]), np.float32)
        units = self.ahead.h
        for t, state in self.back.states(x, range(len(x) - 1, -1, -1), sizes):
            scores = self.out[:, :units] @ kept[t]
            scores += self.out[:, units:] @ state
            scores += self.bias
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            scores /= scores.sum(axis=0)
            scores *= t < sizes
            sums += scores
        return sums


def held_out(id_column):
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def noise_like(texts, seed=5):
    """Texts of no language, made from others: each in one of three ways in turn."""
    rng, out = np.random.default_rng(seed), []
    for number, text in enumerate(texts):
        if number % 3 == 0:
            out.append("".join(rng.permutation(list(text))))
        elif number % 3 == 1:
            letters = iter(rng.integers(97, 123, len(text)))
            out.append("".join(chr(next(letters)) if c.isalpha() else c for c in text))
        else:
            first = rng.choice(SCRIPTS)
            out.append("".join(map(chr, rng.integers(first, first + 96, len(text) // 3 + 1))))
    return out


def fit(docs, id_column="doc_id", text_column="text", label_column="lang", per_language=250,
        noise=False, units=5, **training):
    """The network, or None if no document has a label to learn from.

    The label of ``noise`` is None; as many of its texts are made as of two labels.
    """
    known = docs.select(
        docs[id_column].alias("id"), docs[text_column].alias("text"),
        docs[label_column].alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("text") != "")
        & ~held_out(F.col("id")))
    counts = {row[0]: row[1] for row in known.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(
        F.lit(x) for label, n in sorted(counts.items()) for x in (label, per_language / n)))
    order = F.xxhash64(F.lit("sample"), "id")
    place = F.pmod(F.xxhash64(F.lit("place"), "id"), F.greatest(
        F.lit(1), F.length("text") - SAMPLE_CHARS))
    sample = known.where(
        F.pmod(order, F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)).select(
        "label", order.alias("order"),
        F.col("text").substr(place.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")
    ).orderBy("order", "text").limit(2 * per_language * len(counts)).collect()
    labels = sorted({row["label"] for row in sample})
    if not labels:
        return None
    texts, label = [row["text"] for row in sample], [labels.index(row["label"]) for row in sample]
    if noise:
        chosen = np.random.default_rng(3).permutation(len(texts))[:2 * per_language]
        texts += noise_like([texts[k] for k in chosen])
        label += [len(labels)] * len(chosen)
        labels = [*labels, None]
    x, sizes, owner = pieces_of(texts)
    return Network(labels, units).train(x, sizes, np.array(label)[owner], **training)


def with_language(docs, network, text_column="text", batch_texts=500):
    """``docs`` in the struct ``row``, with ``lang_pred`` and ``score``."""
    def label(batch):
        names, scores = [], []
        for at in range(0, batch.num_rows, batch_texts):
            texts = column_of(batch, text_column).slice(at, batch_texts).to_pylist()
            written = [bool(text) and any(map(str.isalpha, text)) for text in texts]
            if network is None or not any(written):
                names += [UNDETERMINED] * len(texts)
                scores += [0.0] * len(texts)
                continue
            chances = network.predict([t if ok else "" for t, ok in zip(texts, written)])
            best = chances.argmax(axis=1)
            written = [ok and network.labels[k] is not None for k, ok in zip(best, written)]
            names += [network.labels[k] if ok else UNDETERMINED for k, ok in zip(best, written)]
            scores += [
                min(1.0, float(c[k])) if ok else 0.0 for c, k, ok in zip(chances, best, written)]
        return pa.table({"row": batch["row"], "lang_pred": pa.array(names, pa.string()),
                         "score": pa.array(scores, pa.float64())})

    rows = packed(docs)
    return map_batches(
        rows, label, with_fields(rows.schema["row"], "lang_pred string, score double"))


def identify(docs, id_column="doc_id", text_column="text", label_column="lang", **fitting):
    """doc_id, held_out, lang_pred, score of every document."""
    network = fit(docs, id_column, text_column, label_column, **fitting)
    narrow = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return with_language(
        narrow.select("doc_id", "text"), network).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs, text_column="text", label_column="lang", id_column="doc_id",
                    least_score=0.3, **fitting):
    """``docs`` without those of undetermined language or a score under ``least_score``."""
    network = fit(docs, id_column, text_column, label_column, **(WITH_NOISE | fitting))
    return with_language(docs, network, text_column).where(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
