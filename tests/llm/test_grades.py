import numpy as np

from parleyframe.llm import grades
from tests.llm.conftest import ODD


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        grade = int(rng.integers(3))
        text = list(rng.choice(words, 60)) + [["bad", "plain", "fine"][grade]] * 2
        out.append((k, " ".join(text), grade))
    return out


def test_thresholds_stay_ordered_and_grades_are_found():
    rows = rows_of(500, 1)
    model = grades.Ordinal(3).fit([grades.features(t) for _, t, _ in rows[:350]],
                                  [g for *_, g in rows[:350]])
    assert np.all(np.diff(model.thresholds()) > 0)
    scores = [float(model.words[s].sum() + d @ model.shares)
              for s, d in (grades.features(t) for _, t, _ in rows[350:])]
    tails = model.tails(scores)
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert np.mean(np.round(tails.sum(axis=1)) == [g for *_, g in rows[350:]]) > 0.95


def test_slopes_agree_with_differences():
    model = grades.Ordinal(4)
    model.first[:] = -0.5
    scores, target = np.array([0.3, -1.0, 2.0, 0.1]), np.array([0, 1, 2, 3])

    def loss(s, first, gaps):
        m = grades.Ordinal(4)
        m.first[:], m.gaps[:] = first, gaps
        cuts = np.concatenate([[-np.inf], m.thresholds(), [np.inf]])
        chance = grades._logistic(cuts[target + 1] - s) - grades._logistic(cuts[target] - s)
        return -np.log(chance).sum()

    d_score, d_cut = model._slopes(scores, target)
    step = 1e-6
    for i in range(4):
        moved = scores.copy()
        moved[i] += step
        assert abs((loss(moved, -0.5, 0) - loss(scores, -0.5, 0)) / step - d_score[i]) < 1e-4
    assert abs((loss(scores, -0.5 + step, 0) - loss(scores, -0.5, 0)) / step - d_cut.sum()) < 1e-4


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_select(spark, documents):
    rows = rows_of(400, 2)
    rated = [(k, int(g == 2), int(g == 0), "x") for k, _, g in rows]
    rated += [(None, 1, 0, "x"), (0, None, None, "x"), (10_000, 1, 0, "x"), rated[0]]
    found = {r["doc_id"]: r for r in grades.select_by_grade(
        documents([(k, t) for k, t, _ in rows]), labels(spark, rated)).collect()}
    right = [found[k]["selected"] == (g > 0) for k, _, g in rows if found[k]["held_out"]]
    assert np.mean(right) > 0.9


def test_odd_rows(spark, odd):
    rated = labels(spark, [(1, 1, 0, "x"), (3, 0, 1, "x"), (6, 0, 0, "x"), (2, 1, 0, "y")])
    assert grades.select_by_grade(odd, rated).count() == len(ODD)


def test_nothing_to_learn(spark, odd, none):
    found = grades.select_by_grade(odd, labels(spark, [])).collect()
    assert len(found) == len(ODD) and not any(r["selected"] for r in found)
    assert grades.select_by_grade(none, labels(spark, [(1, 1, 0, "x")])).collect() == []
