import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import language

WORDS = {"aa": "the of and thing whether".split(), "bb": "der die nicht über straße".split(), "cc": "que élan avec été pour".split()}


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[k], 60)), k) for i, k in enumerate(list(WORDS) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "the of", None), (902, "12 34", "bb")], "doc_id long, text string, lang string")
    return df, language.train(df, F.col("doc_id") % 4 != 2)


def test_held_out_accuracy(trained):
    df, model = trained
    assert model.languages == ["aa", "bb", "cc"]
    rows = language.predict(df, model).filter("doc_id < 900 and doc_id % 4 = 2").collect()
    assert len(rows) == 30 and sum(r.lang_pred == r.lang for r in rows) >= 29
    assert all(0 <= r.score <= 1 for r in rows)


def test_null_empty_letterless_long_and_repeated(spark, trained):
    _, model = trained
    rows = [(1, None), (2, ""), (3, " 12 ?!\n"), (4, "über nicht " * 60_000), (5, "the of"), (5, "the of"), (None, "the of and"), (6, "é")]
    docs = spark.createDataFrame([(*r, "x", 9.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    assert [g[1:] for g in got[:3]] == [("und", 0.0)] * 3
    assert got[3][1] == "bb" and got[4] == got[5] and len(got) == 8 and got[7][1] != "und"
    assert language.predict(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def plain_probabilities(m, data):
    """One byte at a time, in plain arithmetic: each block's bytes with their context, all labels, their mean."""
    k, h = len(m.languages), m.gate.shape[1]
    total = [0.0] * k
    for start in range(0, len(data), language.BLOCK):
        places = range(start - language.CONTEXT, start + language.BLOCK + language.CONTEXT)
        x = [data[i] if 0 <= i < len(data) else 32 for i in places]
        states = []
        for d in range(2):
            s, out = [0.0] * h, []
            for byte in x if d == 0 else x[::-1]:
                table = [float(z) for z in m.tables[d, byte]]
                f = [1 / (1 + math.exp(-(table[j] + sum(s[i] * float(m.gate[d, i, j]) for i in range(h))))) for j in range(h)]
                c = [math.tanh(table[h + j] + sum(f[i] * s[i] * float(m.candidate[d, i, j]) for i in range(h))) for j in range(h)]
                s = [(1 - f[j]) * s[j] + f[j] * c[j] for j in range(h)]
                out.append(s)
            states.append(out if d == 0 else out[::-1])
        for t in range(language.CONTEXT, language.CONTEXT + min(language.BLOCK, len(data) - start)):
            both = states[0][t] + states[1][t] + [1.0]
            z = [sum(v * float(m.head[i, j]) for i, v in enumerate(both)) for j in range(k)]
            e = [math.exp(v - max(z)) for v in z]
            total = [a + b / sum(e) for a, b in zip(total, e)]
    return [a / max(1, len(data)) for a in total]


def test_against_a_plain_forward_pass(trained):
    _, model = trained
    texts = ["über nicht the", "", "élan avec " * 60, "a" * 128, "the of " * 19 + "xyz", "q"]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = ends - [len(t.encode()) for t in texts]
    got = language.probabilities(model, np.frombuffer(data, np.uint8), starts, ends)
    for row, text in zip(got, texts):
        np.testing.assert_allclose(row, plain_probabilities(model, text.encode()), atol=2e-4)


def test_every_gradient_matches_finite_differences(monkeypatch):
    monkeypatch.setattr(language, "CONTEXT", 3)
    rng = np.random.default_rng(0)
    h, names = 3, ["a", "b", "c", "d"]
    p = [rng.normal(0, 0.5, n) for n in ((2, 256, 2 * h), (2, h, h), (2, h, h), (2 * h + 1, len(names)))]
    x, y = rng.integers(97, 100, (11, 5)).astype(np.uint8), rng.integers(0, 4, 5)
    _, grads = language.gradients(p, names, x, y)
    for group, (a, g) in enumerate(zip(p, grads)):
        places = [i for i in np.ndindex(a.shape) if group or i[1] in (97, 98, 99)]
        for i in places:
            held, losses = a[i], []
            for step in (1e-5, -1e-5):
                a[i] = held + step
                losses.append(language.gradients(p, names, x, y)[0])
            a[i] = held
            assert abs((losses[0] - losses[1]) / 2e-5 - g[i]) < 1e-7 + 1e-4 * abs(g[i])


def test_the_loss_falls():
    rng = np.random.default_rng(0)
    blocks = np.concatenate([rng.integers(97, 103, (40, language.WIDTH)), rng.integers(104, 110, (40, language.WIDTH))]).astype(np.uint8)
    target = np.repeat([0, 1], 40)

    def loss(m):
        return language.gradients([m.tables, m.gate, m.candidate, m.head], ["a", "b"], np.ascontiguousarray(blocks.T), target)[0]

    losses = [loss(language.fit(blocks, target, ["a", "b"], steps=n)) for n in (1, 30, 100)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_more_languages_than_any_bound_of_theirs(spark):
    """Seventy languages, each with letters of its own, the rarest with two texts: all are learned and told apart."""
    rows = []
    for i in range(70):
        letters = chr(0x4E00 + 64 * i) + chr(0x4E00 + 64 * i + 1) + " "
        rows += [(1000 * i + j, letters * (40 + j), f"l{i:02}") for j in range(2 if i % 2 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True))
    assert len(model.languages) == 70 and model.least_score < 0.02
    got = language.predict(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)
    right = [r for r in got if r.lang == r.lang_pred]
    assert all(r.score >= model.least_score for r in right)


def test_names_that_clash_pass_or_are_replaced(spark, trained):
    _, model = trained
    docs = spark.createDataFrame([(1, "the of", 2, "x", "y")], "doc_id long, text string, Score int, utf8 string, __row string")
    got = language.predict(docs, model)
    assert got.columns == ["doc_id", "text", "utf8", "__row", "lang_pred", "score"]
    (r,) = got.collect()
    assert (r.utf8, r["__row"], r.lang_pred) == ("x", "y", "aa")
