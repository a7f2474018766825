import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import hmm


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def docs_of(seed=1):
    rng = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(200)] for p in ("a", "É", "x")]
    rows = []
    for i in range(120):
        words = rng.choice(tongues)
        rows.append((i, rng.choice([" ", "\n\t "]).join(words[min(int(rng.expovariate(0.03)), 199)] for _ in range(rng.randint(0, 600)))))
    return [*rows, (200, None), (201, ""), (202, " \n"), (203, "A1 a1 " * 3000), (5, rows[5][1]), (204, "never seen words"), (None, "a1 É2")]


def test_counts_and_base_against_brute_force(make_docs):
    rows = docs_of()
    held = F.col("doc_id") % 10 == 4
    counts, n = Counter(), 0
    for i, t in rows:
        if i is None or i % 10 != 4:
            counts.update(plain_words(t))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    got = {}
    for r in hmm.score(make_docs(rows), held).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        tokens = [*plain_words(t), "\n"]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.held_out == (i is not None and i % 10 == 4) and abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0


def test_rare_words_meet_their_counts(spark, make_docs, monkeypatch):
    """The head is cut to three words: every other word's count and class share come by the join."""
    rows = docs_of(2)[:30] + [(204, "never seen words")]
    held = F.col("doc_id") == 204
    whole = {r.doc_id: r for r in hmm.score(make_docs(rows), held, rounds=0).collect()}
    source = hmm.vocabulary
    def short(counts, n):
        v = source(counts, n)
        k = hmm.SYMBOLS
        words = v.words.split(b" ")
        assert len(words) < k  # all have symbols of their own
        tokens, distinct = v.class_tokens.copy(), v.class_distinct.copy()
        for w, c in zip(words[3:], v.counts[3:]):
            tokens[hmm.word_class(w)] += c
            distinct[hmm.word_class(w)] += 1
        return hmm.Vocabulary(b" ".join(words[:3]), v.counts[:3], v.classes[:3], v.n_docs, v.n_tokens, v.n_distinct, tokens, distinct)
    monkeypatch.setattr(hmm, "vocabulary", short)
    got = {r.doc_id: r for r in hmm.score(make_docs(rows), held, rounds=0).collect()}
    for i, r in got.items():
        assert (r.n_tokens, r.n_known) == (whole[i].n_tokens, whole[i].n_known) and abs(r.base_score - whole[i].base_score) < 1e-6 * max(1, abs(r.base_score))
    # the share of an unseen word in its class, by hand
    counts = Counter(w for i, t in rows if i != 204 for w in plain_words(t))
    frequent = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:3]}
    tokens, distinct = Counter(), Counter()
    for w, c in counts.items():
        if w not in frequent:
            tokens[hmm.word_class(w.encode())] += c
            distinct[hmm.word_class(w.encode())] += 1
    own = sum(math.log10(0.1 / (tokens[k] + 0.1 * (distinct[k] + 1))) for k in (hmm.word_class(w) for w in (b"never", b"seen", b"words")))
    assert got[204].score < own < 0


def brute_likelihood(m, x):
    """Sum over all paths, in plain arithmetic."""
    a = [float(m.start[s]) * float(m.emit[x[0], s]) for s in range(len(m.start))]
    for c in x[1:]:
        a = [sum(a[r] * float(m.move[r, s]) for r in range(len(a))) * float(m.emit[c, s]) for s in range(len(a))]
    return math.log10(sum(a))


def random_model(k=3, seed=0):
    rng = np.random.default_rng(seed)
    move, emit = rng.random((k, k)), rng.random((hmm.PAD + 1, k))
    emit[hmm.PAD] = 0
    emit /= emit.sum(axis=0)
    emit[hmm.PAD] = 1
    return hmm.Model(np.full(k, 1 / k, np.float32), (move / move.sum(axis=1, keepdims=True)).astype(np.float32), emit.astype(np.float32))


def test_forward_is_exact_over_stretches():
    m, rng = random_model(), np.random.default_rng(1)
    lengths = [1, 2, 40, 255, 256, 257, 300, 512, 513, 40]
    x = [rng.integers(0, hmm.END + 1, n).astype(np.uint16) for n in lengths]
    got = hmm.likelihoods(m, [c.tobytes() for c in x])
    m64 = hmm.Model(*(a.astype(np.float64) for a in (m.start, m.move, m.emit)))
    for c, y in zip(x, got):
        want, a = 0.0, m64.start
        for i, s in enumerate(c):
            a = (a if i == 0 else a @ m64.move) * m64.emit[s]
            want += math.log10(a.sum())
            a = a / a.sum()
        assert abs(y - want) < 1e-4 * abs(want)
    assert abs(brute_likelihood(m64, x[2]) - got[2]) < 1e-4 * abs(got[2])
    assert hmm.likelihoods(m, []).shape == (0,)


@pytest.mark.parametrize("stretch", [1, 2, 3, 256])
def test_expected_counts_against_enumeration(monkeypatch, stretch):
    """All state paths of a short sequence, weighed by their probability."""
    import itertools

    monkeypatch.setattr(hmm, "STRETCH", stretch)
    m = random_model(2, 3)
    c = [5, 9, 5, 7]
    other = [np.array(z, np.uint16).tobytes() for z in ([8], [8, 8, 4, 1, 2, 9], [3, 3])]
    sums = hmm.expected(m, [np.array(c, np.uint16).tobytes(), *other]) - hmm.expected(m, other)
    start, move, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.PAD + 1, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        p = float(m.start[path[0]] * m.emit[c[0], path[0]])
        for i in range(1, 4):
            p *= float(m.move[path[i - 1], path[i]] * m.emit[c[i], path[i]])
        total += p
        start[path[0]] += p
        for i in range(4):
            emit[c[i], path[i]] += p
            if i:
                move[path[i - 1], path[i]] += p
    np.testing.assert_allclose(sums[:2], start / total, rtol=1e-4)
    np.testing.assert_allclose(sums[2:6].reshape(2, 2), move / total, rtol=1e-4)
    got = sums[6:-1].reshape(-1, 2)
    np.testing.assert_allclose(got[: hmm.PAD], (emit / total)[: hmm.PAD], atol=1e-5)
    assert abs(sums[-1] - math.log10(total)) < 1e-4


def test_model_beats_the_base_on_held_out_texts(make_docs):
    rows = docs_of(5)[:120]
    got = hmm.score(make_docs(rows), F.col("doc_id") % 5 == 0).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and len(got) == 24


def test_score_against_plain_code(make_docs, monkeypatch):
    """The whole score of every text: symbols, shares and the forward recursion, in plain arithmetic with the trained model."""
    monkeypatch.setattr(hmm, "HEAD", 2500)  # the other words meet their counts by a join
    models, learned, train, vocabulary = [], [], hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    monkeypatch.setattr(hmm, "vocabulary", lambda *a: learned.append(vocabulary(*a)) or learned[-1])
    rng = random.Random(3)
    rows = [(i, " ".join(f"É{min(int(rng.expovariate(0.001)), 3999)}" for _ in range(rng.randint(0, 700)))) for i in range(60)]
    rows += [(300, "never seen É1"), (301, None)]
    got = {r.doc_id: r.score for r in hmm.score(make_docs(rows), F.col("doc_id") >= 300).collect()}
    (m,), (v,) = models, learned
    counts = Counter(w.encode() for i, t in rows if i < 300 for w in plain_words(t))
    assert len(counts) > 2600
    first = v.words.split(b" ")[:2000]
    assert min(counts[w] for w in first) >= max(c for w, c in counts.items() if w not in v.words.split(b" "))
    first = {w: n for n, w in enumerate(first)}
    tokens, distinct = Counter(), Counter()
    for w, c in counts.items():
        if w not in first:
            tokens[hmm.word_class(w)] += c
            distinct[hmm.word_class(w)] += 1
    for i, text in rows:
        want, a = 0.0, m.start.astype(float)
        for n, w in enumerate([*(x.encode() for x in plain_words(text)), None]):
            k = hmm.word_class(w) if w else 0
            symbol = hmm.END if w is None else first.get(w, 2000 + k)
            if 2000 <= symbol < hmm.END:
                want += math.log10((counts[w] + 0.1) / (tokens[k] + 0.1 * (distinct[k] + 1)))
            a = (a if n == 0 else a @ m.move.astype(float)) * m.emit[symbol].astype(float)
            want += math.log10(a.sum())
            a = a / a.sum()
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want))


@pytest.mark.parametrize("doc_id", [1, 5])
def test_equal_rows_are_learned_from(spark, make_docs, monkeypatch, doc_id):
    updates, source = [], hmm.updated
    monkeypatch.setattr(hmm, "updated", lambda *a: updates.append(1) or source(*a))
    docs = spark.range(5000).selectExpr(f"cast({doc_id} as long) as doc_id", "'the same few words' as text")
    got = hmm.score(docs, F.lit(False))
    assert got.count() == 5000 and len(updates) > hmm.SAMPLE_ROUNDS


def test_the_head_is_filled_from_a_bucket_that_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 300)
    counts = spark.range(2000).selectExpr("cast(concat('w', id) as binary) as word", "cast(id % 256 as int) as class", "if(id < 10, 50L, 7L) as n")
    v = hmm.vocabulary(counts, 5)
    words = v.words.split(b" ")
    assert 200 < len(words) <= 330 and {f"w{i}".encode() for i in range(10)} == set(words[:10])


def test_empty_table_and_nothing_to_learn_from(make_docs):
    assert hmm.score(make_docs([(1, "a")]).limit(0), F.lit(False)).collect() == []
    (row,) = hmm.score(make_docs([(1, "a b")]), F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0
