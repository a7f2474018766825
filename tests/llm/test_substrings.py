import hashlib
import random

import pytest

from corpuslake.llm import substrings


def plain(rows, window):
    """Brute force over all windows in order of (doc_id, text's order, start)."""
    docs = sorted({(i if i is not None else substrings.NULL_ID, t or "") for i, t in rows})
    first, out = {}, {}
    for i, t in docs:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in first:
                gone.update(range(s, s + window))
            else:
                first[g] = (i, s)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return sorted((i if i is not None else substrings.NULL_ID, *out[i if i is not None else substrings.NULL_ID, t or ""]) for i, t in rows)


def cases(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "É", "The", "of"] * 60
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(rng.randint(window - 3, 4 * window)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = text(rng.randint(0, 3 * window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            words[rng.randint(0, len(words)) : 0] = p[a : len(p) - rng.randint(0, len(p) // 3)]
        if i % 10 == 0:
            words += words
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a " * 3000), (504, "a b " * 1500), (505, "a " * (window - 1)), (506, "a " * window)]
    rows += [(507, rows[4][1]), (508, rows[4][1]), (rows[7][0], rows[7][1]), (None, rows[5][1]), (509, "x y " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 400_000), (2, 60)])
def test_against_brute_force(make_docs, monkeypatch, seed, block):
    monkeypatch.setattr(substrings, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(substrings, "BLOCK_PIECES", max(10, block // 10))
    rows = cases(seed, 20)
    got = substrings.remove_repeats(make_docs(rows).repartition(5)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else substrings.NULL_ID, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows, 20)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("crowded, block", [(2, 400_000), (10, 50), (40, 20)])
def test_crowded_anchor_is_dealt_by_windows(make_docs, monkeypatch, crowded, block):
    """One passage, followed by something else in each document."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{rng.randint(0, 9)} {passage} " + " ".join(f"{rng.randint(0, 3)}" for _ in range(30))) for i in range(50)]
    monkeypatch.setattr(substrings, "BLOCK_ANCHORS", block)
    source = substrings.repeated
    monkeypatch.setattr(substrings, "repeated", lambda rows, w, g: source(rows, w, g, crowded))
    got = substrings.remove_repeats(make_docs(rows).repartition(6), with_text=False).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 20)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_meeting_over_batch_ends(size):
    """Counts and repeats are the same however the sorted rows are cut into batches."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(size)
    rows = sorted((r, k, n) for r in range(12) for k, n in [(100 * r + i, 1) for i in range(rng.choice([1, 1, 2, 3]))])
    rows = [(r, k, n) if rng.random() < 0.8 else (r, None, 4) for r, k, n in rows]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((r, None, k, n) for r, k, n in rows[i : i + size])), kinds)], names=["route", "hash", "row_key", "n"]) for i in range(0, len(rows), size)]
    got = [tuple(x.values()) for b in substrings._meet(5)(iter(batches)) for x in b.to_pylist()]
    by = {}
    for r, k, n in rows:
        by.setdefault(r, []).append((k, n))
    want = [(k, r) for r, g in by.items() if len(g) > 1 for k, _ in g if k is not None] + [(None, r) for r, g in by.items() if sum(n for _, n in g) >= 5]
    assert sorted(got, key=str) == sorted(want, key=str) and np.all([len(x) == 2 for x in got])


def test_automaton_against_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        a = substrings.Automaton()
        for t in texts[:3]:
            a.add(t)
        joined = ["".join(t) for t in texts[:3]]
        last = "".join(texts[3])
        want = [max(n for n in range(e + 2) if any(last[e + 1 - n : e + 1] in j for j in joined)) for e in range(len(last))]
        assert a.statistics(texts[3]) == want


def test_empty_table(make_docs):
    assert substrings.remove_repeats(make_docs([(1, "a")]).limit(0)).collect() == []


def test_one_row_many_times(spark, make_docs):
    rows = [r for r in cases(5, 20) if r[0] is not None][:20]
    many = [*rows, *[rows[0]] * 3000, *[(700, rows[1][1])] * 2000]
    want = plain([*rows, (700, rows[1][1])], 20)
    got = substrings.remove_repeats(make_docs(many).repartition(4), with_text=False).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    assert sorted(tuple(r)[:4] for r in got) == want
    counts = {r.doc_id: r["count"] for r in got}
    assert counts[rows[0][0]] == 3001 and counts[700] == 2000 and sum(counts.values()) == len(many)


def test_what_it_refuses(spark, make_docs):
    with pytest.raises(ValueError):
        substrings.remove_repeats(make_docs([(1, "a")]), window=70)
    with pytest.raises(TypeError):
        substrings.remove_repeats(spark.createDataFrame([("x", "a")], "doc_id string, text string"))
