import random

import numpy as np
import pytest

from corpuslake.llm import common, near_copies


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [plain_sets(t) for _, t in rows]
    group = list(range(len(rows)))
    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                linked += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return sorted((i, least[g]) for (i, _), g in zip(rows, group)), linked


def edited():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append((100 * i, " ".join(base)))
        for k in range(8):  # from nearly all kept to far below the bound; some in chains
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 * i + k + 1, " ".join(copy)))
            base = copy if k % 3 == 0 else base
    rows += [(9000, None), (9001, " \n"), (9002, "two words"), (9003, "TWO  words"), (9004, "é"), (9005, rows[0][1])]
    rng.shuffle(rows)
    return rows


def test_edited_copies_against_brute_force_jaccard(make_docs):
    rows = edited()
    want, linked = plain_components(rows)
    got = sorted(tuple(r) for r in near_copies.near_copies(make_docs(rows).repartition(3)).collect())
    assert got == want and linked > 100 and len({c for _, c in want}) > 60


def test_the_stage_keeps_one_of_each_group(spark, make_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in edited() if r[1]]
    want, _ = plain_components(rows)
    got = corpus_pipeline.without_near_copies(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in want if i == c)


def _rows(n, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, np.uint64)
    return {"a": a, "b": a ^ np.uint64(5), "node": np.arange(n), "n": np.full(n, 9, np.int32)}


def test_a_forest_spans_what_brute_force_links():
    x = _rows(300)
    x["a"][100:] = x["a"][:200] ^ np.uint64(0b1011)  # chains of near fingerprints
    x["b"] = x["a"] ^ np.uint64(5)
    u, v = near_copies.forest(x, x, True)
    label = list(range(300))
    for i, j in zip(u.tolist(), v.tolist()):
        old, new = label[i], label[j]
        assert old != new  # no link inside a component
        label = [new if z == old else z for z in label]
    for i in range(300):
        for j in range(i):
            near = sum(bin(int(x[c][i]) ^ int(x[c][j])).count("1") for c in ("a", "b")) <= near_copies.RADIUS
            assert not near or label[i] == label[j]


def test_a_tile_over_several_batches_is_one_and_full_ones_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "TILE", 4)
    x = _rows(11)
    rows = pa.table({c: pa.array(z.view(np.int64) if z.dtype == np.uint64 else z) for c, z in x.items()} | {"key": [1] * 7 + [2] * 4, "ones": list(range(11))})
    found = pa.Table.from_batches(near_copies._tiles(iter(rows.to_batches(max_chunksize=3)))).to_pylist()
    assert [(r["key"], len(r["n"]) // 4, r["low"], r["high"]) for r in found] == [(1, 4, 0, 3), (1, 3, 4, 6), (2, 4, 7, 10)]


@pytest.mark.parametrize("shingles", [1 << 20, 2500])
def test_a_group_of_which_many_are_not_alike(make_docs, monkeypatch, shingles):
    """Copies of one text whose pairs lie on both sides of the bound, in one block and in several."""
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(300)]
    rows = [(1, " ".join(base))]
    for i in range(2, 40):
        copy = list(base)
        for k in rng.sample(range(300), 4 + i % 7):
            copy[k] = f"z{i}"
        rows.append((i, " ".join(copy)))
    want, _ = plain_components(rows)
    got = sorted(tuple(r) for r in near_copies.near_copies(make_docs(rows)).collect())
    assert got == want


def test_sets_that_are_alike_share_a_hash_of_their_prefixes():
    rng = np.random.default_rng(5)
    for n in [4, 5, 6, 9, 10, 11, 99, 100, 101, 317]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, n, np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))  # the smallest go, the worst that can be
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**40, (n - gone) * 5 // 4 - (n - gone), np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 5 * both >= 4 * (len(x) + len(y) - both):
                assert np.intersect1d(near_copies.prefix(x), near_copies.prefix(y)).size


@pytest.mark.parametrize("crowd", [2, 70, 4096])
def test_meetings_span_what_brute_force_links(crowd):
    rng = np.random.default_rng(9)
    x = _rows(300)
    x["a"][100:] = x["a"][:200] ^ np.uint64(0b1011)
    x["b"] = x["a"] ^ np.uint64(5)
    token = np.where(rng.random(300) < 0.4, 7, rng.integers(0, 60, 300)).astype(np.uint32)  # one large meeting
    rows = np.empty(300, near_copies._MET)
    rows["token"] = token
    for c in x:
        rows[c] = x[c]
    u, v = near_copies.met(rng.permutation(np.concatenate([rows, rows[:50]])), crowd)
    sizes = np.bincount(token)[token]
    assert sorted(u[u == v]) == np.flatnonzero(sizes > crowd).tolist()
    label = list(range(300))
    for i, j in zip(u.tolist(), v.tolist()):
        old, new = label[i], label[j]
        label = [new if z == old else z for z in label]
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            near = sum(bin(int(x[c][i]) ^ int(x[c][j])).count("1") for c in ("a", "b")) <= near_copies.RADIUS
            if near and token[i] == token[j] and sizes[i] <= crowd:
                old, new = want[i], want[j]
                want = [new if z == old else z for z in want]
    assert len(set(label)) == len(set(want)) == len(set(zip(label, want)))


def test_texts_without_a_common_shingle_are_not_compared(make_docs, monkeypatch):
    """Compared are those that share a shingle, not all pairs of the corpus."""
    monkeypatch.setattr(near_copies, "by_tiles", None)  # for crowds only
    seen = []
    real = near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda links: seen.append(links.distinct().count()) or real(links))
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(30))) for i in range(40)] + [(50, " ".join(f"w3-{k}" for k in range(29)))]
    got = dict(tuple(r) for r in near_copies.near_copies(make_docs(rows)).collect())
    assert got == {i: i for i in range(40)} | {50: 3} and seen == [1, 1]


def test_crowds_go_by_tiles_with_the_same_result(make_docs, monkeypatch):
    rows = edited()
    want, _ = plain_components(rows)
    called = []
    real = near_copies.by_tiles
    monkeypatch.setattr(near_copies, "by_tiles", lambda nodes: called.append(nodes.count()) or real(nodes))
    monkeypatch.setattr(near_copies, "CROWD", 2)
    got = sorted(tuple(r) for r in near_copies.near_copies(make_docs(rows).repartition(3)).collect())
    assert got == want and called[0] > 100


def test_an_empty_table(make_docs):
    assert near_copies.near_copies(make_docs([(1, "a")]).limit(0)).collect() == []


def test_workers_give_memory_back(spark, make_docs, monkeypatch):
    """After each task of Python, when the worker's last batch is out."""
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    for b in common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        seen.append(b)
    assert seen == [2, 4, "back"]
    sent = []
    kind = type(spark.range(1))
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, *rest: sent.append(run) or through(df, run, *rest))
    near_copies.near_copies(make_docs(edited()[:30])).collect()
    assert len(sent) >= 5 and all(run.__qualname__.startswith("trimmed.") for run in sent)
