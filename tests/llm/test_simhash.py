import random

import pytest
import xxhash

from corpuslake.llm import simhash


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return sorted((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group))


@pytest.mark.parametrize("quarters, salt", [(4_000_000, 1_000_000), (0, 20)])
def test_against_brute_force(make_docs, monkeypatch, quarters, salt):
    monkeypatch.setattr(simhash, "QUARTERS_FROM", quarters)
    monkeypatch.setattr(simhash, "SALT_FROM", salt)
    rng = random.Random(5)
    vocabulary = ["Été", "The", "of"] + [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        rows.append((10 * i, " ".join(words)))
        for k in range(rng.randint(0, 6)):  # chains of small edits
            words[rng.randrange(len(words))] = f"x{k}"
            rows.append((10 * i + k + 1, " ".join(words)))
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "two words"), (9004, "TWO words"), (9005, "é"), (9006, "x " * 50000)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in simhash.near_duplicates(make_docs(rows)).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("quarters", [4_000_000, 0])
def test_groups_are_not_squared(spark, monkeypatch, quarters):
    """A chain of prints one bit apart over many tiles is one component."""
    monkeypatch.setattr(simhash, "QUARTERS_FROM", quarters)
    prints = [(1 << i) - 1 for i in range(60)] + [0xFFFF << 40 | i for i in range(256)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.links(df).collect()
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 3 for u, v in found)
    nodes = dict(tuple(r) for r in simhash.components(spark.createDataFrame(found, "u long, v long")).collect())
    assert len({nodes[p] for p in prints[:60]}) == 1
    assert len(found) < 20 * len(prints)


def test_a_dense_tile_pair_has_a_spanning_forest():
    """Thousands of prints that are all near each other give fewer links than prints, and soon."""
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    pairs = [(1 << i) | (1 << j) for i in range(40) for j in range(i)]  # any two differ in four bits at most
    a = np.array([0, *(1 << i for i in range(40)), *pairs] + [int(x) << 50 for x in range(1, 64)], np.uint64)
    b = np.concatenate([a[::2] ^ np.uint64(1 << 45), rng.integers(0, 2**63, 2000).astype(np.uint64)])
    for x, y, same in ((a, a, True), (a, b, False)):
        began = time.perf_counter()
        links = simhash._forest(x, y, same, 3)
        assert len(links) < len(x) + (0 if same else len(y)) and time.perf_counter() - began < 5
        nodes = list(range(len(x))) + ([] if same else [len(x) + i for i in range(len(y))])

        def groups(edges):
            label = {i: i for i in nodes}
            for p, q in edges:
                if label[p] != label[q]:
                    old, new = label[p], label[q]
                    label = {i: new if g == old else g for i, g in label.items()}
            return sorted(sorted(i for i in nodes if label[i] == g) for g in set(label.values()))

        place = {int(v): i for i, v in enumerate(x)}
        right = place if same else {int(v): len(x) + i for i, v in enumerate(y)}
        near = np.argwhere(np.bitwise_count(x[:, None] ^ y[None, :]) <= 3)
        want = [(int(p), int(q) if same else len(x) + int(q)) for p, q in near]
        assert groups([(place[u], right[v]) for u, v in links]) == groups(want)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_empty_table_and_repeated_rows(make_docs):
    assert simhash.near_duplicates(make_docs([(1, "a")]).limit(0)).collect() == []
    got = simhash.near_duplicates(make_docs([(4, "a b c"), (4, "a b c"), (None, "d e f g")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(4, 4), (4, 4)] and len(got) == 3
