"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The operator of simhash.py at the settings of a training-data stage, with an exact check
of each link:

1. A text's set of shingles gets a fingerprint of BITS bits, and its size. Texts with the
   same set are one node, so copies cost nothing. Two sets of similarity 0.8 differ in
   19 of 128 bits on average and in more than RADIUS with probability 5 in 100,000; the
   more alike, the fewer. Sets without a common shingle differ in 64 on average and in RADIUS or
   fewer with probability 4 in 10 million.
2. Fingerprints are compared where their sets can be alike at all. Two sets of similarity 0.8 share one of
   the smallest fifth of their hashes (prefix() has the proof; it loses none), so texts are dealt out by these
   hashes and compared with those that they meet: work in proportion to the corpus.
3. Texts that meet over CROWD others at one hash (of a line that is everywhere, or a large group of copies) are
   compared with each other tile by tile with numpy's exclusive-or and bit counts. Tile pairs whose
   population counts differ beyond the radius are skipped, and those whose sizes forbid 0.8. Each
   tile pair gives a spanning forest of what it links, never all pairs of a group. This part grows with the
   square of such texts.
4. What such links hold together is a group, outside of which no text has a near copy. Inside
   it the sets themselves (of 64-bit hashes) are compared, block by block: a block of a large group meets each of
   the others in a task of its own. Only pairs whose fingerprints are near and that no link joins so far
   are looked at, and each pair of blocks gives a spanning forest of its links.

A link inside a component adds nothing, so this finds the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import blob, bounded, stored, text_batches, text_key, trimmed
from corpuslake.llm.simhash import components

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
ALIKE = (4, 5)
BITS, RADIUS = 128, 36
#: Smaller sets are alike only if they are equal, and so are one node.
LEAST_SET = ALIKE[0] // (ALIKE[1] - ALIKE[0])
#: Fingerprints of one tile at most: 0.9 MB with sizes and nodes.
TILE = 32768
#: Parts at least into which fingerprints of one size are dealt to be tiled; more from 64 tiles a part on.
SALTS = 4
#: Elements of one comparison.
STEP = 1 << 18
#: Sets that share a hash are compared at once up to so many; those of a larger meeting go by tiles.
CROWD = 4096
#: Meetings of up to so many are compared together, larger ones each by itself.
FEW = 64
#: Shingles of one block of a group, about: 2 MB.
BLOCK_SHINGLES = 1 << 18
#: Nodes whose texts are read again are broadcast up to so many (some 20 MB); beyond, they are joined by a shuffle.
BROADCAST_NODES = 500_000
_RNG = np.random.default_rng(42)
_PLACES = _RNG.integers(0, 2**63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The different five-word shingles' hashes, sorted; one of all words if there are fewer."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    if len(h) == 0:
        return h
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    total = np.full(n, min(len(h), SHINGLE_WORDS), np.uint64)
    for i in range(min(len(h), SHINGLE_WORDS)):
        total += _mix(h[i : i + n] * _PLACES[i])
    return np.unique(_mix(total))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Two unsigned 64-bit halves: a bit is 1 if set in over half of a set's hashes (and of their second ones)."""
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 65536):
        part = found[i : i + 65536]
        octets = np.stack([part, _mix(part + _SECOND)], axis=1).view(np.uint8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * bits > len(found), bitorder="little").view(np.uint64)


def prefix(found: np.ndarray) -> np.ndarray:
    """32 bits of a sorted set's smallest hashes, of which it shares one with every set that is like it.

    Sets that are alike have at least 0.8 n hashes in common, n being the size of either, so at most n - ceil(0.8 n)
    hashes of each are not, and the smallest common one comes after no more than these.
    """
    n = len(found)
    return found[: n + (-ALIKE[0] * n) // ALIKE[1] + 1].astype(np.uint32) if n >= LEAST_SET else found[:0].astype(np.uint32)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature of each text; its prefix only where the task meets its set for the first time."""
    seen: set[int] = set()
    for b in batches:
        nodes, sizes, prints, prefixes = [], [], [], []
        for text in blob(b.column("text")):
            found = shingles(text)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 1))
            sizes.append(len(found))
            prints.append(fingerprint(found))
            prefixes.append(None if nodes[-1] in seen or len(found) < LEAST_SET else prefix(found).tobytes())
            seen.add(nodes[-1])
        halves = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        arrays = [
            b.column("doc_id"), b.column("text_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
            pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(prefixes, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "n", "a", "b", "prefix"])


_MET = np.dtype([("token", np.uint32), ("n", np.int32), ("node", np.int64), ("a", np.uint64), ("b", np.uint64)])


def _dealt(parts: int):
    """Rows of node, n, a, b, prefix: one row for each bucket of the prefixes' hashes, its _MET rows as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, np.uint32) for x in b.column("prefix").to_pylist()]
            if not found:
                continue
            token = np.concatenate(found)
            order = np.argsort((token % parts).astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
            place = np.repeat(np.arange(len(found)), [len(x) for x in found])[order]
            rows = np.empty(len(token), _MET)
            rows["token"] = token[order]
            for c in _COLUMNS:
                values = b.column(c).to_numpy()
                rows[c] = (values if c == "n" else values.view(_MET[c]))[place]
            bucket = rows["token"] % parts
            starts = np.flatnonzero(np.diff(bucket, prepend=parts))
            data = [rows[i:j].tobytes() for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(data, pa.binary())], names=["bucket", "rows"])

    return run


def met(rows: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links that span what the sets that share a token link; a node with itself if over crowd share its token."""
    rows = rows[np.argsort(rows["token"], kind="stable")]
    same = rows["token"][1:] == rows["token"][:-1]
    rows = rows[np.append(same, False) | np.insert(same, 0, False)] if len(rows) else rows
    rows = rows[np.lexsort((rows["node"], rows["token"]))]
    again = (rows["token"][1:] == rows["token"][:-1]) & (rows["node"][1:] == rows["node"][:-1])  # a repeated row's, from another task
    rows = rows[np.insert(~again, 0, True)] if len(rows) else rows
    starts = np.flatnonzero(np.insert(rows["token"][1:] != rows["token"][:-1], 0, True)) if len(rows) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(rows)))
    after = np.repeat(starts + sizes, sizes) - np.arange(len(rows))  # rows of the same token from here on
    size = np.repeat(sizes, sizes)
    us, vs = [], []
    at, d = np.flatnonzero(size <= min(FEW, crowd)), 1
    while len(at := at[after[at] > d]):
        for i in range(0, len(at), STEP):
            p = at[i : i + STEP]
            near = np.bitwise_count(rows["a"][p] ^ rows["a"][p + d]) + np.bitwise_count(rows["b"][p] ^ rows["b"][p + d]) <= RADIUS
            p = p[near]
            n, m = rows["n"][p].astype(np.int64), rows["n"][p + d].astype(np.int64)
            p = p[np.minimum(n, m) * ALIKE[1] >= np.maximum(n, m) * ALIKE[0]]
            us.append(rows["node"][p])
            vs.append(rows["node"][p + d])
        d += 1
    for i in np.flatnonzero((sizes > FEW) & (sizes <= crowd)).tolist():
        group = rows[starts[i] : starts[i] + sizes[i]]
        x = {c: np.ascontiguousarray(group[c]) for c in _COLUMNS}
        for held, found in zip((us, vs), forest(x, x, True)):
            held.append(found)
    crowded = np.unique(rows["node"][size > crowd])
    u, v = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (us, vs))
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    used, _ = _joined(np.arange(len(nodes)), places[: len(u)], places[len(u) :])
    return np.concatenate([u[used], crowded]), np.concatenate([v[used], crowded])


def _meet(crowd: int):
    """Rows of bucket, rows, sorted by bucket: the links of each bucket."""

    def links(held: list[bytes]) -> pa.RecordBatch:
        u, v = met(np.frombuffer(b"".join(held), _MET), crowd)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for b in batches:
            for bucket, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist()):
                if held and bucket != now:
                    yield links(held)
                    held = []
                now = bucket
                held.append(rows)
        if held:
            yield links(held)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts in place of the texts; of a repeated row's node only the task's first."""
    seen: set[int] = set()
    for b in batches:
        fresh = []
        for node in b.column("node").to_pylist():
            fresh.append(node not in seen)
            seen.add(node)
        b = b.filter(pa.array(fresh, pa.bool_()))
        found = [shingles(t).tobytes() for t in blob(b.column("text"))]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.binary())], names=[*names, "set"])


_COLUMNS = ("a", "b", "node", "n")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and population count: one row for each tile, its columns as bytes."""

    def tile(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = {c: np.concatenate([h[c] for h in held]) for c in (*_COLUMNS, "key", "ones")}
        data = [pa.array([rows[c].tobytes()], pa.binary()) for c in _COLUMNS]
        facts = [int(rows["key"][0]), int(rows["node"][0]), int(rows["ones"].min()), int(rows["ones"].max())]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(facts, kinds)), *data], names=["key", "tile", "low", "high", *_COLUMNS])

    held: list[dict[str, np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in (*_COLUMNS, "key", "ones")}
        ends = [*(np.flatnonzero(np.diff(rows["key"])) + 1).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            if held and held[-1]["key"][0] != rows["key"][start]:
                yield tile(held)
                held, n = [], 0
            while start < end:
                stop = min(end, start + TILE - n)
                held.append({c: x[start:stop] for c, x in rows.items()})
                n += stop - start
                start = stop
                if n == TILE:
                    yield tile(held)
                    held, n = [], 0
    if held:
        yield tile(held)


def _tile(row: dict) -> dict[str, np.ndarray]:
    kinds = {c: np.int32 if c == "n" else np.int64 for c in _COLUMNS}
    found = {c: np.frombuffer(row[c], kinds[c]) for c in _COLUMNS}
    return found | {c: found[c].view(np.uint64) for c in ("a", "b")}


def _near(x: dict, y: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places p in x and q in y that may be alike, nearest first, some at a time."""
    m = len(y["a"])
    step = max(1, STEP // m)
    for i in range(0, len(x["a"]), step):
        rows = slice(i, i + step)
        d = np.bitwise_count(x["a"][rows, None] ^ y["a"][None, :])
        d += np.bitwise_count(x["b"][rows, None] ^ y["b"][None, :])
        p, q = np.nonzero(d <= RADIUS)
        d = d[p, q]
        p = p + i
        small, large = np.minimum(x["n"][p], y["n"][q]).astype(np.int64), np.maximum(x["n"][p], y["n"][q]).astype(np.int64)
        keep = small * ALIKE[1] >= large * ALIKE[0]
        if same:
            keep &= p < q
        order = np.argsort(d[keep], kind="stable")
        yield p[keep][order], q[keep][order]


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs p, q of places span what they join, the first ones before others; and the labels after."""
    at, used = np.arange(len(p)), []
    while True:
        low, high = np.minimum(label[p[at]], label[q[at]]), np.maximum(label[p[at]], label[q[at]])
        apart = low != high
        if not apart.any():
            return np.concatenate([*used, np.zeros(0, np.int64)]), label
        at, low, high = at[apart], low[apart], high[apart]
        joined, first = np.unique(high, return_index=True)  # each label hangs on one that is lower
        used.append(at[first])
        onto = np.arange(len(label))
        onto[joined] = low[first]
        while (onto != onto[onto]).any():
            onto = onto[onto]
        label = onto[label]


def forest(x: dict, y: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links that span what a tile pair's fingerprints link: fewer links than fingerprints."""
    n = len(x["node"])
    label = np.arange(n if same else n + len(y["node"]))
    us, vs = [], []
    for p, q in _near(x, y, same):
        used, label = _joined(label, p, q if same else q + n)
        us.append(x["node"][p[used]])
        vs.append(y["node"][q[used]])
    return tuple(np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))


def checked(x: dict, y: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links that span what is alike in two blocks of one group (a, b, node, n, and sets).

    A set's shingles get numbers; one set at a time is marked, and the marks in the sets that it
    may be like are counted.
    """
    sides = [x] if same else [x, y]
    sizes = np.concatenate([z["n"] for z in sides]).astype(np.int64)
    distinct, number = np.unique(np.concatenate([h for z in sides for h in z["sets"]]), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(distinct), bool)
    n = len(x["node"])
    shift = 0 if same else n
    nodes = np.concatenate([z["node"] for z in sides])
    label = np.arange(len(nodes))
    us, vs = [], []
    for p, q in _near(x, y, same):
        order = np.argsort(p, kind="stable")
        rows, first = np.unique(p[order], return_index=True)
        for i, others in zip(rows.tolist(), np.split(q[order] + shift, first[1:])):
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            own = number[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            if 8 * len(others) > len(nodes):
                both = np.add.reduceat(mark[number], ends - sizes, dtype=np.int64)[others]
            else:
                both = np.array([np.count_nonzero(mark[number[ends[j] - sizes[j] : ends[j]]]) for j in others.tolist()])
            mark[own] = False
            good = both * ALIKE[1] >= ALIKE[0] * (sizes[i] + sizes[others] - both)
            for j in others[good].tolist():
                if label[j] != label[i]:
                    us.append(nodes[i])
                    vs.append(nodes[j])
                    label[label == label[j]] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, x, y, side): a pair's two blocks follow one another; a block with itself comes once."""

    def links(held: list[dict]) -> pa.RecordBatch:
        blocks = []
        for side in (0, 1):
            rows = {r["node"]: r for r in held if r["side"] == side}.values()  # a repeated row's node once
            columns = {c: np.array([r[c] for r in rows], np.int64) for c in _COLUMNS}
            sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
            blocks.append(columns | {c: columns[c].view(np.uint64) for c in ("a", "b")} | {"sets": sets})
        x, y = blocks
        same = held[0]["x"] == held[0]["y"]
        u, v = checked(x, x if same else y, same) if len(x["node"]) and (same or len(y["node"])) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (row["part"], row["x"], row["y"]) != tuple(held[0][c] for c in ("part", "x", "y")):
                yield links(held)
                held = []
            held.append(row)
    if held:
        yield links(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (ta, tb, side): the two tiles of a pair follow one another; a tile with itself comes once."""
    left = None
    for b in batches:
        for row in b.to_pylist():
            one = _tile(row)
            if row["ta"] == row["tb"]:
                u, v = forest(one, one, True)
            elif row["side"] == 0:
                left = one
                continue
            else:
                u, v = forest(left, one, False)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def candidates(signatures: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, v: links that span what fingerprints link of sets that can be alike; signatures: a, b, node, n, prefix (or null)."""
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = signatures.filter(F.col("prefix").isNotNull()).select(*_COLUMNS, "prefix")
    dealt = sets.mapInArrow(trimmed(_dealt(parts)), "bucket long, rows binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    links = stored(dealt.mapInArrow(trimmed(_meet(crowd)), "u long, v long"), "near-met")
    crowded = links.filter("u = v").select(F.col("u").alias("node")).distinct()
    links = links.filter("u <> v")
    if crowded.isEmpty():
        return links
    return links.unionByName(by_tiles(sets.drop("prefix").dropDuplicates(["node"]).join(crowded, "node", "left_semi")))


def by_tiles(nodes: DataFrame) -> DataFrame:
    """u, v: links that span what fingerprints link; nodes: a, b, node, n."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sets that are alike have sizes of ratio 0.8, so equal or neighbouring keys; a key is dealt out by salt
    keyed = nodes.select(
        *_COLUMNS, F.floor(F.log("n") / math.log(1.26)).cast("long").alias("key"), (F.bit_count("a") + F.bit_count("b")).alias("ones"),
        F.pmod(F.xxhash64("node"), F.lit(max(SALTS, nodes.count() // (64 * TILE)))).alias("salt"),
    )
    schema = "key long, tile long, low int, high int, a binary, b binary, node binary, n binary"
    tiles = stored(keyed.repartition(parts, "key", "salt").sortWithinPartitions("key", "ones").mapInArrow(trimmed(_tiles), schema), "near-tiles")
    index = tiles.select("key", "tile", "low", "high")
    other = index.select(F.col("key").alias("k"), F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    ahead = index.select(F.explode(F.array("key", F.col("key") + 1)).alias("k"), F.col("tile").alias("ta"), "key", "low", "high")
    met = ahead.join(other, "k").filter((F.col("k") > F.col("key")) | (F.col("ta") <= F.col("tb")))
    near = met.filter((F.col("lb") - F.col("high") <= RADIUS) & (F.col("low") - F.col("hb") <= RADIUS)).select("ta", "tb")
    sides = near.select("ta", "tb", F.explode(F.expr("if(ta = tb, array(0), array(0, 1))")).alias("side"))
    placed = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("ta")).otherwise(F.col("tb")))
    dealt = placed.join(tiles.drop("key", "low", "high"), "tile").repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", "side")
    return dealt.select("ta", "tb", "side", *_COLUMNS).mapInArrow(trimmed(_compare), "u long, v long")


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, nodes): doc_id, node of each row; and node, first (its smallest doc_id), root (the component's smallest node)."""
    text_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    signatures = stored(keyed.mapInArrow(trimmed(_signatures), f"doc_id {kind}, text_key long, node long, n int, a long, b long, prefix binary"), "near-signatures")
    nodes = stored(
        signatures.groupBy("node").agg(
            F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
        ),
        "near-nodes",
    )
    groups = components(candidates(signatures, CROWD))
    # the texts of groups are read again, one of each node, and their sets dealt out by group and pair of blocks
    members = groups.select("node", F.col("root").alias("part")).join(nodes, "node")
    blocks = members.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    wanted = stored(members.join(blocks, "part").select("at", "part", "blocks", *_COLUMNS), "near-wanted")
    texts = keyed.join(bounded(wanted, BROADCAST_NODES), F.struct("doc_id", "text_key").eqNullSafe(F.col("at")))
    sets = texts.select("part", "blocks", *_COLUMNS, "text").mapInArrow(trimmed(_sets), "part long, blocks int, a long, b long, node long, n int, set binary")
    own = sets.withColumn("t", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("t", j).alias("x"), F.greatest("t", j).alias("y"), (F.col("t") > j).cast("int").alias("side")),
    )
    dealt = own.withColumn("pair", F.explode(pair)).select("part", "pair.x", "pair.y", "pair.side", *_COLUMNS, "set")
    links = dealt.repartition(parts, "part", "x", "y").sortWithinPartitions("part", "x", "y", "side").mapInArrow(trimmed(_check), "u long, v long")
    roots = components(links)
    return signatures, nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row of docs: the smallest doc_id that links reach, itself included.

    Texts without a word are alike, and copies of each other. A null doc_id counts only if its
    component has no other. Repeated rows are returned as often as they came; an empty table
    gives no rows. Other columns than doc_id and text are not read.
    """
    signatures, nodes = rooted(docs)
    nodes = stored(nodes, "near-rooted")
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = nodes.join(least, "root").select("node", "component_id")
    return signatures.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the rows with the smallest doc_id; equal ones (doc_id and text) once.

    Of texts without an id those stay that no document with one is near. Texts are shuffled only
    where what goes is too much to broadcast; equal rows meet by themselves.
    """
    signatures, nodes = rooted(docs)
    stay = nodes.groupBy("root").agg(F.min("first").alias("stay")).select("stay").distinct()
    gone = stored(signatures.select("doc_id").distinct().join(stay, F.col("doc_id").eqNullSafe(F.col("stay")), "left_anti").select(F.col("doc_id").alias("gone")), "near-gone")
    kept = docs.join(bounded(gone, BROADCAST_NODES), F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    again = stored(signatures.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.struct("doc_id", "text_key").alias("again")), "near-repeated")
    if again.isEmpty():
        return kept
    keyed = kept.withColumn("text_key", text_key("text"))
    met = F.struct("doc_id", "text_key").eqNullSafe(F.col("again"))
    again = bounded(again, BROADCAST_NODES)
    once = keyed.join(again, met, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return keyed.join(again, met, "left_anti").unionByName(once).drop("text_key")
