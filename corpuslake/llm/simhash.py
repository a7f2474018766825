"""Near duplicates by 64-bit SimHash, linked by tiled exact comparison.

fingerprints() makes one fingerprint per text, near_duplicates() links every two
fingerprints that differ in at most `radius` bits and labels the components.

The comparison is exact and in tiles. Only different fingerprints are compared, so
exact copies cost nothing. A tile holds fingerprints whose halves (of many
fingerprints: whose quarters) have the same population counts; two fingerprints at distance
d differ by at most d in the sum of these counts, so tile pairs farther apart than the
radius are skipped unseen. The rest are compared by numpy exclusive-or and bit counts, and
each tile pair yields a spanning forest of its links, never all pairs of a group. Cost:
about 24 % of all pairs of different fingerprints by halves and 5 % by quarters, 1 ns a
pair; quarters make tiles too small to be worth it before there are millions. Either way it
still grows with the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import blob, forget, stored, text_batches

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one tile at most: 32 KB.
TILE = 4096
#: From so many different fingerprints on tiles go by quarters, and keys are dealt out by a salt for each so many.
QUARTERS_FROM, SALT_FROM = 4_000_000, 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if shingle == 3 and n > 1:
        hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)]
    bits = np.zeros(64, np.int64)
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, n, 65536):
        bits += np.unpackbits(octets[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in blob(b.column("text"))], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row.

    A null or blank text has fingerprint 0. Repeated rows are kept. Columns other
    than doc_id and text are not read.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints, f"doc_id {kind}, fp long"
    )


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of a tile pair's graph of near fingerprints.

    Each fingerprint has its component's label; a row of the comparison joins its label with
    the others that it meets. There are fewer joins than fingerprints, however many are near.
    """
    n, m = len(a), len(b)
    label = np.arange(n) if same else np.arange(n + m)
    right = label if same else label[n:]  # a view of b's labels
    found = []
    step = max(1, (1 << 21) // max(1, m))
    for i in range(0, n, step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        if same:
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        for p in np.flatnonzero(near.any(axis=1)).tolist():
            columns = np.flatnonzero(near[p])
            met = right[columns]
            own = label[i + p]
            for other in np.unique(met[met != own]).tolist():
                found.append((int(a[i + p]), int(b[columns[met == other][0]])))
                label[label == other] = own
    return found


def _compare(radius: int):
    """Rows sorted by (ta, tb, side): the two tiles of a pair follow one another; a tile with itself comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for ta, tb, side, data in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb", "side", "data"))):
                one = np.frombuffer(data, "<i8").view("<u8")
                if ta == tb:
                    links += _forest(one, one, True, radius)
                elif side == 0:
                    left = one
                else:
                    links += _forest(left, one, False, radius)
            pairs = np.array(links, "<u8").reshape(-1, 2).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part): one row per tile, with its fingerprints as bytes.

    A tile's rows are adjacent; a tile that a batch boundary cuts becomes two.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
        cut = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut, [len(key)]])
        keys, parts, data = [], [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            for i in range(s, e, TILE):
                keys.append(int(key[s]))
                parts.append(int(fp[i]))
                data.append(fp[i : min(e, i + TILE)].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())],
            names=["key", "tile", "data"],
        )


def _offsets(radius: int, parts: int) -> list[int]:
    """Key differences of tiles that can hold near fingerprints, one of each +/- pair."""
    found = []
    for d in product(range(-radius, radius + 1), repeat=parts):
        if sum(map(abs, d)) <= radius and d > (0,) * parts:
            found.append(sum(x << 6 * (parts - 1 - i) for i, x in enumerate(d)))
    return found


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that connect just those fingerprints that are near, transitively.

    distinct: fp (long), no repeats.
    """
    n = distinct.count()
    parts = 4 if n >= QUARTERS_FROM else 2
    width = 64 // parts
    key = F.lit(0).cast("long")
    for i in reversed(range(parts)):  # counts are under 64
        part = F.shiftright("fp", width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = key * 64 + F.bit_count(part).cast("long")
    shuffles = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = distinct.withColumns({"key": key, "salt": F.pmod(F.xxhash64("fp"), F.lit(1 + n // SALT_FROM))})
    tiles = stored(
        salted.repartition(shuffles, "key", "salt")
        .sortWithinPartitions("key", "fp")
        .select("key", "fp")
        .mapInArrow(_tiles, "key long, tile long, data binary"),
        "simhash-tiles",
    )
    index = tiles.select("key", "tile")
    # the second tile's key is the first one's plus a difference, or the same
    ahead = index.select(
        F.col("tile").alias("ta"), F.col("key").alias("from"), F.explode(F.array(*[F.col("key") + d for d in [0, *_offsets(radius, parts)]])).alias("key")
    )
    met = ahead.join(index.withColumnRenamed("tile", "tb"), "key").filter((F.col("key") != F.col("from")) | (F.col("ta") <= F.col("tb")))
    sides = met.select("ta", "tb", F.explode(F.expr("if(ta = tb, array(0), array(0, 1))")).alias("side"))
    placed = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("ta")).otherwise(F.col("tb")))
    # data moves once for each pair of tiles, to where the pair is dealt
    dealt = placed.join(tiles.select("tile", "data"), "tile").repartition(shuffles, "ta", "tb").sortWithinPartitions("ta", "tb", "side")
    return dealt.select("ta", "tb", "side", "data").mapInArrow(_compare(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of an edge list (u, v long) and its component's smallest node.

    Rounds of large-star and small-star until the stars stay as they are, each round
    written to the shared folder. Edges never come to the driver, and none is made that
    the last round did not have in another form: the count of edges does not grow.
    """
    now = stored(edges.filter("u <> v").distinct(), "stars")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = stored(small, "stars")
        forget(now)
        heads = after.select(F.col("v").alias("u")).distinct()
        # every node has one parent, and no parent has one: stars, done
        if after.groupBy("u").count().filter("count > 1").isEmpty() and after.join(heads, "u", "left_semi").isEmpty():
            nodes = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    component_id is the smallest doc_id that links reach from the row, itself
    included. Null and blank texts have fingerprint 0 and link like any other. A null
    doc_id counts as the smallest only if its whole component has no other. Repeated
    rows are returned as often as they came; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    nodes = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
