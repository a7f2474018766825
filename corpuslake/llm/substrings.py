"""Repeated passages removed by matching statistics against suffix automata.

A window is WINDOW consecutive words; a word goes if some window over it also starts
earlier, in a smaller doc_id or before in the same document. The corpus is never matched
against all of itself. Each window has an anchor, the leftmost smallest hash among its
GRAM-word sequences, so equal windows have equal anchors, wherever they occur:

1. Later copies of a whole text lose all their windows and need no more search. The other
   documents give their anchors' hashes; a hash that one document or block of documents
   has once is compared with the other blocks' by one sorted pass over a shuffle of one
   row for each hash and block. What repeats, goes back to its documents.
2. Windows that share an anchor make a piece of at most 2 * WINDOW - GRAM words. Pieces
   of repeated anchors are routed by anchor to reference shards, equal ones merged on the
   way (first occurrence kept). A shard reads its pieces in order of their first
   occurrence through a suffix automaton of the pieces before: where the match is shorter
   than a window, the window is new.
3. Documents drop what their repeated anchors cover, but for windows that are new there.

Shards are routed and not broadcast to every task, as broadcast shards would make the work
grow with the square of the corpus. Texts are shuffled once, for all steps together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpuslake.llm.common import NULL_ID, blob, bounded, stored, text_batches, text_key

WINDOW = 20
GRAM = 6
#: Anchors of one block in step 1 (12 MB), and pieces that step 2 merges before it sends them.
BLOCK_ANCHORS, BLOCK_PIECES = 400_000, 40_000
#: An anchor that occurs so often is dealt out by windows; bounds a shard's automaton to some 20 MB.
CROWDED = 1_000
#: Keys of repeated rows are broadcast up to so many (some 20 MB).
BROADCAST_KEYS = 500_000
#: Parts of a hot group of copies.
SALTS = 32
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) ** 7 & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], np.uint64)


def pieces(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, anchor place, first and last window of each run of windows with one anchor."""
    n = len(words)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    g = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        g += h[i : i + len(g)] * _FACTORS[i]
    g ^= g >> np.uint64(31)
    g *= _FACTORS[40]
    g ^= g >> np.uint64(29)
    width, place, least = 1, np.arange(len(g)), g
    span = window - gram + 1
    while width < span:  # least hash of so many places from here, leftmost first
        step = min(width, span - width)
        right = least[step:] < least[: len(least) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        least = g[place]
        width += step
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(place)]]) - 1
    return g[place[first]], place[first], first, last


def _anchors(window: int, gram: int):
    """route, hash, row_key, n rows (see repeated())."""

    def rows(hashes: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        k = np.repeat(np.array(keys, np.int64), [len(x) for x in hashes])
        values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        many = count[inverse] > 1
        single, spoken = h[~many].view(np.int64), values[count > 1].view(np.int64)
        known = np.unique(np.stack([h[many].view(np.int64), k[many]]), axis=1)
        scattered = (known[0].view(np.uint64) * _FACTORS[41] ^ known[1].view(np.uint64) * _FACTORS[42]).view(np.int64)
        nothing = lambda n: pa.nulls(n, pa.int64())
        columns = [
            pa.concat_arrays([pa.array(single), pa.array(spoken), pa.array(scattered)]),
            pa.concat_arrays([nothing(len(single)), nothing(len(spoken)), pa.array(known[0])]),
            pa.concat_arrays([pa.array(k[~many]), nothing(len(spoken)), pa.array(known[1])]),
            pa.array(np.concatenate([np.ones(len(single), np.int32), count[count > 1].astype(np.int32), np.zeros(len(scattered), np.int32)])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["route", "hash", "row_key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        keys: list[int] = []
        held = 0
        for b in batches:
            for key, text in zip(b.column("row_key").to_pylist(), blob(b.column("text"))):
                found = pieces(text.split(), window, gram)[0]
                if len(found):
                    hashes.append(found)
                    keys.append(key)
                    held += len(found)
                if held >= BLOCK_ANCHORS:
                    yield rows(hashes, keys)
                    hashes, keys, held = [], [], 0
        if held:
            yield rows(hashes, keys)

    return run


def _meet(crowded: int):
    """Rows sorted by route: row_key, hash of anchors that another block has too, or that are known to repeat;
    and a row without row_key for each anchor that occurs crowded times or more in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None  # the last batch's last route, its row if that has not been given out, and its count
        waiting: int | None = None
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            hash_, key = b.column("hash"), b.column("row_key")
            known = hash_.is_valid().to_numpy(zero_copy_only=False)
            out_h, out_k = [hash_.filter(pa.array(known)).to_numpy()], [key.filter(pa.array(known)).to_numpy()]
            route, n = b.column("route").to_numpy()[~known], b.column("n").to_numpy()[~known].astype(np.int64)
            rest = key.filter(pa.array(~known))
            single = rest.is_valid().to_numpy(zero_copy_only=False)
            row = rest.fill_null(0).to_numpy()
            often = np.zeros(0, np.int64)
            if len(route):
                same = route[1:] == route[:-1]
                twice = np.zeros(len(route), bool)
                twice[1:] |= same
                twice[:-1] |= same
                starts = np.flatnonzero(np.concatenate([[True], ~same]))
                totals = np.add.reduceat(n, starts)
                fresh = np.ones(len(starts), bool)
                if last == route[0]:
                    twice[0] = True
                    fresh[0] = total < crowded
                    totals[0] += total
                    if waiting is not None:
                        out_h.append(np.array([last]))
                        out_k.append(np.array([waiting]))
                often = route[starts][(totals >= crowded) & fresh]
                take = twice & single
                out_h.append(route[take])
                out_k.append(row[take])
                last, total = int(route[-1]), int(totals[-1])
                waiting = int(row[-1]) if single[-1] and not twice[-1] else None
            keys = np.concatenate(out_k)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(keys), pa.nulls(len(often), pa.int64())]), pa.array(np.concatenate([*out_h, often]))], names=["row_key", "hash"]
            )

    return run


def repeated(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """row_key, hashes, crowded: the anchors of a row that occur elsewhere in the corpus, or
    twice in it; and those of them that occur very often.

    rows: row_key, text (binary). A block of documents sends a hash that it has once with
    its row, and one that it has more often without, but with their number; the rows of
    the latter are known to repeat and only pass through, scattered. So a hash has one row
    for each block at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(_anchors(window, gram), "route long, hash long, row_key long, n int")
    met = sent.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_meet(crowded), "row_key long, hash long")
    often = met.filter("row_key is null").select("hash", F.lit(True).alias("often"))
    each = met.filter("row_key is not null").join(often, "hash", "left")
    return each.groupBy("row_key").agg(F.collect_set("hash").alias("hashes"), F.collect_set(F.when(F.col("often"), F.col("hash"))).alias("crowded"))


def _cut(window: int, gram: int):
    """anchor, lead, content, doc_key, row_key, place, shift of the pieces whose anchors repeat; equal ones of a block once.

    Of a crowded anchor each window by itself, under its own hash: shift is its number in the piece.
    """

    def rows(best: dict) -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in best.items())))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = ["anchor", "lead", "content", "doc_key", "row_key", "place", "shift"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for b in batches:
            hashes, crowded = b.column("hashes"), b.column("crowded")
            for i, (doc_id, row_key, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), blob(b.column("text")))):
                words = text.split()
                h, place, first, last = pieces(words, window, gram)
                h = h.view(np.int64)
                doc_key = NULL_ID if doc_id is None else doc_id
                often = np.isin(h, crowded[i].values.to_numpy())
                for j in np.flatnonzero(np.isin(h, hashes[i].values.to_numpy())).tolist():
                    f, p, z = int(first[j]), int(place[j]), int(last[j])
                    if often[j]:
                        each = [(s - f, b" ".join(words[s : s + window])) for s in range(f, z + 1)]
                        found = [((xxhash.xxh64_intdigest(c) - (1 << 63), -1, c), (doc_key, row_key, p, n)) for n, c in each]
                    else:
                        found = [((int(h[j]), p - f, b" ".join(words[f : z + window])), (doc_key, row_key, p, 0))]
                    for key, at in found:
                        if key not in best or at < best[key]:
                            best[key] = at
                if len(best) >= BLOCK_PIECES:
                    yield rows(best)
                    best = {}
        if best:
            yield rows(best)

    return run


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each place the length of the longest sequence that ends there and occurs in what was added."""
        state = size = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            out.append(size)
        return out

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            now = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = now


def _new_windows(window: int):
    """Rows sorted by anchor and first occurrence: row_key, doc_key, place, mask of windows that are new in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor: int | None = None
        held: bytes | None = None  # the shard's first piece: no automaton is built before a second one comes
        shard = Automaton()
        for b in batches:
            masks = []
            for a, content, shift in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "shift"))):
                if a != anchor:
                    anchor, held = a, content
                    shard = Automaton()
                    masks.append(((1 << (content.count(b" ") + 2 - window)) - 1) << shift)
                    continue
                if held is not None:
                    shard.add(held.split())
                    held = None
                words = content.split()
                mask = sum(1 << i for i, n in enumerate(shard.statistics(words)[window - 1 :]) if n < window)
                if mask:
                    shard.add(words)
                masks.append(mask << shift)
            columns = [b.column(c) for c in ("row_key", "doc_key", "place")]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(masks, pa.int64())], names=["row_key", "doc_key", "place", "mask"])
            yield out.filter(pa.array([bool(m) for m in masks], pa.bool_()))

    return run


def new_windows(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_key, news: places of anchors with windows that occur nowhere earlier, and which these are.

    found: what _cut gives. All windows of one anchor, or all equal windows of a crowded
    one, meet in one shard, equal pieces merged.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = (
        found.repartition(parts, "anchor").groupBy("anchor", "lead", "content")
        .agg(F.min(F.struct("doc_key", "row_key", "place", "shift")).alias("at")).select("anchor", "content", "at.*")
    )
    judged = merged.sortWithinPartitions("anchor", "doc_key", "row_key", "place", "content").mapInArrow(
        _new_windows(window), "row_key long, doc_key long, place int, mask long"
    )
    return judged.groupBy("row_key").agg(F.collect_list(F.struct("doc_key", "place", "mask")).alias("news"))


def later_copies(rows: DataFrame) -> DataFrame:
    """row_key, copy (true) of rows whose whole text a smaller doc_id has too."""
    keyed = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_key"), "row_key", F.sha2("text", 256).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("doc_key").alias("first"), F.max("doc_key").alias("last")).filter("first < last")
    # a text may be copied a million times: its rows are dealt by digest and salt
    salted = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    later = dealt.join(salted, ["digest", "salt"]).filter("doc_key > first")
    return later.select("row_key").distinct().withColumn("copy", F.lit(True))


def _drop(window: int, gram: int, with_text: bool):
    names = ["row_key", "doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals, removed, digests, texts = [], [], [], []
            hashes, news, copies = b.column("hashes"), b.column("news").to_pylist(), b.column("copy").to_pylist()
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), blob(b.column("text")))):
                words = text.split()
                n = len(words)
                gone = None
                if copies[i] and n >= window:
                    words = []
                elif hashes[i].is_valid and n >= window:
                    h, place, first, last = pieces(words, window, gram)
                    hit = np.isin(h.view(np.int64), hashes[i].values.to_numpy())
                    doc_key = NULL_ID if doc_id is None else doc_id
                    fresh: dict[int, int] = {}
                    for x in news[i] or ():
                        if x["doc_key"] == doc_key:
                            fresh[x["place"]] = fresh.get(x["place"], 0) | x["mask"]
                    edge = np.zeros(n + 1, np.int64)
                    for p, f, z in zip(place[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                        mask = fresh.get(p)
                        if mask is None:
                            edge[f] += 1
                            edge[z + window] -= 1
                        else:
                            for s in range(f, z + 1):
                                if not mask >> (s - f) & 1:
                                    edge[s] += 1
                                    edge[s + window] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                totals.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            columns = [b.column("row_key"), b.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept (the words left, joined by a space) if with_text.

    doc_id is a whole number, as "earlier" goes by its size; other ids raise an error. A window has
    so many words that a piece's windows fit 63 bits (69 at most with GRAM). Windows are judged on
    the input. A null or blank text has no words; a text of fewer
    words than a window loses none. Repeated rows (same doc_id and text) do not count as
    earlier than one another, but inside a row, and between rows of one doc_id with
    other texts (in the order of a hash of them), places count. A null doc_id comes before
    all others. An empty table gives no rows; other columns than doc_id and text are not read.
    Repeated rows are worked on once, and their result is given as often as they came.
    """
    if not gram <= window or window - gram + 1 > 63:
        raise ValueError("a window has from gram to gram + 62 words")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    text_batches(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    repeats = stored(every.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-rows")
    if repeats.isEmpty():
        return _once(every, window, gram, with_text).drop("row_key")
    keys = bounded(repeats, BROADCAST_KEYS)
    some = every.join(keys.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
    rows = every.join(keys.select("row_key"), "row_key", "left_anti").select(every.columns).unionByName(some.select(every.columns))
    found = _once(rows, window, gram, with_text).join(keys, "row_key", "left")
    again = F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1)).cast("int")))
    return found.withColumn("again", again).drop("row_key", "n", "again")


def _once(rows: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """row_key and the result of different rows."""
    copies = later_copies(rows)
    again = repeated(rows.join(copies, "row_key", "left_anti"), window, gram)
    concerned = rows.join(again, "row_key").select("doc_id", "row_key", "text", "hashes", "crowded")
    found = concerned.mapInArrow(_cut(window, gram), "anchor long, lead int, content binary, doc_key long, row_key long, place int, shift int")
    new = new_windows(found, window)
    whole = (
        rows.join(copies, "row_key", "left").join(again.select("row_key", "hashes"), "row_key", "left").join(new, "row_key", "left")
        .select("row_key", "doc_id", "text", "hashes", "news", "copy")
    )
    return whole.mapInArrow(
        _drop(window, gram, with_text), "row_key long, doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    )
