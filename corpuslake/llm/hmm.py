"""Language model scores: a hidden Markov model over words, and a smoothed unigram base.

Every distinct training token is counted, over the whole corpus. The hidden Markov
model's alphabet is the most frequent words, one symbol each, classes of all other words
by their last two bytes, and the end of a text; a word's probability is its symbol's, by
the model, times its share of its class, by the counts. Baum-Welch begins from a bounded
sample and then reads all training documents, until the likelihood of a token hardly grows:
each partition adds up its expected counts, and the sums of a fixed size (symbols x states) are
added across partitions. Training too takes whole documents: forward variables are kept where
stretches begin and those between are computed again on the way back, so sums are exact and
memory is bounded at any length. A text's likelihood is exact, by the scaled forward recursion
over all its tokens.

Counts of the HEAD most frequent words go to every task (a bound of some 5 MB); rarer
words are joined with the table of counts by Spark, so no table that grows with the
corpus is broadcast or collected.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import blob, stored, text_batches

STATES = 8
#: Words with a symbol of their own, and classes for the others.
SYMBOLS, CLASSES = 2000, 256
END = SYMBOLS + CLASSES
#: A pad after a training sequence; never an emission.
PAD = END + 1
HEAD = 300_000
SMOOTHING = 0.1
#: Tokens between places where forward variables are kept.
STRETCH = 256
#: The warm start: so many documents, or fewer from so many tokens on, and rounds on them; then rounds on everything,
#: fewer if a round gains less than so much log10 likelihood a token.
SAMPLE, SAMPLE_TOKENS, SAMPLE_ROUNDS, ROUNDS, GAIN = 1500, 1_000_000, 15, 4, 0.002
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 300_000
#: Documents and training stretches that one step of the recursions serves.
LANES = 2048


@dataclass
class Model:
    start: np.ndarray  #: states
    move: np.ndarray  #: states x states
    emit: np.ndarray  #: (PAD + 1) x states


def word_class(word: bytes) -> int:
    """By the last two bytes."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([word_class(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "class", "n"],
        )

    counts: Counter = Counter()
    for b in batches:
        for text in blob(b.column("text")):
            counts.update(text.lower().split())
        if len(counts) >= COUNTED:
            yield rows(counts)
            counts = Counter()
    if counts:
        yield rows(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), class, n of all words of docs (text binary)."""
    counted = docs.select("text").mapInArrow(_count, "word binary, class int, n long")
    return counted.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task gets of the counts: the head, and figures of the whole."""

    words: bytes  #: the head's words, joined by a space, most frequent first
    counts: np.ndarray
    classes: np.ndarray
    n_docs: int  #: training documents
    n_tokens: int  #: training tokens, ends included
    n_distinct: int  #: different ones
    class_tokens: np.ndarray  #: of words without a symbol of their own
    class_distinct: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def base(self) -> float:
        """log10 of the unigram's denominator."""
        return float(np.log10(self.n_tokens + SMOOTHING * (self.n_distinct + 1)))

    def shares(self) -> np.ndarray:
        """log10 of each class's denominator."""
        return np.log10(self.class_tokens + SMOOTHING * (self.class_distinct + 1))


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """The bounded part of a table of counts that tasks need."""
    # the least count of the head, from a histogram of a few thousand buckets at most; words of one bucket stay together
    bucket = F.floor(F.log2("n") * 64).cast("int")
    held, chosen = 0, F.lit(False)
    for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        if held + r["n"] > HEAD:  # of the bucket that does not fit, a share by hash
            share = int((HEAD - held) / r["n"] * 0.98 * (1 << 30))
            chosen |= (bucket == r["b"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share)
            break
        held += r["n"]
        chosen = bucket >= r["b"]
    head = counts.filter(chosen).toArrow()
    head = head.sort_by([("n", "descending"), ("word", "ascending")])
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()
    words, n = head.column("word").to_pylist(), head.column("n").to_numpy()
    classes = head.column("class").to_numpy()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["d"]
    total, different = int(tokens.sum()) + n_docs, int(distinct.sum()) + (n_docs > 0)
    np.subtract.at(tokens, classes[:SYMBOLS], n[:SYMBOLS])
    np.subtract.at(distinct, classes[:SYMBOLS], 1)
    return Vocabulary(b" ".join(words), n, classes, n_docs, total, different, tokens, distinct)


_tables: dict[str, tuple] = {}


def _lookup(shared) -> tuple:
    """A worker's dictionary of the head and its arrays, made once."""
    v: Vocabulary = shared.value
    if v.name not in _tables:
        _tables.clear()
        words = v.words.split(b" ") if v.words else []
        symbols = np.arange(len(words))
        symbols[SYMBOLS:] = SYMBOLS + v.classes[SYMBOLS:]
        logs = np.log10(v.counts + SMOOTHING)
        within = np.where(np.arange(len(words)) < SYMBOLS, 0.0, logs - v.shares()[v.classes] if len(words) else 0.0)
        _tables[v.name] = ({w: i for i, w in enumerate(words)}, symbols.astype(np.uint16), logs, within, v)
    return _tables[v.name]


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, symbols, logs, within, v = _lookup(shared)
        get = index.get
        end_log = float(np.log10(v.n_docs + SMOOTHING))
        shares, least = v.shares(), float(np.log10(SMOOTHING))
        for b in batches:
            codes, totals, known, base, own, rare = [], [], [], [], [], []
            for text in blob(b.column("text")):
                words = text.lower().split()
                at = np.array([get(w, -1) for w in words], np.int64)
                missing = np.flatnonzero(at < 0).tolist()
                out = np.empty(len(words) + 1, np.uint16)
                out[-1] = END
                inside, tail = at[at >= 0], [words[i] for i in missing]
                out[:-1] = symbols[at] if len(symbols) else 0
                kinds = [word_class(w) for w in tail]
                out[missing] = [SYMBOLS + c for c in kinds]
                codes.append(out.tobytes())
                totals.append(len(out))
                known.append(len(inside) + (v.n_docs > 0))
                # rare words count as never learned here; what the table of counts knows of them is added by a join
                base.append(float(logs[inside].sum()) + end_log + least * len(tail) - v.base() * len(out))
                own.append(float(within[inside].sum() + (least - shares[kinds]).sum()))
                rare.append([{"word": w, "k": k} for w, k in Counter(tail).items()])
            arrays = [
                b.column("doc_id"), b.column("held_out"), pa.array(codes, pa.binary()), pa.array(totals, pa.int64()),
                pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()),
                pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "codes", "n_tokens", "known", "base", "own", "rare"])

    return run


def _forward(m: Model, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables (T, N, states) and the scales (T, N) of symbols x (T, N); begin: the states' probabilities before them."""
    t, n = x.shape
    alpha = np.empty((t, n, len(m.start)), np.float32)
    scale = np.empty((t, n), np.float32)
    a = begin
    for i in range(t):
        a = (a if i == 0 else a @ m.move) * m.emit.take(x[i], axis=0)
        scale[i] = a.sum(axis=1)
        a /= scale[i][:, None]
        alpha[i] = a
    return alpha, scale


def _stretch(parts: list[np.ndarray], at: int) -> np.ndarray:
    """Symbols (STRETCH, N) from a place on, of sequences that reach it, the longest first."""
    cut = [p[at : at + STRETCH] for p in parts if len(p) > at]
    x = np.full((len(cut), max(map(len, cut))), PAD, np.uint16)
    for row, p in zip(x, cut):
        row[: len(p)] = p
    return np.ascontiguousarray(x.T)


def expected(m: Model, codes: list[bytes]) -> np.ndarray:
    """Expected counts of Baum-Welch over whole sequences: starts, moves, emissions, and the log10 likelihood, in one array."""
    k = len(m.start)
    parts = sorted((np.frombuffer(c, np.uint16) for c in codes if c), key=len, reverse=True)
    starts, moves, emissions, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((PAD + 1, k)), 0.0
    for lane in range(0, len(parts), LANES):
        some = parts[lane : lane + LANES]
        places = range(0, len(some[0]), STRETCH)
        begins: list[np.ndarray] = []
        begin = np.broadcast_to(m.start, (len(some), k))
        for at in places:
            x = _stretch(some, at)
            begins.append(begin[: x.shape[1]])
            alpha, scale = _forward(m, x, begins[-1])
            likelihood += float(np.log10(scale, dtype=np.float64)[x != PAD].sum())
            begin = alpha[-1] @ m.move
        after = None  # emission times backward variable of the token after the stretch, of sequences that go on
        for at in reversed(places):
            if at != places[-1]:  # the last one's are still there
                x = _stretch(some, at)
                alpha, scale = _forward(m, x, begins[at // STRETCH])
            t, n = x.shape
            beta = np.ones((n, k), np.float32)
            if after is not None:
                moves += alpha[-1, : len(after)].T.astype(np.float64) @ after
                beta[: len(after)] = after @ m.move.T
            gamma = np.empty((t, n, k), np.float32)
            gamma[-1] = alpha[-1] * beta
            for i in range(t - 1, 0, -1):
                w = m.emit.take(x[i], axis=0) * beta
                w /= scale[i][:, None]
                moves += alpha[i - 1].T.astype(np.float64) @ (w * (x[i] != PAD)[:, None])
                beta = w @ m.move.T
                gamma[i - 1] = alpha[i - 1] * beta
            after = m.emit.take(x[0], axis=0) * beta / scale[0][:, None]
            flat = x.reshape(-1)
            for j in range(k):
                emissions[:, j] += np.bincount(flat, weights=gamma[:, :, j].reshape(-1), minlength=PAD + 1)
        starts += gamma[0].sum(axis=0, dtype=np.float64)
    return np.concatenate([starts, (moves * m.move).ravel(), emissions.ravel(), [likelihood]])


def updated(m: Model, sums: np.ndarray, unigram: np.ndarray) -> Model:
    """The model of expected counts, each state's emissions smoothed by a little of the unigram."""
    k = len(m.start)
    start = sums[:k] + 0.1
    move = sums[k : k + k * k].reshape(k, k) + 0.1
    emit = sums[k + k * k : -1].reshape(PAD + 1, k).copy()
    emit[PAD] = 0
    emit += unigram[:, None] * np.maximum(1.0, 1e-3 * emit.sum(axis=0))
    emit /= emit.sum(axis=0)
    emit[PAD] = 1
    return Model((start / start.sum()).astype(np.float32), (move / move.sum(axis=1, keepdims=True)).astype(np.float32), emit.astype(np.float32))


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        total = None
        held: list[bytes] = []

        def more() -> None:
            nonlocal total, held
            if held:
                one = expected(m, held)
                total, held = one if total is None else total + one, []

        for b in batches:
            held += b.column("codes").to_pylist()
            if len(held) >= 4 * LANES:
                more()
        more()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for sums in b.column("sums").to_pylist():
            one = np.frombuffer(sums)
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def train(coded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Baum-Welch over the training rows of coded: sample first, then everything.

    The sums of a partition have a fixed size (some 150 KB); they are added in up to 32
    tasks, whose sums the driver adds.
    """
    spark = coded.sparkSession
    rng = np.random.default_rng(seed)
    unigram = np.zeros(PAD + 1)
    unigram[: min(SYMBOLS, len(v.counts))] = v.counts[:SYMBOLS]
    unigram[SYMBOLS:END] = v.class_tokens
    unigram[END] = v.n_docs
    unigram[:PAD] += SMOOTHING
    unigram /= unigram.sum()
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (PAD + 1, states))
    emit /= emit.sum(axis=0)
    emit[PAD] = 1
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    m = Model(np.full(states, 1 / states, np.float32), move.astype(np.float32), emit.astype(np.float32))
    known = coded.filter("not held_out")
    if not v.n_docs:
        return m
    # documents whose row's hash is small enough for somewhat more than SAMPLE of them, so that no task sends many
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    near = known.filter(place < int(min(1.0, 1.5 * SAMPLE / v.n_docs) * (1 << 30))).select("row", "n_tokens", place.alias("place"))
    picked, tokens = [], 0
    for r in near.orderBy("place", "row").limit(SAMPLE).collect():
        if picked and tokens + r["n_tokens"] > SAMPLE_TOKENS:
            break
        picked.append(r["row"])
        tokens += r["n_tokens"]
    codes = [bytes(r["codes"]) for r in known.filter(F.col("row").isin(picked)).select("codes").collect()]
    for _ in range(SAMPLE_ROUNDS if codes else 0):
        m = updated(m, expected(m, sorted(codes)), unigram)
    before = -np.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(m)
        rows = known.select("codes").mapInArrow(_expect(shared), "sums binary").repartition(32).mapInArrow(_add, "sums binary").collect()
        sums = sum(np.frombuffer(r[0]) for r in rows)
        shared.unpersist()
        m = updated(m, sums, unigram)
        if sums[-1] - before < GAIN * v.n_tokens:
            break
        before = sums[-1]
    return m


def likelihoods(m: Model, codes: list[bytes]) -> np.ndarray:
    """Exact log10 likelihood of each whole sequence of symbols, by the scaled forward recursion."""
    parts = [np.frombuffer(c, np.uint16) for c in codes]
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    length = np.array([len(parts[i]) for i in order])
    total = np.zeros(len(parts))
    a = None
    for at in range(0, int(length.max(initial=0)), STRETCH):
        active = int(np.searchsorted(-length, -at))  # longer than at
        x = np.full((active, STRETCH), PAD, np.uint16)
        for row, i in zip(x, order):
            part = parts[i][at : at + STRETCH]
            row[: len(part)] = part
        x = np.ascontiguousarray(x.T)
        a = np.broadcast_to(m.start, (active, len(m.start))) if a is None else a[:active] @ m.move
        scale = np.ones((STRETCH, active), np.float32)
        for i in range(STRETCH):
            n = int(np.searchsorted(-length[:active], -(at + i)))
            if not n:
                break
            a = (a[:n] if i == 0 else a[:n] @ m.move) * m.emit.take(x[i, :n], axis=0)
            s = a.sum(axis=1)
            a /= s[:, None]
            scale[i, :n] = s
        total[:active] += np.log10(scale, dtype=np.float64).sum(axis=0)
    out = np.empty(len(parts))
    out[order] = total
    return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value

        def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            found = likelihoods(m, t.column("codes").to_pylist())
            out = t.drop_columns(["codes"]).append_column("model", pa.array(found, pa.float64()))
            return out.combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= 4 * LANES:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows where held_out is true are scored but not learned from. A text's tokens are its
    words, A-Z lower-cased, and one end; a null or blank text is its end alone. Repeated
    rows are learned from and scored each. Without training rows all words are unknown
    and the model is the random start. Other columns than doc_id and text are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    known = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(known), "word-counts")
    v = vocabulary(counts, known.select("doc_id").count())
    shared = spark.sparkContext.broadcast(v)
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = stored(
        rows.mapInArrow(_code(shared), f"doc_id {kind}, held_out boolean, codes binary, n_tokens long, known long, base double, own double, rare array<struct<word:binary,k:bigint>>")
        .withColumn("row", F.monotonically_increasing_id()), "coded",
    )
    model = spark.sparkContext.broadcast(train(coded, v, states, rounds))
    names = "doc_id", "held_out", "n_tokens", "known", "base", "own", "row", "codes"
    scored = coded.select(*names).mapInArrow(
        _score(model), f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, own double, row long, model double"
    )
    # rarer words meet their counts in a join; one that was never learned has none, and stays as it was counted
    each = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    gain = F.col("k") * (F.log10(F.col("n") + SMOOTHING) - float(np.log10(SMOOTHING)))
    rare = (
        each.join(counts.select("word", "n"), "word").select("row", "k", gain.alias("gain"))
        .groupBy("row").agg(F.sum("k").alias("k"), F.sum("gain").alias("gain"))
    )
    more = F.coalesce("gain", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(v.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("model") + F.col("own") + more).alias("score"),
    )
