"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is a minimal gated unit in each direction, trained in numpy by
backpropagation through time. It labels every byte of a text; a document's
probabilities are the mean over all its bytes. Texts are read in blocks of BLOCK bytes, with
CONTEXT more on either side in which the states warm up and no label counts (in training
too), so that one step serves thousands of blocks at once, the cost is the same for each byte
of a text of any length, and no byte is labelled without what stands around it. Nothing is
shuffled: one scan of the documents, the model as a closure of a few KB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import ROW, passing, quoted, text_batches, unnamed

BLOCK, CONTEXT = 224, 32
WIDTH = BLOCK + 2 * CONTEXT
#: Numbers that a step's labels take; bounds a worker's memory to some 40 MB, for any number of languages.
LABELS = 3 << 19
UNKNOWN = "und"
#: The classifier is fitted on at most so many documents of each language and so many in all (one of
#: each language at least), a stretch of each from a place that its hash sets, of at most so many characters
#: and so many in all.
SAMPLE_PER_LANGUAGE, SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_TOTAL = 250, 16_000, 6000, 16_000_000
STEPS, BATCH, RATE = 320, 192, 0.02
#: A text is in none of the languages if its best one's score is not so many times a guess among them.
TIMES_CHANCE = 1.2


def hidden(languages: int) -> int:
    """Units of each direction; more languages take more."""
    return 8 if languages <= 16 else 32


def lanes(languages: int) -> int:
    """Blocks that one recurrent step serves."""
    return max(16, LABELS // (WIDTH * max(4, languages)))


@dataclass
class Model:
    languages: list[str]
    tables: np.ndarray  #: 2 directions x 256 bytes x (gate, candidate)
    gate: np.ndarray  #: 2 x hidden x hidden
    candidate: np.ndarray  #: 2 x hidden x hidden
    head: np.ndarray  #: (forward, backward, bias) x languages

    @property
    def least_score(self) -> float:
        """Below it a text is in none of the languages."""
        return min(0.999, TIMES_CHANCE / len(self.languages))


def _run(m: Model, x: np.ndarray, keep: bool = False):
    """States (2, T, N, H) over bytes x (T, N), each direction's own order of time."""
    t, n = x.shape
    h = m.gate.shape[1]
    states = np.zeros((2, t + 1, n, h), m.gate.dtype)
    gates = np.empty((2, t, n, h), m.gate.dtype) if keep else None
    cands = np.empty((2, t, n, h), m.gate.dtype) if keep else None
    for d in range(2):
        order = x if d == 0 else x[::-1]
        s = states[d, 0]
        for i in range(t):
            g = m.tables[d].take(order[i], axis=0)
            f = np.tanh((g[:, :h] + s @ m.gate[d]) * 0.5)
            f *= 0.5
            f += 0.5
            c = np.tanh(g[:, h:] + (f * s) @ m.candidate[d])
            if keep:
                gates[d, i], cands[d, i] = f, c
            c -= s
            c *= f
            s = np.add(s, c, out=states[d, i + 1])
    return states, gates, cands


def _labels(m: Model, states: np.ndarray) -> np.ndarray:
    """Probabilities (T, N, languages) of every position."""
    h = m.gate.shape[1]
    z = states[0, 1:] @ m.head[:h]
    z += states[1, :0:-1] @ m.head[h : 2 * h]
    z += m.head[2 * h]
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def gradients(p: list[np.ndarray], languages: list[str], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the labels inside CONTEXT of bytes x (T, N) of languages y, and its gradient by backpropagation through time."""
    h, k = p[1].shape[1], len(languages)
    states, gates, cands = _run(Model(languages, *p), x, keep=True)
    dz = _labels(Model(languages, *p), states)
    inner = np.zeros(len(x), bool)
    inner[CONTEXT : len(x) - CONTEXT] = True
    n = int(inner.sum()) * x.shape[1]
    loss = -float(np.log(dz[inner][:, np.arange(len(y)), y] + 1e-30).sum()) / n
    dz[:, np.arange(len(y)), y] -= 1
    dz[~inner] = 0
    dz /= n
    grads = [np.zeros_like(a) for a in p]
    flat = dz.reshape(-1, k)
    grads[3][:h] = states[0, 1:].reshape(-1, h).T @ flat
    grads[3][h : 2 * h] = states[1, :0:-1].reshape(-1, h).T @ flat
    grads[3][2 * h] = flat.sum(axis=0)
    for d in range(2):
        order, out = (x, dz) if d == 0 else (x[::-1], dz[::-1])
        ds = np.zeros((x.shape[1], h), p[0].dtype)
        din = np.empty((*x.shape, 2 * h), p[0].dtype)
        w = p[3][:h] if d == 0 else p[3][h : 2 * h]
        for i in range(len(x) - 1, -1, -1):
            s, f, c = states[d, i], gates[d, i], cands[d, i]
            ds = ds + out[i] @ w.T
            dc = ds * f * (1 - c * c)
            back = dc @ p[2][d].T
            df = (ds * (c - s) + back * s) * f * (1 - f)
            grads[2][d] += (f * s).T @ dc
            grads[1][d] += s.T @ df
            din[i, :, :h], din[i, :, h:] = df, dc
            ds = ds * (1 - f) + back * f + df @ p[1][d].T
        np.add.at(grads[0][d], order.reshape(-1), din.reshape(-1, 2 * h))
    return loss, grads


def fit(blocks: np.ndarray, target: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Train on blocks (n, WIDTH) of bytes and their languages, every language as often as any other."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    h = hidden(k)
    p = [
        rng.normal(0, 0.3, (2, 256, 2 * h)), rng.normal(0, 0.35, (2, h, h)), rng.normal(0, 0.35, (2, h, h)), rng.normal(0, 0.3, (2 * h + 1, k)),
    ]
    p = [a.astype(np.float32) for a in p]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    by_language = [np.flatnonzero(target == i) for i in range(k)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_language[i]) for i in rng.integers(0, k, BATCH)])
        _, grads = gradients(p, languages, np.ascontiguousarray(blocks[pick].T), target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 3 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for a, g, u, v in zip(p, grads, first, second):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= rate * u / (np.sqrt(v) + 1e-7)
    return Model(languages, *p)


def _blocks(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first byte of each block of BLOCK bytes."""
    counts = -(-(ends - starts) // BLOCK)
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * BLOCK


def windows(data: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes (n, WIDTH) about blocks that begin at places of texts in data; what is not of the text is spaces."""
    at = begin[:, None] + np.arange(-CONTEXT, BLOCK + CONTEXT)
    inside = (at >= starts[:, None]) & (at < ends[:, None])
    return np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))], 32).astype(np.uint8)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks (n, WIDTH) of texts that lie in data; each block's text and used bytes."""
    owner, begin = _blocks(starts, ends)
    return windows(data, begin, starts[owner], ends[owner]), owner, np.minimum(BLOCK, ends[owner] - begin)


def probabilities(m: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities (texts, languages) over all bytes; zeros for an empty text."""
    total = np.zeros((len(starts), len(m.languages)))
    step = lanes(len(m.languages))
    owner, begin = _blocks(starts, ends)
    for i in range(0, len(owner), step):  # so many blocks at a time, of however many texts
        o, at = owner[i : i + step], begin[i : i + step]
        used = np.minimum(BLOCK, ends[o] - at)
        z = _labels(m, _run(m, np.ascontiguousarray(windows(data, at, starts[o], ends[o]).T))[0])[CONTEXT : CONTEXT + BLOCK]
        z *= (np.arange(BLOCK)[:, None] < used)[:, :, None]
        np.add.at(total, o, z.sum(axis=0, dtype=np.float64))
    return total / np.maximum(1, ends - starts)[:, None]


def train(docs: DataFrame, is_training, seed: int = 7) -> Model | None:
    """A model from the training rows' text and non-null lang; None if there are none.

    Of each language the rows with the smallest hashes of id and text, equal rows once.
    """
    known = docs.filter(is_training & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    rows = known.select(F.col("lang").alias("lang"), place.alias("place"), F.length("text").alias("n"), "text")
    counts = rows.groupBy("lang").count()
    n_languages = counts.count()
    if not n_languages:
        return None
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_DOCUMENTS // n_languages))
    # a hash small enough for some more than the sample, so that the ranking sees few rows of a large language
    few = F.col("place") < F.least(F.lit(float(1 << 62)), F.lit(4.0 * each * (1 << 62)) / F.col("count"))
    best = Window.partitionBy("lang").orderBy("place", "n")
    near = rows.join(F.broadcast(counts) if n_languages <= SAMPLE_DOCUMENTS else counts, "lang").filter(few).select("lang", "place", "n").distinct()
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= each)
    picked = ranked.orderBy("rank", "place", "lang").limit(SAMPLE_DOCUMENTS).select("lang", "place")  # beyond so many languages: some
    chars = max(WIDTH, min(SAMPLE_CHARS, SAMPLE_TOTAL // (each * n_languages)))
    start = f"1 + int(pmod(xxhash64(place), greatest(1, n - {chars} + 1)))"
    taken = (
        rows.join(F.broadcast(picked), ["lang", "place"])
        .select("lang", "place", F.expr(f"substring(text, {start}, {chars})").cast("binary").alias("part")).dropDuplicates(["lang", "place"]).collect()
    )
    rows = sorted(taken, key=lambda r: (r["lang"], r["place"]))
    languages = sorted({r["lang"] for r in rows})
    data = np.frombuffer(b"".join(bytes(r["part"]) for r in rows), np.uint8)
    ends = np.cumsum([len(r["part"]) for r in rows])
    starts = ends - [len(r["part"]) for r in rows]
    blocks, owner, used = cut(data, starts, ends)
    number = {x: i for i, x in enumerate(languages)}
    target = np.array([number[r["lang"]] for r in rows])[owner]
    long = used >= BLOCK // 3
    enough = long | ~np.isin(target, target[long])  # short blocks only of languages that have no other
    return fit(blocks[enough], target[enough], languages, seed=seed)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every column of docs, and lang_pred, score: the language of the whole text and its pooled probability.

    A null text, or one without a letter, is `und` with score 0; so is every text if
    there is no model. Only the text column is read for a prediction. Repeated rows
    get equal results; an empty table gives no rows. Columns of these two names, in any case,
    are replaced; others pass through as they are.
    """
    text_batches(docs.sparkSession)
    names = unnamed(docs, "lang_pred", "score")
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # the text travels once, beside the other columns
    sent = docs.select(passing(unnamed(docs.select(*map(quoted, names)), "text")), F.col("text").cast("string").alias("text"), has_letter.alias("has_letter"))
    schema = sent.select(ROW, "text", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.if_else(b.column("has_letter"), b.column("text"), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
            if model is None or not len(texts):
                found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                pooled = probabilities(model, data, offsets[:-1], offsets[1:])
                best = pooled.argmax(axis=1)
                some = offsets[1:] > offsets[:-1]
                scores = np.where(some, pooled[np.arange(len(best)), best].clip(0, 1), 0.0)
                found = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), some.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(ROW), b.column("text"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[ROW, "text", "lang_pred", "score"]
            )

    own = [F.col("text").alias(c) if c.lower() == "text" else F.col(ROW).getField(c).alias(c) for c in names]
    return sent.mapInArrow(run, schema).select(*own, "lang_pred", "score")
