import collections
import random
import re

from corpuslake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in t))


NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 3000, "\u00a0 é\x0bü", "L\n\nL\n L\nL", "a a a a a a b"]
    for n in (5, 6, 12, 40, 400, 4000):
        out += [rng.choice(["", " "]) + rng.choice([" ", "\n", "\r\n"]).join(rng.choice("ab|C#é") for _ in range(n)) for _ in range(4)]
    return out + [out[-1]]


def test_measurements(make_docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in quality.measure(make_docs(rows)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_place_that_does_not_fit_takes_the_other_way(make_docs, monkeypatch, spark):
    """With few bits for a place, every text goes the way of sorted pairs."""
    rows = list(enumerate(texts()))
    covered = quality._COVERED.replace(str(quality._PLACE), "1")
    monkeypatch.setattr(quality, "_COVERED", covered)
    got = {r.doc_id: r.n_repeat_words for r in quality.measure(make_docs(rows)).collect()}
    assert got == {i: plain(t)[5] for i, t in rows}


def test_ledger_policies_and_ablation(make_docs):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good), (2, "few"), (3, "w " * 50), (4, good.upper()), (5, "# " + good.replace(" ", " | ")), (6, None)]
    book = quality.ledger(quality.measure(make_docs(rows)))
    bits = {r.doc_id: r.failed_rules for r in book.collect()}
    b = quality.BITS
    assert bits[1] == 0 and bits[2] == b["few_words"] and bits[4] == b["shouting"] and bits[6] == b["few_words"]
    assert bits[3] == b["repeated_words"] | b["short_or_long_words"] and bits[5] == b["symbols"] | b["short_or_long_words"] * 0
    strict, base = quality.POLICIES["strict"], quality.POLICIES["base"]
    assert {r.doc_id for r in book.filter(quality.kept(base)).collect()} == {1, 4, 5}
    assert {r.doc_id for r in book.filter(quality.kept(strict)).collect()} == {1}
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(book, strict).collect()}
    want = {rule: (sum(bool(v & b[rule]) for v in bits.values()), sum(v == b[rule] for v in bits.values())) for rule in strict.rules}
    assert got == want
    assert quality.measure(make_docs(rows).limit(0)).collect() == []
    first = quality.VERSIONS["strict", 1]
    assert {r.doc_id for r in book.filter(quality.kept(first)).collect()} == {1, 4} and strict.version == 2
    alone = {r.doc_id: r.o for r in book.select("doc_id", quality.only_rule(strict).alias("o")).collect()}
    assert alone == {1: None, 2: "few_words", 3: None, 4: "shouting", 5: "symbols", 6: "few_words"}
