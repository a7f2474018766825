import random

import numpy as np
import pytest

from corpuslake.llm import packing

P = pytest.importorskip("public_tokenizers")


def test_round_trip_and_padding(make_docs):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    words = ["Hello", "über", "naïve", "123", "don't", "\n\n", "<|endoftext|>", "日本", "  ", "x" * 40]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 80, 900, 4000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, "no id")]
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(make_docs(rows).coalesce(2), path).collect()
    whole, seen = {}, {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.offset == seen.get(r.sequence_id, 0)
        seen[r.sequence_id] = r.offset + r.length
        whole.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    assert max(seen.values()) <= packing.CAPACITY
    total = sum(seen.values())
    assert len(seen) * packing.CAPACITY - total < 0.02 * total + 3 * packing.CAPACITY
    for i, text in rows:
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        n = 2 if i == 7 else 1
        parts = sorted(whole[i])
        assert sum((p for _, p, _ in parts[::n]), []) == want and all(t == len(want) for *_, t in parts)


def test_classes_close_at_their_fixed_count():
    p = packing.Packer(2048)
    closed = [p.add(500, i) for i in range(9)]
    assert [i for i, c in enumerate(closed) if c] == [3, 7] and all(len(c) == 4 for c in closed if c)
    assert p.rest() == [[(500, 8)]] and p.rest() == []
    # every class, the smallest pieces' too, closes by count alone and never overflows
    for length in range(1, 2049):
        p = packing.Packer(2048)
        j = 2048 // length
        closed = [p.add(length, i) for i in range(j)]
        assert closed[-1] and len(closed[-1]) == j and not any(closed[:-1]) and j * length <= 2048


def test_pieces_cover_every_length():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        assert sum(packing.pieces(n)) == n and 0 not in packing.pieces(n)


def test_empty_table(make_docs):
    assert packing.pack(make_docs([(1, "a")]).limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_added_tokens_and_long_white_space_as_the_default_tokenizer_has_them(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    from corpuslake.llm import queries

    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|> <|endoftext", "plain", None, ""]
    texts += [f"a{c * 1_000_000}b" for c in (" ", "\n", "\t", "\u3000")]
    schema = "doc_id long, text string"
    spark.createDataFrame(list(enumerate(texts)), schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    got = {i: 0 for i in want}
    for r in queries.op6_packing(spark, str(tmp_path)).collect():
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        got[r.doc_id] += r.length
    assert got == {i: len(x) for i, x in want.items()}


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" * 2_000_000, "!" * 2_000_000, "\u65e5" * 300_000, "x<|endoftext|>" * 10_000])
def test_very_long_runs_have_the_default_tokenizer_ids(text):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
