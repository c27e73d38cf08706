import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from annalist.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(library):
    rng = random.Random(5)
    texts = ["", " ", "a", "aaaaaaaaaaaaaaaaa" * 40, "it's  we'll\n\n x \n y", "  lead", "trail  ", " x  y", "abababab" * 30]
    for _ in range(400):
        texts.append("".join(chr(rng.choice([rng.randint(32, 126), rng.choice(b"aeb \n\t"), rng.randint(0xA0, 0x2FF), rng.randint(0x3B1, 0x3C9), rng.randint(0x4E00, 0x4FFF), rng.randint(0x1F600, 0x1F64F)])) for _ in range(rng.randint(1, 80))))
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert encoder.long(text).tolist() == ids.tolist()
        assert encoder.decode(ids) == text.encode()


def test_order_changes_go_step_by_step():
    """A merge that makes a pair of lower rank; the corpus replay agrees with the rule for one piece."""
    ranks = {bytes([b]): 100 + b for b in range(97, 101)} | {b"ab": 50, b"abc": 10, b"bc": 60, b"cd": 55, b"abab": 5, b"dd": 70}
    replay = bpe.MergeReplay(ranks)
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))).encode() for _ in range(600)]
    for piece, ids in zip(pieces, replay._replay(pieces)):
        want = bpe.merge_word([ranks[bytes([b])] for b in piece], replay.one)
        assert list(memoryview(ids).cast("i")) == want, piece


def test_rows(odd, none, odd_rows, library):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(odd, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest(none, PATH, public_tokenizers.PATTERN).collect() == []


def test_full_caches_keep_what_a_block_reads(monkeypatch):
    """Words that a block shares with the one before are not replayed again when the caches are full."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 60)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    asked, real = [], encoder.replay.encode
    monkeypatch.setattr(encoder.replay, "encode", lambda pieces: asked.extend(pieces) or real(pieces))
    same, first, second = (" ".join(f"{c}{chr(97 + i)}qxz" for i in range(20)) for c in "klm")
    known = [x.tolist() for x in encoder.encode([f"a {same} {first}."])]
    asked.clear()
    again = encoder.encode([f"b {same} {second}, {second}!", f"a {same} {first}."])
    assert len(encoder.words) <= 80 and again[1].tolist() == known[0]
    assert not {b" " + w.encode() for w in same.split(" ")} & set(asked)


def test_runs_of_merges_beside_each_other():
    """Any rank table over two letters: a merge right behind another, and runs of one letter."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(8)}
        ranks = {b"a": 100, b"b": 101} | dict(zip(sorted(tokens), rng.sample(range(90), len(tokens))))
        replay = bpe.MergeReplay(ranks)
        pieces = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 24))).encode() for _ in range(30)]
        for piece, ids in zip(pieces, replay._replay(pieces)):
            assert list(memoryview(ids).cast("i")) == bpe.merge_word([ranks[bytes([b])] for b in piece], replay.one), (ranks, piece)
