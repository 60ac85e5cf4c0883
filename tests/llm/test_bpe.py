import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from shelfspark.llm import bpe
from shelfspark.llm.queries import PATTERN, RANKS


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(bpe.read_ranks(f.read()), PATTERN, words=True)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.transducer.ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    for k in range(3000):
        letters = ["ab", "aeiourstn ", "0123456789", " \n\t\x1c\x85\xa0a.3", "éèüßñ日本語한", "=-#%.", "abc😀é ", "I'll we've'"][k % 8]
        yield "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))


def test_ids_match_library(encoder, library):
    for t in texts():
        assert list(encoder.encode(t)) == library.encode_ordinary(t)


def test_other_patterns_take_no_shortcuts(encoder, spark):
    odd = r"[^ ]+ ?| +"  # a space ends a piece here
    own = tiktoken.Encoding("odd", pat_str=odd, mergeable_ranks=encoder.transducer.ranks, special_tokens={})
    some = list(texts())[:400] + ["plain words, and more of them."]
    plain = bpe.Encoder(encoder.transducer.ranks, odd)
    assert all(list(plain.encode(t)) == own.encode_ordinary(t) for t in some)
    rows = spark.createDataFrame(list(enumerate(some[-20:])), "doc_id long, text string")
    got = {r.doc_id: [i % (1 << 32) for i in r.ids] for r in bpe.encode_rows(rows, RANKS, odd).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(some[-20:])}


def test_built_and_simulated_moves_agree(encoder, monkeypatch):
    some = [t.encode() for t in texts()][:300]
    lazy = [encoder.transducer.encode(t) for t in some]
    monkeypatch.setattr(bpe, "LAZY", 0)
    built = bpe.Transducer(encoder.transducer.ranks)
    built.missed = [0]
    assert [built.encode(t) for t in some] == lazy


def test_long_text_is_cut_without_effect(encoder, library, monkeypatch):
    t = "word  and\n more, words " * 50 + "x" * 300 + " tail"
    monkeypatch.setattr(bpe, "LONG_TEXT", 64)
    assert list(encoder.encode(t)) == library.encode_ordinary(t)
    assert "".join(bpe.blocks(t)) == t and len(list(bpe.blocks(t))) > 5


def test_decoder_never_tears_a_character(encoder):
    text = "aé日😀" * 40
    ids = encoder.encode(text)
    for chunk in (1, 2, 3, 7):
        parts = list(bpe.decode(ids, encoder.transducer.token, chunk))
        assert "".join(parts) == text and "�" not in "".join(parts)
    state = bpe.Utf8()
    got = "".join(state.feed(bytes([b])) for b in text.encode()) + state.end()
    assert got == text
    assert bpe.Utf8().feed(b"a\xffb") == "a�b"


def test_rows(docs, library):
    pairs = [(1, "Hello  world"), (2, None), (3, ""), (None, "é"), (4, "same"), (4, "same"), (5, "x" * 50_000)]
    got = bpe.round_trip(docs(pairs), RANKS, PATTERN).collect()
    want = []
    for i, t in pairs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in bpe.encode_rows(docs(pairs[:3]), RANKS, PATTERN).collect()}
    assert ids == {i: library.encode_ordinary(t or "") for i, t in pairs[:3]}
    assert bpe.round_trip(docs([]), RANKS, PATTERN).count() == 0
