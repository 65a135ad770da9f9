from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from clipgrid.llm import byte_bpe
from corpus_samples import ODD, prose


@pytest.fixture(scope="module")
def reference():
    pairs = map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODER = byte_bpe.Encoder(byte_bpe.default_vocabulary())
PIECES = byte_bpe.token_bytes(byte_bpe.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab 'sdé\n\t —9½", max_size=60)))
def test_agrees_with_tiktoken(reference, text):
    ids = ENCODER.encode([text])[0].tolist()
    assert ids == reference.encode_ordinary(text)
    assert b"".join(PIECES[i] for i in ids) == text.encode()


def test_agrees_over_the_first_characters(reference):
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x250)) if rng.random() < 0.6 else rng.choice(" '\nat9") for _ in range(40)) for _ in range(400)]
    texts += ["<|endoftext|> it's DON'T", " " * 70 + "x", "\x85 \x1c x", "日本語 テキスト 😀", ""]
    assert [x.tolist() for x in ENCODER.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_every_character_counts_as_in_tiktoken(reference):
    mark, wrong = reference.encode_ordinary("'t"), []
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        text = f"{chr(code)}'t"
        if (ENCODER.split(text)[-1] == "'t") != (reference.encode_ordinary(text)[-1:] == mark):
            wrong.append(hex(code))
    assert wrong == []


def test_later_letters_in_a_text(reference):
    for text in ("\U00010ee3't", "ab\u088fcd 1\U00018e00\U000323b02 x", " \ua7ce\ua7ce's \U00012550", "a\U0001df90b!\U0001df90?"):
        ids = ENCODER.encode([text])[0].tolist()
        assert ids == reference.encode_ordinary(text)
        assert b"".join(PIECES[i] for i in ids) == text.encode()


def test_forgets_when_full(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    for i in range(6):
        text = prose(i, 30)
        assert encoder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_offsets_of_split_characters(documents):
    text = "aé日😀 b"
    row = byte_bpe.encode(documents([(1, text)]), ["doc_id"], with_offsets=True).first()
    pieces = [PIECES[i] for i in row.ids]
    assert row.byte_starts == np.cumsum([0, *map(len, pieces)])[:-1].tolist()
    characters = [len(text.encode()[:b].decode("utf-8", "ignore")) for b in row.byte_starts]
    assert row.char_starts == characters and len(row.ids) > len({*characters})


def test_report(documents, reference):
    rows = [*ODD, (8, prose(8, 20000)), (9, "nospace" * 3000)]
    found = byte_bpe.token_report(documents(rows)).collect()
    want = []
    for doc, text in rows:
        ids = reference.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((doc, len(ids), *digests))
    assert sorted(map(tuple, found), key=lambda r: (str(r[0]), *r[1:])) == sorted(want, key=lambda r: (str(r[0]), *r[1:]))
    assert byte_bpe.token_report(documents([])).count() == 0
