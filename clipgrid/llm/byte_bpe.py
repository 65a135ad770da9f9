"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the byte table.

A vocabulary of this kind names its tokens by printable characters, one for each byte. Encoding goes through the
library; decoding reverses that table, so any run of ids gives back its bytes even where a token ends inside a
character. Offsets are kept both in bytes and in characters; a token that begins inside a character has the offset
of that character.

Texts are split by the pattern of the vocabulary, and each distinct match goes through the library's model once per
task: most matches of a batch repeat. Characters that the splitter of the vocabulary does not know yet, but the regular
expressions here do, count as neither letters nor digits.

Nulls count as empty texts and give no tokens. Repeated rows, ties and clashing column names do not matter: each row
is encoded by itself and new columns replace old ones of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Distinct matches after which a task forgets what it has encoded.
REMEMBERED = 250_000
# Letters, digits and white space of the first 256 characters; general punctuation holds none of them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_UNUSUAL = re.compile("[^\x00-\xff\u2010-\u2027]")
# Letters and digits of the ``regex`` module that the splitter of tiktoken takes for neither, as ranges.
_LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_UNKNOWN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER) + "]")
_NEITHER = "\ue000"  # a character for private use
_MARKS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The splitting pattern for texts without unusual characters, which the standard library matches faster.
_USUAL = re.compile(f"{_MARKS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id."""
    from tokenizers import Tokenizer

    return _token_bytes(Tokenizer.from_file(vocabulary))


def _token_bytes(library: Tokenizer) -> list[bytes]:
    back = {c: b for b, c in enumerate(byte_characters())}
    names = library.get_vocab(with_added_tokens=False)
    found = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        found[i] = bytes(back[c] for c in name)
    return found


class Encoder:
    """Encodes texts of one task."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        self.model, self.table = library.model, _token_bytes(library)
        self.names = dict(enumerate(byte_characters()))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.forget()

    def split(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return _USUAL.findall(text)
        shown = _UNKNOWN.sub(_NEITHER, text)  # character by character, so that places stay
        if shown == text:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(shown)]

    def forget(self) -> None:
        """Known pieces are numbered; piece i has the ids ``pool[ends[i]:ends[i + 1]]``."""
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        named = [p.encode().decode("latin-1").translate(self.names) for p in pieces]
        found = [[t.id for t in self.model.tokenize(x)] for x in named]
        for piece in pieces:
            self.known[piece] = len(self.known)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        fresh = [p for p in dict.fromkeys(flat) if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = list(dict.fromkeys(flat))
        if fresh:
            self.learn(fresh)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.ends[which] - ends + sizes, sizes)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, pieces)])]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def offsets(ids: np.ndarray, text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins, in bytes and in characters."""
    at = np.cumsum(lengths[ids]) - lengths[ids]
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return at.astype(np.int32), (np.cumsum(lead)[at] - 1).astype(np.int32)


def encode(
    docs: DataFrame, keep: list[str], vocabulary: str | None = None, text: str = "text", with_offsets: bool = False, verify: bool = False
) -> DataFrame:
    """The columns ``keep``, ``ids array<int>`` and, if asked for, ``byte_starts`` and ``char_starts``.

    With ``verify`` each text's ids are decoded at once, and ``decodes`` tells whether they give back its bytes.
    """
    vocabulary = vocabulary or default_vocabulary()
    kept = [c for c in keep if c not in ("ids", "byte_starts", "char_starts", "decodes")]
    source = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    extra = [("ids", pa.int32())] + [("byte_starts", pa.int32()), ("char_starts", pa.int32())] * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        table = encoder.table
        lengths = np.array([len(b) for b in table], np.int64)
        for batch in small_slices(batches, "_text", 1 << 20):
            columns: list[list[np.ndarray]] = [[] for _ in extra]
            texts = [x or "" for x in batch.column(len(kept)).to_pylist()]
            for cell, ids in zip(texts, encoder.encode(texts), strict=True):
                columns[0].append(ids)
                if with_offsets:
                    for column, found in zip(columns[1:], offsets(ids, cell.encode(), lengths), strict=True):
                        column.append(found)
            lists = [pa.ListArray.from_arrays(_ends(c), pa.array(np.concatenate(c), pa.int32())) for c in columns]
            names = [*kept, *(n for n, _ in extra)]
            if verify:
                lists.append(pa.array([_joined(table, i) == t.encode() for i, t in zip(columns[0], texts, strict=True)], pa.bool_()))
                names.append("decodes")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return source.mapInArrow(run, ", ".join([*fields, *(f"{n} array<int>" for n, _ in extra), *["decodes boolean"] * verify]))


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def _ends(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())


def decode(encoded: DataFrame, keep: list[str], vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded binary``: the bytes of the ids in turn. Cast to string for text."""
    vocabulary = vocabulary or default_vocabulary()
    kept = [c for c in keep if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                cells = part.column(len(kept))
                out = [_joined(table, c.values.to_numpy()) if c.is_valid else b"" for c in cells]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], [*kept, "decoded"])

    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept]
    source = encoded.select(*kept, F.col(ids).alias("_ids"))
    return source.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def token_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of the bytes that they decode to."""
    encoded = encode(docs, ["doc_id"], vocabulary)
    back = decode(encoded, ["doc_id", "ids"], vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
