"""Encoding whole texts with a public tokenizer, chunk by chunk.

``Chunks`` holds for tokenizers that drop white space before they split and then split letters from
what follows them (``word_bpe_49k.json`` is one): the ids of a text are the ids of its white-space
separated chunks in a row, and a chunk may be cut after an ASCII letter that an ASCII mark or digit
follows. Most chunks come again and again, so they are encoded once while a task remembers them.
A-Z may be lower-cased first, as the tokenizer does. Texts that spell a special token go through the
tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa

#: A-Z in lower case, and the white space of ASCII as blanks.
CHUNK_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
#: 1 for a-z, 2 for the marks and digits of ASCII, 0 for the rest.
CLASSES = bytes(1 if 0x61 <= b <= 0x7A else 2 if 0x21 <= b <= 0x7E else 0 for b in range(256))
#: After a Latin letter, before a mark or digit of ASCII.
CUT = re.compile("(?<=[a-zß-öø-\u012f\u0131-\u024f])(?=[!-@\\[-`{-~])")
#: Latin letters that are lower case, or have a lower case of one letter whatever stands beside them.
LATIN = re.compile("[a-zß-öø-\u012f\u0131-\u024f]+")
#: Chunks that a task remembers.
REMEMBERED = 500_000
END = 1


def _byte_signs() -> dict[int, int]:
    """Signs that stand for bytes in byte-level vocabularies: themselves if they can be seen, else from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}


BYTE_SIGNS = _byte_signs()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(path: str) -> str:
    """The tokenizer's file, read on the driver: a few MB that travel with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Chunks(dict):
    """What is made of chunks: their ids, as little-endian unsigned 32-bit integers.

    Two generations are remembered, so a full memory forgets what was not asked for lately.
    """

    def __init__(self, tokenizer: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model = self.tokenizer.model
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or rb"(?!)")
        self.parts: dict[str, bytes] = {}
        self.earlier: dict = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, signs: str) -> bytes:
        """One word, as the tokenizer hands it to its model."""
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            if LATIN.fullmatch(piece):
                found = self.word(piece if piece.isascii() else piece.lower().encode().decode("latin-1").translate(BYTE_SIGNS))
            else:
                found = self.whole(piece)
            if len(self.parts) >= REMEMBERED // 4:
                self.parts.clear()
            self.parts[piece] = found
        return found

    def made(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # a-z only
            return self.word(chunk.decode())
        return b"".join(map(self.part, CUT.split(chunk.decode())))

    def __missing__(self, chunk):
        value = self.earlier.get(chunk)
        if value is None:
            value = self.made(chunk)
        if len(self) >= REMEMBERED:
            self.earlier = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text (UTF-8; null: none)."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each whole text; the texts are cut into chunks together, and a chunk is looked up once however often it comes."""
        if not texts:
            return []
        plain = [t or b"" for t in texts]
        spelled = {}
        if self.special.search(b"\n".join(plain)):
            spelled = {i: self.whole(t.decode()) for i, t in enumerate(plain) if self.special.search(t)}
            plain = [b"" if i in spelled else t for i, t in enumerate(plain)]
        lower = b" ".join([*plain, b""]).translate(CHUNK_BYTES)
        kinds = np.frombuffer(lower.translate(CLASSES), np.uint8)
        cuts = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2)) + 1
        letters = np.frombuffer(lower, np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in plain)])
        # A text begins with the chunk whose number is the blanks and cuts before it.
        first = np.searchsorted(np.flatnonzero(letters == 0x20), starts) + np.searchsorted(cuts, starts)
        if len(cuts):
            letters = np.insert(letters, cuts, 0x20)
        # Here a chunk ends with the blank after it, so the chunks lie side by side.
        ends = np.concatenate([[0], np.flatnonzero(letters == 0x20) + 1])
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        different = chunks.dictionary.buffers()[2].to_pybytes().split(b" ")[: len(chunks.dictionary)]
        found = pa.array(list(map(self.__getitem__, different)), pa.large_binary()).take(chunks.indices)
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64)[first].tolist()
        joined = memoryview(data or b"")
        out = [bytes(joined[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, ids in spelled.items():
            out[i] = ids
        return out


_KEPT: dict[tuple, Chunks] = {}


def chunks_of(tokenizer: str, kind: type[Chunks] = Chunks) -> Chunks:
    """The chunks of this worker process: what one task has encoded, the next one finds."""
    key = (kind, hash(tokenizer))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = kind(tokenizer)
    return _KEPT[key]


def crc(ids: bytes) -> int:
    return crc32(ids)
