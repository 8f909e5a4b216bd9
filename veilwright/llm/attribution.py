"""Token counts of sections, from one encoding of the whole document.

A document is encoded once; every token keeps its characters ``[start, end)``. Sections are intervals
of characters in order. Tokens and sections are both sorted, so the interval join is a binary search
of token edges among section edges. A token inside one section counts there. A token that crosses an
edge is allocated by a rule: ``largest`` (most of its characters; the earlier section if even),
``first`` or ``last`` (where it begins or ends). Every token of a text that sections cover counts once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from veilwright.llm.common import map_texts
from veilwright.llm.tokens import CUT, REMEMBERED, Chunks, chunks_of, tokenizer_text, vocabulary_path

RULES = ("largest", "first", "last")
SENTENCE_END = re.compile(r"[.!?\n]")
BLANKS = str.maketrans("\n\t\r\x0b\x0c", "     ")


def sentence_edges(text: str) -> list[int]:
    """Ends of sections: after every full stop, exclamation or question mark and line end, and of the text."""
    edges = [m.end() for m in SENTENCE_END.finditer(text)]
    return edges if edges and edges[-1] == len(text) else [*edges, len(text)] if text else []


class Offsets(Chunks):
    """Character spans of the tokens of chunks, as pairs of 32-bit integers."""

    def word(self, signs: str) -> bytes:
        return np.array([t.offsets for t in self.model.tokenize(signs)], "<i4").reshape(-1).tobytes()

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            if piece.isascii() and piece.isalpha() and piece.islower():
                found = self.word(piece)
            else:
                found = np.array(self.tokenizer.encode(piece, add_special_tokens=False).offsets, "<i4").reshape(-1).tobytes()
            if len(self.parts) >= REMEMBERED // 4:
                self.parts.clear()
            self.parts[piece] = found
        return found

    def made(self, chunk: str) -> bytes:
        at, out = 0, []
        for piece in CUT.split(chunk):
            spans = self.part(piece)
            out.append((np.frombuffer(spans, "<i4") + np.int32(at)).tobytes() if at else spans)
            at += len(piece)
        return b"".join(out)

    def spans(self, text: str) -> np.ndarray:
        """``(start, end)`` of each token of a whole text, in characters."""
        if self.special.search(text.encode()):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        lower = text.lower() if "Σ" not in text else text  # a final sigma depends on its neighbours
        chunks = (lower if len(lower) == len(text) else text).translate(BLANKS).split(" ")
        found = list(map(self.__getitem__, chunks))
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths + 1) - lengths - 1
        n = np.fromiter(map(len, found), np.int64, len(found)) // 8
        return np.frombuffer(b"".join(found), "<i4").reshape(-1, 2) + np.repeat(starts, n)[:, None]


def allocate(spans: np.ndarray, edges: list[int], rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens crossed an edge; section ``k`` ends at ``edges[k]``."""
    ends = np.array(edges, np.int64)
    if not len(spans) or not len(ends):
        return np.zeros(len(ends), np.int64), 0
    first = np.minimum(np.searchsorted(ends, spans[:, 0], "right"), len(ends) - 1)
    last = np.minimum(np.searchsorted(ends, np.maximum(spans[:, 0], spans[:, 1] - 1), "right"), len(ends) - 1)
    crossing = np.flatnonzero(first != last)
    own = first if rule != "last" else last.copy()
    if rule == "largest":
        own = first.copy()
        for i in crossing.tolist():
            a, b = spans[i]
            cuts = [a, *ends[first[i] : last[i]], b]
            own[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(own, minlength=len(ends)), len(crossing)


def attribute(docs: DataFrame, keep: list[str], text: str = "text", edges: Callable[[str], list[int]] = sentence_edges, rule: str = "largest", tokenizer_path: str | None = None) -> DataFrame:
    """``keep`` columns with ``n_tokens, n_crossing, section_ends, section_tokens``.

    ``edges(text)`` gives the ascending ends of sections; the first begins at 0 and the last ends with
    the text. Null and empty texts have no sections and no tokens. Repeated rows are counted row by row;
    an empty table gives no rows. A kept column with the name of a result gets ``_`` at its end.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path or vocabulary_path()))

    def setup():
        offsets = chunks_of(vocabulary.value, Offsets)

        def scan(texts):
            rows = []
            for raw in texts:
                text = (raw or b"").decode()
                spans = offsets.spans(text) if text else np.zeros((0, 2), np.int64)
                ends = edges(text)
                counts, crossing = allocate(spans, ends, rule)
                rows.append((len(spans), crossing, ends, counts))
            return None, list(zip(*rows, strict=True)) if rows else [[]] * 4

        return scan

    return map_texts(docs, text, keep, "n_tokens long, n_crossing long, section_ends array<int>, section_tokens array<long>", setup)
