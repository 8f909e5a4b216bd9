"""Secret scans with multipart credential linking.

Three kinds of base findings stand by themselves. Beside them there are parts that mean little alone:
an account or user name, a bare long key, a service address. A part is reported only when its
complements lie in the same scope, a run of lines without an empty line between them, at any distance:
an identifier needs a secret, a bare key needs an identifier or an address, an address needs a secret.
Base findings count as the secret or the identifier they are. Scopes are intervals of the text; every
part is joined to the scope it begins in, and asks which kinds that scope holds.

The job is one Arrow map over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import column, fresh, map_texts

#: Kinds in the order that breaks ties of place.
KINDS = ("assign", "access", "hex", "identifier", "bare_key", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
IDENTIFIER_WORDS = re.compile(r"user|login|account|client_?id|key_?id", re.I | re.A)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
#: What a bare key holds at least one of each.
KEY_LETTERS = tuple(re.compile(f"[{c}]") for c in ("0-9", "A-Z", "a-z"))
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{32}")
ENDPOINT = re.compile(r"\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", re.A)
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

#: What each part needs one of.
NEEDS = {"identifier": ("assign", "hex", "bare_key"), "bare_key": ("assign", "access", "identifier", "endpoint"), "endpoint": ("assign", "access", "hex", "bare_key")}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The findings that count whatever stands beside them."""
    found: list[Span] = []
    if ASSIGN_WORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Candidates that no base finding covers."""
    found: list[Span] = []
    if IDENTIFIER_WORDS.search(text):
        found += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if LONG_RUN.search(text):
        found += [(m.start(), m.end(), "bare_key") for m in BARE_KEY.finditer(text) if all(c.search(m[0]) for c in KEY_LETTERS)]
    starts = sorted(base)
    ends, high = [], 0
    for s in starts:
        high = max(high, s[1])
        ends.append(high)
    return [x for x in found if not (i := bisect_left(starts, (x[1],))) or ends[i - 1] <= x[0]]


def linked(text: str, base: list[Span]) -> list[Span]:
    """The weak parts with a complement in their scope."""
    weak = weak_parts(text, base)
    if not weak or len(weak) + len(base) < 2:
        return []
    breaks = [m.end() for m in SCOPE_END.finditer(text)]
    kinds: dict[int, set[str]] = {}
    for start, _, kind in (*base, *weak):
        kinds.setdefault(bisect_right(breaks, start), set()).add(kind)
    return [x for x in weak if not kinds[bisect_right(breaks, x[0])].isdisjoint(NEEDS[x[2]])]


def in_order(spans: list[Span]) -> list[Span]:
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], rank[s[2]], s[1]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in in_order(spans))


def redact(text: str, spans: list[Span], marker: str = "[SECRET]") -> str:
    """The text with every stretch that a span covers replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], marker]
        at = b
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with counts of base findings, a digest of them, and all spans.

    Spans are ``kind:start:end`` in code points, by start. Null and empty texts have none. Repeated rows
    are scanned row by row; an empty table gives no rows. A kept column with the name of a result gets ``_`` at its end.
    """

    def setup():
        def scan(texts):
            rows = []
            for t in texts:
                text = (t or b"").decode()
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(base + linked(text, base))))
            return None, list(zip(*rows, strict=True)) if rows else [[]] * 5

        return scan

    return map_texts(docs, text, keep, RESULT, setup)


def masked(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by a marker; ``length``, if there is such a column, follows the text.

    Documents without a span, and null texts, stay as they are.
    """
    made = fresh(docs, "masked_text")
    hits = fresh(docs, "masked_hits")

    def setup():
        def scan(texts):
            out, hit = [], []
            for t in texts:
                text = None if t is None else t.decode()
                spans = base_spans(text) if text else []
                spans = spans + linked(text, spans) if text else []
                out.append(redact(text, spans) if spans else None)
                hit.append(bool(spans))
            return None, (out, hit)

        return scan

    ready = map_texts(docs, text, docs.columns, f"`{made}` string, `{hits}` boolean", setup)
    changes = {text: F.when(column(hits), column(made)).otherwise(column(text))}
    if length and length in docs.columns:
        changes[length] = F.when(column(hits), F.length(column(made)).cast(docs.schema[length].dataType)).otherwise(column(length))
    return ready.withColumns(changes).select(*[column(c) for c in docs.columns])
