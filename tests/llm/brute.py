"""Plain forms of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(ascii_lower(text))


def near_classes(rows, similarity=0.8, size=5):
    """id -> least id of its group, for rows ``(id, text)`` with different ids."""
    owner = {}
    for i, text in rows:
        w = tuple(words(text))
        key = ("null", i) if text is None else ("words", w) if w else ("text", text)
        owner.setdefault(key, []).append(i)
    sets, holders = {}, {}
    for key, ids in owner.items():
        w = key[1] if key[0] == "words" else ()
        sets[min(ids)] = s = {w[k : k + size] for k in range(max(1, len(w) - size + 1))} if w else set()
        for x in s:
            holders.setdefault(x, []).append(min(ids))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        shared = {}
        for x in sets[a]:
            for b in holders[x]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(min(ids)) for ids in owner.values() for i in ids}


def secret_base(text):
    """``(start, kind, end)`` of the base findings, by the patterns as stated."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), "hex", m.end()))
    return found


def secret_links(text, base):
    """Weak parts with a complement in the same run of lines, all pairs tried; base is ``(start, end, kind)``."""
    found = []
    for m in re.finditer(r"""\b(?:user|username|login|account|accountid|account_id|clientid|client_id|access_?keyid|access_?key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", text, re.I | re.A):
        found.append((m.start(), m.end(), "identifier"))
    for m in re.finditer(r"\b(?:http|https|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", text, re.A):
        found.append((m.start(), m.end(), "endpoint"))
    for m in re.finditer(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])", text):
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0]):
            found.append((m.start(), m.end(), "bare_key"))
    weak = [x for x in found if not any(y[0] < x[1] and x[0] < y[1] for y in base)]
    needs = {"identifier": {"assign", "hex", "bare_key"}, "bare_key": {"assign", "access", "identifier", "endpoint"}, "endpoint": {"assign", "access", "hex", "bare_key"}}
    scope = lambda x: len(re.findall(r"\n[\x20\t\r]*\n", text[: x[0]]))
    return [x for x in weak if any(y[2] in needs[x[2]] and scope(x) == scope(y) for y in (*base, *weak))]


def rebuilt(rows):
    """conv_id -> turns ``(role, text)`` of the rebuilt conversation, for rows ``(conv_id, turn, role, text)``."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def trie_nodes(sequences, weight):
    """``(conv_id, depth, parent's, n_convs, n_children, n_leaves, saved, ids that end there)`` of every prefix."""
    members, children = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * weight(k[-1]) if k else 0)
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], sorted(c for c in m if len(sequences[c]) == len(k)))
        for k, m in members.items()
    ]


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(c, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def with_faults(rows):
    """Rows ``(turn, role, text)`` of one conversation, in order, as ``(role, text, first fault)``."""
    seen, out = set(), []
    for _, _, role, _, text in sorted((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x) for t, r, x in rows):
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


LEADS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def cheapest_edits(rows):
    """``(cost, audit, lines)`` by a walk over rows and states, all that happened so far kept as a string."""

    def inserted(best):
        for _ in range(4):
            for p, (cost, audit, lines) in list(best.items()):
                for initial, q in LEADS[p].items():
                    found = (cost + 5, audit + "I", (*lines, (FULL.get(initial), "")))
                    if initial != "s" and (q not in best or found[:2] < best[q][:2]):
                        best[q] = found
        return best

    best = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for p, (cost, audit, lines) in best.items():
            ways = [(p, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for initial, q in LEADS[p].items():
                    if role[:1] == initial:
                        ways.append((q, cost + more, audit + "K", (*lines, (role, text))))
                    if initial != "s":
                        ways.append((q, cost + more + 1, audit + "R", (*lines, (FULL[initial], text))))
            for q, *found in ways:
                if q not in after or tuple(found[:2]) < after[q][:2]:
                    after[q] = tuple(found)
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def chart(codes):
    """``(cost, audit)`` by the whole chart: symbols e(mpty), s, u, a, p(airs) and w(hole) over all spans and all splits."""
    rules = [("e", "e", "e"), ("u", "e", "u"), ("u", "u", "e"), ("a", "e", "a"), ("a", "a", "e"), ("s", "e", "s"), ("s", "s", "e"), ("p", "u", "a"), ("p", "p", "p"), ("w", "s", "p"), ("w", "e", "w"), ("w", "w", "e"), ("p", "e", "p"), ("p", "p", "e")]
    n, cells = len(codes), {}

    def close(i, j):
        cell, changed = cells[i, j], True
        while changed:
            changed = False
            for k in range(i, j + 1):
                for x, y, z in rules:
                    if y in cells.get((i, k), {}) and z in cells.get((k, j), {}):
                        (c, a), (d, b) = cells[i, k][y], cells[k, j][z]
                        if x not in cell or (c + d, a + b) < cell[x]:
                            cell[x], changed = (c + d, a + b), True
            for x in ("p", "e"):
                if x in cell and ("w" not in cell or cell[x] < cell["w"]):
                    cell["w"], changed = cell[x], True

    for i in range(n + 1):
        cells[i, i] = {"e": (0, ""), "u": (5, "I"), "a": (5, "I")}
        close(i, i)
    for width in range(1, n + 1):
        for i in range(n - width + 1):
            cells[i, i + width] = {}
            if width == 1:
                cell, code = cells[i, i + 1], codes[i]
                cell["e"] = (2, "D")
                if code != "d":
                    more = 5 * code.isupper()
                    cell |= {x: (more + 1, "R") for x in "ua"}
                    if code.lower() in "sua":
                        cell[code.lower()] = (more, "K")
            close(i, i + width)
    return cells[0, n]["w"]
