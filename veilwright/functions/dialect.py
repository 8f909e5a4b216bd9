"""RE2 expressions as Java expressions with the same matches.

Spark runs ``java.util.regex``; the pattern dimension is written for RE2.  The differences that
matter: Java's ``\\b`` looks at Unicode letters while ``\\w`` is ASCII, ``.`` and ``$`` stop at more
line ends, ``\\s`` includes the vertical tab, and folding. Folded by RE2, ``s`` is also the long s and
``k`` the Kelvin sign, and no i has a dot above or none at all; Java folds ASCII only, or else takes
those for an i. So ASCII is folded by the flag, and the two signs are spelled out.
"""

from __future__ import annotations

import re

_WORD = "0-9A-Za-z_"
_LEFT = f"(?<![{_WORD}])"
_RIGHT = f"(?![{_WORD}])"
_EITHER = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_SPACE = r"\t\n\f\r "

# Stretches that a backtracking engine would walk again and again, and a form that finds the same
# matches in one walk.  Domain part: no dot before the first dot, everything after it is taken whole.
_DOMAIN = r"\w+([-.]\w+)*\.\w+([-.]\w+)*"
_DOMAIN_ONCE = r"\w++(?:-\w++)*+\.\w++(?:[-.]\w++)*+"
# Local part: a start inside a run of address characters that has an earlier possible start can not
# be the leftmost match, unless the last match ended right here.
_LOCAL_START = r"(?:\G|(?<!\w[!#$%&'*+\-/=?^`{|}~]{1,4})(?=\w))"
_LOCAL_RUN = r"[a-zA-Z0-9._%+\-]+@"
_LOCAL_RUN_ONCE = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]+@"


def _walk_once(java: str) -> str:
    if _DOMAIN in java:
        head, rest = java.split(")", 1)
        java = f"{head}){_LOCAL_START}{rest}".replace(_DOMAIN, _DOMAIN_ONCE)
    return java.replace(_LOCAL_RUN, _LOCAL_RUN_ONCE)


#: Letters beyond ASCII that fold to an ASCII letter.
_ALSO = {"s": "\u017f", "k": "\u212a"}


def _class_end(body: str, start: int) -> int:
    """Place of the bracket that ends the class beginning at ``start``."""
    i = start + (2 if body[start + 1 : start + 2] == "^" else 1)
    while body[i] != "]":
        i += 2 if body[i] == "\\" else 1
    return i


def _also_in(members: str) -> str:
    """The signs beyond ASCII that a folded class of these members takes in."""
    found = re.findall(r"\\.|[^\\]-[^\\]|[^\\]", members, re.S)

    def covers(letter: str) -> bool:
        pairs = [(m[0], m[-1]) for m in found if m[0] != "\\"]
        return "\\w" in found or any(low <= c <= high for low, high in pairs for c in (letter, letter.upper()))

    return "".join(sign for letter, sign in _ALSO.items() if covers(letter))


def _folded(letter: str) -> str:
    if letter.lower() in _ALSO:
        return f"[{letter}{_ALSO[letter.lower()]}]"
    return f"(?u:{letter})" if letter.isalpha() and not letter.isascii() else letter


def to_java(regex: str, edges: str = "") -> str:
    """Java form of an RE2 expression.

    A boundary at the left end becomes "no word character before", one at the right end "no word
    character after": one test instead of two.  That is exact when the neighbouring character of the
    match must be a word character; ``edges`` names the ends where it need not be.
    """
    folds = regex.startswith("(?i)")
    dotall = regex.startswith("(?s)")
    body = regex[4:] if folds or dotall else regex
    flags = "(?d" + ("i" if folds else "") + ("s" if dotall else "") + ")"
    out, i, in_class, also = [], 0, False, ""
    while i < len(body):
        two = body[i : i + 2]
        if two == r"\b" and not in_class:
            if i == 0 and "L" not in edges:
                out.append(_LEFT)
            elif i + 2 == len(body) and "R" not in edges:
                out.append(_RIGHT)
            else:
                out.append(_EITHER)
            i += 2
        elif two == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
        elif two == r"\w" and folds and not in_class:
            out.append(rf"[\w{''.join(_ALSO.values())}]")
            i += 2
        elif body[i] == "\\":
            out.append(two)
            i += 2
        elif body[i] == "[" and not in_class:
            in_class = True
            skip = 2 if body[i + 1 : i + 2] == "^" else 1
            also = _also_in(body[i + skip : _class_end(body, i)]) if folds else ""
            out.append(body[i : i + skip])
            i += skip
        elif body[i] == "[" or (body[i] == "&" and body[i + 1 : i + 2] == "&"):
            out.append("\\" + body[i])
            i += 1
        elif in_class:
            if body[i] == "]":
                in_class = False
                out.append(also)
            out.append(body[i])
            i += 1
        else:
            out.append(_folded(body[i]) if folds else body[i])
            i += 1
    return _walk_once(flags + "".join(out))
