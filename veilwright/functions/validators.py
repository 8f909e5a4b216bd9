"""Checks on the value of a hit, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.functions.dialect import to_java
from veilwright.functions.spans import let
from veilwright.sources import patterns as P


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(d: Column, position: int) -> Column:
    return F.substring(d, position, 1).cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    terms = [_digit(d, i + 1) * w for i, w in enumerate(weights)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def luhn(d: Column) -> Column:
    """Every second digit from the right counts double, with its own digits added up."""

    def add(total: Column, i: Column) -> Column:
        shown = F.substring(d, -i, F.lit(1))
        doubled = F.translate(shown, "0123456789", "0246813579")
        return total + F.when(i % 2 == 0, doubled).otherwise(shown).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def card(value: Column) -> Column:
    """12 to 19 digits with a right check digit; a 13-digit run beginning with 1 is no card."""
    not_run = ~value.rlike("^1[0-9]{12}([^0-9]|$)")
    return let(digits_of(value), lambda d: F.length(d).between(12, 19) & luhn(d)) & not_run


def iban(value: Column) -> Column:
    def remainder(c: Column) -> Column:
        turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
        return F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda r, x: F.when(x.rlike("[0-9]"), r * 10 + F.ascii(x) - 48).otherwise(r * 100 + F.ascii(x) - 55) % 97,
        )

    bare = F.regexp_replace(value, r"^[\t-\r \u0085\p{Z}]+|[\t-\r \u0085\p{Z}]+$", "")
    return let(
        F.upper(F.regexp_replace(bare, "[ -]", "")),
        lambda c: F.when(c.rlike("^[0-9A-Z]{15,34}$"), remainder(c) == 1).otherwise(False),
    )


def aba(value: Column) -> Column:
    return let(
        digits_of(value),
        lambda d: F.when(F.length(d) == 9, _weighted(d, P.ABA_WEIGHTS) % 10 == 0).otherwise(False),
    )


def nhs(value: Column) -> Column:
    """Last digit is 11 minus the weighted sum modulo 11, where 11 counts as 0 and 10 never fits."""
    return let(
        digits_of(value),
        lambda d: F.when(
            F.length(d) == 10, (11 - _weighted(d, P.NHS_WEIGHTS) % 11) % 11 == _digit(d, 10)
        ).otherwise(False),
    )


def tfn(value: Column) -> Column:
    return let(
        digits_of(value),
        lambda d: F.when(F.length(d) == 9, _weighted(d, P.TFN_WEIGHTS) % 11 == 0).otherwise(False),
    )


def sin(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.when(F.length(d) == 9, luhn(d)).otherwise(False))


def nif(value: Column) -> Column:
    letter = F.substring(
        F.lit(P.NIF_LETTERS), F.substring(value, 1, 8).cast("int") % len(P.NIF_LETTERS) + 1, F.lit(1)
    )
    return F.when(value.rlike("^[0-9]{8}[A-Z]$"), F.substring(value, 9, 1) == letter).otherwise(False)


def ssn(value: Column) -> Column:
    return let(
        digits_of(value),
        lambda d: (F.length(d) == 9)
        & ~d.isin(*P.SSN_REFUSED)
        & ~F.substring(d, 1, 3).isin("000", "666", "900")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000"),
    )


def mac(value: Column) -> Column:
    return ~F.upper(F.regexp_replace(value, "[:-]", "")).isin("0" * 12, "F" * 12)


def has_digit(value: Column) -> Column:
    return value.rlike("[0-9]")


def not_listed_url(value: Column) -> Column:
    lower = F.lower(value)
    found = F.lit(False)
    for part in P.URL_SKIP:
        found = found | lower.contains(part)
    return ~found


def not_namespace_url(value: Column) -> Column:
    hosts = "|".join(h.replace(".", r"\.") for h in P.NAMESPACE_HOSTS)
    return ~value.rlike(rf"^https?://(?:www\.)?(?:{hosts})")


def nino(value: Column) -> Column:
    return ~F.upper(F.substring(value, 1, 2)).isin(*P.NINO_REFUSED)


def not_state(value: Column) -> Column:
    """The word after "password is" is a value, not a state such as "required"."""
    states = "|".join(P.PROSE_STATES)
    return ~value.rlike(to_java(rf"(?i)^(?:password|passwd|pwd|passcode)\s*(?:is|was|:)\s*(?:{states})\b"))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "card": card,
    "iban": iban,
    "aba": aba,
    "nhs": nhs,
    "tfn": tfn,
    "sin": sin,
    "nif": nif,
    "ssn": ssn,
    "mac": mac,
    "swift": has_digit,
    "digit": has_digit,
    "url": not_listed_url,
    "namespace_url": not_namespace_url,
    "nino": nino,
    "prose": not_state,
}


def passes(name: Column, value: Column, names: set[str]) -> Column:
    """Check chosen by a name column; only the named checks are built into the expression."""
    out = None
    for key in sorted(n for n in names if n):
        test = CHECKS[key](value)
        out = F.when(name == key, test) if out is None else out.when(name == key, test)
    return F.lit(True) if out is None else out.otherwise(True)
