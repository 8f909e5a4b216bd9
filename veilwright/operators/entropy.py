"""Tokens that look random: long, mixed, high entropy, and close to a word such as "token"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import FINDING, built_once, empty, in_order, let, match_starts, settled, wide_form
from veilwright.operators.detect import any_word, lower_text, near

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
SECRET_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "api_key", "apikey", "credential", "private",
    "auth", "bearer", "access_key", "secret_key", "session", "cookie", "encrypt", "decrypt", "hash", "salt",
    "cipher", "signing", "hmac",
)
PATH_PARTS = ("org/", "com/", "xml", "schema", "xbrl", "spec/", "http", "www", "ftp")
TOKEN_SET = r"\p{L}\p{Nd}+/=_-"
LABEL = "ENTROPY-SECRET"
REACH = 80
SURE = 4.5
DEFAULT_THRESHOLD, DEFAULT_LENGTH = 4.5, 20
# ---------------------------------------------------------------------------


def shannon(value: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(value, ""), lambda c: F.length(c) > 0)

    def bits(cs: Column) -> Column:
        n = F.size(cs).cast("double")
        return F.aggregate(
            F.array_distinct(cs),
            F.lit(0.0),
            lambda total, c: let(
                F.size(F.filter(cs, lambda x: x == c)) / n, lambda p: total - p * F.log2(p)
            ),
        )

    return let(chars, bits)


def varied(value: Column) -> Column:
    """At least two of: upper-case letter, lower-case letter, digit, anything else."""
    kinds = [r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{Lu}\p{Ll}\p{Nd}]"]
    total = F.lit(0)
    for k in kinds:
        total = total + value.rlike(k).cast("int")
    return total >= 2


def _count(value: Column, char: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))


def ordinary(value: Column) -> Column:
    """Paths, identifiers, words and masks: long and varied, but no secret."""
    lower = F.lower(value)
    path = F.lit(False)
    for part in PATH_PARTS:
        path = path | lower.contains(part)
    crossed = _count(F.upper(value), "X")
    letters = value.rlike(r"^\p{L}+$")
    return (
        path
        | (_count(value, "/") >= 2)
        | value.startswith("/")
        | ((crossed > 3) & (crossed / F.octet_length(value) > 0.2))
        | value.rlike(r"^[\p{L}-]*-[\p{L}-]*$")
        | (letters & value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}"))
        | (_count(value, "_") >= 2)
        | value.contains("__")
        | (value.rlike(r"^\p{Lu}+$") & (F.octet_length(value) < 20))
        | value.startswith("REDACTED-")
    )


def candidate(value: Column, min_length: int) -> Column:
    return (F.octet_length(value) >= min_length) & varied(value) & ~ordinary(value)


@built_once
def _columns(
    threshold: float, min_length: int, keyword_gated: bool, unconditional: bool, text: str, layer_ord: int
) -> tuple[Column, Column, Column]:
    """Tokens of a text worth a look, whether one of them is a candidate, and the findings."""
    body, lower = F.col(text), F.col("__lower")
    # The length limit counts bytes.  In ASCII text those are characters; elsewhere a token of n bytes
    # has at least n / 4 characters.
    run_ascii = F.lit(f"[{TOKEN_SET}]{{{min_length},}}")
    run_any = F.lit(f"[{TOKEN_SET}]{{{max(1, -(-min_length // 4))},}}")
    ascii_only = F.octet_length(body) == F.length(body)
    run = F.when(ascii_only, run_ascii).otherwise(run_any)
    tokens = F.when(ascii_only, F.regexp_extract_all(body, run_ascii, 0)).otherwise(
        F.regexp_extract_all(body, run_any, 0)
    )
    gate = F.lit(True) if unconditional else any_word(lower, SECRET_WORDS)
    words = F.array(*[F.lit(w) for w in SECRET_WORDS])

    def finding(value: Column, start: Column) -> Column:
        """Null for a token that is no candidate; its entropy and surroundings are then not looked at."""
        h = F.round(shannon(value), 9)
        close = near(lower, F.col("__wide_lower"), start, start + F.length(value), words, REACH)
        seen = F.struct(h.alias("h"), close.alias("close"))
        return F.when(candidate(value, min_length), let(seen, lambda x: judged(value, start, x.h, x.close)))

    def judged(value: Column, start: Column, h: Column, close: Column) -> Column:
        fires = (F.lit(unconditional) & (h >= SURE)) | (F.lit(keyword_gated) & close)
        sure = F.round(F.least(h / 6, F.lit(1.0)), 6)
        return F.struct(
            start.alias("start"),
            (-F.length(value)).alias("neg_len"),
            F.lit(layer_ord).alias("layer_ord"),
            F.lit(0).alias("ord"),
            (start + F.length(value)).alias("end"),
            F.when(close, F.lit("entropy_keyword_gated")).otherwise(F.lit("entropy_unconditional")).alias("rule_id"),
            F.lit(LABEL).alias("label"),
            value.alias("value"),
            F.when((h >= threshold) & fires, sure).alias("confidence"),
            F.lit("entropy").alias("layer"),
        )

    starts = F.slice(match_starts(body, run, F.col("__tokens")), F.lit(1), F.size("__tokens"))
    found = F.filter(F.zip_with("__tokens", starts, finding), lambda f: f.isNotNull() & f.confidence.isNotNull())
    return (
        F.when(gate, tokens),
        F.exists("__tokens", lambda v: candidate(v, min_length)),
        settled(F.when(F.col("__live"), in_order(found)).otherwise(empty(FINDING))),
    )


def detect_entropy(
    texts: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    min_length: int = DEFAULT_LENGTH,
    keyword_gated: bool = True,
    unconditional: bool = False,
    text: str = "text",
    out: str = "findings",
    layer_ord: int = 2,
) -> DataFrame:
    """Add ``out``, the findings of the entropy layer.

    A token fires when its entropy reaches the threshold and either a secret word is within reach
    or, with ``unconditional``, the entropy is 4.5 or more.
    """
    columns = [c for c in texts.columns if c != out]
    if not (keyword_gated or unconditional):
        return texts.select(*columns).withColumn(out, empty(FINDING))
    tokens, live, found = _columns(threshold, min_length, keyword_gated, unconditional, text, layer_ord)
    return (
        texts.select(*columns, lower_text(F.col(text)).alias("__lower"))
        .withColumn("__tokens", tokens)
        .withColumn("__live", live)
        .withColumn("__wide_lower", F.when(F.col("__live"), wide_form(F.col("__lower"))))
        .select(*columns, found.alias(out))
    )
