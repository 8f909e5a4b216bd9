"""Model layers: spans from a model, filtered the way each model needs it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from time import perf_counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import FINDING, empty, in_order, settled
from veilwright.operators.deadline import timed
from veilwright.plans.cascade import Layer
from veilwright.sources.catalog import effective

ENTITY = "struct<text:string,label:string,start:int,end:int,score:double>"

# ---------------------------------------------------------------------------
# Fixed values of the first model's filter.
# ---------------------------------------------------------------------------
MODEL_LABELS = (
    "PERSON", "EMAIL", "PHONE", "ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "MEDICAL_RECORD",
    "FINANCIAL_ACCOUNT", "PASSPORT", "DRIVER_LICENSE", "IP_ADDRESS", "ORGANIZATION", "USERNAME", "LOCATION",
    "IBAN", "BANK_ACCOUNT", "INSURANCE_NUMBER", "LICENSE_PLATE", "NATIONAL_ID", "TAX_ID", "PASSWORD",
)
LABEL_MIN = {
    "PERSON": 0.80, "PASSWORD": 0.85, "CREDIT_CARD": 0.80, "ADDRESS": 0.75, "NATIONAL_ID": 0.80,
    "IP_ADDRESS": 0.75, "DATE_OF_BIRTH": 0.75, "EMAIL": 0.70, "BANK_ACCOUNT": 0.75,
}
DEFAULT_MIN = 0.5
SUPPRESSED = ("ORGANIZATION", "FINANCIAL_ACCOUNT", "USERNAME", "LOCATION", "TAX_ID", "LICENSE_PLATE")
LABEL_RULES = {
    "email_gliner": "EMAIL", "person_gliner": "PERSON", "address_gliner": "ADDRESS",
    "dob_gliner": "DATE_OF_BIRTH", "ip_gliner": "IP_ADDRESS", "gliner_national_id_dup": "NATIONAL_ID",
}
GENERIC_ROLES = (
    "patient", "donor", "inspector", "insured", "applicant", "employee", "customer", "client", "user", "owner",
    "holder", "member", "resident", "caller", "driver", "traveler", "buyer", "seller", "you", "your", "tenant",
    "landlord", "borrower", "lender", "claimant", "beneficiary", "subscriber", "vendor", "contractor", "debtor",
    "creditor", "policyholder", "insurer", "underwriter", "guarantor", "mortgagor", "mortgagee", "plaintiff",
    "defendant", "petitioner", "respondent", "assignee", "assignor", "guest", "investors", "investor", "advisor",
    "manager", "analyst", "officer", "director", "administrator", "coordinator", "specialist", "supervisor",
    "consultant", "representative", "agent", "broker", "examiner", "reviewer", "healthcare provider", "provider",
    "intruder", "project manager", "clinical trial coordinator", "licensee", "licensor", "licensees", "payor",
    "payee", "registrant",
)
COMMON_WORDS = (
    "temporary", "password", "default", "admin", "test", "temp", "root", "null", "none", "empty", "blank",
    "invalid", "expired", "reset", "new", "old", "current", "temporary password", "bm",
)
DESCRIPTIVE = (
    "password", "pin", "passcode", "medical history", "vitals", "medical report", "vaccination record",
    "immunization records", "immunization record", "unknown account", "primary account", "bank account",
    "follow-up appointment", "detailed report", "hepatitis a", "hepatitis b", "hepatitis c", "account number",
    "social security", "credit card", "debit card", "health insurance", "life insurance", "date of birth",
    "place of birth", "tax return", "tax id",
)
# Fixed values of the second model's filter.
LABEL_MAP = {
    "PRIVATE_PERSON": "PERSON", "PRIVATE_EMAIL": "EMAIL", "PRIVATE_PHONE": "PHONE", "PRIVATE_ADDRESS": "ADDRESS",
    "PRIVATE_URL": "URL", "PRIVATE_DATE": "DATE_OF_BIRTH", "ACCOUNT_NUMBER": "ACCOUNT_NUMBER", "SECRET": "SECRET",
}
SECOND_MIN_BYTES = {"SECRET": 8, "PRIVATE_ADDRESS": 8, "PRIVATE_DATE": 6, "ACCOUNT_NUMBER": 5}
# ---------------------------------------------------------------------------


def suppressed_labels(toggles: dict[str, bool] | None = None) -> list[str]:
    """Labels that are not reported: the fixed ones, changed by the rules that switch a label."""
    state = effective(toggles)
    out = dict.fromkeys(SUPPRESSED, True)
    for rule, label in LABEL_RULES.items():
        if state[rule]:
            out.pop(label, None)
        else:
            out[label] = True
    return list(out)


def label_states(toggle_maps: DataFrame) -> DataFrame:
    """(user_id, toggles map) -> (user_id, label, enabled), for the switchable labels."""
    defaults = effective()
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule"), F.lit(defaults[rule]).alias("d"))
            for rule, label in LABEL_RULES.items()
        ]
    )
    picked = F.try_element_at("toggles", F.col("r.rule"))
    return toggle_maps.select("user_id", "toggles", F.explode(rows).alias("r")).select(
        "user_id", F.col("r.label").alias("label"), F.coalesce(picked, F.col("r.d")).alias("enabled")
    )


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\t-\r \u0085\p{Z}]+|[\t-\r \u0085\p{Z}]+$", "")


def _placeholder(text: Column) -> Column:
    t = _trim(text)
    lower = F.lower(t)
    return (
        t.rlike(r"^[<{]|[\[\]]")
        | lower.isin(*DESCRIPTIVE)
        | lower.startswith("your ")
        | lower.endswith(" name")
        | lower.endswith(" address")
        | lower.endswith(" number")
    )


def keep_first(e: Column, suppressed: list[str], min_score: float = DEFAULT_MIN, min_bytes: int = 2) -> Column:
    """Whether a span of the first model is reported."""
    text, label = e["text"], e["label"]
    floor = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_MIN.items() for x in kv]), label), F.lit(min_score)
    )
    word = F.lower(_trim(text))
    digit = text.rlike("[0-9]")
    refused = (
        (label.isin(*suppressed) if suppressed else F.lit(False))
        | ((label == "PERSON") & word.isin(*GENERIC_ROLES))
        | _placeholder(text)
        | (label.isin("MEDICAL_RECORD", "NATIONAL_ID", "IBAN") & ~digit)
        | ((label == "PASSWORD") & ((F.octet_length(text) < 8) | word.isin(*COMMON_WORDS)))
        | ((label == "IP_ADDRESS") & ~_trim(text).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
        | ((label == "EMAIL") & ~text.contains("@"))
        | text.contains("__")
    )
    return (e["score"] >= floor) & (F.octet_length(text) >= min_bytes) & ~refused


def keep_second(e: Column) -> Column:
    """Whether a span of the second model is reported."""
    text, label = e["text"], F.upper(e["label"])
    t = _trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(t, "[^aeiouAEIOU]", ""))
    nonsense = (
        (F.octet_length(t) < 4)
        | ((letters > 3) & (vowels == 0))
        | ((letters > 5) & (vowels / letters < 0.1))
    )
    short = F.lit(False)
    for name, n in SECOND_MIN_BYTES.items():
        short = short | ((label == name) & (F.octet_length(text) < n))
    name_shaped = t.rlike(r"^\p{Lu}[\p{L} .'-]*$") & (F.octet_length(t) >= 2)
    return (
        (F.octet_length(text) >= 3)
        & ~text.contains("REDACTED")
        & ~text.rlike(r"^(\[|<|\$\.|/)")
        & ~nonsense
        & ~((label == "PRIVATE_PERSON") & ~name_shaped)
        & ~short
    )


def second_label(label: Column) -> Column:
    return F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv]), label), label
    )


def to_findings(entities: Column, layer: str, layer_ord: int, label: Callable[[Column], Column] = lambda c: c) -> Column:
    return F.transform(
        entities,
        lambda e, i: F.struct(
            e["start"].alias("start"),
            (e["start"] - e["end"]).alias("neg_len"),
            F.lit(layer_ord).alias("layer_ord"),
            i.alias("ord"),
            e["end"].alias("end"),
            F.lit("").alias("rule_id"),
            label(e["label"]).alias("label"),
            e["text"].alias("value"),
            F.round(e["score"], 4).alias("confidence"),
            F.lit(layer).alias("layer"),
        ),
    )


# A model: called once per Python worker, gives a function from a batch of texts to their spans.
Loader = Callable[[], Callable[[list[str]], list[list[dict]]]]


FAILED = "scan failed"
#: What a model gets at a time, and what its spans are held for: so many texts, fewer where they are long.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 256, 1 << 19
ANSWER = f"struct<entities:array<{ENTITY}>,reason:string,ms:double>"


def isolated(predict: Callable[[list[str]], list[list[dict]]], texts: list[str]) -> list[list[dict] | None]:
    """Spans of each text, null for those that the model fails on."""
    try:
        return list(predict(texts)) if texts else []
    except Exception as failure:  # whatever a model raises concerns its texts
        if len(texts) == 1:
            logging.getLogger(__name__).warning("a model failed on a text of %d characters: %r", len(texts[0]), failure)
            return [None]
    half = len(texts) // 2
    return isolated(predict, texts[:half]) + isolated(predict, texts[half:])


def portions(batches: Iterator[pd.Series]) -> Iterator[list[str]]:
    """The texts of all batches in lists of bounded size; a null text is an empty one."""
    for batch in batches:
        part, size = [], 0
        for text in batch:
            text = text or ""
            if part and (len(part) == TEXTS_AT_ONCE or size + len(text) > CHARACTERS_AT_ONCE):
                yield part
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            yield part


def model_column(load: Loader, timeout_ms: int | None = None, forks: int = 0) -> Callable[[Column], Column]:
    """Arrow batch function around a model: the spans of a text, or the reason why there are none, and its time in ms.

    A batch the model fails on is halved until the text it fails on stands alone, so its neighbours keep
    their spans. With a time limit each text is asked by itself, of a model in a process of its own, or in
    up to ``forks`` copies of it where the model bears a fork. A model that can not be loaded fails the job. Of a batch each text has an equal share of its time.
    """

    def answers(batches: Iterator[list[str]]) -> Iterator[list[tuple[list[dict] | None, str | None, float]]]:
        predict = load()
        for texts in batches:
            begin = perf_counter()
            all_found = isolated(predict, texts)
            ms = (perf_counter() - begin) * 1000 / max(1, len(texts))
            yield [(found, None if found is not None else FAILED, ms) for found in all_found]

    ask = timed(load, timeout_ms, forks=forks) if timeout_ms else answers

    @F.pandas_udf(ANSWER)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for found in ask(portions(batches)):  # in smaller lists than they come: the spans of a batch are many times its texts
            yield pd.DataFrame({"entities": pd.Series([f[0] for f in found], dtype=object), "reason": pd.Series([f[1] for f in found], dtype=object), "ms": pd.Series([f[2] for f in found], dtype=float)})

    return spans


def model_layer(
    load: Loader, toggles: dict[str, bool] | None = None, second: bool = False, ready: bool = True, timeout_ms: int | None = None, forks: int = 0
) -> Layer:
    """A model as a layer of the cascade.  It sees the text the layers before it have masked."""
    name = "opf" if second else "gliner"
    reason, answer, ms = f"__reason_{name}", f"__answer_{name}", f"__ms_{name}"
    suppressed = suppressed_labels(toggles)

    def scan(texts: DataFrame, text: str, out: str, position: int) -> DataFrame:
        found = texts.withColumn(answer, model_column(load, timeout_ms, forks)(F.col(text)))
        kept = F.filter(F.col(answer)["entities"], keep_second if second else lambda e: keep_first(e, suppressed))
        as_findings = to_findings(kept, name, position, second_label if second else lambda c: c)
        return (
            found.withColumn(out, settled(in_order(F.coalesce(as_findings, empty(FINDING)))))
            .withColumn(reason, F.col(answer)["reason"])
            .withColumn(ms, F.col(answer)["ms"])
            .drop(answer)
        )

    return Layer(name, scan, ready=ready, failure=reason, latency=ms)
