"""Pattern dimension: which expressions exist, what they are called and how sure a hit is.

The rows are data.  Turning them into Spark columns is the job of
``veilwright.functions.dialect`` and ``veilwright.operators.detect``.

Columns of a row
----------------
ord        position in the detector; also the tie-break between hits
rule_id    rule of the catalogue the pattern belongs to
label      label of the finding
regex      expression in RE2 syntax (no lookaround)
score      confidence without context
context    words that raise the confidence when they stand near the hit
validator  name of a check on the value, see ``veilwright.functions.validators``
required   drop the hit when no context word is near
profile    ``compat`` rows are always present, ``extended`` rows only on request
edges      ``L`` / ``R`` when the left / right word boundary may border a non-word character
gate       cheap tests a text must pass before the expression runs on it; all must hold.
           ``a|b``      one of the lower-case literals is in the text
           ``#digit``   there is a digit
           ``#mark``    there is a colon or an equals sign
           ``#class:x`` regex x is found in the text
           ``#run:x``   regex x is found after every stretch of 3 or more non-digits became ``~``
           ``#word:x``  regex x is found among the words that hold a digit
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    ord: int
    rule_id: str
    label: str
    regex: str
    score: float
    context: tuple[str, ...] = ()
    validator: str = ""
    required: bool = False
    profile: str = "compat"
    edges: str = ""
    gate: tuple[str, ...] = ("#digit",)


# ---------------------------------------------------------------------------
# Labels, expressions, scores and context words of the detector.
# ---------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_H = "[0-9A-Fa-f]"
_MBI = "[ACDEFGHJKMNPQRTUVWXY]"
_MBI_N = "[0-9ACDEFGHJKMNPQRTUVWXY]"
_BIRTH = ("birthday", "born", "dob", "date of birth", "birth date", "birthdate")
_MAC = ("mac", "mac address", "hardware address", "physical address", "ethernet", "device")
_TAXPAYER = ("individual", "taxpayer", "itin", "tax", "payer", "tin")
_US_PASSPORT = ("passport", "travel", "document", "us passport")
_ABA = ("aba", "routing", "bankrouting", "transit")
_MEDICARE = ("medicare", "mbi", "beneficiary", "cms", "medicaid")
_PROVIDER = ("npi", "national provider", "provider", "provider id", "taxonomy")
_SIN = ("sin", "social insurance", "canada")
_SSN = ("social", "security", "ssn")

_EMAIL_SET = r"!#$%&'*+\-/=?^_`{|}~"
_EMAIL = (
    rf"\b((([{_EMAIL_SET}\w])|([{_EMAIL_SET}\w][{_EMAIL_SET}.\w]{{0,}}[{_EMAIL_SET}\w]))"
    r"[@]\w+([-.]\w+)*\.\w+([-.]\w+)*)\b"
)
_IPV6 = (
    r"(?:[^:\w])(?:"
    rf"(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,7}}:"
    rf"|:(?::{_H}{{1,4}}){{1,7}}"
    rf"|(?:{_H}{{1,4}}:){{1,6}}:{_H}{{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,5}}(?::{_H}{{1,4}}){{1,2}}"
    rf"|(?:{_H}{{1,4}}:){{1,4}}(?::{_H}{{1,4}}){{1,3}}"
    rf"|(?:{_H}{{1,4}}:){{1,3}}(?::{_H}{{1,4}}){{1,4}}"
    rf"|(?:{_H}{{1,4}}:){{1,2}}(?::{_H}{{1,4}}){{1,5}}"
    rf"|{_H}{{1,4}}:(?::{_H}{{1,4}}){{1,6}}"
    rf"|:(?::{_H}{{1,4}}){{1,6}}"
    r")(?:[^:\w]|$)"
)
_US_LICENSE = (
    r"\b(?:[A-Z]\d{3,6}|[A-Z]\d{5,9}|[A-Z]\d{6,8}|[A-Z]\d{4,8}|[A-Z]\d{9,11}|[A-Z]{1,2}\d{5,6}"
    r"|[A-Z]{2}\d{2,5}|[A-Z]{2}\d{3,7}|\d{2}[A-Z]{3}\d{5,6}|[A-Z]\d{13,14}|[A-Z]\d{18}|[A-Z]\d{6}R"
    r"|[A-Z]\d{9}|[A-Z]\d{1,12}|\d{9}[A-Z]|[A-Z]{2}\d{6}[A-Z]|\d{8}[A-Z]{2}|\d{3}[A-Z]{2}\d{4}"
    r"|[A-Z]\d[A-Z]\d[A-Z]|\d{7,8}[A-Z])\b"
)
_POST_END = "[0-9][ABD-HJLNP-UW-Z]{2}"
_UK_POSTCODE = (
    rf"\b(?:GIR\s?0AA|[A-PR-UWYZ][0-9][ABCDEFGHJKPSTUW]?\s?{_POST_END}"
    rf"|[A-PR-UWYZ][0-9]{{2}}\s?{_POST_END}"
    rf"|[A-PR-UWYZ][A-HK-Y][0-9][ABEHMNPRVWXY]?\s?{_POST_END}"
    rf"|[A-PR-UWYZ][A-HK-Y][0-9]{{2}}\s?{_POST_END})\b"
)
_PEM = (
    r"(?s)-----BEGIN\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----.*?"
    r"-----END\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
)
_PHONE_PLUS = r"\+\d{1,4}[\s\-.]?\(?\d{1,5}\)?[\s\-.]?\d{2,5}[\s\-.]?\d{2,5}[\s\-.]?\d{0,5}"
_PHONE_ZERO = r"\b0\d{2,4}[\s.\-]\d{3,8}[\s.\-]?\d{0,6}\b"
_PHONE_ZEROS = r"\b00\d{2,4}[\s.\-]\d{2,5}[\s\-.]?\d{3,5}[\s\-.]?\d{0,5}\b"
_SECRET_KV = (
    r"(?i)(?:password|secret|token|api_key|apikey)\s*[=:]\s*['\"]?[A-Za-z0-9/+=\-_]{8,}['\"]?"
)
_SECRET_PWD = r"(?i)(?:password|passwd|pwd)\s*[=:]\s*['\"]?[^\s'\"]{4,}['\"]?"
_PASSWORD_PROSE = r"(?i)(?:password|passwd|pwd|passcode)\s*(?:is|was|:)\s*[^\s,;]{4,40}"
_STUDENT_ID = (
    r"(?i)(?:student|registration|reg|enrollment)\s*(?:no|number|id|#|:)\s*[A-Z0-9\-]{5,15}\b"
)
_INSURANCE = (
    r"(?i)(?:insurance|policy|health\s*plan|member)\s*(?:no|number|id|#|:)\s*[A-Z]{0,3}\d{6,12}\b"
)
_CARD_BARE = r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b"
_CARD_4X4 = r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b"
_IBAN_FLAT = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b"
_JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_\-]+"
_AWS_SECRET = r"(?i)aws_secret_access_key\s*[=:]\s*[A-Za-z0-9/+=]{40}"
_DSN = r"(?i)(?:mongodb|postgres|mysql|redis|amqp):\/\/[^\s]+"
_EXPIRY = r"\b(?:0[1-9]|1[0-2])\/(?:2[0-9]|3[0-9])\b"

PATTERNS: tuple[Pattern, ...] = (
    Pattern(1, "credit_card_luhn", "CREDIT_CARD",
            r"\b((4\d{3})|(5[0-5]\d{2})|(6\d{3})|(1\d{3})|(3\d{3}))[- ]?(\d{3,4})[- ]?(\d{3,4})[- ]?(\d{3,5})\b",
            0.3, ("credit", "card", "visa", "mastercard", "cc", "amex", "discover", "jcb", "diners", "maestro"),
            "card", profile="extended"),
    Pattern(2, "crypto_btc", "CRYPTO", r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,59}\b", 0.5,
            ("wallet", "btc", "bitcoin", "crypto")),
    Pattern(3, "crypto_eth", "CRYPTO", r"\b0x[a-fA-F0-9]{40}\b", 0.5,
            ("wallet", "eth", "ethereum", "crypto")),
    Pattern(4, "email_regex", "EMAIL_ADDRESS", _EMAIL, 0.5, ("email",), edges="L", gate=("@",)),
    Pattern(5, "iban_presidio", "IBAN_CODE",
            r"(?:[^A-Z0-9]|^)([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?)(?:[^A-Z0-9]|$)",
            0.5, ("iban", "bank", "transaction", "account"), "iban"),
    Pattern(6, "ipv4", "IP_ADDRESS",
            rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/(?:[0-2]?\d|3[0-2]))?\b",
            0.6, ("ip", "ipv4", "ipv6", "address")),
    Pattern(7, "ipv6", "IP_ADDRESS", _IPV6, 0.6, ("ip", "ipv4", "ipv6")),
    Pattern(8, "url_bare", "URL", r"https?://[^\s<>\"')\]]+", 0.5, (), "url"),
    Pattern(9, "dob_mdy", "DATE_OF_BIRTH",
            r"\b(?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])[/\-.](?:\d{4}|\d{2})\b",
            0.3, _BIRTH, required=True),
    Pattern(10, "dob_dmy", "DATE_OF_BIRTH",
            r"\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:\d{4}|\d{2})\b",
            0.3, _BIRTH, required=True),
    Pattern(11, "mac_colon_dash", "MAC_ADDRESS", rf"\b{_H}{{2}}:{_H}{{2}}:{_H}{{2}}:{_H}{{2}}:{_H}{{2}}:{_H}{{2}}\b",
            0.6, _MAC, "mac"),
    Pattern(12, "mac_colon_dash", "MAC_ADDRESS", rf"\b{_H}{{2}}-{_H}{{2}}-{_H}{{2}}-{_H}{{2}}-{_H}{{2}}-{_H}{{2}}\b",
            0.6, _MAC, "mac"),
    Pattern(13, "mac_cisco_dot", "MAC_ADDRESS", rf"\b{_H}{{4}}\.{_H}{{4}}\.{_H}{{4}}\b", 0.6,
            ("mac", "mac address", "hardware address", "cisco")),
    Pattern(14, "us_ssn_dash", "US_SSN", r"\b([0-9]{3})[- .]([0-9]{2})[- .]([0-9]{4})\b", 0.5,
            ("social", "security", "ssn", "ssns"), "ssn"),
    Pattern(15, "us_itin_dash", "US_ITIN", r"\b9\d{2}[- ](5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b",
            0.5, _TAXPAYER),
    Pattern(16, "us_itin_bare", "US_ITIN", r"\b9\d{2}(5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])\d{4}\b",
            0.3, _TAXPAYER, required=True),
    Pattern(17, "us_passport_numeric", "US_PASSPORT", r"\b\d{9}\b", 0.05, _US_PASSPORT, required=True),
    Pattern(18, "us_passport_alpha", "US_PASSPORT", r"\b[A-Z]\d{8}\b", 0.1, _US_PASSPORT),
    Pattern(19, "us_driver_license", "US_DRIVER_LICENSE", _US_LICENSE, 0.3,
            ("driver", "license", "licence", "permit", "identification", "driving", "dl", "lic"), required=True),
    Pattern(20, "us_bank_number", "US_BANK_NUMBER", r"\b\d{10,17}\b", 0.05,
            ("account#", "acct", "bank account", "checking", "savings", "routing number"), required=True),
    Pattern(21, "aba_routing_dashed", "ABA_ROUTING", r"\b[0123678]\d{3}-\d{4}-\d\b", 0.3, _ABA, "aba"),
    Pattern(22, "aba_routing_bare", "ABA_ROUTING", r"\b[0123678]\d{8}\b", 0.05, _ABA, "aba", required=True),
    Pattern(23, "dea_license", "MEDICAL_LICENSE", r"\b[ABCDEFGHJKLMPRSTUXabcdefghjklmprstux][a-zA-Z]\d{7}\b",
            0.4, ("medical", "certificate", "dea", "license", "npi", "provider")),
    Pattern(24, "us_mbi_separated", "US_MBI",
            rf"\b\d{_MBI}{_MBI_N}\d-{_MBI}{_MBI_N}\d-{_MBI}{_MBI}\d{{2}}\b", 0.5, _MEDICARE),
    Pattern(25, "us_mbi_bare", "US_MBI",
            rf"\b\d{_MBI}{_MBI_N}\d{_MBI}{_MBI_N}\d{_MBI}{_MBI}\d{{2}}\b", 0.3, _MEDICARE, required=True),
    Pattern(26, "us_npi_separated", "US_NPI", r"\b[12]\d{3}[ -]\d{3}[ -]\d{3}\b", 0.4, _PROVIDER),
    Pattern(27, "us_npi_bare", "US_NPI", r"\b[12]\d{9}\b", 0.1, _PROVIDER, required=True),
    Pattern(28, "uk_nhs", "UK_NHS", r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b", 0.3,
            ("national health service", "nhs", "health services authority", "health authority"), "nhs", required=True),
    Pattern(29, "uk_nino", "UK_NINO",
            r"(?i)\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", 0.5,
            ("national insurance", "ni number", "nino"), "nino", profile="extended", edges="LR"),
    Pattern(30, "uk_postcode", "UK_POSTCODE", _UK_POSTCODE, 0.1,
            ("postcode", "post code", "postal code", "zip", "address", "delivery", "mailing"), required=True),
    Pattern(31, "uk_passport", "UK_PASSPORT", r"\b[A-Z]{2}\d{7}\b", 0.1,
            ("passport", "travel document", "uk passport", "british passport"), required=True),
    Pattern(32, "uk_driving_licence", "UK_DRIVING_LICENCE",
            r"\b[A-Z9]{5}\d(?:0[1-9]|1[0-2]|5[1-9]|6[0-2])(?:0[1-9]|[12]\d|3[01])\d[A-Z9]{2}[A-Z0-9][A-Z]{2}\b",
            0.5, ("driving licence", "driving license", "driver", "dvla", "licence number", "license number")),
    Pattern(33, "ca_sin", "CA_SIN", r"\b[1-79]\d{2}-\d{3}-\d{3}\b", 0.5, _SIN, "sin"),
    Pattern(34, "ca_sin", "CA_SIN", r"\b[1-79]\d{2} \d{3} \d{3}\b", 0.5, _SIN, "sin"),
    Pattern(35, "au_tfn", "AU_TFN", r"\b\d{3}\s\d{3}\s\d{3}\b", 0.1, ("tax file number", "tfn"), "tfn",
            required=True),
    Pattern(36, "in_pan", "IN_PAN", r"(?i)\b[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]\b", 0.5,
            ("permanent account number", "pan", "income tax"), edges="LR"),
    Pattern(37, "es_nif", "ES_NIF", r"\b\d{8}[A-Z]\b", 0.3, ("dni", "nif", "identificacion", "documento"), "nif"),
    Pattern(38, "de_passport", "DE_PASSPORT", r"\b[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}\d\b", 0.4,
            ("reisepass", "passport", "passnummer", "passport number"), required=True),
    Pattern(39, "sg_nric_fin", "SG_NRIC_FIN", r"(?i)\b[STFGM]\d{7}[A-Z]\b", 0.5, ("fin", "nric", "singapore"),
            edges="LR"),
    Pattern(40, "person_id_generic", "PERSON_ID",
            r"(?i)(?:customer|employee|member|patient|policy|claim|case|ref(?:erence)?|order|invoice|ticket|tracking|confirmation|transaction)"
            r"\s*(?:id|no|number|num|#|:)\s*[:=#]?\s*[A-Z0-9\-]{4,20}\b", 0.5, edges="R",
            gate=("customer|employee|member|patient|policy|claim|case|ref|order|invoice|ticket|tracking"
                  "|confirmation|transaction",)),
    Pattern(41, "swift_bic", "SWIFT_BIC", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.3,
            ("swift", "bic", "wire", "routing", "correspondent"), "swift", required=True),
    Pattern(42, "cvv", "CVV", r"(?i)(?:cvv|cvc|cvv2|cvc2|security\s*code|card\s*verification)\s*[:=]?\s*\d{3,4}\b",
            0.6, ("card", "credit", "visa", "mastercard", "amex", "expir", "cardholder", "payment"), required=True,
            gate=("#digit", "cvv|cvc|security|verification")),
    Pattern(43, "phone_parens", "PHONE_NUMBER", r"\(\d{3}\)[\s.\-]?\d{3}[\s.\-]?\d{4}", 0.7),
    Pattern(44, "phone_dash_dot", "PHONE_NUMBER", r"\b\d{3}[\-\.]\d{3}[\-\.]\d{4}\b", 0.6),
    Pattern(45, "phone_intl_plus", "PHONE_NUMBER", _PHONE_PLUS, 0.6, gate=("#digit", "+")),
    Pattern(46, "phone_leading_zero", "PHONE_NUMBER", _PHONE_ZERO, 0.5,
            ("phone", "tel", "mobile", "cell", "call", "fax", "contact"), edges="R"),
    Pattern(47, "phone_double_zero", "PHONE_NUMBER", _PHONE_ZEROS, 0.5, edges="R"),
    Pattern(48, "aws_access_key", "AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}", 0.9, gate=("akia",)),
    Pattern(49, "aws_secret_key", "AWS_SECRET_KEY", _AWS_SECRET, 0.9),
    Pattern(50, "gcp_api_key", "GCP_API_KEY", r"AIza[0-9A-Za-z\-_]{35}", 0.9, gate=("aiza",)),
    Pattern(51, "private_key_pem", "PRIVATE_KEY", _PEM, 1.0, gate=("-----begin", "private key-----")),
    Pattern(52, "jwt", "JWT", _JWT, 0.9, gate=("eyj",)),
    Pattern(53, "connection_string", "CONNECTION_STRING", _DSN, 0.8),
    Pattern(54, "generic_secret_kv", "GENERIC_SECRET", _SECRET_KV, 0.7),
    Pattern(55, "generic_secret_pwd", "GENERIC_SECRET", _SECRET_PWD, 0.6),
    Pattern(56, "password_prose", "PASSWORD", _PASSWORD_PROSE, 0.7, (), "prose", profile="extended",
            gate=("password|passwd|pwd|passcode",)),
    Pattern(57, "imei", "IMEI", r"\b\d{2}-\d{6}-\d{6}-\d{1}\b", 0.7),
    Pattern(58, "cc_expiry", "CC_EXPIRY", _EXPIRY, 0.4, ("card", "credit", "expir", "exp", "valid")),
    Pattern(59, "insurance_id", "INSURANCE_ID", _INSURANCE, 0.6, gate=("#digit", "insurance|policy|health|member")),
    Pattern(60, "registration_id_generic", "REGISTRATION_ID", _STUDENT_ID, 0.6, (), "digit", profile="extended",
            edges="R", gate=("#digit", "student|reg|enrollment")),
    Pattern(61, "iban_simple", "IBAN_CODE", _IBAN_FLAT, 0.5, ("iban", "bank", "account")),
    Pattern(62, "credit_card_4x4", "CREDIT_CARD", _CARD_4X4, 0.7),
    Pattern(63, "health_plan_id", "HEALTH_PLAN_ID",
            r"(?i)(?:health\s*plan|beneficiary|hpb|hic|hicn|subscriber)\s*(?:id|no|number|num|#|:)\s*[:=#]?\s*[A-Z0-9\-]{6,15}\b",
            0.7, edges="R", gate=("health|beneficiary|hpb|hic|subscriber",)),
    Pattern(64, "medical_record_mrn", "MEDICAL_RECORD",
            r"(?i)(?:medical\s*record|mrn|chart|patient\s*id|medical\s*id)\s*(?:no|number|num|#|:)?\s*[:=#]?\s*[A-Z0-9\-]{4,15}\b",
            0.7, (), "digit", profile="extended", edges="R", gate=("#digit", "medical|mrn|chart|patient")),
    Pattern(65, "biometric_id", "BIOMETRIC_ID",
            r"(?i)(?:biometric|fingerprint|face\s*id|retina|iris)\s*(?:id|hash|data|scan|template|no|number|#|:)\s*[:=#]?\s*[A-Za-z0-9\-_]{8,64}\b",
            0.6, (), "digit", profile="extended", edges="R",
            gate=("#digit", "biometric|fingerprint|face|retina|iris")),
    Pattern(66, "license_plate", "LICENSE_PLATE",
            r"(?i)(?:license\s*plate|plate\s*(?:no|number|#)|vehicle\s*(?:reg|registration)|vrn)\s*[:=#]?\s*[A-Z0-9]{2,3}[\s\-]?[A-Z0-9]{2,4}[\s\-]?[A-Z0-9]{1,4}\b",
            0.6, edges="R", gate=("plate|vehicle|vrn",)),
    Pattern(67, "url_with_token", "URL_WITH_TOKEN",
            r"https?://[^\s<>\"')\]]*[?&](?:token|session|auth|key|api_key|access_token|sid|csrf|jwt)=[^\s<>\"')\]&]+",
            0.8),
    Pattern(68, "us_ssn_dash", "US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.5, _SSN),
    Pattern(69, "us_ssn_space", "US_SSN", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.5, _SSN),
    Pattern(70, "credit_card_bare", "CREDIT_CARD", _CARD_BARE, 0.7, profile="extended"),
)


def _plain(ord: int, label: str, regex: str, **kw) -> Pattern:
    return Pattern(ord, "", label, regex, 1.0, **kw)


# Older profile: no context, no checks, every hit counts fully.
SIMPLE_PATTERNS: tuple[Pattern, ...] = (
    _plain(101, "EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", gate=("@",)),
    _plain(102, "SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    _plain(103, "SSN", r"\b\d{3}\s\d{2}\s\d{4}\b"),
    _plain(104, "CREDIT-CARD", _CARD_4X4),
    _plain(105, "PHONE", r"\(\d{3}\)[\s.\-]?\d{3}[\s.\-]?\d{4}"),
    _plain(106, "PHONE", r"\b\d{3}[\-\.]\d{3}[\-\.]\d{4}\b"),
    _plain(107, "PHONE", _PHONE_PLUS),
    _plain(108, "PHONE", _PHONE_ZERO, edges="R"),
    _plain(109, "PHONE", _PHONE_ZEROS, edges="R"),
    _plain(110, "AWS-ACCESS-KEY", r"AKIA[0-9A-Z]{16}", gate=("akia",)),
    _plain(111, "AWS-SECRET-KEY", _AWS_SECRET, gate=("aws_secret_access_key",)),
    _plain(112, "GCP-API-KEY", r"AIza[0-9A-Za-z\-_]{35}", gate=("aiza",)),
    _plain(113, "PRIVATE-KEY", _PEM, gate=("-----begin", "private key-----")),
    _plain(114, "JWT", _JWT, gate=("eyj",)),
    _plain(115, "CONNECTION-STRING", _DSN, gate=("mongodb://|postgres://|mysql://|redis://|amqp://",)),
    _plain(116, "GENERIC-SECRET", _SECRET_KV, gate=("password|secret|token|api_key|apikey", "=|:")),
    _plain(117, "GENERIC-SECRET", _SECRET_PWD, gate=("password|passwd|pwd", "=|:")),
    _plain(118, "IP-ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    _plain(119, "IPV6-ADDRESS", rf"\b{_H}{{1,4}}(?::{_H}{{1,4}}){{7}}\b", gate=(":",)),
    _plain(120, "IPV6-ADDRESS", rf"\b{_H}{{1,4}}(?::{_H}{{1,4}}){{2,7}}::[0-9a-fA-F:]*\b", edges="R", gate=("::",)),
    _plain(121, "PASSPORT",
           r"(?i)(?:passport|travel\s+doc(?:ument)?)\s*(?:no|number|#|:)\s*[A-Z]{0,2}\d{6,9}\b",
           gate=("#digit", "passport|travel")),
    _plain(122, "DRIVER-LICENSE",
           r"(?i)(?:driver'?s?\s*(?:license|licence|lic)|DL|DMV)\s*(?:no|number|#|:)\s*[A-Z0-9][\-.]?[A-Z0-9]{5,12}\b",
           edges="R", gate=("driver|dl|dmv",)),
    _plain(123, "IBAN", _IBAN_FLAT),
    _plain(124, "MAC-ADDRESS",
           rf"\b{_H}{{2}}[:\-\s]{_H}{{2}}[:\-\s]{_H}{{2}}[:\-\s]{_H}{{2}}[:\-\s]{_H}{{2}}[:\-\s]{_H}{{2}}\b",
           gate=("#class:[0-9A-Fa-f]{2}[:\\-\\s][0-9A-Fa-f]{2}[:\\-\\s][0-9A-Fa-f]{2}[:\\-\\s]",)),
    _plain(125, "IMEI", r"\b\d{2}-\d{6}-\d{6}-\d{1}\b"),
    _plain(126, "CREDIT-CARD", _CARD_BARE),
    _plain(127, "PASSWORD", _PASSWORD_PROSE, validator="prose", profile="extended",
           gate=("password|passwd|pwd|passcode",)),
    _plain(128, "CC-EXPIRY", _EXPIRY),
    _plain(129, "URL", r"https?://[^\s<>\"')\]]+", validator="namespace_url", profile="extended", gate=("://",)),
    _plain(130, "BANK-ACCOUNT", r"(?i)(?:account|acct|routing)\s*(?:no|number|num|#|:)\s*[A-Z]{0,4}\d{6,18}\b",
           gate=("#digit", "account|acct|routing")),
    _plain(131, "INSURANCE-ID", _INSURANCE, gate=("#digit", "insurance|policy|health|member")),
    _plain(132, "REGISTRATION-ID", _STUDENT_ID, validator="digit", profile="extended", edges="R",
           gate=("#digit", "student|reg|enrollment")),
)

# What a text must hold before a pattern runs on it, where the row itself says no more than "a digit".
GATES: dict[int, tuple[str, ...]] = {
    1: ("#digit", "#run:[0-9]{4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3}"),
    2: ("#digit", "#word:[13][0-9A-Za-z]{25}"),
    3: ("#digit", "#word:0x[0-9A-Fa-f]{40}"),
    5: ("#digit", "#word:[A-Z]{2}[0-9]{2}"),
    6: ("#digit", r"#run:[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    7: ("#mark", "#class:::|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    8: ("#mark", "://"),
    9: ("#digit", r"#run:[0-9][/\-.][0-9]{1,2}[/\-.][0-9]{2}"),
    10: ("#digit", r"#run:[0-9][/\-.][0-9]{1,2}[/\-.][0-9]{2}"),
    11: ("#mark", "#class::[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:"),
    12: ("#class:-[0-9A-Fa-f]{2}-[0-9A-Fa-f]{2}-",),
    13: (r"#class:\.[0-9A-Fa-f]{4}\.",),
    14: ("#digit", "#run:[0-9]{3}[- .][0-9]{2}[- .][0-9]{4}"),
    15: ("#digit", "#run:9[0-9]{2}[- ][0-9]{2}[- ][0-9]{4}"),
    16: ("#digit", "#run:9[0-9]{8}"),
    17: ("#digit", "#run:[0-9]{9}"),
    18: ("#digit", "#word:[A-Z][0-9]{8}"),
    19: ("#digit", "#word:[A-Z][0-9]|[0-9][A-Z]"),
    20: ("#digit", "#run:[0-9]{10}"),
    21: ("#digit", "#run:[0-9]{4}-[0-9]{4}-[0-9]"),
    22: ("#digit", "#run:[0-9]{9}"),
    23: ("#digit", "#word:[A-Za-z]{2}[0-9]{7}"),
    24: ("#digit", "#word:[0-9][A-Z][0-9A-Z][0-9]"),
    25: ("#digit", "#word:[0-9][A-Z][0-9A-Z][0-9][A-Z][0-9A-Z][0-9][A-Z]{2}[0-9]{2}"),
    26: ("#digit", "#run:[12][0-9]{3}[ -][0-9]{3}[ -][0-9]{3}"),
    27: ("#digit", "#run:[12][0-9]{9}"),
    28: ("#digit", "#run:[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}"),
    29: ("#digit", "#run:[0-9]{2} ?[0-9]{2} ?[0-9]{2}"),
    30: ("#digit", "#word:[0-9][A-Z]{2}"),
    31: ("#digit", "#word:[A-Z]{2}[0-9]{7}"),
    32: ("#digit", "#word:[A-Z9]{5}[0-9]{6}"),
    33: ("#digit", "#run:[0-9]{3}-[0-9]{3}-[0-9]{3}"),
    34: ("#digit", "#run:[0-9]{3} [0-9]{3} [0-9]{3}"),
    35: ("#digit", r"#run:[0-9]{3}\s[0-9]{3}\s[0-9]{3}"),
    36: ("#digit", "#word:[0-9]{4}[^0-9 ]"),
    37: ("#digit", "#word:[0-9]{8}[A-Z]"),
    38: ("#digit", "#word:[0-9A-Z]{8}[0-9]"),
    39: ("#digit", "#word:[0-9]{7}[^0-9 ]"),
    41: ("#digit", "#word:[A-Z]{6}"),
    43: ("#digit", r"#run:[0-9]{3}\)[\s.\-]?[0-9]{3}[\s.\-]?[0-9]{4}"),
    44: ("#digit", r"#run:[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}"),
    46: ("#digit", r"#run:0[0-9]{2,4}[\s.\-][0-9]{3}"),
    47: ("#digit", r"#run:00[0-9]{2,4}[\s.\-][0-9]{2}"),
    49: ("#mark", "aws_secret_access_key"),
    53: ("#mark", "://", "mongodb://|postgres://|mysql://|redis://|amqp://"),
    54: ("#mark", "password|secret|token|api_key|apikey"),
    55: ("#mark", "password|passwd|pwd"),
    57: ("#digit", "#run:[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]"),
    58: ("#digit", "#run:[01][0-9]/[23][0-9]"),
    61: ("#digit", "#word:[A-Z]{2}[0-9]{2}"),
    62: ("#digit", r"#run:[0-9]{4}[\s\-][0-9]{4}[\s\-][0-9]{4}[\s\-][0-9]{4}"),
    67: ("#mark", "://"),
    68: ("#digit", "#run:[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    69: ("#digit", r"#run:[0-9]{3}\s[0-9]{2}\s[0-9]{4}"),
    70: ("#digit", "#run:[0-9]{13}"),
    118: ("#digit", r"#run:[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
}
# What holds for an expression holds for it in the older profile too.
_SAME_GATE = {(p.regex, p.edges): GATES.get(p.ord, p.gate) for p in PATTERNS}
# Words that do not count as a password after "the password is".
PROSE_STATES = (
    "valid", "invalid", "temporary", "required", "optional", "incorrect", "correct", "wrong", "right",
    "expired", "changed", "reset", "secure", "strong", "weak", "empty", "null", "blank", "missing", "set",
    "enabled", "disabled", "locked", "unlocked",
)
# A bare URL holding one of these is a schema or a placeholder, not personal data.
URL_SKIP = (
    "w3.org", "xml", "schema", "xmlns", "xsd", "dtd", "xbrl", "spec/", "json-schema", "openid", "oauth",
    "example.com", "example.org", "localhost", "fpml.org", "iso.org", "ietf.org", "oasis-open.org",
)
# Hosts the older profile does not report as URLs.
NAMESPACE_HOSTS = ("w3.org", "xbrl.org", "fpml.org", "xmlsoap.org", "schemas.xmlsoap.org", "xml.org")
NINO_REFUSED = ("BG", "GB", "NK", "KN", "NT", "TN", "ZZ")
SSN_REFUSED = ("078051120", "123456789", "219099999")
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)

CONTEXT_REACH = 100
CONTEXT_BOOST = 0.35
CONFIDENCE_FLOOR = 0.3

# ---------------------------------------------------------------------------


def profile(name: str = "compat", custom: list[tuple[str, str]] | None = None) -> list[Pattern]:
    """Rows of a profile: ``compat``, ``extended``, ``simple`` or ``simple_extended``.

    ``custom`` adds ``(label, regex)`` rows that belong to no rule and so cannot be switched off.
    """
    if name not in ("compat", "extended", "simple", "simple_extended"):
        raise ValueError(f"unknown profile {name!r}")
    rows = SIMPLE_PATTERNS if name.startswith("simple") else PATTERNS
    keep = [p for p in rows if p.profile == "compat" or name.endswith("extended")]
    for k, (label, regex) in enumerate(custom or []):
        keep.append(Pattern(1000 + k, "", label, regex, 1.0, edges="LR", gate=()))
    return [p._replace(gate=GATES.get(p.ord, _SAME_GATE.get((p.regex, p.edges), p.gate))) for p in keep]


def word_patterns(words: list[str], label: str = "CUSTOM-WORD", first_ord: int = 2000) -> list[Pattern]:
    """Blocked words as patterns: literal, case-insensitive."""
    special = set(r"\.+*?()|[]{}^$/#-&~")
    out = []
    for k, word in enumerate(words):
        quoted = "".join("\\" + c if c in special else c for c in word)
        gate = (word.lower(),) if word.isascii() and "|" not in word else ()
        out.append(Pattern(first_ord + k, "", label, "(?i)" + quoted, 1.0, gate=gate))
    return out
