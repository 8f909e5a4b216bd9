"""Detection, masking and entropy once more, as SQL for the checking engine.

Written against the same pattern rows but sharing no code with the Spark jobs: the other engine has
its own regular expressions (RE2), its own list functions and its own arithmetic.
"""

from __future__ import annotations

from veilwright.operators import entropy as E
from veilwright.sources import patterns as P
from veilwright.sources.planted import planted_texts


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def corpus() -> str:
    texts = planted_texts()
    listed = ", ".join(lit(t) for t in texts)
    return f"""
    SELECT doc_id AS id, text FROM documents
    UNION ALL
    SELECT 10000000 + c_custkey AS id,
           replace(([{listed}])[CAST(c_custkey % {len(texts)} AS INTEGER) + 1], '¶', chr(10)) || ' (' || c_mktsegment || ')' AS text
    FROM customer"""


_D = "regexp_replace(value, '[^0-9]', '', 'g')"


def _weighted(weights, d=_D) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights)) + ")"


def _luhn() -> str:
    digit = f"CAST(substr({_D}, length({_D}) - i + 1, 1) AS INTEGER)"
    return (
        f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
        f"WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"
    )


def _iban() -> str:
    c = (
        r"upper(replace(replace(regexp_replace(value, '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g'), ' ', ''), '-', ''))"
    )
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    number = (
        f"array_to_string(list_transform(string_split({turned}, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' "
        "THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), '')"
    )
    rest = (
        f"list_reduce(list_transform(string_split({number}, ''), lambda x: CAST(x AS INTEGER)), "
        "lambda a, b: (a * 10 + b) % 97)"
    )
    return f"CASE WHEN regexp_matches({c}, '^[0-9A-Z]{{15,34}}$') THEN {rest} = 1 ELSE false END"


def _checks() -> dict[str, str]:
    hosts = "|".join(h.replace(".", r"\.") for h in P.NAMESPACE_HOSTS)
    n = f"length({_D})"
    return {
        "card": f"{n} BETWEEN 12 AND 19 AND NOT regexp_matches(value, '^1[0-9]{{12}}([^0-9]|$)') AND {_luhn()}",
        "iban": _iban(),
        "aba": f"CASE WHEN {n} = 9 THEN {_weighted(P.ABA_WEIGHTS)} % 10 = 0 ELSE false END",
        "nhs": f"CASE WHEN {n} <> 10 THEN false WHEN 11 - {_weighted(P.NHS_WEIGHTS)} % 11 = 11 THEN substr({_D}, 10, 1) = '0' "
        f"WHEN 11 - {_weighted(P.NHS_WEIGHTS)} % 11 = 10 THEN false "
        f"ELSE CAST(substr({_D}, 10, 1) AS INTEGER) = 11 - {_weighted(P.NHS_WEIGHTS)} % 11 END",
        "tfn": f"CASE WHEN {n} = 9 THEN {_weighted(P.TFN_WEIGHTS)} % 11 = 0 ELSE false END",
        "sin": f"CASE WHEN {n} = 9 THEN {_luhn()} ELSE false END",
        "nif": f"substr(value, 9, 1) = substr('{P.NIF_LETTERS}', CAST(CAST({_D} AS BIGINT) % 23 AS INTEGER) + 1, 1)",
        "ssn": f"{n} = 9 AND {_D} NOT IN ({', '.join(lit(x) for x in P.SSN_REFUSED)}) AND substr({_D}, 1, 3) NOT IN "
        f"('000', '666', '900') AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6, 4) <> '0000'",
        "mac": "upper(replace(replace(value, ':', ''), '-', '')) NOT IN ('000000000000', 'FFFFFFFFFFFF')",
        "swift": "regexp_matches(value, '[0-9]')",
        "digit": "regexp_matches(value, '[0-9]')",
        "url": f"len(list_filter({words(P.URL_SKIP)}, lambda w: contains(lower(value), w))) = 0",
        "namespace_url": f"NOT regexp_matches(value, {lit(rf'^https?://(?:www\.)?(?:{hosts})')})",
        "nino": f"upper(substr(value, 1, 2)) NOT IN ({', '.join(lit(x) for x in P.NINO_REFUSED)})",
        "prose": "NOT regexp_matches(value, "
        + lit(rf"(?i)^(?:password|passwd|pwd|passcode)\s*(?:is|was|:)\s*(?:{'|'.join(P.PROSE_STATES)})\b")
        + ")",
    }


def matches(patterns: list[P.Pattern], source: str, text: str = "text", extra: str = "") -> str:
    """All matches of all patterns with their place: (id, text, ord, value, s, e)."""
    hits = " UNION ALL ".join(
        f"SELECT id, {text} AS text{extra}, {p.ord} AS ord, regexp_extract_all({text}, {lit(p.regex)}) AS m, "
        f"string_split_regex({text}, {lit(p.regex)}) AS g FROM {source}"
        for p in patterns
    )
    return f"""
    SELECT id, text{extra}, ord, m[k] AS value, s, s + length(m[k]) AS e FROM (
      SELECT *, CAST(list_sum(list_transform(g[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({hits}) WHERE len(m) > 0))"""


def findings(patterns: list[P.Pattern], source: str, layer: str = "presidio", layer_ord: int = 1) -> str:
    """SELECT of (id, rule_id, ord, label, value, s, e, confidence, layer, layer_ord)."""
    facts = ", ".join(
        f"({p.ord}, {lit(p.rule_id)}, {lit(p.label)}, CAST({p.score} AS DOUBLE), {words(p.context)}, "
        f"{lit(p.validator)}, {str(p.required).lower()})"
        for p in patterns
    )
    used = {p.validator for p in patterns if p.validator}
    checks = _checks()
    valid = "true"
    if used:
        valid = "CASE validator " + " ".join(f"WHEN {lit(v)} THEN ({checks[v]})" for v in sorted(used)) + " ELSE true END"
    window = (
        f"substr(lower(text), greatest(s - {P.CONTEXT_REACH}, 0) + 1, "
        f"least(e + {P.CONTEXT_REACH}, length(text)) - greatest(s - {P.CONTEXT_REACH}, 0))"
    )
    return f"""
    SELECT id, rule_id, ord, label, value, s, e, round(confidence, 4) AS confidence,
           {lit(layer)} AS layer, {layer_ord} AS layer_ord
    FROM (
      SELECT *, CASE WHEN len(context) = 0 THEN score WHEN near THEN least(score + {P.CONTEXT_BOOST}, 1.0)
                     WHEN required THEN NULL ELSE score END AS confidence
      FROM (
        SELECT *, len(list_filter(context, lambda w: contains({window}, w))) > 0 AS near
        FROM ({matches(patterns, source)}) JOIN
             (VALUES {facts}) AS facts(ord, rule_id, label, score, context, validator, required) USING (ord))
      WHERE {valid})
    WHERE confidence >= {P.CONFIDENCE_FLOOR}"""


FINDING_ORDER = "s, e DESC, layer_ord, ord"


def fold(listed: str, contained: bool) -> str:
    """Accept spans from the left; the result also holds the masked text and the marks.

    ``listed`` is an ordered list of {s, e, label, value}; a column ``text`` must be in scope.
    """
    accept = "x.s >= a.last" + (" AND x.e > a.reach" if contained else "")
    return f"""
    list_reduce({listed}, lambda a, x: CASE WHEN {accept} THEN
        {{'last': x.e, 'reach': greatest(a.reach, x.e),
          'shift': CAST(a.shift + 11 + length(x.label) - (x.e - x.s) AS BIGINT),
          'masked': a.masked || substr(text, a.last + 1, x.s - a.last) || '[REDACTED-' || x.label || ']',
          'html': a.html || replace(replace(replace(substr(text, a.last + 1, x.s - a.last), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                  || '<mark>' || replace(replace(replace(x.value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark>',
          'marks': list_append(a.marks, {{'s': x.s, 'e': x.e, 'label': x.label, 'value': x.value,
                   'ms': CAST(x.s + a.shift AS BIGINT), 'me': CAST(x.s + a.shift + 11 + length(x.label) AS BIGINT),
                   'shift': CAST(a.shift + 11 + length(x.label) - (x.e - x.s) AS BIGINT)}})}}
      ELSE {{'last': a.last, 'reach': greatest(a.reach, x.e), 'shift': a.shift, 'masked': a.masked, 'html': a.html,
             'marks': a.marks}} END,
      {{'last': CAST(0 AS INTEGER), 'reach': CAST(-1 AS INTEGER), 'shift': CAST(0 AS BIGINT), 'masked': '', 'html': '',
        'marks': CAST([] AS STRUCT(s INTEGER, e INTEGER, label VARCHAR, value VARCHAR, ms BIGINT, me BIGINT, shift BIGINT)[])}})"""


def folded(source: str, found: str, contained: bool) -> str:
    """(id, text, masked, html, marks) of every text in ``source`` given findings ``found``."""
    return f"""
    SELECT id, text,
           CASE WHEN r IS NULL THEN text ELSE r.masked || substr(text, r.last + 1) END AS masked,
           CASE WHEN r IS NULL THEN replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                ELSE r.html || replace(replace(replace(substr(text, r.last + 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS html,
           coalesce(r.marks, []) AS marks
    FROM (
      SELECT c.id, c.text, CASE WHEN l.spans IS NULL THEN NULL ELSE {fold('l.spans', contained)} END AS r
      FROM ({source}) c LEFT JOIN (
        SELECT id, list({{'s': CAST(s AS INTEGER), 'e': CAST(e AS INTEGER), 'label': label, 'value': value}} ORDER BY {FINDING_ORDER}) AS spans
        FROM ({found}) GROUP BY id) l ON c.id = l.id)"""


def tokens(source: str, min_length: int) -> str:
    """Entropy candidates of column ``masked``: (id, text, value, s, e)."""
    run = rf"[\p{{L}}\p{{Nd}}+/=_-]{{{max(1, -(-min_length // 4))},}}"
    one = P.Pattern(0, "", "", run, 1.0)
    kinds = " + ".join(
        f"CAST(regexp_matches(value, {lit(k)}) AS INTEGER)"
        for k in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{Lu}\p{Ll}\p{Nd}]")
    )
    slashes = "(length(value) - length(replace(value, '/', '')))"
    scores = "(length(value) - length(replace(value, '_', '')))"
    crosses = "(length(value) - length(replace(upper(value), 'X', '')))"
    return f"""
    SELECT * FROM ({matches([one], source, "masked", ", marks")})
    WHERE strlen(value) >= {min_length} AND {kinds} >= 2
      AND len(list_filter({words(E.PATH_PARTS)}, lambda w: contains(lower(value), w))) = 0
      AND {slashes} < 2 AND NOT starts_with(value, '/')
      AND NOT ({crosses} > 3 AND {crosses} / strlen(value) > 0.2)
      AND NOT (contains(value, '-') AND regexp_matches(value, '^[\\p{{L}}-]+$'))
      AND NOT (regexp_matches(value, '^\\p{{L}}+$') AND regexp_matches(value, '\\p{{Lu}}') AND regexp_matches(value, '\\p{{Ll}}'))
      AND {scores} < 2 AND NOT contains(value, '__')
      AND NOT (regexp_matches(value, '^\\p{{Lu}}+$') AND strlen(value) < 20)
      AND NOT starts_with(value, 'REDACTED-')"""


#: The place in the original of a place ``{p}`` in the masked text, by the column ``marks``.
BACK = (
    "coalesce(list_filter(marks, lambda m: m.ms < {p} AND {p} < m.me)[1].s, "
    "{p} - coalesce(list_filter(marks, lambda m: m.me <= {p})[-1].shift, 0))"
)


def moved(found: str, marks: str) -> str:
    """Findings in the masked texts of table ``marks``, at their places in the original."""
    return f"""
    SELECT id, rule_id, ord, label, value, CAST({BACK.format(p='s')} AS INTEGER) AS s, CAST({BACK.format(p='e')} AS INTEGER) AS e,
           confidence, layer, layer_ord
    FROM ({found}) JOIN (SELECT id, marks FROM {marks}) USING (id)"""


def entropy(
    source: str, threshold: float, min_length: int, gated: bool = True, unconditional: bool = False, layer_ord: int = 2
) -> str:
    """Findings of the entropy layer over (id, text, masked, marks), at their places in the original."""
    chars = "string_split(value, '')"
    share = f"(len(list_filter({chars}, lambda y: y = x)) / CAST(length(value) AS DOUBLE))"
    bits = f"-list_sum(list_transform(list_distinct({chars}), lambda x: {share} * log2({share})))"
    window = (
        f"substr(lower(text), greatest(s - {E.REACH}, 0) + 1, "
        f"least(e + {E.REACH}, length(text)) - greatest(s - {E.REACH}, 0))"
    )
    return f"""
    SELECT id, CASE WHEN near THEN 'entropy_keyword_gated' ELSE 'entropy_unconditional' END AS rule_id, 0 AS ord,
           '{E.LABEL}' AS label, value, CAST({BACK.format(p='s')} AS INTEGER) AS s, CAST({BACK.format(p='e')} AS INTEGER) AS e,
           round(least(h / 6, 1.0), 6) AS confidence, 'entropy' AS layer, {layer_ord} AS layer_ord
    FROM (SELECT *, round({bits}, 9) AS h,
                 len(list_filter({words(E.SECRET_WORDS)}, lambda w: contains({window}, w))) > 0 AS near
          FROM ({tokens(source, min_length)}))
    WHERE h >= {threshold} AND ((h >= {E.SURE} AND {str(unconditional).lower()}) OR ({str(gated).lower()} AND near))"""
