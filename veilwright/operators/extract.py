"""Text out of chat requests and tool messages, and clean text back in.  JSON is read as variants.

Of a repeated key the last value counts, so that no text hides behind one. Spark decides that by a
setting of the session, ``spark.sql.variant.allowDuplicateKeys``; it is switched on here, in the session
of the table that is read. A body that still can not be read, or holds a number that no double holds,
is masked as plain text as a whole and marked with an ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions.spans import settled
from veilwright.sources.scratch import written

# (id, text) -> (id, redacted_text)
Clean = Callable[[DataFrame], DataFrame]

REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
UNREADABLE = "parse request body"
#: Place of the unit that is a whole unreadable body.
WHOLE = -2


def _readable(body: Column) -> Column:
    """The body as a variant; null where it is no JSON or writing it again would change a number."""
    doc = F.try_parse_json(body)
    huge = body.rlike(r"[0-9][eE]\+?[0-9]{3}") & F.to_json(doc).rlike('"-?Infinity"')
    return F.when(~huge, doc)


def lenient(df: DataFrame) -> DataFrame:
    """``df``, in whose session the last value of a repeated JSON key counts."""
    df.sparkSession.conf.set(REPEATED_KEYS, "true")
    return df


def _string(part: Column, field: str) -> Column:
    """A field of an object that is a string; null when it is something else."""
    value = F.try_variant_get(part, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _kind(part: Column) -> Column:
    return F.try_variant_get(part, "$.type", "string")


def _nested(part: Column) -> Column:
    """Parts inside a tool result whose content is a list."""
    content = F.try_variant_get(part, "$.content", "variant")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>"))


def _units(part: Column, place: Column) -> Column:
    """``(part, nested, text)`` of each text in a content part; ``nested`` is -1 for the part's own."""

    def unit(nested: Column, text: Column) -> Column:
        return F.struct(place.alias("part"), nested.alias("nested"), text.alias("text"))

    own = F.array(unit(F.lit(-1), F.when(_kind(part) == "text", _string(part, "text")).otherwise(_string(part, "content"))))
    inner = F.transform(_nested(part), lambda q, j: unit(j, F.when(_kind(q) == "text", _string(q, "text"))))
    found = F.when((_kind(part) == "tool_result") & _nested(part).isNotNull(), inner).when(_kind(part).isin("text", "tool_result"), own)
    return F.filter(F.coalesce(found, F.filter(own, lambda _: F.lit(False))), lambda u: u.text.isNotNull())


def _text_of(part: Column) -> Column:
    """Text of a content part; null when the part carries none."""
    inner = F.array_join(F.filter(F.transform(_nested(part), lambda q: F.when(_kind(q) == "text", _string(q, "text"))), lambda t: t.isNotNull()), "\n")
    result = F.coalesce(inner, _string(part, "content"))
    return F.when(_kind(part) == "text", F.coalesce(F.try_variant_get(part, "$.text", "string"), F.lit(""))).when(
        (_kind(part) == "tool_result") & (result != ""), result
    )


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def parsed(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc`` (the body as a variant, null if it is no request) and ``messages`` (array of variants)."""
    doc = _readable(F.col(body))
    listed = F.try_variant_get(doc, "$.messages", "variant")
    fits = F.schema_of_variant(doc).startswith("OBJECT") & (listed.isNull() | F.schema_of_variant(listed).startswith("ARRAY") | F.schema_of_variant(listed).isin("VOID"))
    return lenient(requests).withColumn("doc", settled(F.when(fits, doc))).withColumn(
        "messages", F.try_variant_get("doc", "$.messages", "array<variant>")
    )


def message_rows(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per message: request, index, role, text."""
    rows = parsed(requests, body).select("id", F.posexplode("messages").alias("idx", "m"))
    content = F.try_variant_get("m", "$.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    text = F.when(_is_string(content), F.try_variant_get(content, "$", "string")).otherwise(
        F.array_join(F.filter(F.transform(parts, _text_of), lambda t: t.isNotNull()), "\n")
    )
    return rows.select("id", "idx", F.try_variant_get("m", "$.role", "string").alias("role"), text.alias("text"))


def last_user(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``idx`` and ``content`` of the last message of role user, its texts and units of text, and an ``error``."""
    picked = F.try_element_at(
        F.filter(
            F.transform("messages", lambda m, i: F.struct(i.alias("idx"), m.alias("m"))),
            lambda x: F.try_variant_get(x.m, "$.role", "string") == "user",
        ),
        F.lit(-1),
    )
    content = F.try_variant_get(F.col("last.m"), "$.content", "variant")
    parts = F.try_variant_get("content", "$", "array<variant>")
    return (
        parsed(requests, body)
        .withColumn("last", settled(picked))
        .withColumn("idx", F.col("last.idx"))
        .withColumn("content", content)
        .withColumn("is_array", F.schema_of_variant("content").startswith("ARRAY"))
        .withColumn("parts", F.when(F.col("is_array"), parts))
        .withColumn(
            "texts",
            F.when(F.col("is_array"), F.transform("parts", _text_of)).when(
                _is_string(F.col("content")), F.array(F.try_variant_get("content", "$", "string"))
            ),
        )
        .withColumn(
            "units",
            F.when(F.col("is_array"), F.flatten(F.transform("parts", _units))).when(
                _is_string(F.col("content")),
                F.array(F.struct(F.lit(-1).alias("part"), F.lit(-1).alias("nested"), F.try_variant_get("content", "$", "string").alias("text"))),
            ),
        )
        .withColumn(
            "error",
            F.when(F.col("doc").isNull(), UNREADABLE)
            .when(F.col("last").isNull(), "no user message found")
            .when(F.col("texts").isNull(), "unsupported content format"),
        )
    )


def last_user_message(requests: DataFrame, body: str = "body") -> DataFrame:
    """(id, idx, text, is_array, error)."""
    return last_user(requests, body).select(
        "id",
        "idx",
        F.array_join(F.filter("texts", lambda t: t.isNotNull()), "\n").alias("text"),
        F.coalesce("is_array", F.lit(False)).alias("is_array"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def _quoted(value: Column) -> Column:
    """A string as JSON text."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _object(fields: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def _with_field(v: Column, key: str, value: Column) -> Column:
    """An object as JSON text, with one field that it has set anew and all others as they are."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return _object(
        F.transform(
            entries,
            lambda e: F.concat(_quoted(e.key), F.lit(":"), F.when(e.key == key, value).otherwise(F.to_json(e.value))),
        )
    )


def _whole(body: str) -> Column:
    """The units of a body that can not be read: all of it."""
    return F.array(F.struct(F.lit(WHOLE).alias("part"), F.lit(-1).alias("nested"), F.col(body).alias("text")))


def _cleaned(found: DataFrame, keep: list[str], clean: Clean) -> DataFrame:
    """``keep`` and ``done``, the units ``(part, nested, text)`` with clean texts; null for a row without any.

    Rows are written with a key first, so a task that runs again finds the key it had. Each text goes
    through ``clean`` with the key of its row, and the texts of a row come together by that key; what
    else belongs to the row travels once. Ids may repeat or be null.
    """
    rows = written(found.select(*keep, "units", F.monotonically_increasing_id().alias("row")), "bodies")
    none = rows.where("coalesce(size(units), 0) <= 0").select(*keep, F.lit(None).cast("array<struct<part:int,nested:int,text:string>>").alias("done"))
    parts = rows.where("size(units) > 0").select("row", *keep, F.posexplode("units").alias("at", "u"))
    head = F.when(F.col("at") == 0, F.struct(*keep))
    parts = parts.select(F.struct("row", "at", head.alias("head"), F.col("u.part").alias("part"), F.col("u.nested").alias("nested")).alias("id"), F.col("u.text").alias("text"))
    unit = F.struct(F.col("id.part").alias("part"), F.col("id.nested").alias("nested"), F.col("redacted_text").alias("text"))
    grouped = clean(parts).groupBy(F.col("id.row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id.at").alias("at"), F.col("id.head").alias("head"), unit.alias("unit")))).alias("g")
    )
    done = grouped.select(*[F.element_at("g", 1).head[k].alias(k) for k in keep], F.transform("g", lambda x: x.unit).alias("done"))
    return none.unionByName(done)


def _done(part: Column, nested: Column) -> Column:
    """The clean text of a unit; null where there was none."""
    return F.try_element_at(F.filter("done", lambda u: (u.part == part) & (u.nested == nested)), F.lit(1)).text


def _part_json(part: Column, place: Column) -> Column:
    """A content part as JSON text; only its texts differ from what it was."""
    own = _done(place, F.lit(-1))
    inner = F.transform(
        _nested(part),
        lambda q, j: F.when(_done(place, j).isNotNull(), _with_field(q, "text", _quoted(_done(place, j)))).otherwise(F.to_json(q)),
    )
    inner = F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    return (
        F.when(own.isNotNull() & (_kind(part) == "text"), _with_field(part, "text", _quoted(own)))
        .when(own.isNotNull(), _with_field(part, "content", _quoted(own)))
        .when((_kind(part) == "tool_result") & _nested(part).isNotNull(), _with_field(part, "content", inner))
        .otherwise(F.to_json(part))
    )


def rewrite_requests(requests: DataFrame, clean: Clean, body: str = "body") -> DataFrame:
    """(id, body, error): the texts of the last user message masked, everything else as it was.

    A body without such a message comes back unchanged, with the reason as ``error`` (else empty). Of a
    repeated key the last value is kept. A body that can not be read is masked as one text; a null one
    stays null. Ids may repeat and may be null.
    """
    carried = requests.select("id", F.col(body).alias("body"))
    found = last_user(carried).withColumn("units", F.when(F.col("error").isNull(), F.col("units")).when((F.col("error") == UNREADABLE) & F.col("body").isNotNull(), _whole("body")))
    ready = last_user(_cleaned(found.select("id", "body", "units"), ["id", "body"], clean))
    listed = F.concat(F.lit("["), F.array_join(F.transform("parts", _part_json), ","), F.lit("]"))
    content = F.when(F.col("is_array"), listed).otherwise(_quoted(_done(F.lit(-1), F.lit(-1))))
    ready = ready.withColumn("__content", settled(content))
    ready = ready.withColumn("__message", settled(_with_field(F.col("last.m"), "content", F.col("__content"))))
    messages = F.transform("messages", lambda m, i: F.when(i == F.col("idx"), F.col("__message")).otherwise(F.to_json(m)))
    ready = ready.withColumn("__messages", settled(F.concat(F.lit("["), F.array_join(messages, ","), F.lit("]"))))
    raw = _done(F.lit(WHOLE), F.lit(-1))
    body_out = F.when(F.col("done").isNull(), F.col("body")).when(raw.isNotNull(), raw).otherwise(_with_field(F.col("doc"), "messages", F.col("__messages")))
    return ready.select("id", body_out.alias("body"), F.coalesce("error", F.lit("")).alias("error"))


# --- tool messages ---------------------------------------------------------------------------------


def rpc_texts(messages: DataFrame, message: str = "message") -> DataFrame:
    """Add ``doc``, ``place`` and ``texts``: parts of ``result.content``, else ``result``, else ``params.content``."""
    content = F.try_variant_get("doc", "$.result.content", "array<variant>")
    result = F.try_variant_get("doc", "$.result", "variant")
    params = F.try_variant_get("doc", "$.params.content", "variant")
    return (
        lenient(messages).withColumn("doc", settled(_readable(F.col(message))))
        .withColumn("parts", content)
        .withColumn(
            "place",
            F.when(F.col("parts").isNotNull(), "parts")
            .when(_is_string(result), "result")
            .when(_is_string(params), "params"),
        )
        .withColumn(
            "texts",
            F.when(
                F.col("place") == "parts",
                F.transform(
                    "parts",
                    lambda p: F.when(
                        F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING",
                        F.try_variant_get(p, "$.text", "string"),
                    ),
                ),
            )
            .when(F.col("place") == "result", F.array(F.try_variant_get("doc", "$.result", "string")))
            .when(F.col("place") == "params", F.array(F.try_variant_get("doc", "$.params.content", "string"))),
        )
    )


def rpc_text(messages: DataFrame, message: str = "message") -> DataFrame:
    return rpc_texts(messages, message).select(
        "id",
        F.coalesce("place", F.lit("")).alias("place"),
        F.coalesce(F.array_join(F.filter("texts", lambda t: t.isNotNull()), "\n"), F.lit("")).alias("text"),
    )


def clean_rpc(messages: DataFrame, clean: Clean, message: str = "message") -> DataFrame:
    """(id, message, error): every text masked on its decoded value; a message without text is unchanged.

    A message that can not be read is masked as one text and marked. Ids may repeat and may be null.
    """
    carried = messages.select("id", F.col(message).alias("message"))
    units = F.transform("texts", lambda t, i: F.struct(i.alias("part"), F.lit(-1).alias("nested"), t.alias("text")))
    read = F.when(F.col("place").isNotNull(), F.filter(units, lambda u: u.text.isNotNull()))
    found = rpc_texts(carried).withColumn("units", read.when(F.col("doc").isNull() & F.col("message").isNotNull(), _whole("message")))
    ready = rpc_texts(_cleaned(found.select("id", "message", "units"), ["id", "message"], clean))
    parts = F.transform("parts", lambda p, i: F.when(_done(i, F.lit(-1)).isNull(), F.to_json(p)).otherwise(_with_field(p, "text", _quoted(_done(i, F.lit(-1))))))
    result = F.try_variant_get("doc", "$.result", "variant")
    params = F.try_variant_get("doc", "$.params", "variant")
    first = _quoted(_done(F.lit(0), F.lit(-1)))
    ready = ready.withColumn("__parts", settled(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))))
    inner = (
        F.when(F.col("place") == "parts", _with_field(result, "content", F.col("__parts")))
        .when(F.col("place") == "params", _with_field(params, "content", first))
        .otherwise(first)
    )
    ready = ready.withColumn("__inner", settled(inner))
    rebuilt = F.when(F.col("place") == "params", _with_field(F.col("doc"), "params", F.col("__inner"))).otherwise(_with_field(F.col("doc"), "result", F.col("__inner")))
    raw = _done(F.lit(WHOLE), F.lit(-1))
    message_out = F.when(F.col("done").isNull(), F.col("message")).when(raw.isNotNull(), raw).otherwise(rebuilt)
    return ready.select("id", message_out.alias("message"), F.when(F.col("doc").isNull(), "parse message").otherwise("").alias("error"))
