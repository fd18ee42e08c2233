"""Column functions over chat requests, responses, headers and gateway replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: reply texts, reply fields and header names ----------------
PII_REPLY_TEXT = (
    "I cannot process this request as it contains personally identifiable information (%s) that is not "
    "allowed for the '%s' model according to the configured privacy policy. Please remove any sensitive "
    "information and try again."
)
GUARD_REPLY_TEXT = (
    "I cannot process this request as it appears to contain a potential jailbreak attempt (type: %s, "
    "confidence: %.3f). Please rephrase your request in a way that complies with our usage policies."
)
PII_REPLY_ID, PII_REPLY_FINGERPRINT = "chatcmpl-pii-violation-", "router_pii_policy"
GUARD_REPLY_ID, GUARD_REPLY_FINGERPRINT = "chatcmpl-jailbreak-blocked-", "router_prompt_guard"
GUARD_REPLY_MODEL = "security-filter"
REPLY_OBJECT, FINISH_REASON, REPLY_STATUS = "chat.completion", "content_filter", 200
HEADER_PII, HEADER_CACHE = "x-pii-violation", "x-cache-hit"
HEADER_BLOCKED, HEADER_TYPE, HEADER_CONFIDENCE = "x-jailbreak-blocked", "x-jailbreak-type", "x-jailbreak-confidence"
REQUEST_ID_HEADER = "x-request-id"
# -----------------------------------------------------------------------------


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` refers to it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _path(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _is_type(value: Column, pattern: str) -> Column:
    """The JSON value is absent, null, or of a variant type that matches."""
    return value.isNull() | F.schema_of_variant(value).rlike(f"^(VOID|{pattern})$")


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(VOID$|OBJECT<)")


def strict_json(body: Column) -> Column:
    """The body as a variant, NULL unless it is exactly one JSON value.

    The parser stops at the end of the first value, so the body is parsed as the
    first of two list items: text left over would disturb the second. A body that
    closes the list itself is caught by a second sentinel.
    """
    probe = lambda mark: F.try_parse_json(F.concat(F.lit("["), body, F.lit(f",{mark}]")))
    closes_list = body.rlike(r",\s*0\s*\]")
    intact = F.when(closes_list, F.try_variant_get(probe(1), "$[1]", "int") == 1).otherwise(True)
    return bind(
        probe(0),
        lambda v: F.when(
            (F.try_variant_get(v, "$[1]", "int") == 0) & _path(v, "$[2]").isNull() & intact, _path(v, "$[0]")
        ),
    )


def parse_request(body: Column) -> Column:
    """``struct<ok, model, messages>`` from a request body.

    The check is strict: a value of the wrong JSON type makes the request invalid.
    A missing or null field counts as empty and unknown fields are ignored.
    """
    text = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    fields = lambda d: F.struct(
        d.alias("doc"),
        F.coalesce(F.try_variant_get(d, "$.messages", "array<variant>"), F.array().cast("array<variant>")).alias("items"),
    )

    def valid(f: Column) -> Column:
        item_ok = lambda m: m.isNull() | (
            _is_object(m) & _is_type(_path(m, "$.role"), "STRING") & _is_type(_path(m, "$.content"), "STRING")
        )
        doc = f["doc"]
        return F.coalesce(
            _is_object(doc)
            & _is_type(_path(doc, "$.model"), "STRING")
            & _is_type(_path(doc, "$.messages"), "ARRAY<.*")
            & F.forall(f["items"], item_ok),
            F.lit(False),
        )

    def result(f: Column) -> Column:
        parsed = F.transform(
            f["items"], lambda m: F.struct(text(m, "$.role").alias("role"), text(m, "$.content").alias("content"))
        )
        return bind(
            valid(f),
            lambda ok: F.struct(
                ok.alias("ok"), F.when(ok, text(f["doc"], "$.model")).alias("model"), F.when(ok, parsed).alias("messages")
            ),
        )

    return bind(strict_json(body), lambda d: bind(fields(d), result))


def parse_usage(body: Column) -> Column:
    """``struct<ok, prompt_tokens, completion_tokens, total_tokens>`` from a response body; zero on failure."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    whole = r"BIGINT|DECIMAL\([0-9]+,0\)"

    def result(doc: Column) -> Column:
        ok = _is_object(doc) & _is_type(_path(doc, "$.usage"), "OBJECT<.*")
        for path in (*(f"usage.{n}" for n in names), "created"):
            ok = ok & _is_type(_path(doc, f"$.{path}"), whole)
        for name in ("id", "object", "model"):
            ok = ok & _is_type(_path(doc, f"$.{name}"), "STRING")
        count = lambda good, n: F.when(
            good, F.coalesce(F.try_variant_get(doc, f"$.usage.{n}", "bigint"), F.lit(0))
        ).otherwise(F.lit(0))
        return bind(
            F.coalesce(ok, F.lit(False)),
            lambda good: F.struct(good.alias("ok"), *[count(good, n).alias(n) for n in names]),
        )

    return bind(strict_json(body), result)


def request_id(headers: Column) -> Column:
    """Value of the request-id header, matched without regard to case; NULL if absent."""
    lowered = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.try_element_at(lowered, F.lit(REQUEST_ID_HEADER))


def user_content(messages: Column) -> Column:
    """Content of the last message whose role is exactly ``user``; empty if none."""
    mine = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(mine, F.lit(-1))["content"], F.lit(""))


def non_user_contents(messages: Column) -> Column:
    """Contents of all messages with another, non-empty role, in order."""
    others = F.filter(messages, lambda m: (m["role"] != "user") & (m["role"] != ""))
    return F.transform(others, lambda m: m["content"])


def content_list(user: Column, non_user: Column) -> Column:
    """All contents to screen: the user content if there is one, then the others."""
    return F.concat(F.when(user != "", F.array(user)).otherwise(F.array().cast("array<string>")), non_user)


def classification_text(user: Column, non_user: Column) -> Column:
    """User content, else the other contents joined by one space."""
    return F.when(user != "", user).otherwise(F.array_join(non_user, " "))


def rewrite_request(model: Column, messages: Column) -> Column:
    """Request JSON with the new model; only model and messages are kept."""
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages")))


def rewrite_request_keeping_fields(body: Column, model: Column) -> Column:
    """Request JSON with the new model and every other field of the body kept."""
    fields = F.try_parse_json(body).cast("map<string,variant>")
    renamed = F.parse_json(F.to_json(F.struct(model.alias("model")))).cast("map<string,variant>")
    return F.to_json(F.map_concat(fields, renamed))


def drop_content_length(headers: Column) -> Column:
    """Headers of the rewritten request; the stale length is removed."""
    return F.map_filter(headers, lambda k, v: F.lower(k) != "content-length")


def _completion(ident: str, fingerprint: str, model: Column, text: Column, created: Column) -> Column:
    # Keys in alphabetical order, as in the serialised replies clients already see.
    return F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit(FINISH_REASON).alias("finish_reason"),
                    F.lit(0).alias("index"),
                    F.struct(text.alias("content"), F.lit("assistant").alias("role")).alias("message"),
                )
            ).alias("choices"),
            created.alias("created"),
            F.concat(F.lit(ident), created.cast("string")).alias("id"),
            model.alias("model"),
            F.lit(REPLY_OBJECT).alias("object"),
            F.lit(fingerprint).alias("system_fingerprint"),
            F.struct(
                F.lit(0).alias("completion_tokens"), F.lit(0).alias("prompt_tokens"), F.lit(0).alias("total_tokens")
            ).alias("usage"),
        )
    )


def _reply(body: Column, **headers: Column | str) -> Column:
    pairs = [F.lit("content-type"), F.lit("application/json")]
    for name, value in headers.items():
        pairs += [F.lit(name.replace("_", "-")), value if isinstance(value, Column) else F.lit(value)]
    return F.struct(F.lit(REPLY_STATUS).alias("status"), F.create_map(*pairs).alias("headers"), body.alias("body"))


def pii_reply_text(model: Column, denied: Column) -> Column:
    listed = F.concat(F.lit("["), F.array_join(denied, " "), F.lit("]"))
    return F.format_string(PII_REPLY_TEXT, listed, model)


def guard_reply_text(kind: Column, confidence: Column) -> Column:
    return F.format_string(GUARD_REPLY_TEXT, kind, confidence)


def pii_reply(model: Column, denied: Column, created: Column) -> Column:
    """Reply for a request blocked by the privacy policy."""
    body = _completion(PII_REPLY_ID, PII_REPLY_FINGERPRINT, model, pii_reply_text(model, denied), created)
    return _reply(body, **{HEADER_PII: "true"})


def guard_reply(kind: Column, confidence: Column, created: Column) -> Column:
    """Reply for a request blocked by the prompt guard."""
    body = _completion(
        GUARD_REPLY_ID, GUARD_REPLY_FINGERPRINT, F.lit(GUARD_REPLY_MODEL), guard_reply_text(kind, confidence), created
    )
    return _reply(
        body,
        **{HEADER_BLOCKED: "true", HEADER_TYPE: kind, HEADER_CONFIDENCE: F.format_string("%.3f", confidence)},
    )


def cache_reply(body: Column) -> Column:
    """Reply answered from the semantic cache."""
    return _reply(body, **{HEADER_CACHE: "true"})
