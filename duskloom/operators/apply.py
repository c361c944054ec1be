"""Masking: spans become tokens or irreversible renderings, with a manifest of what can be restored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..plans.policy import Policy

REDACTED = "[REDACTED]"


def kind_of(entity: Column, policy: Policy) -> Column:
    """The operator's kind for an entity under a policy."""
    special = {e: policy.operator_for(e).kind for e in (*policy.overrides, "CVV", "CREDIT_CARD")}
    return F.coalesce(*[F.when(entity == e, kind) for e, kind in special.items()], F.lit(policy.default_operator.kind))


def rendered(policy: Policy):
    """span -> what stands in its place."""

    def one(s: Column) -> Column:
        masks = {e: policy.operator_for(e) for e in (*policy.overrides, "CVV", "CREDIT_CARD")}
        masked = F.coalesce(*[F.when(s["entity"] == e, T.keep_last(s["value"], o.from_end, o.char)) for e, o in masks.items() if o.kind == "mask"], T.keep_last(s["value"]))
        kind = F.when(s["literal"], F.lit("token")).otherwise(kind_of(s["entity"], policy))
        made = {"token": T.token(policy.salt, s["entity"], s["value"]), "redact": F.lit(REDACTED), "mask": masked, "hash": T.hash_mark(s["entity"], s["value"]), "keep": s["value"], "broker": T.token(policy.salt, F.concat(F.lit("BROKER__"), T.slug(s["entity"])), s["value"]), "local": T.token(policy.salt, T.slug(s["entity"]), s["value"])}
        return F.coalesce(*[F.when(kind == k, v) for k, v in made.items()])

    return one


def masked(text: Column, spans: Column, policy: Policy) -> Column:
    return S.splice(text, spans, rendered(policy)) if policy.enabled else text


def manifest(spans: Column, policy: Policy) -> Column:
    """array<struct<token,value,entity,start,end,masked_start,masked_end>> of the spans that became tokens, in text order.

    start and end are places in the original text, masked_start and masked_end those of the token in the masked text.
    """
    show = rendered(policy)
    shown = F.transform(spans, lambda x: F.struct(x.alias("x"), show(x).alias("token")))

    def placed(b: Column) -> Column:
        def row(y: Column, shift: Column) -> Column:
            x, start = y["x"], y["x"]["start"] + shift
            return F.struct(y["token"].alias("token"), x["value"].alias("value"), x["entity"].alias("entity"), x["start"].alias("start"), x["end"].alias("end"), start.alias("masked_start"), (start + F.length(y["token"])).alias("masked_end"))

        rows = F.zip_with(b, S.running_sums(F.transform(b, lambda y: F.length(y["token"]) - (y["x"]["end"] - y["x"]["start"]))), lambda y, shift: F.struct(row(y, shift).alias("r"), (y["x"]["literal"] | kind_of(y["x"]["entity"], policy).isin("token", "broker", "local")).alias("keep")))
        return F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: r["r"])

    return S.let(shown, placed)


def bypass_parts(text: Column) -> Column:
    """A user's text cut at >>...<<: array<struct<text,raw>> in order, raw where the markers asked for it. The first << closes;
    without one the marker is ordinary text."""
    pattern = r"(?s)>>(.*?)<<"
    inner, outer = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
    pairs = F.transform(F.sequence(F.lit(0), F.size(outer) - 1), lambda i: F.filter(F.array(F.struct(outer[i].alias("text"), F.lit(False).alias("raw")), F.struct(F.get(inner, i).alias("text"), F.lit(True).alias("raw"))), lambda p: p["text"].isNotNull()))
    return F.flatten(pairs)


def with_bypass(text: Column, mask) -> Column:
    """The text with mask applied outside >>...<< and the markers gone. A span can't cross a marker."""
    return F.array_join(F.transform(bypass_parts(text), lambda p: F.when(p["raw"], p["text"]).otherwise(mask(p["text"]))), "")
