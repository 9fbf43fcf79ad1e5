"""Prompt hashes, compound labels, tier and scope labels, chat messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import config as C
from plumbline.functions.text import strip


def prompt_hash(prompt: Column) -> Column:
    return F.coalesce(F.sha1(prompt), F.lit(C.ERROR_HASH))


def compound_label(label: Column, digest: Column) -> Column:
    """label:digest; null where the label is."""
    return F.concat(label, F.lit(":"), digest)


def split_label(compound: Column) -> Column:
    """struct(label, digest) split on the first colon; null without a colon."""
    at = F.locate(":", compound)
    return F.when(
        at > 0,
        F.struct(
            F.substring(compound, F.lit(1), at - 1).alias("label"),
            F.substring(compound, at + 1, F.length(compound)).alias("digest"),
        ),
    )


def verify_hash(prompt: Column, compound: Column) -> Column:
    """Embedded digest equals the recomputed one; unsplittable labels pass."""
    return F.coalesce(split_label(compound)["digest"] == prompt_hash(prompt), F.lit(True))


def extract_label(compound: Column, default: str = "C") -> Column:
    plain = compound.rlike(r"^\p{L}$")
    return F.coalesce(
        split_label(compound)["label"], F.when(plain, compound), F.lit(default)
    )


def parse_tier(raw: Column) -> Column:
    t = F.upper(strip(raw))
    return F.when(t.isin(C.TIERS), t).otherwise(F.lit("C"))


def parse_scope(raw: Column) -> Column:
    """The scope of a JSON answer, else the first scope named in the text, else null."""
    parsed = F.try_parse_json(raw)
    said = F.upper(F.try_variant_get(parsed, "$.scope", "string"))
    up = F.upper(raw)
    named = F.when(F.contains(up, F.lit(C.SCOPES[0])), C.SCOPES[0])
    for s in C.SCOPES[1:]:
        named = named.when(F.contains(up, F.lit(s)), s)
    return F.when(parsed.isNotNull(), F.when(said.isin(C.SCOPES), said)).otherwise(named)


def symptom_override(scope: Column, symptom_answer: Column) -> Column:
    yes = F.coalesce(F.upper(strip(symptom_answer)).startswith("Y"), F.lit(False))
    return F.when((scope != "S0") & yes, F.lit("S0")).otherwise(scope)


def user_text(messages: Column) -> Column:
    """Content of the first user message, '' if there is none."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))
    return F.coalesce(first["content"], F.lit(""))


def completion_text(messages: Column) -> Column:
    """Content of the first message, '' for an empty list."""
    return F.coalesce(F.get(messages, F.lit(0))["content"], F.lit(""))


def chat_format(prompt: Column, system: str) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", prompt))
