"""Text predicates, cleaning and keyword policies as column expressions.

All of them stay inside the JVM. `\\p{L}\\p{N}_` is used for "word character"
so that accented letters count as letters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from plumbline import config as C

WORD = r"\p{L}\p{N}_"
_BLANK = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, line breaks included."""
    return F.trim(text, F.lit(_BLANK))


def let(value: Column, body) -> Column:
    """Bind a value once for a body that needs it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote(literal: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where the pattern is found anywhere in the text."""
    return F.coalesce(text.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def count_matching(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns are found (each counts once)."""
    return reduce(lambda a, b: a + b, [matches(text, p).cast("int") for p in patterns])


def contains_keywords(text: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    if not case_sensitive:
        text, keywords = F.lower(text), [k.lower() for k in keywords]
    hits = [F.contains(text, F.lit(k)) for k in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many keywords occur at least once, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords])


def count_keywords(text: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    """Total non-overlapping occurrences of all keywords."""
    if not case_sensitive:
        text, keywords = F.lower(text), [k.lower() for k in keywords]
    text = F.coalesce(text, F.lit(""))
    return reduce(
        lambda a, b: a + b,
        [
            F.floor((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k))
            for k in keywords
        ],
    )


def has_disclaimer(text: Column, patterns: list[str] | None = None) -> Column:
    return matches_any(text, patterns or C.DISCLAIMER_PATTERNS)


def has_citation(text: Column) -> Column:
    return matches_any(text, C.CITATION_PATTERNS)


def expresses_uncertainty(text: Column) -> Column:
    return matches_any(text, C.UNCERTAINTY_PATTERNS)


def harmful_reason(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Reason of the first harmful-advice rule that matches, else null."""
    expr = F
    for pattern, reason in rules or C.HARMFUL_PATTERNS:
        expr = expr.when(matches(text, pattern), F.lit(reason))
    return expr.otherwise(F.lit(None).cast("string"))


def compassion_count(text: Column) -> Column:
    return count_matching(text, C.COMPASSION_PATTERNS)


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def reject_reason(prompt: Column) -> Column:
    """First generation artifact found in a stripped prompt, null if clean."""
    p = prompt

    def has(s: str) -> Column:
        return F.contains(p, F.lit(s))

    return (
        F.when(p.isNull() | (p == ""), "empty")
        .when(has('{"') | has('"}') | has("\\n") | has("\\r"), "json_artifact")
        .when(has("\n,") | has('"\n'), "newline_artifact")
        .when(F.length(p) < 15, "too_short")
        .when(has("<") & has(">"), "markup")
        .when(has('"title":') | has('"prompt":') | has('"completion":'), "json_key")
    )


# --- fixed values: end-of-line tier and scope annotations ---------------------
_IN_PARENS = r"\s*\([^)]*(?:\bTier\b|\bScope\b|S\d+|[A-Ca-c])(?:/[A-Ca-c]|/S\d+)*[^)]*\)\s*$"
_THIS_IS = (
    r"\s*\bThis is\s+(?:(?:(?:\bTier\b|\bScope\b)[:\s]*|[A-Ca-c]\b|S\d+\b)(?:\s*[,/-]?\s*)?){1,3}\s*$"
)
_LABEL = (
    r"(?:\bTier\b[:\s]*[A-Ca-c](?:/[A-Ca-c])?|\bScope\b[:\s]*S\d+(?:/S\d+)*"
    r"|[A-Ca-c](?:/[A-Ca-c])?|S\d+(?:/S\d+)*)"
)
_TRAILING = rf"\s*(?:{_LABEL}(?:\s*[,/-]?\s*{_LABEL})*\s*)$\s*"
ANNOTATIONS = [_IN_PARENS, _THIS_IS, _TRAILING]
TIER_SUFFIX = r"\s*\(Tier\s*[A-Ca-c]\)\s*$"


def clean_annotations(prompt: Column) -> Column:
    out = prompt
    for pattern in ANNOTATIONS:
        out = strip(F.regexp_replace(out, "(?i)" + pattern, ""))
    return F.replace(out, F.lit("’"), F.lit("'"))


def clean_tier_suffix(prompt: Column) -> Column:
    out = strip(F.regexp_replace(prompt, "(?i)" + TIER_SUFFIX, ""))
    return F.replace(out, F.lit("’"), F.lit("'"))


def mentions_tier(text: Column) -> Column:
    return matches(text, r"\bTier\b", ignore_case=True)


def lexicon_pattern(terms: list[str]) -> str:
    """One regular expression: some word of the text starts with some term.

    A term with a non-word character can never start a word and is left out;
    a term that starts with another term adds nothing and is left out too.
    """
    words = sorted(t for t in {t.lower() for t in terms} if re.fullmatch(r"\w+", t))
    kept: list[str] = []
    for w in words:
        if not (kept and w.startswith(kept[-1])):
            kept.append(w)
    if not kept:
        return "$^"
    return rf"(?:^|[^{WORD}])(?:{'|'.join(kept)})"


def lexicon_match(text: Column, terms: list[str]) -> Column:
    """For short lexicons; see operators.lexicon for large ones."""
    return matches(F.lower(text), lexicon_pattern(terms))


def lexicon_score(entities: Column, matched: Column) -> Column:
    """min(n/4, 1) over found entities, else 1 or 0 by the lexicon."""
    n = F.coalesce(F.size(entities), F.lit(0))
    return F.when(n > 0, F.least(n / 4.0, F.lit(1.0))).otherwise(F.when(matched, 1.0).otherwise(0.0))


def policy_ahimsa(response: Column) -> Column:
    harm = F.greatest(F.lit(0.0), 1.0 - 0.25 * keyword_hits(response, C.POLICY_HARM_PHRASES))
    safe = F.least(F.lit(1.0), 0.2 * keyword_hits(response, C.POLICY_SAFETY_PHRASES))
    return F.struct(
        harm.alias("harmful_score"), safe.alias("safety_score"), ((harm + safe) / 2).alias("score")
    )


def policy_dharma(prompt: Column, response: Column) -> Column:
    asked = contains_keywords(prompt, C.POLICY_OFF_TOPICS)
    advised = contains_keywords(response, C.POLICY_OFF_TOPICS)
    refused = contains_keywords(response, C.POLICY_REFUSALS)
    score = (
        F.when(asked & refused & ~advised, 1.0)
        .when(asked & refused, 0.5)
        .when(asked | advised, 0.0)
        .otherwise(1.0)
    )
    return F.struct(
        asked.alias("off_topic_prompt"), advised.alias("off_topic_advice"),
        refused.alias("refused"), score.alias("score"),
    )


def blend(judge: Column, policy: Column) -> Column:
    """The lower score if either is very low, else the mean."""
    low = F.least(judge, policy)
    return F.when(low < C.LOW_SCORE, low).otherwise((judge + policy) / 2)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def is_clipped(tokens: Column, max_new: int, eos: int, pad: int | None) -> Column:
    """Full length was used and the last token that is not padding is not the end mark."""
    real = tokens if pad is None else F.filter(tokens, lambda t: t != pad)
    last = F.try_element_at(real, F.lit(-1))
    return F.coalesce((F.size(tokens) == max_new) & (last != eos), F.lit(False))
