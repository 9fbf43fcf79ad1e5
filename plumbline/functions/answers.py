"""Raw judge and model answers: sanitising, JSON repair, JSON extraction, typing.

Everything is an expression over one text column. A parsed object is a
MAP<STRING, STRING>; typing happens afterwards with try_cast, so one malformed
answer never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import config as C
from plumbline.functions.text import clamp, let, quote, strip

STRATEGIES = ["json_fence", "any_fence", "object", "array", "whole", "salvage"]


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def _first_group(text: Column, pattern: str) -> Column:
    """First capture of the first match, null without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def _odd_quotes(text: Column) -> Column:
    # bytes, as a quote is one: they are known, characters have to be counted
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def _from_first(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def _between(text: Column, opening: str, closing: str) -> Column:
    """First opening to last closing mark, null if they do not enclose anything."""
    start = F.locate(opening, text)
    end = F.length(text) - F.length(F.substring_index(text, closing, -1))
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


# --- model answers ------------------------------------------------------------


def sanitize(raw: Column) -> Column:
    """Text that is safe to embed in a judge prompt."""
    s = F.coalesce(raw, F.lit(""))
    table = F.contains(s, F.lit("\\begin{tabular}"))
    s = F.when(table, _sub(_sub(s, r"\\begin\{tabular\}.*?\\hline", ""), r"\\end\{tabular\}", "")).otherwise(s)
    s = _sub(s, r"\\[a-zA-Z]+(\{.*?\})?", "")
    s = _sub(s, r"[\n\t\r\x08\f]", " ")
    s = _sub(s, r"(?U)(?<!\\)\{(?!\s*[\"'a-zA-Z0-9_]+\s*:)", "(")
    s = _sub(s, r"(?U)(?<!\\)\}(?!\s*,?\s*[\"'a-zA-Z0-9_]+\s*:)", ")")
    s = _sub(s, r"[\x00-\x1F\x7F]", "")
    return F.trim(_sub(s, r"(?U)\s+", " "))


def invalid_reason(sanitized: Column, raw: Column) -> Column:
    return (
        F.when(F.length(sanitized) < 10, "too_short")
        .when(sanitized.rlike(r"^[\s\\{}\[\]]*$"), "only_formatting")
        .when(F.length(sanitized) < F.length(raw) * 0.3, "lost_content")
    )


def fallback_response(raw: Column, reason: Column) -> Column:
    """Plain words of a long enough raw text, else a placeholder with the reason."""
    plain = F.trim(_sub(_sub(raw, r"(?U)[^\p{L}\p{N}_\s.,?!]", " "), r"(?U)\s+", " "))
    message = reason
    for code, text in C.INVALID_MESSAGES.items():
        message = F.when(reason == code, text).otherwise(message)
    return F.when((F.length(raw) > 20) & (F.length(plain) > 20), plain).otherwise(
        F.format_string("[Invalid response that could not be processed. Error: %s]", message)
    )


def has_control_chars(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{C}&&[^\t\n\r]]"), F.lit(False))


# --- JSON repair ----------------------------------------------------------------


def _close_dangling(s: Column) -> Column:
    tail = strip(F.substring_index(s, ":", -1))
    dangling = F.contains(s, F.lit(":")) & _odd_quotes(s) & tail.startswith('"') & ~tail.endswith('"')
    return F.when(dangling, F.concat(s, F.lit('"'))).otherwise(s)


def repair_basic(text: Column) -> Column:
    def words(s: Column) -> Column:
        said = _sub(_sub(s, r"(?i):\s*yes\s*([,}])", ": true$1"), r"(?i):\s*no\s*([,}])", ": false$1")
        return F.when(s.rlike(r"(?i):\s*(?:yes|no)\s*[,}]"), said).otherwise(s)

    def escapes(s: Column) -> Column:
        return F.when(F.contains(s, F.lit("\\")), _sub(s, r"\\([^\"\\/bfnrtu])", "$1")).otherwise(s)

    s = let(let(_sub(text, r"[\x00-\x1f\x7f-\x9f]", ""), words), escapes)
    return let(strip(_sub(s, r",\s*([}\]])", "$1")), _close_dangling)


def repair_spaces(text: Column) -> Column:
    s = _sub(text, r"[\p{C}&&[^\t\n\r]]", " ")
    s = _sub(s, r"(?U)\s+", " ")
    s = _sub(s, r"(?i):\s*yes\s*,", ": true,")
    s = _sub(s, r"(?i):\s*no\s*,", ": false,")
    s = _sub(s, r"(?i):\s*yes\s*\}", ": true}")
    s = _sub(s, r"(?i):\s*no\s*\}", ": false}")
    s = _sub(s, r"\\([|_\-+=()\[\]])", "$1")
    s = _sub(s, r",\s*([}\]])", "$1")
    s = _sub(_sub(s, "[“”]", '"'), "[‘’]", "'")
    return F.trim(s)


def is_truncated(text: Column) -> Column:
    s = strip(text)
    return (
        text.isNull() | (text == "") | (F.length(s) < 50)
        | s.rlike(r':\s*$|:\s*"[^"]*$|[,{]\s*$|"[^"]*$')
    )


def _close_line(line: Column) -> Column:
    s = strip(line)
    complete = (s == "") | s.rlike(r'[}",]$')
    after_colon = F.length(F.substring_index(s, ":", -1)) < F.length(F.substring_index(s, '"', -1))
    quoted = F.contains(s, F.lit(":")) & F.contains(s, F.lit('"'))
    return (
        F.when(complete, line)
        .when(quoted & (after_colon | _odd_quotes(s)), F.concat(s, F.lit('"')))
        .otherwise(s)
    )


def _close_object(text: Column) -> Column:
    trimmed = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed.endswith("}"), text).otherwise(F.concat(trimmed, F.lit("\n}")))


def close_truncated(text: Column) -> Column:
    """Close the string on the last line and the object, where they are open."""

    def close(t: Column) -> Column:
        last = F.substring_index(t, "\n", -1)
        head = F.substring(t, F.lit(1), F.length(t) - F.length(last))
        return let(F.concat(head, let(last, _close_line)), _close_object)

    return let(text, close)


# --- JSON extraction ------------------------------------------------------------


def parse_exact(text: Column) -> Column:
    """VARIANT of a text that is one JSON object or array and nothing else."""
    boxed = F.when(
        text.rlike(r"^\s*[\[{]"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    )
    return let(
        boxed,
        lambda b: F.when(
            F.try_variant_get(b, "$[1]", "variant").isNull(), F.try_variant_get(b, "$[0]", "variant")
        ),
    )


def _parse_repaired(candidate: Column, repair) -> Column:
    """The parsed candidate, raw first, then repaired; one that the repair leaves as it is is parsed once."""

    def repaired(c: Column) -> Column:
        return let(repair(c), lambda r: F.when(r != c, parse_exact(r)))

    return let(candidate, lambda c: F.when(c.isNotNull(), F.coalesce(parse_exact(c), repaired(c))))


def _attempt(name: str, candidate: Column) -> Column:
    return let(
        _parse_repaired(candidate, repair_basic),
        lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("strategy"), v.alias("value"))),
    )


def salvage_pairs(text: Column) -> Column:
    """MAP of key/value pairs found one by one; the first value of a key wins."""
    return let(_from_first(text, "{"), lambda body: F.when(F.contains(body, F.lit('":')), _salvaged(body)))


def _salvaged(body: Column) -> Column:
    def pairs(value_pattern: str, convert) -> Column:
        found = F.regexp_extract_all(body, F.lit(r'(?i)"[^"]+":\s*' + value_pattern), F.lit(0))

        def entry(m: Column) -> Column:
            key = F.substring_index(F.substring(m, 2, 2**31 - 1), '":', 1)  # a key holds no quote
            value = F.regexp_extract(m, r'(?is)^"[^"]+":\s*' + value_pattern, 1)
            return F.struct(key.alias("key"), convert(value).cast("string").alias("value"))

        return F.transform(found, entry)

    def yes_no(v: Column) -> Column:
        low = F.lower(v)
        return F.when(low == "yes", "true").when(low == "no", "false").otherwise(v)

    entries = F.concat(
        pairs(r'"([^"]*)"', yes_no),
        pairs(r"(\d+\.?\d*)", lambda v: v),
        pairs(r"(true|false)", F.lower),
        pairs(r"(null)", lambda v: F.lit(None)),
    )
    return let(entries, _first_wins)


def _first_wins(entries: Column) -> Column:
    def firsts(keys: Column) -> Column:
        return F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)

    first = let(F.transform(entries, lambda e: e["key"]), firsts)
    return F.when(F.size(entries) > 0, F.map_from_entries(first))


def extract_json(raw: Column) -> Column:
    """struct(strategy, value VARIANT) of the first strategy that parses."""
    fenced = F.when(F.contains(raw, F.lit("```")), raw)  # most answers have none, and need no search
    any_fence = strip(_first_group(fenced, r"(?is)```(?:json)?\s*(.*?)\s*```"))
    candidates = {
        "json_fence": strip(_first_group(fenced, r"(?is)```json\s*(.*?)\s*```")),
        "any_fence": let(any_fence, lambda t: F.when(t.rlike(r"^[\[{]"), t)),
        "object": let(_between(raw, "{", "}"), lambda t: F.coalesce(t, close_truncated(_from_first(raw, "{")))),
        "array": _between(raw, "[", "]"),
        "whole": raw,
    }
    return F.coalesce(*[_attempt(n, c) for n, c in candidates.items()])


def extract_object(raw: Column) -> Column:
    """struct(strategy, fields MAP<STRING,STRING>) of one judge answer.

    A parsed value that is no object yields no fields: the answer then counts
    as a parse failure, as it does for an object without the needed keys.
    """
    parsed = let(
        extract_json(raw),
        lambda found: F.when(
            found.isNotNull(),
            F.struct(
                found["strategy"].alias("strategy"),
                found["value"].try_cast("map<string,string>").alias("fields"),
            ),
        ),
    )
    saved = let(
        salvage_pairs(raw),
        lambda m: F.when(m.isNotNull(), F.struct(F.lit("salvage").alias("strategy"), m.alias("fields"))),
    )
    return F.coalesce(parsed, saved)


def extract_array(raw: Column) -> Column:
    """ARRAY<VARIANT> of an answer for several items.

    Looks at the outermost bracket first, so that a list of one object stays a
    list.
    """
    fence = strip(_first_group(raw, r"(?is)```(?:json)?\s*(.*?)\s*```"))
    bare = _between(raw, "[", "]")
    value = F.coalesce(*[_parse_repaired(c, repair_spaces) for c in (fence, bare)])
    return value.try_cast("array<variant>")


def string_list(raw: Column) -> Column:
    """Strings of a JSON list; other items are dropped, other values give []."""
    items = parse_exact(raw).try_cast("array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>")
    )


def chat_string_list(raw: Column, aggressive: bool = False) -> Column:
    """Non-blank strings of the JSON list inside a chat answer, null if there is none."""
    answer = raw
    for mark in C.LIST_MARKERS:
        answer = F.substring_index(answer, mark, -1)
    # each phrase is optional, in this order from the start and from the end
    prefixes = "".join(f"(?:{quote(p)}\\s*)?" for p in C.LIST_PREFIXES)
    suffixes = "".join(f"(?:\\s*{quote(p)})?" for p in reversed(C.LIST_SUFFIXES))

    def extract(plain: Column) -> Column:
        body = _sub(_sub(plain, "(?i)^" + prefixes, ""), f"(?i){suffixes}$", "")
        mended = F.replace(_between(plain, "[", "]"), F.lit("'"), F.lit('"'))
        mended = _sub(_sub(mended, r'"\s*"', '", "'), r",\s*\]", "]")
        precise = _first_group(body, r'(?s)(\[\s*".*?"\s*(?:,\s*".*?"\s*)*\])')
        bracket = _first_group(plain, r"(\[[\s\S]*?\])")
        fence = strip(_first_group(plain, r"```(?:json)?\s*([\s\S]*?)```"))
        order = [mended, precise, bracket, fence] if aggressive else [precise, bracket, fence, mended]
        return F.coalesce(*[let(c, parse_exact) for c in order])

    items = let(strip(answer), extract).try_cast("array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.filter(
        F.transform(texts, lambda v: F.variant_get(v, "$", "string")), lambda t: strip(t) != ""
    )


# --- typed judge answers ----------------------------------------------------------


def fix_keys(fields: Column, axis: str, fixes: list[tuple[str, str]] | None = None) -> Column:
    """Give near-miss keys their right name where the right one is absent.

    Of several near misses for one key the first listed one is renamed.
    """
    fixes = fixes or C.KEY_FIXES[axis]

    def renamed(key: Column) -> Column:
        expr = F
        for i, (wrong, right) in enumerate(fixes):
            taken = [right] + [w for w, r in fixes[:i] if r == right]
            free = F.lit(True)
            for name in taken:
                free = free & ~F.map_contains_key(fields, name)
            expr = expr.when((key == wrong) & free, right)
        return expr.otherwise(key)

    return F.transform_keys(fields, lambda k, v: renamed(k))


def missing_keys(fields: Column, axis: str) -> Column:
    required = F.array(*[F.lit(k) for k in C.REQUIRED_KEYS[axis]])
    return F.array_except(required, F.coalesce(F.map_keys(fields), F.array().cast("array<string>")))


def coerce_score(value: Column) -> Column:
    v = value.try_cast("double")
    return clamp(F.when(v > 1, v / 10).otherwise(v))


def coerce_bool(value: Column) -> Column:
    return F.lower(value).isin("yes", "true", "1")


def coerce_enum(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def _typed(fields: Column, key: str, default) -> Column:
    value = fields[key]
    if isinstance(default, bool):
        return coerce_bool(value)
    if isinstance(default, float):
        return coerce_score(value)
    if key == "referral_strength":
        return coerce_enum(value, list(C.REFERRAL_LEVELS), "none")
    if key == "response_scope":
        return coerce_enum(value, C.SCOPES, "S0")
    if key == "scope_risk":
        return coerce_enum(value, C.SCOPE_RISKS, "high")
    # severity: an unknown value is harmless on the safety axis, major on the domain axis
    return coerce_enum(value, list(C.SEVERITY_LEVELS), default)


def typed_answer(fields: Column, axis: str) -> Column:
    """Typed struct of one axis; neutral defaults if a needed value is unusable."""
    defaults = C.PARSE_DEFAULTS[axis]
    optional = {"referral_strength", "severity"} if axis == "ahimsa" else set()
    usable = fields.isNotNull()
    for key, default in defaults.items():
        if isinstance(default, float):
            usable = usable & fields[key].try_cast("double").isNotNull()
        elif key not in optional:
            usable = usable & F.coalesce(F.map_contains_key(fields, key), F.lit(False))
    values = [
        F.when(usable, _typed(fields, k, d)).otherwise(F.lit(d)).alias(k) for k, d in defaults.items()
    ]
    return F.struct(*values, usable.alias("usable"))


def ensure_reasoning(reasoning: Column, requested: bool = False) -> Column:
    return F.coalesce(reasoning, F.lit(C.REASONING_MISSING if requested else C.REASONING_DISABLED))
