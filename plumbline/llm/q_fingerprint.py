"""Query over the fingerprints, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import fingerprint as fp
from plumbline.llm.registry import query, table


def _words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"


_FOLD = f"translate({{}}, '{fp.UPPER}', '{fp.LOWER}')"
_NUMBER = f"(('0x' || substr(md5(term), 1, 12))::BIGINT % {1 << 39}) * {1 << fp.SUBSETS} + " + " + ".join(
    f"CASE WHEN ('0x' || substr(md5('{k}:' || term), 1, 8))::BIGINT % {2 ** (k % fp.RATES + 1)} = 0 THEN {1 << k}::BIGINT ELSE 0::BIGINT END"
    for k in range(fp.SUBSETS))


def _digest(found: str) -> str:
    codes = f"list_transform({found}, lambda t: t >> {fp.SUBSETS})"
    return f"CASE WHEN len({found}) > 0 THEN substr(md5(array_to_string({codes}, ' ')), 1, 8) ELSE '' END"


def _signatures(found: str, whole: str) -> str:
    parts = [_digest(f"list_filter({found}, lambda t: t & {1 << k} <> 0)")
             for k in range(fp.SUBSETS)]
    first = (f"CASE WHEN len({found}) > 0 THEN {_digest(found)} "
             f"ELSE 't' || substr({whole}, 1, 16) END")
    return f"[{first}, {', '.join(parts)}]"


def _likeness(a: str, b: str) -> str:
    n = fp.SUBSETS + 1
    same = f"len(list_filter(range(1, {n + 1}), lambda i: {a}[i] = {b}[i] AND {a}[i] <> ''))"
    some = f"len(list_filter(range(1, {n + 1}), lambda i: {a}[i] <> '' OR {b}[i] <> ''))"
    return f"round({same}::DOUBLE / {some}, 9)"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS rn,
    count(*) OVER () AS n FROM documents),
p AS (
  SELECT a.*, b.text AS next_text, b.rn AS next_rn FROM d a JOIN d b ON b.rn = CASE WHEN a.rn = a.n THEN 1 ELSE a.rn + 1 END),
e AS (
  SELECT *, length(text)::BIGINT AS n_chars,
    left(text, (length(text) - length(text) // 3)::BIGINT) || left(next_text, (length(text) // 3)::BIGINT) AS edited FROM p),
t AS (
  SELECT rn, {_words(_FOLD.format('text'))} AS own, {_words(_FOLD.format('edited'))} AS changed FROM e),
lex AS (
  SELECT term, {_NUMBER} AS number FROM (
    SELECT term, count(*) AS c FROM (SELECT unnest(own) AS term FROM t) GROUP BY term)
  WHERE c > {fp.LOW} * (SELECT count(*) FROM d) AND c <= greatest({fp.HIGH} * (SELECT count(*) FROM d), 2.0)),
hits AS (
  SELECT rn, 0 AS v, unnest(own) AS term FROM t UNION ALL SELECT rn, 1, unnest(changed) FROM t),
found AS (
  SELECT rn, v, list(number ORDER BY number) AS found FROM hits JOIN lex USING (term) GROUP BY rn, v),
both_ AS (
  SELECT e.*, coalesce(a.found, []) AS fa, coalesce(b.found, []) AS fb FROM e
  LEFT JOIN found a ON a.rn = e.rn AND a.v = 0 LEFT JOIN found b ON b.rn = e.rn AND b.v = 1),
s AS (
  SELECT *, {_signatures('fa', 'md5(' + _FOLD.format('text') + ')')} AS own,
    {_signatures('fb', 'md5(' + _FOLD.format('edited') + ')')} AS changed FROM both_)
SELECT s.doc_id, s.n_chars, sha256(s.edited) AS edited_sha256, array_to_string(s.own, '-') AS fingerprint,
  array_to_string(s.changed, '-') AS edited_fingerprint, {_likeness('s.own', 's.changed')} AS near_edited,
  {_likeness('s.own', 'n.own')} AS near_next
FROM s JOIN s n ON n.rn = s.next_rn
"""


@query("op2_fingerprint", SQL)
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fp.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})
