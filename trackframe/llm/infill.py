"""Fill-in-middle transformation by counted quantifiers.

A unit is a word with the white space before it, or the white space at the end. `regexp_count` gives a text's number of
units, n. Two draws from a hash of the id are the cuts a <= b, and a pattern of the row's own,
`\\A((?:unit){a}+)((?:unit){b-a}+)(rest)\\z`, captures prefix, middle and suffix in one match, which `regexp_replace`
writes in the order of the row's form. The quantifiers are possessive: they are walked in a loop, so that the length of a
text costs neither stack nor backtracking. Everything is a column expression; nothing is shuffled.

Defined cases: a null or empty text has no units and stays as it is (form plain), as does a text that holds a sentinel; a
null id is hashed as no digits; rows that repeat are cut alike; an empty table gives no row; columns beyond doc_id and
text pass through (`transformed`); one that is called like a result column gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: As the contract words it; alternatives and parts exclude each other, so the possessive one matches the same.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
UNIT_ONCE = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Percent of documents that are transformed, and of those that put the suffix first.
FIM_RATE, SPM_RATE, SEED = 50, 80, 42


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_pattern(a: Column, b: Column) -> Column:
    """The pattern that captures a units, the units up to b, and the rest."""
    return F.concat(F.lit(rf"\A({UNIT_ONCE}{{"), a.cast("string"), F.lit(rf"}}+)({UNIT_ONCE}{{"), (b - a).cast("string"), F.lit(r"}+)((?s:.*+))\z"))


def checked(sentinels: dict[str, str]) -> dict[str, str]:
    """Sentinels from which a text can be told again: none empty, no end of one begins another, none inside another."""
    marks = [sentinels[k] for k in ("prefix", "suffix", "middle")]
    overlap = any(x[-n:] == y[:n] for i, x in enumerate(marks) for j, y in enumerate(marks) for n in range(1, min(len(x), len(y)) + (i != j)))
    inside = any(x in y for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j)
    if not all(marks) or overlap or inside:
        raise ValueError("sentinels must be non-empty and must not overlap")
    return sentinels


def transformed(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, sentinels: dict[str, str] | None = None) -> DataFrame:
    """docs with n, form, output, prefix_chars and middle_chars (code points; null where plain)."""
    marks = checked(sentinels or SENTINELS)
    p, s, m = marks["prefix"], marks["suffix"], marks["middle"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n", "form", "output", "prefix_chars", "middle_chars")]
    kept = docs.select(F.struct(*rest).alias("row"), base.text_of().alias("whole"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    # The count and the output are each computed once: what follows uses them many times.
    counted = kept.select("*", base.once(F.regexp_count("whole", F.lit(UNIT)).cast("long")).alias("n"))
    whole, n, h, form = F.col("whole"), F.col("n"), F.col("h"), F.col("form")
    marked = whole.contains(p) | whole.contains(s) | whole.contains(m)
    formed = counted.withColumn("form", F.when((whole == "") | marked | (h[2] % 100 >= fim_rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    literal = lambda x: re.sub(r"([$\\])", r"\\\1", x)  # noqa: E731  in a replacement
    order = F.when(form == "psm", f"{literal(p)}$1{literal(s)}$3{literal(m)}$2").otherwise(f"{literal(s)}$3{literal(p)}$1{literal(m)}$2")
    cut = F.regexp_replace(whole, cut_pattern(F.least(one, two), F.greatest(one, two)), order)
    written = formed.select("*", base.once(F.when(form == "plain", whole).otherwise(cut)).alias("output"))
    at = {k: F.locate(x, F.col("output")) for k, x in marks.items()}
    prefix = F.when(form == "psm", at["suffix"] - 1 - len(p)).when(form == "spm", at["middle"] - at["prefix"] - len(p))
    middle = F.when(form != "plain", F.char_length("output") - at["middle"] + 1 - len(m))
    return written.select("row.*", "n", "form", "output", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"))


def restored(form: Column, output: Column, sentinels: dict[str, str] | None = None) -> Column:
    """The text again, from output and form alone."""
    marks = checked(sentinels or SENTINELS)
    parts = F.split(output, "|".join(re.escape(marks[k]) for k in ("prefix", "suffix", "middle")), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256")
    )


ORACLE = {
    "op12_infill": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
             CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
""",
}
QUERIES = {"op12_infill": op12_infill}
