"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: what every match must contain, as an AND of ORs of trigram
sets. The index is a table of postings (trigram, text), stored by trigram: a query reads the lists of its own trigrams
and no others. Lists are intersected by counting: a text is in the intersection of a set's lists if it is in all of
them. Only texts that a rule's query lets through are verified with its regex. A rule whose regex has no mandatory
trigram is matched against every text. The index holds the trigrams that some rule has asked for, in lower case. It can
be kept at a path: a later rule set reads the lists that are there, and only trigrams that no earlier one has asked for
are looked up in the texts and added.

A text is known in the index by the digest of its id and content.

Defined cases: a null text is the empty one; null ids and repeated rows get results like any other row; matches that
fail a rule's check are dropped without a retry; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Characters that this group of a match must have at least.
    group: int = 0
    least: int = 1


#: Fixed patterns, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more, which are the runs of one and more that are long enough.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public formats of keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Files of one list at most, and matches of a text folded at once.
SPREAD = 32
CHUNK = 256
#: AND of ORs of trigram sets.
Query = tuple[frozenset[frozenset[str]], ...]


def trigram_query(regex: str, most: int = 64) -> Query:
    """The trigram query of a regex; empty if nothing is mandatory.

    Strings that a stretch of the regex can match are listed while there are at most `most` of them; wherever that
    ends, each listed string of three and more characters gives the set of its trigrams, and one of the sets must occur.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            clauses.append(frozenset(sets))

    def listed(items) -> set[str] | None:
        """All strings of a sequence, in lower case, or None."""
        out = {""}
        for op, arg in items:
            one = listed_one(str(op), arg)
            if one is None:
                return None
            out = {a + b for a in out for b in one}
            if len(out) > most:
                return None
        return out

    def listed_one(op: str, arg) -> set[str] | None:
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            found = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], min(a[1], a[0] + most) + 1))}
            return found if len(found) <= 8 else None
        if op == "SUBPATTERN":
            return listed(arg[3])
        if op == "BRANCH":
            ways = [listed(x) for x in arg[1]]
            return None if any(w is None for w in ways) else set().union(*ways)
        if op == "MAX_REPEAT" and (arg[0], arg[1]) in ((0, 1), (1, 1)):
            one = listed(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            one = listed_one(str(op), arg)
            if one is not None and len(run) * len(one) <= most:
                run = {a + b for a in run for b in one}
                continue
            flush(run)
            run = {""} if one is None else one
            if one is None and str(op) == "SUBPATTERN":
                walk(arg[3])
            elif one is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                walk(arg[2])
        flush(run)

    walk(re._parser.parse(regex))  # noqa: SLF001
    return tuple(dict.fromkeys(clauses))


def text_key() -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), base.text_of()).cast("binary")))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, text_key) for these trigrams, each pair once per row. texts: text_key, text."""
    lower = texts.select("text_key", base.once(F.lower("text")).alias("lower"))
    # Each of a text's trigrams once, before anything moves.
    return lower.select("text_key", F.explode(F.filter(F.lit(sorted(trigrams)), lambda t: F.contains(F.col("lower"), t))).alias("trigram"))


def write_index(texts: DataFrame, trigrams: list[str], path: str) -> list[str]:
    """The inverted index at path, a folder per trigram; a long list is in several files, as its texts hash. Returns the trigrams that were added.

    Lists that the index has already are not made again, and if none is missing the texts are not read. Which lists it
    has is noted after they are written: a job that is lost in between writes them once more, and a text that stands in
    a list twice counts once. The texts have to be those that the index was made of.
    """
    spark = texts.sparkSession
    missing = sorted(set(trigrams) - set(indexed_trigrams(spark, path)))
    if missing:
        hexed = F.hex("trigram").alias("list")
        spread = F.pmod(F.xxhash64("text_key"), F.lit(SPREAD))
        postings(texts, missing).select("text_key", hexed).repartition("list", spread).write.mode("append").partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(t,) for t in missing], "trigram string").coalesce(1).write.mode("append").parquet(f"{path}/trigrams")
    return missing


def indexed_trigrams(spark: SparkSession, path: str) -> list[str]:
    """The trigrams whose lists are in the index at path, also those that no text has; none where there is no index."""
    if not base.exists(spark, f"{path}/trigrams"):
        return []
    # As many as the rules have asked for.
    return [r.trigram for r in spark.read.schema("trigram string").parquet(f"{path}/trigrams").distinct().collect()]


def read_lists(spark: SparkSession, path: str, trigrams: list[str]) -> DataFrame:
    """(list, text_key): the lists of these trigrams; the others are not opened."""
    stored = spark.read.schema("text_key binary, list string").parquet(f"{path}/lists")
    return stored.filter(F.col("list").isin([_list_of(t) for t in trigrams]))


def _list_of(trigram: str) -> str:
    return trigram.encode().hex().upper()


def candidates(spark: SparkSession, path: str, queries: dict[str, Query]) -> DataFrame:
    """text_key and, per rule, whether the lists satisfy its query; only texts that satisfy one."""
    sets = sorted({s for q in queries.values() for clause in q for s in clause}, key=sorted)
    asked = sorted({t for s in sets for t in s})
    # By trigram, the sets that it belongs to: as many as the rules have, so it is a literal.
    of = F.create_map(*[x for t in asked for x in (F.lit(_list_of(t)), F.lit([n for n, s in enumerate(sets) if t in s]))])
    sizes = F.lit([len(s) for s in sets])
    met = read_lists(spark, path, asked).distinct().select("text_key", F.explode(F.element_at(of, F.col("list"))).alias("set_no"))
    whole = met.groupBy("text_key", "set_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.get(sizes, F.col("set_no")))
    per_text = whole.groupBy("text_key").agg(F.collect_list("set_no").alias("sets"))

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            out = out & F.arrays_overlap("sets", F.lit([n for n, s in enumerate(sets) if s in clause]))
        return out

    flags = per_text.select("text_key", *[holds(q).alias(kind) for kind, q in queries.items()])
    return flags.filter(" OR ".join(f"`{k}`" for k in queries))


def _matches(text: Column, rule: Rule) -> tuple[Column, Column]:
    """(start, end) of every match and the pieces between: lengths of what split leaves and of what it takes."""
    pieces = F.transform(F.split(text, rule.regex, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    return pieces, F.arrays_zip(F.transform(whole, F.length).alias("n"), F.transform(checked, F.length).alias("c"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of a rule's matches in code points, checked ones only."""
    pieces, found = _matches(text, rule)
    steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(p.alias("p"), m["n"].alias("n"), m["c"].alias("c")))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def step(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["p"], a["at"] + x["p"] + x["n"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["c"] >= rule.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    def chunk(a: Column, first: Column) -> Column:
        """Matches are folded in chunks, so that what is appended to stays short."""
        done = F.aggregate(F.slice(steps, first, F.lit(CHUNK)), F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    lists = F.array().cast("array<array<struct<start:int,number:int,end:int>>>")
    firsts = F.filter(F.sequence(F.lit(1), F.size(found) + 1, F.lit(CHUNK)), lambda i: i <= F.size(found))
    folded = F.aggregate(firsts, F.struct(F.lit(0).alias("at"), lists.alias("out")), chunk, lambda a: F.flatten(a["out"]))
    return F.when(F.regexp_like(text, F.lit(rule.regex)), folded).otherwise(none)


def scan(docs: DataFrame, rules: tuple = BASE_RULES + MORE_RULES, index_path: str | None = None) -> DataFrame:
    """doc_id and `spans`, an array of (start, number, end) sorted by start, then rule; one row per row of docs.

    index_path: where the index of these rows is kept for later rule sets; without it, it goes with the application.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_key().alias("text_key"), base.text_of().alias("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = [(i, r) for i, r in enumerate(rules) if queries[r.kind]]
    full = [(i, r) for i, r in enumerate(rules) if not queries[r.kind]]
    asked = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    scanned = texts.select("doc_id", "text_key", F.concat(none, *[spans_of(F.col("text"), r, i) for i, r in full]).alias("full"))
    if not indexed:
        return scanned.select("doc_id", F.sort_array("full").alias("spans"))
    path = index_path or base.scratch(spark, "trigram-index")
    write_index(texts, asked, path)
    some = base.saved(candidates(spark, path, {r.kind: queries[r.kind] for _, r in indexed}), "secret-candidates")
    n = some.count()
    # The keys of candidate texts are broadcast while they are few; otherwise texts and keys are shuffled.
    hits = base.semi(texts.select("text_key", "text"), some.select("text_key"), ["text_key"], n).dropDuplicates(["text_key"])
    flagged = hits.join(some.hint("merge"), "text_key")
    verified = base.saved(
        flagged.select("text_key", F.concat(none, *[F.when(F.col(f"`{r.kind}`"), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in indexed]).alias("more"))
        .filter(F.size("more") > 0),
        "secret-verified",
    )
    return scanned.join(verified.hint("merge"), "text_key", "left").select(
        "doc_id", F.sort_array(F.concat("full", F.coalesce("more", none))).alias("spans")
    )


def _listed(spans: Column, kinds: list[str]) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(kinds), s["number"]), s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE_RULES + MORE_RULES
    kinds = [r.kind for r in rules]
    found = scan(base.table(spark, sf_dir, "documents"), rules)
    own = F.filter("spans", lambda s: s["number"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(_listed(own, kinds).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans"), kinds).alias("spans"),
    )


def _is(number: int):
    return lambda s: s["number"] == number


ORACLE: dict[str, str] = {}
QUERIES = {"op4_secrets": op4_secrets}
