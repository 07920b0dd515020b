"""Quality rules as a learned decision list.

Statistics of a text are Spark expressions over its words and lines. A decision list is learned from labelled
documents by sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled rows by
information gain, pruned on the rest, and kept while it is precise there; the rows it covers are then set aside. The
list becomes one ordered conditional expression, which the scan of the corpus evaluates.

Learning sees the corpus only through counts by statistic, bin and label, a small table for every step.

Defined cases: a null text is the empty one (all statistics 0, rejected for its length); a null label or one other than
0 and 1 is not used; an id labelled twice with different labels counts for both; a null id has no label; without labels
the list is empty and only the base rules reject; an empty table gives an empty result; extra columns are not read
(`judged`) or pass through (`kept_rows`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

WINDOW = 3
#: Labelled rows that a list is fitted on at most (those with the lowest hashes of their ids).
SAMPLE = 10_000
#: Thresholds tried per statistic.
BINS = 16


def add_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `q`: the base statistics and those the rules draw on.

    `base.once` keeps the optimizer from copying word arrays and hashes into every expression that reads them. Windows
    are compared by 64-bit hashes; only texts with a repeated hash are sorted.
    """
    t = base.text_of(text)
    words, hashes, lines = F.col("q_words"), F.col("q_hashes"), F.col("q_lines")
    one = docs.withColumn("q_words", base.once(base.words_of(t)))
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    two = one.withColumn("q_hashes", base.once(windows)).withColumn(
        "q_lines", base.once(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    three = two.withColumn("q_sorted", base.once(F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("s")))))))
    four = three.withColumn("q_hit", base.once(_repeated(F.col("q_sorted"))))
    hit = F.col("q_hit")
    stats = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.array(*[_shifted(hit, k) for k in range(WINDOW)])))), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        _count(t, "!?").alias("n_marks"),
        _count(t, "0-9").alias("n_digits"),
    )
    return four.withColumn("q", base.once(stats)).drop("q_words", "q_lines", "q_hashes", "q_sorted", "q_hit")


def _count(text: Column, chars: str) -> Column:
    """Characters of a class in a text, by what is left when all others go."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeated(windows: Column) -> Column:
    """Starts of the windows, sorted by hash, that equal the one before or behind them."""
    hit = F.filter(
        windows,
        lambda x, i: F.coalesce(x["h"] == F.get(windows, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(windows, i + 1)["h"], F.lit(False)),
    )
    return F.coalesce(F.transform(hit, lambda x: x["s"]), F.array().cast("array<int>"))


def _shifted(starts: Column, by: int) -> Column:
    return F.transform(starts, lambda s: s + by)


def ratios(q: Column) -> dict[str, Column]:
    """The statistics that rules draw on, by name."""
    n = F.greatest(q["n_words"], F.lit(1))
    chars = F.greatest(q["word_chars"], F.lit(1))
    return {
        "n_words": q["n_words"].cast("double"),
        "mean_word": q["word_chars"] / n,
        "symbols_per_word": q["n_symbols"] / n,
        "marks_per_word": q["n_marks"] / n,
        "upper_share": q["n_upper"] / chars,
        "digit_share": q["n_digits"] / chars,
        "dup_line_share": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
        "repeat_share": q["n_repeat_words"] / n,
        "words_per_line": q["n_words"] / F.greatest(q["n_lines"], F.lit(1)),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


@dataclass(frozen=True)
class Condition:
    stat: str
    over: bool  # the statistic is at least the threshold, else below it
    threshold: float

    def column(self, q: Column) -> Column:
        value = ratios(q)[self.stat]
        return value >= self.threshold if self.over else value < self.threshold


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule], q: Column) -> Column:
    """The decision list as a conditional expression: the number of the first rule that holds (from 1), else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = _all(rule, q)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def _all(rule: Rule, q: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(q)
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(bad, prune, q) of at most `sample` labelled documents, written to the shared folder.

    The labels chosen are those with the lowest hashes of their ids, at most `sample` rows, so they can be broadcast.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = add_stats(rows).select((1 - F.col("quality")).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune"), "q")
    return base.saved(stats, "quality-labelled")


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches."""
    return F.size(F.filter(F.lit(cuts), lambda t: value >= t))


def learn(rows: DataFrame, bins: int = BINS, precision: float = 0.9, min_cover: float = 0.002, max_conditions: int = 4, max_rules: int = 12) -> list[Rule]:
    """Sequential covering on rows (bad, prune, q) of `labelled`.

    A rule is kept when, on the pruning rows not yet covered, at least `precision` of those it covers are bad and at
    least `min_cover` of all rows are covered.
    """
    names = list(ratios(F.col("q")))
    cuts_row = rows.agg(*[F.percentile(c, [i / bins for i in range(bins + 1)]).alias(n) for n, c in ratios(F.col("q")).items()]).first()
    cuts = {n: sorted({v for v in (cuts_row[n] or []) if v is not None and not math.isnan(v)}) for n in names}
    slot = F.array(*[_bin(c, cuts[n] or [0.0]) for n, c in ratios(F.col("q")).items()])
    binned = base.saved(rows.select("bad", "prune", slot.alias("slot"), "q"), "quality-binned")

    def counts(where: Column, prune: bool) -> dict[tuple[int, int], list[int]]:
        """(statistic, bin) -> [good, bad]; some hundred rows whatever the size of the corpus."""
        got = binned.filter(where & (F.col("prune") == prune)).select("bad", F.posexplode("slot")).groupBy("pos", "col", "bad").count().collect()
        out: dict[tuple[int, int], list[int]] = {}
        for r in got:
            out.setdefault((r.pos, r.col), [0, 0])[r.bad] += r["count"]
        return out

    def tally(rule: Rule, where: Column, prune: bool) -> tuple[int, int]:
        r = binned.filter(where & _all(rule, F.col("q")) & (F.col("prune") == prune)).agg(F.count_if(F.col("bad") == 0).alias("g"), F.count_if(F.col("bad") == 1).alias("b")).first()
        return r.g, r.b

    def grow(open_rows: Column) -> Rule:
        rule: Rule = ()
        while len(rule) < max_conditions:
            table = counts(open_rows & _all(rule, F.col("q")), False)
            g0, b0 = (sum(v[i] for (p, _), v in table.items() if p == 0) for i in (0, 1))
            if not b0 or not g0:
                return rule
            start, best = math.log2(b0 / (b0 + g0)), (1e-9, None)
            for p, n in enumerate(names):
                for k, cut in enumerate(cuts[n], 1):
                    above = [sum(v[i] for (q, b), v in table.items() if q == p and b >= k) for i in (0, 1)]
                    for over, (g, b) in ((True, above), (False, (g0 - above[0], b0 - above[1]))):
                        if b and (gain := b * (math.log2(b / (b + g)) - start)) > best[0]:
                            best = (gain, Condition(n, over, cut))
            if best[1] is None:
                return rule
            rule = (*rule, best[1])
        return rule

    def pruned(rule: Rule, open_rows: Column) -> tuple[Rule, int, int]:
        """The prefix of the rule that does best on the pruning rows."""
        found = [(rule[:k], *tally(rule[:k], open_rows, True)) for k in range(len(rule), 0, -1)]
        return max(found, key=lambda x: ((x[2] - x[1]) / max(1, x[1] + x[2]), x[1] + x[2]))

    total = binned.count()
    rules: list[Rule] = []
    open_rows = ~base_failed(F.col("q"))
    while total and len(rules) < max_rules:
        if not (rule := grow(open_rows)):
            break
        rule, g, b = pruned(rule, open_rows)
        if b < precision * (g + b) or g + b < max(3, min_cover * total / 3):
            break
        rules.append(rule)
        open_rows = open_rows & ~_all(rule, F.col("q"))
    return rules


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (number of the rule that rejects, else 0), kept. One scan, no shuffle."""
    q = F.col("q")
    out = add_stats(docs.select("doc_id", "text")).withColumn("rule", verdict(rules, q))
    return out.select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(q).alias("base_failed"), (~base_failed(q) & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that base rules and list keep, with the columns of docs."""
    own = docs.columns
    q = F.col("q")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col("text"))
    return add_stats(packed).filter(~base_failed(q) & (verdict(rules, q) == 0)).select("own.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    rules = learn(labelled(docs, base.table(spark, sf_dir, "labels")))
    return judged(docs, rules)


ORACLE: dict[str, str] = {}
QUERIES = {"op9_quality": op9_quality}
