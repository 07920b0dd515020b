"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a window of words and ignores the others, so that a window with substituted words still
hashes alike under some mask. Hashes of benchmark windows meet those of training windows; around every hit, text and
item are laid side by side at the hit's offset. The verified overlap is the whole item where SIMILAR of its words are
equal, or a stretch of OVERLAP words at least of which four in five are: the best-scoring one (+1 for an equal word, -4
for another) if it is long enough, the longest otherwise.

Whatever is verified has a hit, at any places of substitutions. An item of n words is cut into one group of two or three
adjacent words more than words may differ, so one group at least is whole. A stretch of 13 words or more, four in five of
them equal, has four equal words in a row, or else is three, one other, three, and so on (15 words): MASKS has both.

Words are runs of letters and digits in lower case. Test hashes go to the tasks in blocks of a fixed number of words
(equal items once), one pass over the texts for each block; the driver holds one block at a time, and a block's result is
written before the next is made. So what is sent is bounded, and the number of passes grows with the benchmark.

Defined cases: null and empty texts and items overlap with nothing; an item shorter than `min_words` overlaps with texts
of just its words alone; null and repeated ids are reported as they are, each; empty tables give an empty result; extra
columns are not read (`overlaps`) or pass through (`clean_rows`).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

WORD = re.compile(r"[^\W_]+")
#: For stretches of OVERLAP words and more.
MASKS = ("1111", "1110111")
#: Words of an overlap at least, or all of a shorter item's.
OVERLAP = 13
MIN_WORDS = 6
#: Or this share of an item's words equal at one offset.
SIMILAR = 0.6
#: Benchmark words in a block at most (an item is never cut).
BLOCK_WORDS = 500_000
#: Words laid side by side at once, so that memory does not follow the number of hits.
PIECE = 1 << 20
#: Letters and digits, as Spark counts them.
LETTERS = r"[\p{L}\p{N}]+"
FOUND = "doc_id long, text_key string, item_key string, overlap_words long, equal_words long, item_words long, start_word long"


class Seeds:
    """Hashes of a block of items, and the matching of texts against them."""

    def __init__(self, items: list[tuple], overlap: int = OVERLAP, masks: tuple = MASKS, min_words: int = MIN_WORDS):
        """items: (name, words)."""
        import numpy as np

        #: Short items by their words: they are compared as a whole.
        self.min_words = min_words
        self.short: dict[tuple, list] = {}
        for i, ws in items:
            if 0 < len(ws) < min_words:
                self.short.setdefault(tuple(ws), []).append(i)
        items = [(i, ws) for i, ws in items if len(ws) >= min_words]
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        number = lambda w: self.number.setdefault(w, len(self.number) + 1)
        self.items = [np.asarray([number(w) for w in ws], dtype=np.int64) for _, ws in items]
        self.sizes = np.asarray([len(x) for x in self.items], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*self.items, np.empty(0, np.int64)])
        #: Words that have to be equal in the whole item, and in a stretch.
        self.least = np.ceil(SIMILAR * self.sizes - 1e-9).astype(np.int64)
        self.stretch = np.minimum(overlap, self.sizes)
        places: dict[str, list] = {"11": [], "111": [], **{m: [] for m in masks}}
        for k, n in enumerate(self.sizes.tolist()):
            groups = n - int(self.least[k]) + 1
            longer = n - 2 * groups
            at = np.arange(0, 2 * groups, 2) + np.minimum(np.arange(groups), longer)
            places["111"].append((k, at[: min(longer, groups)]))
            places["11"].append((k, at[max(0, longer) :]))
            for m in masks:
                # Shorter items have no stretch but the whole.
                places[m].append((k, np.arange(n - len(m) + 1 if n >= overlap else 0)))
        self.tables: list[tuple] = []
        for mask, some in places.items():
            keep = np.flatnonzero(np.frombuffer(mask.encode(), dtype="u1") == ord("1"))
            owner = np.concatenate([*(np.full(len(at), k) for k, at in some), np.empty(0, np.int64)]).astype(np.int64)
            at = np.concatenate([*(at for _, at in some), np.empty(0, np.int64)]).astype(np.int64)
            if len(at):
                h = self._hash(self.flat, keep, self.begins[owner] + at)
                order = np.argsort(h, kind="stable")
                self.tables.append((keep, len(mask), h[order], owner[order], at[order]))

    @staticmethod
    def _hash(x, places, starts):
        import numpy as np

        h = np.full(len(starts), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for p in places:
            h = (h ^ x[starts + p].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h

    def hits(self, words: list[str]):
        """(item, offset of the item in the text), each once, with enough equal words for an overlap."""
        import numpy as np

        x = np.fromiter((self.number.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        known, found, n_found, good = x > 0, [], 0, []
        for places, span, hashes, owner, at in self.tables:
            n = len(x) - span + 1
            if n <= 0:
                continue
            starts = np.flatnonzero(np.logical_and.reduce([known[p : n + p] for p in places]))
            if not len(starts):
                continue
            h = self._hash(x, places, starts)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            many = hi - lo
            for part in np.split(np.arange(len(starts)), np.searchsorted(np.cumsum(many), np.arange(PIECE, many.sum(), PIECE))):
                m = many[part]
                of = np.repeat(lo[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
                found.append(np.unique((owner[of] << 32) + (np.repeat(starts[part], m) - at[of] + (1 << 31))))
                n_found += len(found[-1])
                if n_found >= PIECE:
                    good.append(self._enough(x, np.unique(np.concatenate(found))))
                    found, n_found = [], 0
        if n_found:
            good.append(self._enough(x, np.unique(np.concatenate(found))))
        packed = np.unique(np.concatenate([*good, np.empty(0, np.int64)]))
        return x, list(zip((packed >> 32).tolist(), ((packed & ((1 << 32) - 1)) - (1 << 31)).tolist(), strict=True))

    def _enough(self, x, packed):
        """Those of (item, offset), packed in one number, that have enough equal words for an overlap."""
        import numpy as np

        item, offset = packed >> 32, (packed & ((1 << 32) - 1)) - (1 << 31)
        lo, hi = np.maximum(0, -offset), np.minimum(self.sizes[item], len(x) - offset)
        # Four in five of a stretch, or the whole item's share.
        need = np.minimum(self.least[item], np.ceil(0.8 * self.stretch[item] - 1e-9).astype(np.int64))
        some = np.flatnonzero(hi - lo >= need)
        out = []
        ends = np.cumsum((hi - lo)[some])
        for part in np.split(some, np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE))):
            if not len(part):
                continue
            size = (hi - lo)[part]
            first = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(lo[part], size)
            same = self.flat[np.repeat(self.begins[item[part]], size) + within] == x[np.repeat(offset[part], size) + within]
            out.append(packed[part[np.add.reduceat(same.astype(np.int64), first) >= need[part]]])
        return np.concatenate([*out, np.empty(0, np.int64)])

    def overlaps(self, text: str):
        """(name of the item, words of the overlap, equal words, words of the item, first word) of every item's best overlap."""
        import numpy as np

        words = WORD.findall(text.lower())
        x, found = self.hits(words)
        best: dict[int, tuple] = {}
        for k, offset in found:
            item = self.items[k]
            lo, hi = max(0, -offset), min(len(item), len(x) - offset)
            same = x[offset + lo : offset + hi] == item[lo:hi]
            if same.sum() >= self.least[k]:
                one = (int(hi - lo), int(same.sum()), len(item), int(offset + lo))
                if k not in best or one[:2] > best[k][:2]:
                    best[k] = one
                continue
            score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
            low = np.minimum.accumulate(score)
            end = int(np.argmax(score - low))
            start = int(np.argmin(score[: end + 1]))
            if end - start < self.stretch[k]:
                # The longest stretch with four equal words in five: to each end, the first start with no higher score.
                starts = np.searchsorted(-low, -score)
                end = int(np.argmax(np.arange(len(score)) - starts))
                start = int(starts[end])
            if end - start >= self.stretch[k]:
                one = (end - start, int(same[start:end].sum()), len(item), offset + lo + start)
                if k not in best or one[:2] > best[k][:2]:
                    best[k] = one
        out = [(self.ids[k], *v) for k, v in best.items()]
        n = len(words)
        return out + [(i, n, n, n, 0) for i in (self.short.get(tuple(words), ()) if n < self.min_words else ())]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("item_key", F.md5(F.col("text").cast("binary")))


def _blocks(items: DataFrame, block_words: int):
    """Lists of (item_key, words) of about block_words words at most: hashes deal the items to blocks of known size. items: item_key, text."""
    total = items.agg(F.sum(F.regexp_count("text", F.lit(LETTERS)))).first()[0] or 0
    n = -(-total // block_words) if total > block_words else 1
    n = n + n // 4 if n > 1 else 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_key"), F.lit(n)) == k)
        if some := [(r.item_key, WORD.findall(r.text.lower())) for r in part.collect()]:
            yield some


def _found(docs: DataFrame, items: DataFrame, overlap: int, min_words: int, block_words: int) -> DataFrame:
    """A row per document and different item that overlap, with the keys of both texts; written."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL")
    out = None
    for block in _blocks(items, block_words):
        sent = spark.sparkContext.broadcast(Seeds(block, overlap, min_words=min_words))
        one = base.saved(rows.mapInArrow(_matcher(sent), FOUND), "overlaps")
        sent.destroy()
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], FOUND) if out is None else out


def _items(benchmark: DataFrame) -> DataFrame:
    """Different items: item_key, text."""
    return _keyed(benchmark.select("text").filter("text IS NOT NULL")).dropDuplicates(["item_key"])


def overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and item that overlap: doc_id, item_id, overlap_words, equal_words, item_words, start_word (in words of the text)."""
    found = _found(docs, _items(benchmark), overlap, min_words, block_words)
    named = _keyed(benchmark.select("item_id", "text").filter("text IS NOT NULL")).select("item_id", "item_key")
    return found.join(named.hint("merge"), "item_key").select("doc_id", "item_id", "overlap_words", "equal_words", "item_words", "start_word")


def _matcher(sent):
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches):
        import hashlib

        import pyarrow as pa

        seeds, schema = sent.value, pa.schema([(n, pa.string() if n.endswith("key") else pa.int64()) for n in names])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if hit := seeds.overlaps(t := text.as_py()):
                    key = hashlib.md5(t.encode()).hexdigest()  # noqa: S324
                    rows += [(doc_id, key, *o) for o in hit]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that overlap with no item, with the columns of docs."""
    found = _found(docs, _items(benchmark), overlap, min_words, block_words)
    # Whether a text leaks is the text's own property, so its digest is the key.
    leaks = base.saved(found.select("text_key").distinct(), "leaks")
    key = base.free(docs.columns, "text_key")
    n = leaks.count()
    keyed = docs.withColumn(key, F.md5(base.text_of().cast("binary")))
    side = leaks.withColumnRenamed("text_key", key)
    return keyed.join(F.broadcast(side) if n <= base.BROADCAST_ROWS // 2 else side.hint("shuffle_hash"), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.col("equal_words") / F.col("overlap_words"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_decontaminate": op10_decontaminate}
