"""Near-duplicates by Order MinHash.

A text is a sequence of word k-mers, each labelled with its occurrence (first, second, ... of the same k-mer). A sketch
takes the few labelled k-mers with the lowest hashes and keeps them in text order, so that texts with the same k-mers in
another order differ. Texts that agree in a sketch are candidates; a banded alignment decides: common labelled k-mers in
the same order, at most `band` positions apart, as a share of all k-mers of both.

Exact copies are one node. First the nodes of a bucket are laid beside one hub: m nodes make m - 1 pairs, and links give
classes. Then every pair of different classes that shares a bucket is settled, without a limit on a bucket's size. A
bucket with few nodes outside its largest class lays those beside its nodes of other classes. Nodes of the other buckets
are joined by prefixes: distinct k-mers are put in one order, the rare ones first, and two texts at `least` have one in
common among the first of each. There are these two rounds and no others. Pairs whose lengths, parity bits or places in
the prefixes rule out the similarity are not made: all bound it from above, so no link is lost by them.

Defined cases: a null text equals the empty one, and all empty texts are copies; a text of fewer than k words is one
k-mer, so it is like others with the same words only; null ids come last when a class is named by its lowest id (a class
of null ids alone has a null name); rows repeated with the same id and text are copies; an empty table gives an empty
result; extra columns are not read (`classes`) or pass through (`deduplicated`).
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import base

K = 5
SIMILAR = 0.8
#: Sketches per text, and k-mers per sketch: a pair at 0.8 is missed by all with a chance of 0.0002.
SKETCHES, PER_SKETCH = 12, 3
#: A bucket with so many nodes outside its largest class is gone through pair by pair, beyond that it is split by prefixes.
FEW = 6
#: Parity bits of a text, as longs: each distinct k-mer flips one bit.
BIT_LONGS = 16
#: Counters by which k-mers are ordered, the rare ones first: k-mers that share one are ordered by hash, which loses nothing.
COUNTERS = 1 << 20
#: k-mers hashed at once, so that memory does not follow a text's length.
PIECE = 1 << 16
#: Copies of a hub's text are made for every so many of its pairs.
PAIRS_PER_COPY = 256


#: Words whose hashes a task remembers.
REMEMBERED = 200_000


class Words(dict):
    """Hashes of words; forgets when it has grown, and when a task ends (`_forgetful`)."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def _forgetful(run):
    """run, which leaves no words behind in its worker."""

    def both(batches):
        try:
            yield from run(batches)
        finally:
            _words.clear()

    return both


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def kmers(text: str, k: int = K):
    """Hashes of a text's labelled k-mers in text order."""
    return labelled(text, k)[0]


def labelled(text: str, k: int = K):
    """(hashes of a text's labelled k-mers in text order, which of them are first occurrences)."""
    import numpy as np

    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, bool)
    x = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(x) - k + 1)
    h = np.full(n, len(x) if len(x) < k else k, dtype=np.uint64)
    for i in range(min(k, len(x))):
        h = _mix(h * np.uint64(31) + x[i : i + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if first.all():
        return h, np.ones(n, bool)
    at = np.arange(n)
    nth = np.empty(n, np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(nth > 0, _mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), h), nth == 0


def sketches(h, count: int = SKETCHES, per: int = PER_SKETCH):
    """One hash per sketch: its `per` lowest labelled k-mers, in text order."""
    import numpy as np

    seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    low, at = np.empty((count, 0), np.uint64), np.empty((count, 0), np.int64)
    for i in range(0, len(h), PIECE):
        part = _mix(h[None, i : i + PIECE] ^ seeds)
        low, at = np.concatenate([low, part], axis=1), np.concatenate([at, np.broadcast_to(np.arange(i, i + part.shape[1]), part.shape)], axis=1)
        if low.shape[1] > per:
            pick = np.argpartition(low, per - 1, axis=1)[:, :per]
            low, at = np.take_along_axis(low, pick, 1), np.take_along_axis(at, pick, 1)
    at = np.sort(at, axis=1)
    out = np.arange(1, count + 1, dtype=np.uint64)
    for c in range(at.shape[1]):
        out = _mix(out * np.uint64(31) + h[at[:, c]])
    return out


def parity_bits(h):
    """BIT_LONGS longs and the number of k-mers: a bit is set if an odd number of these distinct k-mers fall on it.

    What two texts share cancels out, so their bits differ in as many places as k-mers are in one text only, at most.
    """
    import numpy as np

    n = 64 * BIT_LONGS
    odd = np.bincount((h % np.uint64(n)).astype(np.int64), minlength=n).astype(np.uint8) & 1
    return np.append(np.packbits(odd).view(np.int64), len(h))


def similarity(x: tuple, y: tuple, least: float = SIMILAR) -> float:
    """Banded alignment of two sequences of labelled k-mers: those shared in order within the band / those of both.

    Texts that repeat themselves are not similar for their repeats alone: the distinct k-mers have to be, too. The share without regard to order bounds it from above, so most pairs below `least` need no alignment. Two texts at
    `least` can be shifted against each other by their unshared k-mers at most, which is the band.
    """
    import numpy as np

    (a, first_a), (b, first_b) = x, y
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    whole = len(a) + len(b)
    if len(common) < least * (whole - len(common)):
        return len(common) / (whole - len(common))
    once = np.count_nonzero(first_a[i])
    if once < least * (distinct := np.count_nonzero(first_a) + np.count_nonzero(first_b) - once):
        return once / distinct
    band = whole - 2 * len(common) + K
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band]
    if len(j) and not (j[1:] > j[:-1]).all():
        tails: list[int] = []
        for x in j.tolist():
            if (p := bisect_left(tails, x)) == len(tails):
                tails.append(x)
            else:
                tails[p] = x
        n = len(tails)
    else:
        n = len(j)
    return n / (whole - n)


def _sketch(batches):
    import hashlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        nodes, keys, sizes, bits = [], [], [], []
        for t in b.column(1):
            text = t.as_py() or ""
            nodes.append(hashlib.md5(text.encode()).digest())
            h, first = labelled(text)
            keys.append(sketches(h).astype(np.int64) if len(h) else np.empty(0, np.int64))
            sizes.append(len(h))
            bits.append(parity_bits(h[first]))
        columns = [b.column(0), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "keys", "kmers", "bits"])


def _verify(least: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            hub, h = None, None
            keep = []
            for x, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if x != hub:
                    hub, h = x, labelled(s.as_py())
                keep.append(similarity(h, labelled(t.as_py()), least) >= least)
            # Without the texts: a batch of them is not copied.
            yield b.select(["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counts(batches):
    """(counter, n): how many texts have a distinct k-mer of this counter."""
    import numpy as np
    import pyarrow as pa

    n = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for t in b.column(0):
            h, first = labelled(t.as_py())
            np.add.at(n, (h[first] % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["counter", "n"])


def prefix(h, counts, least: float = SIMILAR):
    """(k-mers, their places): of distinct k-mers, the first ones in the order of their counts. Two sets with a Jaccard similarity of `least` share one.

    They share `least` of the k-mers of each at least, so those that come first in each cannot all be missing in the other.
    """
    import numpy as np

    n = counts[(h % np.uint64(COUNTERS)).astype(np.int64)]
    order = np.lexsort((h, n))[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
    # A k-mer whose counter is 1 is in this text alone.
    at = np.flatnonzero(n[order] > 1)
    return h[order[at]], at


def _prefixes(sent, least: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys, places = [], []
            for t in b.column(1):
                h, first = labelled(t.as_py())
                k, at = prefix(h[first], sent.value, least)
                keys.append(k.astype(np.int64))
                places.append(at)
            columns = [b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "keys", "places"])

    return run


def _may_be_similar(least: float) -> Column:
    """False only for pairs below `least`: shared k-mers are those of the shorter text at most, and unshared ones are as many as differing bits at least.

    `similarity` asks for `least` of the distinct k-mers, too, which the bits are of.
    """
    long_enough = F.least("kmers", "hub_kmers") >= least * F.greatest("kmers", "hub_kmers")
    differ = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("hub_bits")[i])) for i in range(BIT_LONGS))
    # s shared of n k-mers of both have s / (n - s) >= least only if n - 2 s <= n (1 - least) / (1 + least).
    return long_enough & (differ <= (F.col("bits")[BIT_LONGS] + F.col("hub_bits")[BIT_LONGS]) * ((1 - least) / (1 + least)) + 1e-6)


def _as_hub(*columns: str) -> list[Column]:
    return [F.col(c).alias("hub" if c == "node" else f"hub_{c}") for c in columns]


def _entries(nodes: DataFrame, work: str) -> DataFrame:
    """(bucket, node, kmers, bits, near) of buckets with two nodes and more; near: nodes in all buckets of the node."""
    entries = nodes.select("node", F.explode("keys").alias("bucket"))
    # Sizes and other sums per key are written here and below, so that the join is of two plain shuffles, of which a hot key's can be split.
    sizes = base.saved(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes", work)
    shared = base.saved(entries.join(sizes.hint("merge"), "bucket"), "shared", work)
    near = shared.groupBy("node").agg(F.sum("n").alias("near")).join(nodes.select("node", "kmers", "bits").hint("merge"), "node")
    return base.saved(shared.select("bucket", "node").join(near.hint("merge"), "node"), "entries", work)


def _star_pairs(entries: DataFrame, least: float, work: str) -> DataFrame:
    """(hub, node): the nodes of a bucket beside one hub, for one half of the buckets the node that meets most others, for the rest any node."""
    rank = F.struct(F.when(F.col("bucket") % 2 == 0, -F.col("near")).otherwise(0), F.xxhash64("node", "bucket"), "node", "kmers", "bits")
    hubs = entries.groupBy("bucket").agg(F.min(rank).alias("hub")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.kmers").alias("hub_kmers"), F.col("hub.bits").alias("hub_bits"))
    hubs = base.saved(hubs, "hubs", work)
    pairs = entries.join(hubs.hint("merge"), "bucket").filter((F.col("node") != F.col("hub")) & _may_be_similar(least))
    return pairs.select("hub", "node").distinct()


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, work: str) -> DataFrame:
    """(node, text) of the wanted nodes: each is read from the documents that have its text and its lowest id, null where all its ids are."""
    named = lambda i: [F.col(i).isNull().alias("no_id"), F.coalesce(i, F.lit(0)).alias("id")]
    some = base.saved(wanted.join(nodes.select("node", "any_id").hint("shuffle_hash"), "node").select("node", *named("any_id")), "wanted", work)
    read = docs.select("doc_id", base.text_of().alias("text")).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), *named("doc_id"), "text")
    found = base.semi(read, some, ["node", "no_id", "id"], some.count(), limit=base.BROADCAST_ROWS // 2).select("node", "text")
    return base.saved(found.dropDuplicates(["node"]), "texts", work)


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, work: str) -> DataFrame:
    """The pairs (hub, node) that the alignment accepts.

    A hub with many pairs is copied, one copy for every PAIRS_PER_COPY of them, so that no task gets all its pairs.
    """
    pairs = base.saved(pairs, "pairs", work)
    texts = _texts(docs, nodes, pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct(), work)
    copies = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", F.ceil(F.col("n") / PAIRS_PER_COPY).cast("int").alias("n_copies"))
    copies = base.saved(copies, "copies", work)
    salted = pairs.join(copies.hint("merge"), "hub").withColumn("copy", F.pmod(F.xxhash64("node"), F.col("n_copies")).cast("int"))
    hub_texts = (
        texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")).join(copies.hint("merge"), "hub")
        .select("hub", "hub_text", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    )
    with_node = salted.select("hub", "copy", "node").join(texts.hint("merge"), "node")
    both = with_node.join(hub_texts.hint("merge"), ["hub", "copy"]).select("hub", "node", "hub_text", "text")
    return base.saved(both.mapInArrow(_forgetful(_verify(least)), "hub binary, node binary"), "links", work)


def components(links: DataFrame, work: str | None = None) -> DataFrame:
    """(node, root): the lowest node of every connected component, by large-star and small-star steps; nodes without links are left out.

    links: (a, b). Each step is grouped minima and joins over edges; the edges are written to the shared folder.
    """

    work = work or base.scratch(links.sparkSession, "components")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        low = base.saved(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low", work)
        out = near.join(low.hint("merge"), "a")
        if large:
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def step(edges: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = base.saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges", work)
        return out, seen.get

    edges, now = step(links.select("a", "b").filter("a <> b").distinct())
    before = None
    while now["n"] and now != before:
        before = now
        edges, now = step(star(star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _open(entries: DataFrame, roots: DataFrame, work: str) -> DataFrame:
    """Entries of buckets that hold several classes, with root, largest (the root of the bucket's largest class) and others (its nodes outside that class)."""
    rooted = base.saved(entries.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", work)
    per_class = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    most = per_class.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    most = base.saved(most.select("bucket", F.col("most.root").alias("largest"), "others"), "most", work)
    return base.saved(rooted.join(most.hint("merge"), "bucket"), "open", work)


def _few_pairs(open_: DataFrame, few: int, least: float) -> DataFrame:
    """All pairs of different classes in buckets with at most `few` nodes outside their largest class: few times the bucket's nodes."""
    some = open_.filter(F.col("others") <= few)
    hubs = some.filter("root <> largest").select("bucket", *_as_hub("node", "root", "kmers", "bits"))
    pairs = some.select("bucket", "node", "root", "kmers", "bits").join(hubs.hint("merge"), "bucket").filter((F.col("root") != F.col("hub_root")) & _may_be_similar(least))
    # Of two hubs one is the hub: the pair's order does not matter.
    return pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))


def _crowded_pairs(docs: DataFrame, nodes: DataFrame, open_: DataFrame, few: int, least: float, work: str) -> DataFrame | None:
    """All pairs of different classes that can be similar, of the nodes in buckets with more than `few` nodes outside their largest class; None if there are none.

    An exact join by prefixes of distinct k-mers: the longer text gives its first ones in the common order, the shorter
    one as many as suffice beside a text that is no shorter, and the places where they meet bound what can follow.
    """
    crowded = base.saved(open_.filter(F.col("others") > few).select("node", "root", "kmers", "bits").dropDuplicates(["node"]), "crowded", work)
    if crowded.isEmpty():
        return None
    texts = _texts(docs, nodes, crowded.select("node"), work)
    rows = texts.select("text").mapInArrow(_forgetful(_counts), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    # COUNTERS numbers, whatever the number of texts.
    counts = np_counts(rows.column(0).to_numpy(), rows.column(1).to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    keys = base.saved(texts.select("node", "text").mapInArrow(_forgetful(_prefixes(sent, least)), "node binary, keys array<long>, places array<long>"), "prefixes", work)
    split = keys.join(crowded.select("node", "root").hint("merge"), "node").select("node", "root", F.explode(F.arrays_zip("keys", "places")).alias("x"))
    split = split.select("node", "root", F.col("x.keys").alias("bucket"), F.col("x.places").alias("place"))
    mixed = split.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    mixed = base.saved(mixed, "mixed", work)
    some = split.join(mixed.hint("merge"), "bucket").select("node", "bucket", "place").join(crowded.hint("merge"), "node")
    longer = base.saved(some.withColumn("n", F.col("bits")[BIT_LONGS]), "split", work)
    share = least / (1 + least)
    shorter = longer.filter(F.col("place") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-6)).select("bucket", *_as_hub("node", "root", "kmers", "bits", "place", "n"))
    # Where two texts meet first, nothing that they share lies before.
    after = F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))
    ordered = (F.col("hub_n") < F.col("n")) | ((F.col("hub_n") == F.col("n")) & (F.col("hub") < F.col("node")))
    meets = ordered & (F.col("root") != F.col("hub_root")) & (after >= share * (F.col("n") + F.col("hub_n")) - 1e-6)
    pairs = longer.join(shorter.hint("merge"), "bucket").filter(meets & _may_be_similar(least))
    return pairs.select("hub", "node")


def np_counts(at, n):
    """Counters as one array, from those that are not 0."""
    import numpy as np

    out = np.zeros(COUNTERS, np.int64)
    out[at] = n
    return out


def _settled(docs: DataFrame, least: float, few: int, work: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketched rows, links of both rounds, roots of the nodes with links), all written below work."""
    sketched = base.saved(docs.select("doc_id", "text").mapInArrow(_forgetful(_sketch), "doc_id long, node binary, keys array<long>, kmers long, bits array<long>"), "sketches", work)
    nodes = sketched.groupBy("node").agg(F.min("doc_id").alias("any_id"), F.first("keys").alias("keys"), F.first("kmers").alias("kmers"), F.first("bits").alias("bits"))
    nodes = base.saved(nodes, "nodes", work)
    entries = _entries(nodes, work)
    first = _links(docs, nodes, _star_pairs(entries, least, work), least, work)
    roots = components(first.select(F.col("hub").alias("a"), F.col("node").alias("b")), work)
    open_ = _open(entries, roots, work)
    pairs = _few_pairs(open_, few, least)
    crowded = _crowded_pairs(docs, nodes, open_, few, least, work)
    pairs = pairs if crowded is None else pairs.union(crowded)
    second = _links(docs, nodes, pairs.distinct(), least, work)
    # Classes so far are stars already: with the links between them, few steps are left.
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second.select("hub", "node"))
    roots = base.saved(components(edges, work), "roots", work)
    return sketched, first.union(second), roots


def _with_roots(sketched: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, node, root) of every row, written."""
    members = sketched.select("doc_id", "node").join(roots.hint("merge"), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    return base.saved(members, "neardup-members")


def _links_per_class(links: DataFrame, roots: DataFrame, work: str) -> DataFrame:
    """(root, class_links): different pairs of texts that the alignment has accepted, whichever of the two was the hub."""
    pairs = base.saved(links.select(F.least("hub", "node").alias("node"), F.greatest("hub", "node").alias("other")).distinct(), "different-links", work)
    # A hub's links are of one node: the join is of two plain shuffles, so they can be split.
    return base.saved(pairs.join(roots.hint("merge"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("class_links")), "class-links", work)


def _members(docs: DataFrame, least: float, few: int = FEW) -> DataFrame:
    """(doc_id, node, root) of every row of docs, written; all that was written on the way is removed."""
    work = base.scratch(docs.sparkSession, "neardup")
    sketched, _, roots = _settled(docs, least, few, work)
    out = _with_roots(sketched, roots)
    base.remove(docs.sparkSession, work)
    return out


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the lowest id of its class), class_rows, class_texts (its different texts), class_links; one row per row of docs.

    class_links counts the pairs of different texts of the class that were laid side by side and accepted. It is one less
    than class_texts at least, and 0 for a class of copies of one text; pairs within a class that others have already
    linked are not all compared.
    """
    spark = docs.sparkSession
    work = base.scratch(spark, "neardup")
    sketched, links, roots = _settled(docs, least, FEW, work)
    members = _with_roots(sketched, roots)
    n_links = _links_per_class(links, roots, work)
    # Sums per node and root are map-side combined and written; the joins are of plain shuffles, whose hot side AQE can split.
    per_node = members.groupBy("root", "node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    sums = per_node.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    sums = sums.join(n_links.hint("merge"), "root", "left").withColumn("class_links", F.coalesce("class_links", F.lit(0)))
    named = base.saved(sums, "neardup-classes")
    base.remove(spark, work)
    return members.join(named.hint("merge"), "root").select("doc_id", "class_id", "class_rows", "class_texts", "class_links")


def deduplicated(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of every class, that with the lowest id, with the columns of docs.

    A row is named by its id and its text's digest. Rows repeated with both are one: any of them stays.
    """
    row, key = (base.free(docs.columns, x) for x in ("row", "key"))
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "node")
    members = _members(docs, least).select("root", one.alias(key))
    kept = base.saved(members.groupBy("root").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")).select(key, "n"), "neardup-kept")
    node = F.unhex(F.md5(base.text_of().cast("binary"))).alias("node")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    keyed = docs.select(own, F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), node).alias(key))
    rows = base.semi(keyed, kept.select(key), [key], kept.count(), limit=base.BROADCAST_ROWS // 2)
    # A class of one row has no row to repeat; of the others, one row of each key stays.
    several = base.saved(kept.filter("n > 1").select(key), "neardup-several")
    n = several.count()
    once = rows.join(F.broadcast(several) if n <= base.BROADCAST_ROWS // 2 else several.hint("shuffle_hash"), [key], "left_anti")
    again = base.semi(rows, several, [key], n, limit=base.BROADCAST_ROWS // 2).dropDuplicates([key])
    return once.union(again).select(f"{row}.*")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(base.table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_neardup": op2_neardup}
