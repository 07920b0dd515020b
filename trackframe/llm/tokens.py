"""Token ids in ORC files.

Documents are range-sorted by id, encoded in that order and written by Spark's ORC writer: integer columns are run-length
encoded, every stripe has row indexes and a Bloom filter on doc_id, so readers split by stripe and skip by metadata.
Row order within the table is (part, row): `part` is the range a file belongs to. The number of ids before a document is
the sum over the parts before it and the rows before it in its part.

Defined cases: a null text is the empty one (the end id alone); null ids come first; rows of the same id are ordered by
text; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

#: White space of Unicode.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that are encoded whole: empty ones, and those with white space next to white space or at an end, where a space or
#: line feed need not start a token. Elsewhere it always does in a byte-level BPE of this family, and a line feed is a
#: token of its own, so a text may be cut there.
WHOLE = rf"\A\z|\A{BLANK}|{BLANK}\z|{BLANK}{BLANK}"
#: Punctuation that may follow a word: a token of its own behind letters. Not the quote, with which contractions begin.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A worker remembers words and their ids up to this many bytes, and forgets those that it has not met for long. Longer words are not remembered.
REMEMBERED_BYTES = 128 << 20
WORD_BYTES = 256
#: Rows and bytes encoded at once (one row at least).
ROWS, BYTES = 10_000, 4 << 20
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.create.index": "true", "compression": "zstd"}
END = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cuts_at_spaces(model: dict) -> bool:
    """Whether a tokenizer (its file as a dict) is of the family whose texts may be cut: byte-level BPE on its usual pieces, text as it is."""
    before, inner = model.get("pre_tokenizer") or {}, model.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and model.get("normalizer") is None
    return plain and inner.get("type", "BPE") == "BPE" and not any(inner.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


def byte_letters() -> dict[int, str]:
    """Byte-level letters: bytes that print stand for themselves, the others for letters from U+0100 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of texts as bytes (little-endian, 32 bits each). Words between safe cuts are encoded once and remembered.

    Tokenizers of another family than `cuts_at_spaces` get every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.bpe = self.model.model
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.room = REMEMBERED_BYTES // 2
        #: A text with one of these is encoded whole: they are found before the text is cut.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        feed = self._ids("\n")
        self.cuts = len(feed) == 1 and cuts_at_spaces(json.loads(self.model.to_str()))
        self.feed = int(feed[0])
        self.letters = byte_letters()

    def _ids(self, text: str):
        import numpy as np

        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _part(self, piece: str) -> bytes:
        """Ids of one piece, that is, of what the tokenizer's own cutting leaves whole."""
        if piece.isascii() and piece[0] != " ":
            letters = piece
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.bpe.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new words. Letters and punctuation behind them are two pieces. Other words go through the tokenizer as lines of one text: each line feed comes out as one id and parts them."""
        import numpy as np

        out, others, feed, space = [b""] * len(new), [], struct.pack("<I", self.feed), self.letters[32]
        tokenize, parts, letters = self.bpe.tokenize, self.parts, self.letters
        if len(parts) > 10_000:
            parts.clear()
        for k, w in enumerate(new):
            core = w.rstrip(TAIL)
            lined = core[:1] == "\n"
            plain = core[1:] if lined else core
            ascii_ = plain.isascii()
            if not plain.isalpha() or not (ascii_ or max(plain) < "\u0250"):
                others.append(k)
                continue
            # A word that is known without its punctuation needs no second look.
            ids = None if len(core) == len(w) else self.words.get(core) or self.older.get(core)
            if ids is None:
                found = [t.id for t in tokenize(("" if lined else space) + (plain if ascii_ else plain.encode().decode("latin-1").translate(letters)))]
                ids = struct.pack(f"<{len(found)}I", *found)
                ids = feed + ids if lined else ids
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in parts:
                    parts[tail] = self._part(tail)
                ids += parts[tail]
            out[k] = ids
        for at in range(0, len(others), 2000):
            some = others[at : at + 2000]
            ids = self._ids("\n".join([new[k][1:] if new[k][0] == "\n" else " " + new[k] for k in some]))
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)) * 4
            raw, i = ids.tobytes(), 0
            for k, j in zip(some, ends.tolist(), strict=True):
                out[k] = feed + raw[i:j] if new[k][0] == "\n" else raw[i:j]
                i = j + 4
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of words. What is remembered has two generations: a word of the older one that is met moves to the newer, and
        when that is full, it becomes the older one, and what has not been met meanwhile is forgotten."""
        out = list(map(self.words.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        older = self.older.get
        new, room = [], self.room
        for k in missing:
            w = words[k]
            ids = older(w)
            if ids is None:
                new.append(k)
                continue
            out[k] = self.words[w] = ids
            room -= 2 * len(w) + len(ids) + 180
        for k, ids in zip(new, self._learn([words[k] for k in new]) if new else [], strict=True):
            out[k], w = ids, words[k]
            # A word, its ids and its place in the dict.
            size = 2 * len(w) + len(ids) + 180
            if size <= WORD_BYTES + 180:
                self.words[w] = ids
                room -= size
        if room < 0:
            self.words, self.older, room = {}, self.words, REMEMBERED_BYTES // 2
        self.room = room
        return out

    def ids_of(self, texts):
        """(ids of all texts in a row, number of ids of each); texts is an Arrow array without nulls.

        A word stands for itself behind a space, or behind a line feed where it begins with one, as the first does.
        Arrow cuts the texts and counts equal words as one, so that Python sees each word of the texts once.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        whole = np.ones(n, dtype=bool)
        if self.cuts:
            odd = pc.match_substring_regex(texts, WHOLE)
            for a in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, a))
            whole = odd.to_numpy(zero_copy_only=False)
        sizes, parts = np.zeros(n, dtype=np.int64), {}
        for k in np.flatnonzero(whole).tolist():
            parts[k] = self._ids(texts[k].as_py())
            sizes[k] = len(parts[k])
        if len(parts) == n:
            return (np.concatenate(list(parts.values())) if n else np.zeros(0, dtype="<u4")), sizes
        cut = texts.filter(pa.array(~whole)) if parts else texts
        lined = pc.binary_join_element_wise("\n", pc.replace_substring(cut, "\n", " \n"), "")
        lists = pc.split_pattern(lined, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        own = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        codes = coded.indices.to_numpy()
        lengths = own[codes]
        upto = np.concatenate([[0], lengths.cumsum()])
        at = np.repeat(((own.cumsum() - own)[codes] - upto[:-1]).astype(np.int32), lengths)
        at += np.arange(upto[-1], dtype=np.int32)
        flat = ids[at]
        ends = upto[ends - ends[0]]
        # The first id of each is the line feed that is not the text's.
        keep = np.ones(len(flat), dtype=bool)
        keep[ends[:-1]] = False
        sizes[~whole] = np.diff(ends) - 1
        flat = flat[keep]
        if not parts:
            return flat, sizes
        out, starts = np.empty(sizes.sum(), dtype="<u4"), sizes.cumsum() - sizes
        inside = np.repeat(~whole, sizes)
        out[inside] = flat
        for k, x in parts.items():
            out[starts[k] : starts[k] + len(x)] = x
        return out, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        flat, sizes = self.ids_of(pa.array(texts, pa.string()))
        ends = sizes.cumsum().tolist()
        return [flat[j - int(m) : j].tobytes() for j, m in zip(ends, sizes, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker, for all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = _encoder(path)
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            k = 0
            while k < b.num_rows:
                n = max(1, min(ROWS, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + BYTES, side="right")) - k))
                part = b.slice(k, n)
                k += n
                flat, own = encoder.ids_of(part.column(1))
                # Each row ends with the end id.
                ends = own.cumsum()
                flat = np.insert(flat, ends, end).astype(np.int32)
                own = own + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(own), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], own.cumsum()]).astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "part", "row", "n_tokens", "ids"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Encodes docs and writes doc_id, part, row, n_tokens, ids as ORC, in ascending doc_id order."""
    rows = docs.select("doc_id", base.text_of().alias("text"))
    # The beginning of the text splits the rows of a hot id; it is in the order of the whole text.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    numbered = ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    schema = "doc_id long, part int, row long, n_tokens long, ids array<int>"
    numbered.mapInArrow(_encode(tokenizer or tokenizer_path(), end), schema).write.options(**ORC).orc(path)


def _checksums(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists = b.column(4)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ends[1:] - ends[:-1], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, row long, n_tokens long, ids array<int>").orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of tokens as read back: checksums over the ids, sums over narrow rows."""
    sums = base.saved(tokens.mapInArrow(_checksums, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"), "token-sums")
    # One row per part: as many as there are files.
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    run = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("run", run).join(ahead.hint("merge"), "part").select("doc_id", (F.col("ahead") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")


def find(tokens: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Rows of these documents: the filter goes to the ORC reader, which skips stripes and row groups by index and Bloom filter."""
    return tokens.filter(F.col("doc_id").isin(doc_ids))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch(spark, "tokens")
    write_tokens(base.table(spark, sf_dir, "documents"), path)
    return token_index(read_tokens(spark, path))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_tokens": op6_tokens}
