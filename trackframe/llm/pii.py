"""Personal data by weak supervision.

Candidates are spans: those of four fixed kinds, and looser ones (written-out e-mail addresses, account numbers, social
security numbers, names behind a title). Labelers vote on each: the edges (regexes for what stands beside a span), a
check (digits, ranges, check sums), a gazetteer (domain endings, calling codes, card and country prefixes, given names),
and words in the context for and against. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern means personal data. Those likelihoods are the labels on which the
final classifier is trained, a logistic regression that sees no votes but the span itself: its kind, length, digits,
letters, neighbours and the words around it. It decides on the looser candidates, also where no labeler votes; spans of
the fixed kinds always stay.

All texts vote: what reaches the driver is the count per kind and vote pattern, some hundred numbers at any size. The
classifier is fitted on at most SAMPLE candidates, those whose hash is lowest.

Defined cases: a null text is the empty one, without spans; null ids and repeated rows get results like any other row;
a fixed match that fails its check is dropped without a retry; an empty table gives an empty result and an untrained
classifier; extra columns are not read (`detect`) or pass through (`redact`).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Fixed kinds in the order in which spans are listed, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_text", "iban", "ssn", "person")
LABELERS = ("edges", "check", "gazetteer", "context", "against")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = (
    ("email_text", re.compile(r"\b[A-Za-z0-9._]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}){1,3}\b")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")),
    ("person", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b")),
)
#: Strings one of which every match of a loose kind has.
NEEDED = {"email_text": ("(dot)", "[dot]", " dot "), "iban": (), "ssn": ("-",), "person": ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ")}
#: Gazetteers: endings of domains, calling codes, prefixes of cards, lengths of account numbers by country, given names.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev me tv co cc eu at au be bg br ca ch cl cn cz de dk ee es fi fr gr hk hr hu ie il in is it jp kr lt lu lv mx my nl no nz pl pt ro rs ru se sg si sk th tr tw ua uk us za".split()
)
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 216 234 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 966 971 972".split())
CARDS = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])|62")
IBAN = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
GIVEN = frozenset(
    "Adam Alice Amy Andrea Andrew Ann Anna Anne Anthony Antonio Barbara Ben Brian Carl Carla Carlos Carol Charles Chris Claire Clara Daniel David Diana Donald Edward Elena Elizabeth Emily Emma Eric Eva Francis Frank George Grace Hannah Hans Helen Henry Isabel Jack "
    "James Jane Jean Jennifer John Jose Joseph Juan Julia Karen Karl Kate Kevin Laura Lea Leo Linda Lisa Louis Lucas Lucia Luis Maria Marie Mark Martin Mary Matthew Max Michael Miguel Nancy Nicolas Nina Oliver Olivia Otto Patricia Paul Pedro Peter Pierre Rachel "
    "Richard Robert Rosa Ruth Sam Sandra Sara Sarah Simon Sofia Sophie Stefan Stephen Steven Susan Thomas Tim Tom Victor Walter William".split()
)
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"), "ip": ("ip", "address", "host", "server", "client"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "email_text": ("mail", "contact", "reach"), "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"), "person": ("name", "contact", "signed", "dear"),
}
AGAINST = ("version", "isbn", "doi", "order no", "serial", "part no", "section", "release")
#: Code points before and behind a span that count as its context.
REACH, BEHIND = 40, 20
#: Candidates on which the classifier is fitted, at most.
SAMPLE = 20_000
#: Words beside a span are hashed to so many features each.
HASHED = 64
SPAN = "struct<kind:int,start:int,end:int,votes:int,features:array<int>>"
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed kinds, by kind, then start. Every step is linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in LOCAL:
            i -= 1
        if i < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((0, i, end))
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        if len(parts) < 4:
            continue
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, at, at + n))
            at += n + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def mod97(account: str) -> bool:
    """The check sum of account numbers."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _votes(kind: int, start: int, end: int, text: str) -> int:
    """Votes of all labelers as one number in base 3: 0 no vote, 1 for, 2 against."""
    name, span = KINDS[kind], text[start:end]
    beside = text[max(0, start - REACH) : start].lower() + " " + text[end : end + BEHIND].lower()
    digits = re.sub("[^0-9]", "", span)
    plain = re.sub("[^A-Za-z0-9]", "", span)
    before, after = text[start - 1 : start], text[end : end + 2]
    edges = not (before.isalnum() or before in ("_", "-", "/", "=") or after[:1].isalnum() or after[:1] in ("_", "/") or (after[:1] in ("-", ".") and after[1:].isalnum()))
    check, known = {
        "email": lambda: (".." not in span and span[0] not in ".-%+", span.rpartition(".")[2].lower() in ENDINGS),
        "ip": lambda: (digits[:1] != "0" and span.split(".")[0] not in ("0", "255"), span.startswith(("10.", "192.168.", "127.")) or None),
        "card": lambda: (len(digits) in (13, 14, 15, 16, 19) and len(set(digits)) > 3, bool(CARDS.match(digits))),
        "phone": lambda: (len(digits) >= 10 and len(set(digits)) > 3, any(digits[:n] in CALLING for n in (1, 2, 3))),
        "email_text": lambda: (" at " not in span, re.split("[^A-Za-z]+", span)[-1].lower() in ENDINGS),
        "iban": lambda: (len(plain) == IBAN.get(plain[:2], len(plain)) and mod97(plain), plain[:2] in IBAN),
        "ssn": lambda: (digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000", None),
        "person": lambda: (" " in span[5:], span.split()[1] in GIVEN or None),
    }[name]()
    out = 0
    for v in (1 if edges else 2, 1 if check else 2, 0 if known is None else 1 if known else 2, 1 if any(w in beside for w in CONTEXT[name]) else 0, 2 if any(w in beside for w in AGAINST) else 0):
        out = out * 3 + v
    return out


#: Features in groups: a span has one of each.
GROUPS = (len(KINDS), 2 * len(KINDS), 6 * len(KINDS), 5 * len(KINDS), 4, 5, 5, HASHED, HASHED, HASHED)
N_FEATURES = sum(GROUPS)


def _features(kind: int, start: int, end: int, text: str, passed: bool) -> list[int]:
    """Numbers of a span's features: kind, whether its digits or form pass their check, length, digits, case, characters beside it, two words before it and one behind it."""
    import xxhash

    span = text[start:end]
    around = lambda c: 0 if not c else 1 if c.isalnum() else 2 if c.isspace() else 3 if c in ".,;:()\"'" else 4
    length = min(5, (end - start) // 6)
    digits = sum(c.isdigit() for c in span) * 4 // max(1, len(span))
    case = (any(c.isupper() for c in span)) + 2 * (any(c.islower() for c in span))
    before, behind = [m.lower() for m in WORD.findall(text[max(0, start - REACH) : start])][-2:], [m.lower() for m in WORD.findall(text[end : end + REACH])][:1]
    hashed = [xxhash.xxh32_intdigest(w) % HASHED for w in [*(["", ""] + before)[-2:], *(behind or [""])]]
    values = (kind, kind * 2 + passed, kind * 6 + length, kind * 5 + digits, case, around(text[start - 1 : start]), around(text[end : end + 1]), *hashed)
    out, first = [], 0
    for v, n in zip(values, GROUPS, strict=True):
        out.append(first + v)
        first += n
    return out


def candidates(text: str) -> list[tuple]:
    """(kind, start, end, votes, features): fixed kinds, then the looser ones that touch no fixed span."""
    found = base_spans(text)
    starts = sorted(s for _, s, _ in found)
    # The furthest end of the spans up to each start, so that one look-up tells whether a span is touched.
    ends = list(accumulate((e for _, e in sorted((s, e) for _, s, e in found)), max))
    for name, pattern in LOOSE:
        if NEEDED[name] and not any(x in text for x in NEEDED[name]):
            continue
        for m in pattern.finditer(text):
            n = bisect_left(starts, m.end())
            if not n or ends[n - 1] <= m.start():
                found.append((KINDS.index(name), m.start(), m.end()))
    out = []
    for x in found:
        votes = _votes(*x, text)
        passed = pattern_votes(votes)[LABELERS.index("check")] > 0
        out.append((*x, votes, _features(*x, text, passed)))
    return out


def _extract(batches):
    import hashlib

    import pyarrow as pa

    names = ("kind", "start", "end", "votes", "features")
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:4]), ("features", pa.list_(pa.int32()))]))
    for b in batches:
        texts = [t.as_py() or "" for t in b.column(1)]
        found = [[dict(zip(names, x, strict=True)) for x in candidates(t)] for t in texts]
        keys = [hashlib.md5(t.encode()).digest() if f else None for t, f in zip(texts, found, strict=True)]  # noqa: S324
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(keys, pa.binary())], names=["doc_id", "found", "text_key"])


def pattern_votes(pattern: int) -> list[int]:
    """A pattern's votes as -1, 0, 1 by labeler."""
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append((0, 1, -1)[v])
    return out[::-1]


#: Chances of no vote, one for and one against that are assumed of personal data and of other spans; so many votes each.
ASSUMED, VOTES = ((0.35, 0.5, 0.15), (0.35, 0.15, 0.5)), 2.0


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 100):
    """Expectation-maximisation over counts per (kind, pattern).

    Returns (accuracy of each labeler when it votes, posterior per (kind, pattern)). Labelers vote independently given
    the truth. Each kind has a prior, and each labeler its chances of every vote per kind and truth, so that one that
    always says the same has no weight.
    """
    import numpy as np

    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([pattern_votes(p) for _, p in keys]).reshape(len(keys), len(LABELERS))
    kind = np.array([k for k, _ in keys], dtype=int)
    vote = np.where(v < 0, 2, v)
    chance = np.tile(np.array(ASSUMED), (len(KINDS), len(LABELERS), 1, 1))
    prior, post, each = np.full(len(KINDS), 0.5), np.zeros(len(keys)), np.arange(len(LABELERS))
    for _ in range(rounds):
        log = np.log(chance[kind[:, None], each[None, :], :, vote]).sum(1)
        odds = np.log(prior[kind] / (1 - prior[kind])) + log[:, 0] - log[:, 1]
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = np.clip(((post * n)[own].sum() + 1) / (n[own].sum() + 2), 0.02, 0.98)
            for truth, share in enumerate((post, 1 - post)):
                seen = np.stack([((vote == x) * (share * n * own)[:, None]).sum(0) for x in range(3)], axis=1) + VOTES * np.array(ASSUMED[truth])
                chance[k, :, truth] = seen / seen.sum(1, keepdims=True)
    right = np.where(v == 1, post[:, None], 1 - post[:, None])
    voted = (v != 0) * n[:, None]
    return (right * voted).sum(0) / np.maximum(1.0, voted.sum(0)), dict(zip(keys, post.tolist(), strict=True))


def train(features, labels, steps: int = 30, ridge: float = 1.0):
    """Weights of the span classifier, a bias and one per feature, by Newton steps on soft labels. features: rows of feature numbers."""
    import numpy as np

    x = np.zeros((len(features), N_FEATURES + 1))
    x[:, 0] = 1
    for i, row in enumerate(features):
        x[i, [f + 1 for f in row]] = 1
    y, w = np.asarray(labels, dtype=float), np.zeros(N_FEATURES + 1)
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score(features: Column, weights: list[float]) -> Column:
    """Probability that a span is personal data: the classifier as a Spark expression."""
    each = F.lit([float(w) for w in weights[1:]])
    z = F.aggregate(features, F.lit(float(weights[0])), lambda a, f: a + F.get(each, f))
    return 1 / (1 + F.exp(-z))


def fit(found: DataFrame, sample: int = SAMPLE):
    """(weights, accuracies) from candidates (doc_id, found): counts per kind and pattern go to the driver, and at most `sample` candidates."""
    spans = found.select("doc_id", F.inline("found"))
    counts = {(r.kind, r.votes): r["count"] for r in spans.groupBy("kind", "votes").count().collect()}
    if not counts:
        return [0.0] * (N_FEATURES + 1), [0.8] * len(LABELERS)
    accuracy, posterior = reliabilities(counts)
    order = F.xxhash64("doc_id", "kind", "start", "end")
    rows = spans.select("kind", "votes", "features", order.alias("h")).orderBy("h", "kind", "votes", "features").limit(sample).collect()
    return train([r.features for r in rows], [posterior[r.kind, r.votes] for r in rows]), accuracy.tolist()


def detect(docs: DataFrame, least: float = 0.5, weights: list[float] | None = None) -> DataFrame:
    """doc_id, `spans`, an array of (kind, start, end, votes, features) by kind and start, and text_key, the text's digest where it has candidates.

    One row per row of docs; texts are read once. weights: a classifier fitted before; without it, these documents fit one.
    """
    found = base.saved(docs.select("doc_id", "text").mapInArrow(_extract, f"doc_id long, found array<{SPAN}>, text_key binary"), "pii-candidates")
    if weights is None:
        weights, _ = fit(found)
    kept = F.filter("found", lambda s: (s["kind"] < len(BASE_KINDS)) | (score(s["features"], weights) >= least))
    return found.select("doc_id", F.sort_array(kept).alias("spans"), "text_key")


def _cut(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts with their spans replaced, in one go from left to right; of spans that overlap, the first."""
    for text, starts, ends, kinds in texts:
        out = []
        for t, s, e, k in zip(text, starts, ends, kinds, strict=True):
            if s is None or t is None:
                out.append(t)
                continue
            at, pieces = 0, []
            for start, end, kind in sorted(zip(s.tolist(), e.tolist(), k.tolist(), strict=True)):
                if start >= at:
                    pieces += [t[at:start], "[", KINDS[kind], "]"]
                    at = end
            out.append("".join([*pieces, t[at:]]))
        yield pd.Series(out, dtype=object)


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans of `detect` replaced by their kind in brackets; a row finds its spans by its id and its text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = spans.filter(F.size("spans") > 0).select("doc_id", "text_key", *[F.col(f"spans.{f}").alias(f) for f in ("start", "end", "kind")])
    rows = docs.select(row, F.col("doc_id").alias("row_id"), F.unhex(F.md5(base.text_of().cast("binary"))).alias("row_key"))
    joined = rows.join(found.dropDuplicates(["doc_id", "text_key"]).hint("merge"), F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key")), "left")
    text = F.pandas_udf(_cut, "string")(F.col("row.text"), "start", "end", "kind")
    out = joined.select("row", text.alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(list(KINDS)), s["kind"]), s["start"], s["end"])), ",")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(base.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


ORACLE: dict[str, str] = {}
QUERIES = {"op3_pii": op3_pii}
