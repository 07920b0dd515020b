import collections
import hashlib
import io
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trackframe.llm import base, decontamination, infill, licenses, mixing, neardup, pii, quality, secrets, sharding, tokens, warc

WORDS = [f"{a}{b}" for a in "ba de fi go lu me no pa ri su".split() for b in "ka le mi no ru sa te vu wo xi".split()]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def empty(df):
    return df.limit(0)


def clashing(df):
    """Extra columns with the names that operators use themselves."""
    return df.withColumns({c: F.lit("mine") for c in ("size", "place", "tie", "rank", "slot", "shard", "node", "keys", "q", "words", "text_key", "license_key", "run", "before", "row", "part", "key", "n", "root", "dedup_key", "mix_no", "mix_hash", "mix_position", "nth", "position", "vslot", "shard_no", "shard_vslot", "tie", "spans", "found", "item_id", "hash", "id", "no_id", "n_tokens", "ids", "digest", "first_id", "record_type", "whole", "h", "form", "again_id", "slot_id", "copy")})


#: A benchmark for the operators that need one.
def bench_of(df):
    return df.sparkSession.createDataFrame([(1, "one two three four five six seven eight nine"), (None, None), (2, ""), (3, "short")], "item_id long, text string")


def sharded(df):
    """write_shards and what it wrote."""
    spark, path = df.sparkSession, base.scratch(df.sparkSession, "shards")
    mapping = spark.createDataFrame([(v, v % 3) for v in range(sharding.N_SLOTS)], "vslot int, shard int")
    sharding.write_shards(df, mapping, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def tokenized(df):
    path = base.scratch(df.sparkSession, "tokens")
    tokens.write_tokens(df, path)
    return tokens.token_index(tokens.read_tokens(df.sparkSession, path))


def archived(df):
    """Rows as pages, written as archives and read back."""
    pages = df.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    return warc.read_archives(warc.write_archives(pages, base.scratch(df.sparkSession, "warc"))).withColumnRenamed("page_id", "doc_id")


EVERY = {
    "tokens": tokenized, "warc": archived, "infill": infill.transformed,
    "overlaps": lambda d: decontamination.overlaps(d, bench_of(d)), "clean_rows": lambda d: decontamination.clean_rows(d, bench_of(d)),
    "redact": lambda d: pii.redact(d, pii.detect(d)), "write_shards": sharded,
    "mix": mixing.mix, "mixed_rows": mixing.mixed_rows, "shard": sharding.shard, "pii": pii.detect, "secrets": secrets.scan, "licenses": licenses.scan,
    "quality": lambda d: quality.judged(d, []), "kept_rows": lambda d: quality.kept_rows(d, []), "classes": neardup.classes, "deduplicated": neardup.deduplicated,
}
PER_ROW = ("tokens", "warc", "infill", "write_shards", "redact", "mix", "shard", "pii", "secrets", "licenses", "quality", "classes")


@pytest.mark.parametrize("name", sorted(EVERY))
def test_odd_rows(odd, name):
    got = EVERY[name](clashing(odd)).collect()
    if name in PER_ROW:
        assert sorted(collections.Counter(r.doc_id for r in got).items(), key=str) == sorted(collections.Counter(r.doc_id for r in odd.collect()).items(), key=str)
    if name == "warc":
        # Equal payloads are short here, so all are responses, with the digests of their own.
        want = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect() if len(r.text or "") < 100)
        assert collections.Counter((r.doc_id, r.payload_digest) for r in got if r.payload_bytes < 100) == want
        assert {r.record_type for r in got} == {"response"}
    if name == "tokens":
        model = __import__("tokenizers").Tokenizer.from_file(tokens.tokenizer_path())
        counts = collections.Counter((r.doc_id, len(model.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == counts
    if name in ("mixed_rows", "kept_rows", "deduplicated", "clean_rows", "redact", "write_shards"):
        # All odd rows are too short or repeat themselves for kept_rows.
        assert got or name == "kept_rows"
        taken = {"doc_id", "text", "lang", "source", "n_chars"}
        assert all(r[c] == "mine" for r in got for c in r.asDict() if c not in taken)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_tables(odd, name):
    assert EVERY[name](empty(odd)).count() == 0


def test_mix_reaches_its_targets(docs):
    rows = [(i, prose(i, 5 + i % 40), s) for i, s in enumerate("aaaaaaaabbbcdd" * 20)] + [(999, prose(1, 10), None)]
    out = mixing.mix(docs(rows)).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in [*"abcd", None]}
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    # Water-filling by repeated resharing, as the contract words it.
    order, w, total = [*"abcd", None], dict(zip([*"abcd", None], (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(size.values())
    want, open_, left = {}, set(order), total
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * size[s]}
        if not full:
            want |= {s: level * w[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s, rs in by.items():
        assert rs[0].source_size == size[s]
        assert rs[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs)
        assert all(r.taken <= 2 * r.size and (r.position is None) == (r.passes == 0) for r in rs)
    again = mixing.mix(docs(list(reversed(rows)))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_positions_invert_the_schedule(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        got = spark.range(101).select(mixing.position(F.col("id") / 100, F.lit(k + 1)).alias("t")).collect()
        for i, r in enumerate(got):
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
                x = min(max(r.t - t0, 0), t1 - t0)
                done += a * x + (b - a) / (t1 - t0) * x * x / 2
            assert done == pytest.approx(i / 100, abs=1e-9)


def test_mixed_rows_repeat_what_is_taken(docs):
    d = docs([(i, prose(i, 20), "ab"[i % 2]) for i in range(40)] + [(3, prose(3, 20), "b")])
    taken = sum(r.passes for r in mixing.mix(d).collect())
    assert mixing.mixed_rows(d).count() == taken


def test_shards_are_even_and_slots_gapless(docs):
    out = sharding.shard(docs([(i, prose(i, 40 + i % 9), "a") for i in range(2000)]), 8).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * min(sizes.values())
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    text = prose(7, 47)
    r = next(r for r in out if r.doc_id == 7)
    assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))


def test_rebalancing_moves_to_new_shards_only():
    r = random.Random(1)
    weights = {v: r.randint(0, 1000) for v in range(4096)}
    old = sharding.first_map(weights, 40)
    new = sharding.rebalanced(old, weights, 41)
    assert {new[v] for v in old if new[v] != old[v]} == {40}
    load = collections.Counter()
    for v, s in new.items():
        load[s] += weights[v]
    assert load[40] > 0.9 * sum(weights.values()) / 41
    fewer = sharding.rebalanced(old, weights, 39)
    assert max(fewer.values()) == 38


def test_maps_are_edited(docs, tmp_path):
    """A later call goes on from the stored map: few rows move, and all of them where a shard is new."""
    d, path = docs([(i, prose(i, 40 + i % 9), "a") for i in range(3000)]), str(tmp_path / "m")
    spark = d.sparkSession
    one = {r.doc_id: (r.vslot, r.shard) for r in sharding.shard(d, 8, map_path=path).collect()}
    assert sharding.load_map(spark, path)[0] == 2
    again = {r.doc_id: (r.vslot, r.shard) for r in sharding.shard(d, 8, map_path=path).collect()}
    assert again == one
    assert sharding.load_map(spark, path)[0] == 2
    out = sharding.shard(d, 9, map_path=path).collect()
    more = {r.doc_id: (r.vslot, r.shard) for r in out}
    assert sharding.load_map(spark, path)[0] == 3
    assert all(more[i][0] == one[i][0] for i in one)
    assert {more[i][1] for i in one if more[i] != one[i]} == {8}
    assert len(out) == 3000


def test_map_versions(spark, tmp_path):
    one = sharding.store_map(spark, {0: 0, 1: 1}, str(tmp_path / "m"), 1)
    two = sharding.store_map(spark, {0: 0, 1: 2}, str(tmp_path / "m"), 2)
    assert [r.shard for r in one.orderBy("vslot").collect()] == [0, 1]
    assert [r.shard for r in two.orderBy("vslot").collect()] == [0, 2]


PAGE = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 700_000 + "é"
    rows = [(3, "http://a/?q=a b%20\r\nX: y", big), (1, None, big), (2, "u", "small"), (4, "v", "small"), (5, None, None), (6, "w", ""), (None, "n", big), (7, "z", "y" * 100)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGE), f"file://{tmp_path}/w")
    got = {r.url if r.page_id is None else r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert len(got) == len(rows)
    assert got[3].url == rows[0][1]
    for i, _, html in rows:
        r = got["n" if i is None else i]
        data = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = html == big and i != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGE), f"file://{tmp_path}/e")).count() == 0


def test_warc_damage_is_seen():
    payload = b"<p>hello</p>" * 50
    data = warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)
    (r,) = warc.read_records(io.BytesIO(data), keep_payload=True)
    assert r["payload"] == payload
    wrong = warc.record(1, "u", payload, hashlib.sha256(b"other").hexdigest(), None, False)
    for bad in (wrong, data[:-20], data + data[:40]):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_tokens_round_trip(spark, odd, docs):
    import numpy as np
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_path())
    r = random.Random(2)
    extra = docs([(100 + i, "".join(r.choice(" \n\tab.,'é!1ñ日\r") for _ in range(r.randint(0, 50))), "a") for i in range(200)] + [(999, "a <|endoftext|> b", "a")])
    d = odd.unionByName(extra)
    path = base.scratch(spark, "t")
    tokens.write_tokens(d, path)
    back = tokens.read_tokens(spark, path)
    got = sorted(tokens.token_index(back).collect(), key=lambda x: x.start)
    rows = sorted(((x.doc_id, x.text or "") for x in d.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for x, (i, t) in zip(got, rows, strict=True):
        ids = [*model.encode(t, add_special_tokens=False).ids, 2]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [x.doc_id for x in tokens.find(back, [999]).collect()] == [999]
    assert tokens.token_index(tokens.read_tokens(spark, _written(spark, empty(d)))).count() == 0


def _written(spark, d):
    path = base.scratch(spark, "t")
    tokens.write_tokens(d, path)
    return path


def test_pii_base_spans_match_plain_regexes():
    def plain(t):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return out

    r = random.Random(3)
    parts = ["a", "b.", "@", "1", "22", ".", "+", "-", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "_", "é"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "." * 1000) == []


def loose_rows(seed, n):
    """(rows, truth): texts with one loose span each, personal or not, in sentences of many shapes."""
    r, rows, truth = random.Random(seed), [], {}
    names = "Anna Paul Elena Martin Sofia Zork Vexa Quil".split()

    def iban(good):
        body = "".join(r.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        check = check if good else (check + 1 + r.randint(0, 90)) % 97
        x = f"DE{check:02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, 22, 4))

    for i in range(n):
        kind, good = r.choice(("iban", "ssn", "person", "email_text")), r.random() < 0.6
        span = {
            "iban": iban(good), "person": f"Dr. {r.choice(names)} {r.choice(names)}", "email_text": f"{r.choice(names).lower()} [at] {r.choice(WORDS)} [dot] {'com' if good else 'qqx'}",
            "ssn": f"{r.randint(100, 600):03d}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if good else f"9{r.randint(10, 99)}-00-{r.randint(1000, 9999)}",
        }[kind]
        for_, against = {"iban": ("account", "serial"), "ssn": ("ssn", "part no"), "person": ("dear", "section"), "email_text": ("contact", "version")}[kind]
        if r.random() < 0.7:
            lead = r.choice((f"my {for_}", f"please use {for_}", f"the {for_} is")) if good else r.choice((f"see {against}", f"the {against}", f"old {against}"))
        else:
            lead = r.choice(("here comes", "so it was"))
        rows.append((i, f"{prose(seed * 1000 + i, 6)} {lead} {span} {prose(seed * 2000 + i, 5)}", "a"))
        truth[i] = (kind, good)
    return rows, truth


def test_pii_learns_which_loose_spans_to_add(docs):
    """The classifier is fitted on some rows and judged on others; those have no part in the fit."""
    rows, _ = loose_rows(1, 800)
    found = docs(rows).select("doc_id", "text").mapInArrow(pii._extract, f"doc_id long, found array<{pii.SPAN}>, text_key binary")
    weights, _ = pii.fit(found)
    rows, truth = loose_rows(2, 400)
    out = {r.doc_id: {pii.KINDS[s.kind] for s in r.spans} for r in pii.detect(docs(rows), weights=weights).collect()}
    for kind in ("iban", "ssn", "email_text"):
        right = [i for i, (k, good) in truth.items() if k == kind and good]
        wrong = [i for i, (k, good) in truth.items() if k == kind and not good]
        assert sum(kind in out[i] for i in right) >= 0.8 * len(right), kind
        assert sum(kind in out[i] for i in wrong) <= 0.4 * len(wrong), kind


def test_loose_spans_touch_no_fixed_one():
    r = random.Random(17)
    parts = ["123-45-6789", " ", "DE44 5001 0517 5407 3249 31", "+1 555 123 4567", "a@b.cd", "4111 1111 1111 1111", "1.2.3.4", "-", "Dr. Anna Weber", " joe [at] x [dot] com "]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        fixed = pii.base_spans(t)
        loose = [x for x in pii.candidates(t) if x[0] >= len(pii.BASE_KINDS)]
        every = [(pii.KINDS.index(n), m.start(), m.end()) for n, p in pii.LOOSE for m in p.finditer(t)]
        want = [x for x in every if not any(s < x[2] and x[1] < e for _, s, e in fixed)]
        assert [x[:3] for x in loose] == want


def test_pii_reliabilities_recover_planted_ones():
    r, truth, counts = random.Random(4), (0.95, 0.9, 0.8, 0.7, 0.6), collections.Counter()
    for _ in range(20_000):
        y, p = r.random() < 0.5, 0
        for a in truth:
            p = p * 3 + (1 if (r.random() < a) == y else 2)
        counts[0, p] += 1
    accuracy, _ = pii.reliabilities(counts)
    assert all(abs(a - b) < 0.05 for a, b in zip(accuracy, truth, strict=True))


def test_redaction(docs):
    d = docs([(1, "mail a@b.cd or +1 (609) 555-7932 é", "a"), (1, "1.2.3.4 of one id", "a"), (2, "nothing", "a"), (None, "a@b.cd", "a"), (None, "a@b.cd", "a"), (None, None, "a"), (3, "a@b.cd " * 5000, "a")])
    got = collections.Counter((r.doc_id, r.text) for r in pii.redact(d, pii.detect(d)).collect())
    assert got == {(1, "mail [email] or [phone] é"): 1, (1, "[ip] of one id"): 1, (2, "nothing"): 1, (None, "[email]"): 2, (None, None): 1, (3, "[email] " * 5000): 1}


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_match_plain_regexes(docs):
    r = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "apikey", "Secret", " ", "=", ":", '"', "'", "abc", "ABCDEF", "AKIA", "0123456789abcdef", "é", "😀", "Z9Z9Z9Z9Z9", "f"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25))), "a") for i in range(400)] + [(9999, "secret=" * 300, "a")]
    got = {x.doc_id: [tuple(s) for s in x.spans if s.number < 3] for x in secrets.scan(docs(rows)).collect()}
    for i, t, _ in rows:
        assert got[i] == plain_secrets(t), t


def test_added_rules_match_a_full_scan(docs):
    """Every rule with an index gives what its regex gives on whole texts, also where a text has thousands of matches."""
    r = random.Random(15)
    parts = ["-----BEGIN ", "RSA ", "OPENSSH ", "PRIVATE KEY-----", "ghp_", "gho_", "xoxb-", "AIza", "sk_live_", "eyJ", ".", "A1b2C3d4E5F6a7B8c9", "0123456789abcdefXY", "-", "_", " ", "é", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 20))), "a") for i in range(600)]
    rows += [(1000, "ghp_" + "a" * 36 + " xoxb-0123456789 AIza" + "b" * 35 + " sk_live_" + "c" * 16 + " eyJ" + "d" * 9 + ".eyJ" + "e" * 9 + "." + "f" * 9, "a"), (1001, "AKIA" + "Z" * 17 + " x " + "secret=abcdefgh " * 3000, "a")]
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets.scan(docs(rows)).collect()}
    for i, t, _ in rows:
        want = [(m.start(), n, m.end()) for n, rule in enumerate(rules) for m in re.finditer(rule.regex, t, re.ASCII) if len(m[rule.group]) >= rule.least]
        assert got[i] == sorted(want), t[:200]
    assert {n for s in got.values() for _, n, _ in s} == set(range(len(rules)))


def test_lists_are_read_by_trigram(spark, docs):
    d = docs([(1, "xabcx bcd", "a"), (2, "ABC", "a"), (3, "bcd", "a"), (3, "bcd", "a")])
    path = base.scratch(spark, "index")
    secrets.write_index(d.select("doc_id", "text", secrets.text_key().alias("text_key")), ["abc", "bcd"], path)
    assert secrets.read_lists(spark, path, ["abc"]).count() == 2
    assert "PartitionFilters: [isnotnull(list" in secrets.read_lists(spark, path, ["abc"])._jdf.queryExecution().toString()
    f = frozenset
    found = secrets.candidates(spark, path, {"both": (f({f({"abc", "bcd"})}),), "either": (f({f({"abc"}), f({"bcd"})}),)}).collect()
    assert sorted((r.both, r.either) for r in found) == [(False, True), (False, True), (True, True)]


def test_a_kept_index_serves_later_rules(spark, docs):
    """Lists that are there are read, not made: the texts are looked at for trigrams that no earlier rule set has asked for, and only then."""
    one, other = secrets.BASE_RULES[:2], (secrets.Rule("word", "secret=[a-z]+"), secrets.Rule("new", "quux-[0-9]+"), secrets.Rule("none", "zzyzx[0-9]"))
    d = docs([(1, "secret=abcdef quux-17", "a"), (2, "AKIA" + "Z" * 17, "a"), (None, None, None), (4, "quux-1 Quux-2", "b"), (4, "quux-1 Quux-2", "b")])
    path = base.scratch(spark, "kept")
    assert secrets.indexed_trigrams(spark, path) == []
    for rules in (one, other, one + other):
        got, want = ([(x.doc_id, [tuple(s) for s in x.spans]) for x in secrets.scan(d, rules, p).collect()] for p in (path, None))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {"sec", "aki", "quu", "ux-", "zzy"} <= set(secrets.indexed_trigrams(spark, path))
    unread = spark.range(3).select(F.raise_error(F.lit("read")).alias("text"), F.lit(b"x").alias("text_key"))
    assert secrets.write_index(unread, ["sec", "zzy"], path) == []
    with pytest.raises(Exception, match="read"):
        secrets.write_index(unread, ["sec", "+++"], path)
    assert "+++" not in secrets.indexed_trigrams(spark, path)
    # Lists that a lost job has written twice count once.
    texts = d.select("doc_id", "text", secrets.text_key().alias("text_key"))
    secrets.postings(texts, ["sec"]).select("text_key", F.hex("trigram").alias("list")).write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    assert [(x.doc_id, len(x.spans)) for x in secrets.scan(d, other[:1], path).filter("size(spans) > 0").collect()] == [(1, 1)]


def test_trigram_queries():
    q = secrets.trigram_query(r"(?i:foo|quux)[0-9]+bar?z")
    assert frozenset({frozenset({"foo"}), frozenset({"quu", "uux"})}) in q
    assert frozenset({frozenset({"bar", "arz"}), frozenset({"baz"})}) in q
    assert secrets.trigram_query("[0-9a-f]{24,}") == ()
    assert secrets.trigram_query("(?:abc)?") == ()


def test_licenses_match_brute_force(docs):
    apache = licenses.TEMPLATES[1][1]
    rows = [(1, f"{prose(1, 300)}\n{apache} {prose(2, 300)}", "a"), (2, prose(3, 200) + " MIT License MIT License gnu general public license", "a"), (3, apache.replace("obtain a copy", "fetch one"), "a"), (4, prose(5, 600), "a"), (5, "CC BY-NC é-Apache\nLicense", "a")]
    size = 2 * max(len(licenses._tokens(t)) for _, t in licenses.TEMPLATES)
    for r in licenses.scan(docs(rows)).collect():
        w = licenses._tokens(rows[r.doc_id - 1][1])
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, best = {x for _, x in places}, float(bool(places))
        for k in range(0, len(w), size // 2):
            b = set(w[k : k + size])
            for label, t in licenses.TEMPLATES:
                s = set(licenses._tokens(t))
                if len(b & s) >= licenses.THRESHOLD * len(s) - 1e-9:
                    labels.add(label)
                    best = max(best, len(b & s) / len(s))
        assert (r.n_words, r.n_base, r.labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert r.score == pytest.approx(best)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_quality_statistics(docs):
    rows = [(1, "a b c a b c\nx\nx\n\n x", "a"), (2, prose(1, 80) + "\n" + prose(1, 80), "a"), (3, "#* $ |é|\x0b<>&%", "a"), (4, "u v", "a")]
    for r in quality.judged(docs(rows), []).collect():
        t = rows[r.doc_id - 1][1]
        w = SPACE.findall(t)
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_hold_on_other_rows(spark, docs):
    junk = lambda i: " ".join(x + "***" for x in prose(i, 80).split())
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 80), "a") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(quality.labelled(docs(rows), labels))
    assert rules
    got = {r.doc_id: r.kept for r in quality.judged(docs(rows), rules).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(400, 800))
    assert quality.learn(quality.labelled(docs(rows), labels.limit(0))) == []


def test_leaks_are_found_with_substitutions(spark, docs):
    items = [(i, prose(100 + i, 15 + i)) for i in range(30)] + [(99, None), (98, ""), (97, "one two"), (95, "One, two."), (96, "Six words, not one more: here")]
    r, rows = random.Random(6), []
    for i in range(30):
        w = items[i][1].split()
        w = [x if r.random() > 0.1 else "zz" for x in w]
        rows.append((i, f"{prose(i, 60)} {' '.join(w).upper()}! {prose(500 + i, 60)}", "a"))
    rows += [(1000 + i, prose(2000 + i, 200), "a") for i in range(30)] + [(50, None, "a"), (51, "", "a"), (52, "six words not one more here", "a"), (53, "ONE two!", "a"), (54, "one two three", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_WORDS, 200):
        got = {(x.doc_id, x.item_id) for x in decontamination.overlaps(docs(rows), bench, block_words=block).collect()}
        assert got == {(i, i) for i in range(30)} | {(52, 96), (53, 97), (53, 95)}
    kept = {x.doc_id for x in decontamination.clean_rows(docs(rows), bench).collect()}
    assert kept == {i for i, _, _ in rows} - set(range(30)) - {52, 53}
    assert decontamination.overlaps(docs(rows), bench.limit(0)).count() == 0


def test_leaks_match_brute_force(docs):
    """All offsets of all items against all texts, by the rule that the module states."""
    words = re.compile(r"[^\W_]+")

    def overlap(x, item):
        for o in range(1 - len(item), len(x)):
            lo, hi = max(0, -o), min(len(item), len(x) - o)
            same = [x[o + i] == item[i] for i in range(lo, hi)]
            if sum(same) >= 0.6 * len(item) - 1e-9:
                return True
            for i in range(len(same)):
                for j in range(i + 13, len(same) + 1):
                    if sum(same[i:j]) >= 0.8 * (j - i) - 1e-9:
                        return True
        return False

    r = random.Random(21)
    few = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    items = [(i, " ".join(r.choice(few) if r.random() < 0.3 else f"{r.choice(WORDS)}{r.randint(0, 9)}" for _ in range(r.randint(6, 40)))) for i in range(40)]
    rows = []
    for d in range(120):
        w = prose(9000 + d, r.randint(0, 40)).split()
        src = items[r.randrange(40)][1].split()
        a, b = sorted(r.sample(range(len(src) + 1), 2))
        part = [x if r.random() > 0.25 * (d % 3) / 2 else "zz" for x in src[a:b]]
        rows.append((d, " ".join([*w, *part, *prose(d, r.randint(0, 20)).split()]), "a"))
    bench = docs(rows).sparkSession.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, _ in rows for i, item in items if overlap(words.findall(t.lower()), words.findall(item.lower()))}
    got = {(x.doc_id, x.item_id) for x in decontamination.overlaps(docs(rows), bench).collect()}
    assert got == want
    assert 20 < len(want) < 120


def brute_classes(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(docs):
    r, rows = random.Random(7), []
    for g in range(40):
        w = prose(g, 150).split()
        for c in range(r.randint(1, 5)):
            v = list(w)
            for _ in range(c):
                v[r.randrange(len(v))] = f"new{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(v), "a"))
    shared = prose(777, 120)
    rows += [(1000 + i, f"{prose(3000 + i, 60)} {shared} {prose(4000 + i, 60)}", "a") for i in range(40)]
    hub = prose(888, 200).split()
    for i in range(60):
        v = list(hub)
        v[3 * i] = f"only{i}"
        rows.append((2000 + i, " ".join(v), "a"))
    rows += [(5000, "", "a"), (5001, None, "a"), (5002, "two words", "a"), (5003, "two  words", "a"), (5004, "words two", "a")]
    found = neardup.classes(docs(rows)).collect()
    got = {x.doc_id: x.class_id for x in found}
    want = brute_classes(rows)
    assert got == want
    # Links are of different texts that are similar, and connect those of a class.
    text = {i: " ".join((t or "").split()) for i, t, _ in rows}
    for x in found:
        different = {text[i] for i, c in want.items() if c == x.class_id}
        similar = [neardup.similarity(neardup.labelled(a), neardup.labelled(b)) >= 0.8 for a, b in itertools.combinations(sorted(different), 2)] if x.class_id == x.doc_id else None
        assert x.class_texts >= len(different) and x.class_links >= x.class_texts - 1
        if similar is not None and x.class_texts == len(different):
            assert x.class_links <= sum(similar)
    assert sorted(x.doc_id for x in neardup.deduplicated(docs(rows + rows[:3])).collect()) == sorted(set(want.values()))


def test_order_matters():
    a, b = prose(1, 200).split(), prose(1, 200).split()
    assert neardup.similarity(neardup.labelled(" ".join(a)), neardup.labelled(" ".join(b[100:] + b[:100]))) < 0.8
    assert neardup.similarity(neardup.labelled(" ".join(a)), neardup.labelled(" ".join(["new", *a]))) > 0.9
    long = neardup.kmers(prose(2, 3 * neardup.PIECE))
    piece, neardup.PIECE = neardup.PIECE, 1 << 30
    try:
        whole = neardup.sketches(long)
    finally:
        neardup.PIECE = piece
    assert (neardup.sketches(long) == whole).all()


def test_parity_bits_bound_the_similarity():
    r = random.Random(5)
    for n in (1, 6, 60, 300, 2000):
        for share in (0.01, 0.03, 0.1):
            a = prose(n, n).split()
            b = [r.choice(WORDS) if r.random() < share else w for w in a]
            one, two = neardup.labelled(" ".join(a)), neardup.labelled(" ".join(b))
            x, y = one[0][one[1]], two[0][two[1]]
            *u, n_x = neardup.parity_bits(x).view("uint64").tolist()
            *v, n_y = neardup.parity_bits(y).view("uint64").tolist()
            differ = sum((i ^ j).bit_count() for i, j in zip(u, v, strict=True))
            assert (n_x, n_y) == (len(x), len(y))
            assert differ <= len(set(x.tolist()) ^ set(y.tolist()))
            if neardup.similarity(one, two) >= 0.8:
                assert 9 * differ <= n_x + n_y


def test_crowded_buckets_are_exhausted(docs):
    """Twins in a large family of copies that have drifted apart: most of their sketches are those of all the others, too."""
    r, core, rows = random.Random(8), prose(9, 120).split(), []
    for g in range(150):
        a = list(core)
        at = r.randrange(4, 40)
        a[at : at + 11] = [f"own{g}x{k}" for k in range(11)]
        b = list(a)
        at = r.randrange(60, 105)
        b[at : at + 7] = [f"twin{g}x{k}" for k in range(7)]
        rows += [(2 * g, " ".join(a), "a"), (2 * g + 1, " ".join(b), "a")]
    x, y, z = (neardup.labelled(rows[i][1]) for i in (0, 1, 2))
    assert neardup.similarity(x, y) >= 0.8 > neardup.similarity(x, z)
    got = collections.defaultdict(set)
    for m in neardup._members(docs(rows), 0.8, few=1).collect():
        got[m.root].add(m.doc_id)
    assert sorted(map(sorted, got.values())) == [[2 * g, 2 * g + 1] for g in range(150)]


def test_prefixes_of_similar_texts_meet():
    import numpy as np

    r, counts = random.Random(10), np.ones(neardup.COUNTERS, np.int64) * 2
    counts[::3] = 7
    for n in (1, 2, 5, 9, 10, 15, 40, 300):
        for _ in range(20):
            a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
            both = int(np.ceil(0.8 * n - 1e-9))
            b = np.unique(np.concatenate([r.sample(a.tolist(), both), [r.getrandbits(63) for _ in range(r.randint(0, max(0, int(both / 0.8 - n))))]]).astype(np.uint64))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert len(np.intersect1d(neardup.prefix(a, counts)[0], neardup.prefix(b, counts)[0]))


def test_near_copies_with_null_ids(docs):
    a, b, c = (prose(20 + i, 100) for i in range(3))
    rows = [(None, a, "a"), (None, a + " end", "a"), (None, a, "a"), (0, b, "a"), (None, b + " end", "a"), (None, c, "a"), (None, None, "a")]
    got = collections.Counter(tuple(x) for x in neardup.classes(docs(rows)).collect())
    assert got == {(None, None, 3, 2, 1): 3, (0, 0, 2, 2, 1): 1, (None, 0, 2, 2, 1): 1, (None, None, 1, 1, 0): 2}
    assert neardup.deduplicated(docs(rows)).count() == 4


def test_every_overlap_has_a_hit():
    """Whole items with as many substitutions as are allowed, and stretches of four equal words in five, at all places or many."""
    r, far = random.Random(11), " ".join(f"far{i}" for i in range(60))

    def found(equal, before="x y", after="z"):
        item = [f"w{i}" for i in range(len(equal))]
        text = " ".join([before, *(w if e else "other" for w, e in zip(item, equal, strict=True)), after])
        return decontamination.Seeds([(1, item)]).overlaps(text), decontamination.Seeds([(1, [*far.split(), *item, *far.upper().split()])]).overlaps(text)

    for n in range(6, 14):
        for off in itertools.combinations(range(n), n - (3 * n + 4) // 5):
            whole, _ = found([i not in off for i in range(n)])
            assert whole, (n, off)
    for n in range(14, 40):
        for _ in range(40):
            off = r.sample(range(n), n - (3 * n + 4) // 5)
            assert found([i not in off for i in range(n)])[0], (n, off)
            off = r.sample(range(n), n // 5)
            assert found([i not in off for i in range(n)])[1], (n, off)
    assert found([i % 4 != 3 for i in range(15)])[1]
    assert not found([i not in (2, 5, 8) for i in range(13)])[1]
