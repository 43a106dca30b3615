"""Exact dedup, mixing and fingerprints against plain Python."""

import collections
import functools
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kgaudit.llm import exact_dedup, fingerprints, mixing

ODD = [
    (5, "Same text"), (9, "same TEXT"), (7, "same text"), (1, None), (2, ""), (3, "É é"), (4, "é é"), (None, "lone"), (None, "same text"),
    (8, "x" * 50_000), (8, "x" * 50_000), (6, "line\nline\nother\n"),
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def copies(rows, best):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(corpus, keep, best, weak):
    """With a hash of two values, only the comparison of the bytes can tell texts apart."""
    hash_of = (lambda t: F.substring(F.md5(t.cast("binary")), 1, 1) < "8") if weak else exact_dedup.content_hash
    got = exact_dedup.exact_duplicates(corpus(ODD), keep=keep, hash_of=hash_of)
    assert sorted((tuple(r) for r in got.collect()), key=str) == copies(ODD, best)


def test_drop_copies(corpus):
    got = exact_dedup.drop_copies(corpus(ODD), keep="largest")
    assert got.columns == corpus(ODD).columns
    assert collections.Counter(lower(r.text) for r in got.collect()) == {t: 1 for t in {lower(t) for _, t in ODD}}
    assert exact_dedup.drop_copies(corpus([])).count() == 0


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by handing out, capping and handing out the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def mix_rows():
    rows = [(i, "w " * (1 + i * 7 % 40), None, ("big", "b", "c", "é", None)[min(4, i % 9)]) for i in range(300)]
    return rows + [(900, None, None, "big"), (901, " \n", None, "blank"), (902, "v " * 3000, None, "long"), (5, rows[5][1], None, rows[5][3])]


def test_mix(corpus):
    rows = mix_rows()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = shares(sizes)
    got = mixing.mix(corpus(rows), block_words=16).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, words(t)) for i, t, *_ in rows)
    source = {i: s for i, _, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(corpus(rows[::-1]), block_words=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(corpus([])).count() == 0


def test_schedule_interleaves(corpus):
    """Every stretch of slots holds each source about as often as its target says."""
    rows = [(i, "w " * 64, None, "abc"[i % 3]) for i in range(300)]
    targets = mixing.source_targets(mixing.sized(corpus(rows)))
    slots = [r.source_no for r in mixing.schedule(targets, 16).filter("slot IS NOT NULL").orderBy("slot").collect()]
    for start in range(0, len(slots) - 120, 60):
        part = collections.Counter(slots[start : start + 120])
        assert all(abs(part[k] - 20 * (k + 1)) <= 4 for k in range(3))


def spark_hash(*parts):
    """Spark's xxhash64 of strings; nulls leave the seed as it is."""
    h = 42
    for x in parts:
        if x is not None:
            h = xxhash.xxh64_intdigest(x.encode(), h)
    return h


def ends_word(c):
    return (c.isascii() and 35 <= ord(c) < 127 and (ord(c) - 35) % 7 == 0) or (0xC0 <= ord(c) < 0x700 and (ord(c) - 0xC0) % 32 < 4)


def pieces(text):
    """Character by character: what a line, a fitting word or, in long pieces, a fitting run of three ends."""
    out = [""]
    for i, c in enumerate(text):
        if c == "\n" or (c == " " and i and ends_word(text[i - 1])):
            out.append("")
        else:
            out[-1] += c
    cut = []
    for piece in out:
        cut.append("")
        for i, c in enumerate(piece):
            cut[-1] += c
            run = [piece[k] if k >= 0 else None for k in (i - 2, i - 1, i)]
            if len(piece) > 512 and i < len(piece) - 1 and spark_hash(*run) % 64 == 0:
                cut.append("")
    return cut


def paragraphs(t):
    """Pieces and words of the opening, each with the number of its repeat."""
    counts = collections.Counter(pieces(t)), collections.Counter(re.split("[ \n]", t[:64]))
    return {(kind, x, k) for kind, c in enumerate(counts) for x, n in c.items() for k in range(n)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_fingerprints(corpus, n):
    rows = [(i * 3, "\n".join(f"line {(i * j) % 37}" for j in range(i * 5 % 90 + 1))) for i in range(n)] + [(None, None)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(corpus(rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    for k, (i, _) in enumerate(order):
        own, other = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(paragraphs(own), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(own), paragraphs(other)))
    assert fingerprints.fingerprints(corpus([])).count() == 0


def test_long_lines_and_repeats(spark, corpus):
    """Documents of one line, with and without blanks, and of one repeated word, stay alike after an edit of their end."""
    rows = [(i, " ".join(f"w{(i * 7919 + k * k * 31) % 5003}" for k in range(400))) for i in range(4)]
    rows += [(9, "".join(f"{k * k * 37 % 10007:x}" for k in range(2000))), (10, "буква слово привет мир " * 60), (11, "same " * 2000), (12, "x" * 3000), (13, "a few words only")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(corpus(rows)).collect()}
    assert all(r.near_edited > (0.05 if i == 11 else 0.3) and r.near_next < r.near_edited for i, r in got.items())
    texts = spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", fingerprints.paragraphs(F.col("t")).alias("p")).collect()
    assert all(r.p == pieces(r.t) for r in texts)
    order = sorted(rows, reverse=True)
    for k, (i, own) in enumerate(order):
        other, half = order[(k + 1) % len(order)][1], len(own) // 2
        after = own[: len(own) - half] + other[:half]
        assert got[i].near_edited == pytest.approx(jaccard(paragraphs(own), paragraphs(after)))
        assert got[i].near_next == pytest.approx(jaccard(paragraphs(own), paragraphs(other)))


def test_hot_ids(corpus):
    """One id in a third of all rows, a third of null ids, repeated rows: each row has a next one, and the order is a circle."""
    rows = [(7, f"hot {i}") for i in range(60)] + [(None, f"none {i}") for i in range(50)] + [(i * 1000, f"own {i}") for i in range(50)] + [(3, "twice")] * 2
    got = fingerprints.with_next(corpus(rows).select("doc_id", "text"), per_bucket=4, segments=8).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    assert collections.Counter(r.next_text for r in got) == collections.Counter(t for _, t in rows)
    ids = {t: i for i, t in rows}
    rank = lambda i: (i is None, -(i or 0))
    down = sum(rank(ids[r.next_text]) < rank(r.doc_id) for r in got)
    assert down == 1


def test_peeling_recovers_digests(spark):
    """Few differences, many, none; a bad first guess needs larger sketches, and a hopeless one a plain comparison."""
    sets = [([*range(50)], [*range(4, 50), 99]), ([*range(400)], [*range(200, 900)]), ([], [1]), ([3], [3]), ([*range(1000)], [*range(1000, 1100)]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sets)], "no bigint, a array<bigint>, b array<bigint>")
    want = {(i, "a", x) for i, (a, b) in enumerate(sets) for x in {*a} - {*b}} | {(i, "b", x) for i, (a, b) in enumerate(sets) for x in {*b} - {*a}}
    for size in (fingerprints.first_size(F.col("a"), F.col("b")), F.lit(36)):
        pairs = df.withColumn("size", size)
        assert {tuple(r) for r in fingerprints.differing(pairs, ["no"]).collect()} == want
        found = {r.no: r for r in fingerprints.difference_sizes(pairs, ["no"]).collect()}
        for i, (a, b) in enumerate(sets):
            n = (len({*a} - {*b}), len({*b} - {*a}))
            assert n == ((found[i].only_a, found[i].only_b) if i in found else (0, 0))
    assert any(r.tries > 0 for r in found.values())


def test_peeling_falls_back(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RETRIES", 2)
    pairs = spark.createDataFrame([(1, [*range(3000)], [7])], "no bigint, a array<bigint>, b array<bigint>").withColumn("size", F.lit(36))
    assert [tuple(r) for r in fingerprints.difference_sizes(pairs, ["no"]).collect()] == [(1, 2999, 0, -1)]
    assert fingerprints.differing(pairs, ["no"]).count() == 2999


def spark_hash_long(*parts):
    """Spark's xxhash64 of longs (int: 8 bytes), ints (bytes: 4) and strings."""
    h = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x if isinstance(x, bytes) else (x % 2**64).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(raw, h)
    return h


def test_fingerprint_text(spark):
    """Cells of both sides against a sum in plain Python."""
    sets = [([*range(-30, 30)], [5, 2**62, -(2**63)]), ([7], [7]), ([1, 2, 3], [*range(500)])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sets)], "no bigint, a array<bigint>, b array<bigint>")
    got = {r.no: r for r in fingerprints.sketched(df, ["no"]).collect()}
    for i, pair in enumerate(sets):
        for digests, cells in zip(pair, (got[i].a_cells, got[i].b_cells)):
            want = {}
            for d in digests:
                place, check = spark_hash_long(d, (0).to_bytes(4, "little")), spark_hash_long(d, "check") >> 32
                for k in range(3):
                    cell = want.setdefault(12 * k + ((place >> 21 * k) % 2**21) % 12, [0, 0, 0])
                    cell[:] = [cell[0] + 1, cell[1] ^ d % 2**64, cell[2] ^ check]
            assert cells.hex().upper() == "".join(f"{c:02X}{n:08X}{key:016X}{check:08X}" for c, (n, key, check) in sorted(want.items()))


def test_digests_are_made_once(spark, corpus, monkeypatch):
    """A text and its edited text are digested once each, besides one guard a bucket."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    digests, ahead = fingerprints.paragraph_digests, fingerprints.with_next
    monkeypatch.setattr(fingerprints, "paragraph_digests", lambda text: digests(counted(text)))
    monkeypatch.setattr(fingerprints, "with_next", functools.partial(ahead, per_bucket=50, segments=2))
    rows = [(i, f"text {i}\nof {i % 7} lines") for i in range(200)]
    assert len(fingerprints.fingerprints(corpus(rows)).collect()) == 200
    assert 400 <= calls.value <= 420
