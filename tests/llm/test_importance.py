"""Importance resampling against plain counting."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from kgaudit.llm import importance


def words_of(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(t, n=10_000, longest=2):
    w = words_of(t)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def noise(rnd, n):
    return "".join(rnd.choice(["ab", "Cd", " ", ", ", "é", "12", "\n", "_", "漢", "\x7f"]) for _ in range(n))


@pytest.mark.parametrize("longest", [1, 2, 4])
@pytest.mark.parametrize("slab", [40, 1 << 22])
def test_features(monkeypatch, longest, slab):
    """CRCs from running ones equal those of the bytes, also in texts that are scanned in parts."""
    monkeypatch.setattr(importance, "SLAB", slab)
    rnd = random.Random(2)
    texts = ["", "a", "  ", "Abc DEF", "x" * 3000, " a b, c!"] + [noise(rnd, rnd.randint(0, 150)) for _ in range(300)]
    for n in (10_000, 1 << 20):
        counts, found = importance.feature_buckets(texts, n, longest)
        for t, c, f in zip(texts, counts, found, strict=True):
            assert c == len(words_of(t))
            assert sorted(np.frombuffer(f, "<u2" if n == 10_000 else "<u4").tolist()) == sorted(buckets_of(t, n, longest))


def test_running_crcs():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    ends = np.array([0, 1, 2, 63, 64, 65, 999, 4999, 5000])
    got = importance.running_crcs(data, ends)
    start = importance.shifted(np.full(len(ends), 0xFFFFFFFF, np.uint32), ends)
    assert (got ^ start ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(data[:e].tobytes()) for e in ends]


def plain(rows, aims):
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(buckets_of(x))
    for x in aims:
        t.update(buckets_of(x))
    total, aim = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, x in rows:
        f = buckets_of(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * aim))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    many = [r for r, (_, x) in zip(out, rows, strict=True) if len(words_of(x)) >= 20]
    for k, r in enumerate(sorted(many, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))[: len(many) * 25 // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def test_resample(spark, corpus):
    rnd = random.Random(9)
    draw = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, draw(["red", "blue", "One", "two,"] if i % 3 else ["sun", "moon", "one"], rnd.randint(0, 60))) for i in range(200)]
    rows += [(None, draw(["sun"], 40)), (None, None), (7, draw(["sun", "moon"], 30)), (7, rows[7][1]), (900, ""), (901, "sun moon " * 20_000), (1 << 60, "é " * 25)]
    aims = ["sun moon sun", "the moon", None, ""]
    target = spark.createDataFrame([(k, a) for k, a in enumerate(aims)], "item_id bigint, text string")
    got = importance.resample(corpus(rows), target).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, aims)
    again = importance.resample(corpus(rows[::-1]), target).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(corpus([]), none).count() == 0
    rows = [(i, "word " * 25) for i in range(8)]
    assert sorted((tuple(r) for r in importance.resample(corpus(rows), none).collect()), key=str) == plain(rows, [])
