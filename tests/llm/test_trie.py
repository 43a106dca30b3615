"""The conversation trie against a plain trie of tuples."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kgaudit.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    turns = collections.defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + ts[h:]
    nodes = collections.defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, cs in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(n))
        out.append((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        for name in ("depth", "rep", "pos", "h", "weight", "block", "score"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


def check(table, rows, **options):
    got = prefix_trie.prefix_trie(table(rows), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_shared_starts(table):
    """Short alphabets make many common prefixes, equal conversations and ones that end inside others."""
    rnd = random.Random(8)
    rows = [(c, n, rnd.choice("ua"), rnd.choice(["x", "yé"])) for c in range(-20, 130) if c % 7 for n in range(rnd.randint(1, 12))]
    check(table, rows)


def test_odd_rows(table):
    """Nulls anywhere, equal turn numbers, repeated rows, a conversation that loses all its turns."""
    gone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    rows = [(gone, 1, "u", "a"), (200, None, "u", None), (200, 1, None, "b"), (200, 1, "u", "b"), (200, 1, "u", "b"), (201, 0, None, ""), (None, 1, "u", "lost"), (1 << 60, 3, "u", "t" * 30_000)]
    check(table, rows)
    assert prefix_trie.prefix_trie(table([])).count() == 0


def test_long_and_common_conversations(table, monkeypatch):
    """A conversation of many blocks, and one that most ids hold, whose ends come in parts."""
    monkeypatch.setattr(prefix_trie, "PART", 7)
    rows = [(5, n, "u", f"t{n % 11}") for n in range(100)] + [(10, n, "u", f"t{n % 11}") for n in range(60)]
    rows += [(1000 + 5 * k, n, "u", f"s{n}") for k in range(90) for n in range(3)]
    check(table, rows, block=8)
