"""Token counts, packing, archive, near-dedup and the classifiers against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgaudit.llm import archive, language_id, near_dedup, packing, quality, tokenizing, toxicity
from kgaudit.llm.components import components

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["ab", "don't", "I'll", "é", "é", "  ", " ", "\n", "\n\n", "\t ", "123", "!!", "<|endoftext|>", "漢字", "🙂", " ", "İ", "'s", "x" * 30, "_", "\r\n"]
ODD = ["", None, " ", "\n", "a", "x" * 3000, "word " * 3000, "Same", "Same", "&&& 12"]


def noise(rnd, n):
    return "".join(rnd.choice(ATOMS) + rnd.choice([" ", "", " ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_equal_whole_text(path):
    """Splices of overlapping chunks, also where no word boundary is near."""
    tok, rnd = tokenizing.load_tokenizer(path), random.Random(4)
    for trial in range(150):
        text = noise(rnd, rnd.randint(0, 300)) if trial % 5 else "x" * rnd.randint(1, 900)
        assert tokenizing.chunked_ids(tok, text, 200, 40) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_equal_whole_text(path):
    tok, rnd = tokenizing.load_tokenizer(path), random.Random(5)
    count = tokenizing.PieceMemo(tokenizing.piece_lengths(path), entries=20)
    ids = tokenizing.PieceMemo(tokenizing.piece_ids(path), entries=20)
    for _ in range(400):
        text = noise(rnd, rnd.randint(0, 30))
        cut = tokenizing.pieces(text)
        if cut is not None:
            want = tok.encode(text, add_special_tokens=False).ids
            assert sum(count.of([cut])[0]) == len(want)
            assert b"".join(ids.of([cut])[0]) == np.array(want, "<u4").tobytes()


def test_ranks_give_the_same_ids():
    """The faster encoding of a plain byte-level file, on any text; other files have none."""
    tok, rnd, fast = tokenizing.load_tokenizer(BYTE), random.Random(9), tokenizing.by_ranks(BYTE)
    for k in range(400):
        text = noise(rnd, rnd.randint(0, 60)) if k % 2 else "".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x400, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(60))
        text = text.replace("<|endoftext|>", "")
        assert fast(text) == tok.encode(text, add_special_tokens=False).ids
    assert tokenizing.by_ranks(WORD) is None


def test_token_counts(corpus):
    rows = list(enumerate([*ODD, noise(random.Random(1), 400)])) + [(None, "lone"), (1 << 60, "big id")]
    tok = Tokenizer.from_file(WORD)
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = tokenizing.token_counts(corpus(rows), WORD, limit=100, chunk=500).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokenizing.token_counts(corpus([]), WORD).count() == 0


def test_best_fit():
    """The tree finds what a scan of all open windows finds."""
    lengths = np.random.default_rng(2).integers(1, 1024, 700)
    number, offset = packing.best_fit(lengths)
    room = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in room.values() if c >= lengths[i]]
        w = number[i]
        assert (room[w] == min(fits)) if fits else w not in room
        assert offset[i] == 1024 - room.get(w, 1024)
        room[w] = room.get(w, 1024) - lengths[i]


def test_packing(corpus):
    rows = list(enumerate([*ODD, *["some words " * (i % 50) for i in range(300)]])) + [(None, "lone"), (3, "\n")]
    tok = Tokenizer.from_file(BYTE)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    got = packing.pack(corpus(rows), BYTE, shard_pieces=100).collect()
    assert sum(r.length for r in got) == sum(len(a) for x in ids.values() for a in x)
    for r in got:
        parts = [a[r.start : r.start + r.length] for a in ids[r.doc_id] if len(a) == r.doc_tokens]
        assert any(zlib.crc32(p.tobytes()) == r.ids_crc32 and len(p) == r.length for p in parts)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(corpus([]), BYTE).count() == 0


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/\n1", big), (7, None, big), (5, "u", big), (2, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "u", big), (7, "v", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("header", F.lit("x")).withColumn("address", F.lit("y"))
    folder = str(tmp_path / "archive")
    archive.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    got = archive.read_records(spark, folder).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    for r in got:
        body = bytes(r.payload)
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        want = body in (b"small", b"") or r.page_id == 7
        assert r.record_type == ("response" if want else "revisit") and r.refers_to == (None if want else 7)
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
        assert block.endswith((body if want else b"") + b"\r\n\r\n")
        assert r.payload_digest == hashlib.sha1(body).hexdigest() and r.payload_bytes == len(body)
    digest = archive.archive_digest(pages).collect()
    assert sorted(map(str, digest)) == sorted(str(r) for r in archive.read_records(spark, folder).select(*digest[0].__fields__).collect())
    assert archive.archive_digest(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part, change", [("payloads", "payload"), ("headers", "digest"), ("headers", "length"), ("payloads", "missing")])
def test_damaged_archives_are_noticed(spark, tmp_path, monkeypatch, part, change):
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "b" * 1500)], "page_id bigint, url string, html string")
    folder, other = str(tmp_path / "good"), str(tmp_path / "bad")
    archive.write_archive(pages, folder)
    for name in ("payloads", "headers"):
        df = spark.read.parquet(f"{folder}/{name}")
        if name == part:
            swap = lambda a, b: df.withColumn("header", F.regexp_replace("header", a, b))
            df = {
                "payload": lambda: df.withColumn("payload", F.concat("payload", F.lit(b"!"))), "digest": lambda: swap("sha1:[0-9a-f]{3}", "sha1:000"),
                "length": lambda: swap("Length: ", "Length: 9"), "missing": lambda: df.filter("n_bytes = 2000"),
            }[change]()
        df.write.parquet(f"{other}/{name}")
    assert [r.verified for r in archive.read_records(spark, folder).collect()] == [True, True]
    assert len(got := archive.read_records(spark, other).collect()) == 2 and not all(r.verified for r in got)
    monkeypatch.setattr(archive, "shared_folder", lambda *_: other)
    monkeypatch.setattr(archive, "write_archive", lambda *_, **__: None)
    with pytest.raises(Exception, match="does not match"):
        archive.archive_digest(pages).collect()


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_near_duplicates(corpus, monkeypatch):
    """Near copies, common passages, short and empty texts; large buckets are split."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, passage, rows = draw(80), draw(60), []
    for i in range(160):
        if i % 4 == 0:
            w = list(base)
            for _ in range(rnd.choice([1, 2, 3, 4])):
                w[rnd.randrange(80)] = rnd.choice(vocabulary)
        elif i % 4 == 1:
            w = draw(rnd.randint(5, 40)) + passage
        elif i % 4 == 2:
            w = draw(rnd.randint(0, 9))
        else:
            w = passage + draw(rnd.randint(10, 25))
        rows.append((i * 3 % 160, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a B"), (504, "x " * 20_000)]
    got = near_dedup.near_duplicates(corpus(rows)).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_near_duplicates_in_large_mixed_buckets(corpus, monkeypatch):
    """Couples just above the limit, all in large buckets of one family just under it."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    core = [f"c{k}" for k in range(400)]
    rows = []
    for i in range(300):
        shared, own = [f"p{i // 2}_{k}" for k in range(39)], [f"o{i}_{k}" for k in range(67)]
        rows.append((i, " ".join(core + shared + own)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(corpus(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_near_duplicates_odd_ids(corpus):
    text = "one two three four five six seven"
    got = near_dedup.near_duplicates(corpus([(None, text), (4, text), (4, text), (4, "other words here"), (9, "other words here")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, None, True), (4, 4, True), (4, 4, True), (4, 4, True), (9, 4, False)], key=str)
    assert near_dedup.near_duplicates(corpus([])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 60, 5000):
        sketch = near_dedup.similarity_sketch(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert len(sketch) == 192 and not (sketch == near_dedup._FREE).any()
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    seen = [np.mean(near_dedup.similarity_sketch(a) == near_dedup.similarity_sketch(np.concatenate([a[60:], rng.integers(0, 1 << 63, 60).astype(np.uint64)]))) for _ in range(60)]
    assert abs(np.mean(seen) - 240 / 360) < 0.02


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_language(spark, corpus, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    learnt = language_id.profiles(docs)
    plain = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            padded = "".join(c if c.isalpha() else " " for c in r.text.lower()).split()
            for w in padded:
                s = f" {w} "
                plain[r.lang].update(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g.strip())
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    for lang, counts in plain.items():
        best = sorted(((-n, code(g)) for g, n in counts.items() if g != " "))[:300]
        assert [c for _, c in best] == learnt[lang].tolist()
    got = language_id.languages(docs, learnt).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = {r.doc_id: r for r in language_id.languages(corpus(list(enumerate([None, "", " 12 !", "the thing"]))), learnt).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred == "en"
    assert language_id.languages(corpus([]), {}).count() == 0


def test_quality(spark, corpus, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85
    odd = corpus(list(enumerate(ODD)))
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(odd, model).collect())
    assert quality.drop_poor(odd, model).columns == odd.columns
    constant = quality.fit(odd, labels.limit(0))
    assert len({r.score for r in quality.quality_scores(odd, constant).collect()}) == 1


def test_contexts_equal_plain_sums(spark, corpus, monkeypatch):
    """Rolling sums over many texts together, and over parts of long ones, against neighbour by neighbour."""
    monkeypatch.setattr(quality, "_TOGETHER", 37)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["One", "two", "THREE", "4", "five!", "é"]) for _ in range(n)) for n in (0, 1, 2, 3, 30, 36, 37, 38, 200)]
    want = np.zeros((quality._VOCAB, quality.DIM))
    vectors = quality.dense_vectors()
    for text in texts:
        words, shapes = quality.word_ids(text)
        for i, w in enumerate(words):
            want[w] += vectors[shapes[i]]
            want[shapes[i]] += vectors[w]
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    want[w] += vectors[words[j]].astype(int) + vectors[shapes[j]]
    got = np.zeros((quality._VOCAB + 1, quality.DIM), np.int64)
    for words, shapes, own in quality._together(texts):
        quality.add_contexts(got, words, shapes, vectors, own)
    assert (got[:-1] == want).all()
    want -= want.mean(0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    whole = quality.word_vectors(corpus(list(enumerate(texts))))
    assert np.allclose(whole, unit(want) + unit(vectors[:-1].astype(float)), atol=1e-3)


def test_pooled_features():
    vectors = np.random.default_rng(3).normal(size=(quality._VOCAB, quality.DIM)).astype(np.float32)
    text = "the cat The cat sat SAT 12 ! cat cat"
    words, shapes = quality.word_ids(text)
    n, counts = len(words), collections.Counter(words.tolist())
    kinds = [np.mean(shapes == quality.WORDS + k) for k in range(4)]
    again = sum(a == b for a, b in zip(words, words[1:])) / (n - 1)
    apart = sum(a == b for a, b in zip(words, words[2:])) / (n - 2)
    want = [*np.mean([vectors[w] for w in words], 0), *kinds, len(counts) / n**0.5, max(counts.values()) / n, again, apart, np.log1p(n)]
    assert kinds == [0.6, 0.1, 0.1, 0.2] and np.allclose(quality.pooled(text, vectors), want, atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    z, y, weight = rng.normal(size=(20, 6)), rng.integers(0, 2, 20).astype(float), rng.random(20) + 0.5
    params = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]

    def loss():
        p = 1 / (1 + np.exp(-(np.maximum(z @ params[0] + params[1], 0) @ params[2] + params[3])))
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean() + 0.05 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    for p, g in zip(params, quality.gradients(params, z, y, weight, 0.1)):
        for at in np.ndindex(p.shape):
            p[at] += 1e-6
            up = loss()
            p[at] -= 2e-6
            assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-4)
            p[at] += 1e-6


def test_quality_odd_rows(spark, corpus):
    """Null ids, repeated rows, clashing names, empty tables, a text column of another name."""
    rows = [(None, "lone words"), (3, "same"), (3, "same"), (1 << 60, "long " * 60_000), (4, None)]
    df = corpus(rows)
    model = quality.QualityModel(np.zeros((quality._VOCAB, quality.DIM), np.float32), quality.fit_network(np.zeros((0, quality.DIM + 9)), np.zeros(0), 0.9))
    got = quality.quality_scores(df, model).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows) and {r.predicted for r in got} == {1}
    other = df.withColumnRenamed("text", "body").withColumn("text", F.lit("x")).withColumn("row", F.lit("y"))
    kept = quality.drop_poor(other, model, text_col="body")
    assert kept.columns == other.columns and kept.count() == len(rows) and {r.text for r in kept.collect()} == {"x"}
    empty = corpus([])
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.quality_scores(empty, quality.fit(empty, labels)).count() == 0 and quality.drop_poor(empty, model).count() == 0


def test_quality_uses_all_texts_and_no_held_out_label(spark, corpus, monkeypatch):
    """Words of unlabelled documents have contexts; the prior leaves out the held-out fold."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in range(200) if fold(i)][:40] + [i for i in range(200) if not fold(i)][:20]
    docs = corpus([(i, f"plain words number {i % 7} here") for i in ids] + [(1000, "zebra quagga zebra quagga okapi")])
    labels = spark.createDataFrame([(i, int(not fold(i) or k % 4 == 0)) for k, i in enumerate(ids)], "doc_id bigint, quality int")
    seen, fit_network = [], quality.fit_network
    monkeypatch.setattr(quality, "fit_network", lambda x, y, prior: seen.append(prior) or fit_network(x, y, prior))
    vectors = quality.fit(docs, labels).vectors
    assert seen == [0.25]
    zebra, quagga = (quality.word_ids(w)[0][0] for w in ("zebra", "quagga"))
    unused = quality.word_ids("nowhere")[0][0]
    index = quality.dense_vectors().astype(float)
    own, near = index[zebra], index[quagga]
    context = vectors[zebra] - own / np.linalg.norm(own)
    assert np.dot(context, near) / np.linalg.norm(near) > 0.3 and len({zebra, quagga, unused}) == 3


def test_toxicity(spark, corpus):
    """Insults that the labels show are found, also with a character put in; clean texts are left alone."""
    rnd = random.Random(6)
    clean = lambda: " ".join(rnd.choice("abcdefghij") + rnd.choice(["alo", "eru", "ino"]) + rnd.choice(["", "ta", "ve"]) for _ in range(60))
    insults = ["stinkard", "blockhead", "wretch"]
    rows, marks = [], []
    for i in range(240):
        text = clean()
        if i % 3 == 0:
            w = text.split()
            for _ in range(3):
                w.insert(rnd.randrange(60), rnd.choice(insults))
            text = " ".join(w)
        rows.append((i, text))
        marks.append((i, int(i % 3 == 0)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit(corpus(rows), labels)
    got = toxicity.toxicity_scores(corpus(rows), model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    probes = [clean() + " you blo-ckhead and stinxkard, w r e t c h", clean(), "", None, " "]
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(corpus(list(enumerate(probes))), model).collect()}
    assert scored == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}
    constant = toxicity.fit(corpus(rows), labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(corpus(rows[:3]), constant).collect()} == {0.5}


def test_kernel_counts_subsequences():
    """Against the definition: all triples of positions, weighted by their span."""

    def plain(s):
        c = collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    c[s[i] + s[j] + s[k]] += toxicity.LAMBDA ** (k - i + 1)
        return c

    def dot(a, b):
        return sum(v * b[g] for g, v in a.items())

    words = ["banana", "bandana", "nab", "abcabcabc"]
    got = toxicity.Landmarks(words, 2).all_values(words)
    for i, a in enumerate(map(plain, words)):
        for j, b in enumerate(map(plain, words)):
            k = dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))
            assert got[i, j] == pytest.approx(np.exp(toxicity.SHARPNESS * (k - 1)), rel=1e-4)
