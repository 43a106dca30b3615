"""The stages of the corpus pipeline against plain versions, one after the other and on odd tables."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_learnt import brute_groups
from tokenizers import Tokenizer

from kgaudit.llm import mixing, near_dedup, quality

ROWS = [
    (1, None, None, "a"), (2, "", None, "a"), (3, "The same text of a few plain words", None, "b"), (4, "the SAME text of a few plain words", None, "b"), (None, "lone words here", None, None),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None, "a"), (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", None, "a"),
    (7, "twice", None, "c"), (7, "twice", None, "c"), (8, "word " * 3000, None, "b"), *[(20 + i, f"document {i} of source d holds {i * 7} and {i * 13}", None, "d") for i in range(30)],
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture
def folder(spark, tmp_path, corpus):
    def make(rows, marks=()):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        corpus(rows).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(list(marks), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return make


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, corpus, folder):
    marks = [(i, int(i not in (1, 2)), 0) for i in [*range(1, 9), *range(20, 50)]]
    path, docs = folder(ROWS, marks), corpus(ROWS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    score = lambda t: model.scores([t or ""])[0]
    kept = stages["quality classifier"](spark, docs, path)
    assert rows_of(kept) == collections.Counter((i, t) for i, t, *_ in ROWS if score(t) >= 0.3)

    one = stages["exact dedup"](spark, docs, path)
    best = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        best[lower(t)].append((i is not None, i or 0, i))
    assert collections.Counter(r.doc_id for r in one.collect()) == collections.Counter(max(x)[2] for x in best.values())

    named = [r for r in ROWS if r[0] is not None and r[0] != 7]
    apart = stages["MinHash near-dedup"](spark, corpus(named), path)
    assert {r.doc_id for r in apart.collect()} == {i for i, _, _, stays in brute_groups([r[:2] for r in named]) if stays}

    mixed = collections.Counter(r.doc_id for r in stages["mixing sources to target weights"](spark, corpus(named), path).collect())
    for r in mixing.mix(corpus(named)).collect():
        unit = int(hashlib.md5(f"draw{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert mixed[r.doc_id] == (int(r.taken / r.size + unit) if r.size else 0)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in named}
    pieces = collections.defaultdict(dict)
    for r in stages["packing"](spark, corpus(named), path).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        pieces[r.doc_id][r.start] = r.length
    assert {i: sum(p.values()) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name


def test_whole_run(spark, folder):
    """Each stage works on what the one before kept; nothing comes from a text that was dropped."""
    path = folder(ROWS, [(i, 1, 0) for i in range(20, 50)])
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} <= {i for i, *_ in ROWS} and not {3, 6} & {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_no_copy_survives(spark, corpus):
    kept = near_dedup.drop_near_copies(corpus(ROWS)).collect()
    assert collections.Counter(r.doc_id for r in kept)[5] == 1 and 6 not in {r.doc_id for r in kept}
