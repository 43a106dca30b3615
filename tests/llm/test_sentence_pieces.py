"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kgaudit.llm import sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ATOMS = [
    "ab", "don't", "é", "é", " ", "  ", " " * 17, "\n", "\n\n", "\t ", "123", "!!", "<s>", "<0x0A>", "<unk>", "漢字", "🙂", "▁", "▁▁x", "x" * 30, "\r\n", "\x00", "the",
    "aaaa", "haha", " ", "　", "===",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(rnd, n):
    for k in range(n):
        kind = k % 4
        if kind == 0:
            yield "".join(rnd.choice("abcdeht ") for _ in range(rnd.randint(0, 500)))
        elif kind == 1:
            yield "".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0x20, 0x7E), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(0, 60)))
        elif kind == 2:
            yield rnd.choice(["a", "=-", "the", "  ", "x ", " ", "0", "漢"]) * rnd.randint(1, 700)
        else:
            yield "".join(rnd.choice(ATOMS) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 25)))


def test_ids_equal_the_library(library):
    made = list(texts(random.Random(3), 1200))
    ids = [i.tolist() for i in sentence_pieces.encoder(MODEL)(made)]
    assert ids == library.encode(made)
    assert sentence_pieces.decoder(MODEL)(ids) == library.decode(ids)


def test_any_ids_decode_like_the_library(library):
    """Control ids, bytes that make no character, unknown pieces and leading blanks."""
    rnd = random.Random(4)
    some = [[rnd.choice([rnd.randint(0, 262), rnd.randint(0, 31999), 28705]) for _ in range(rnd.randint(0, 9))] for _ in range(3000)]
    assert sentence_pieces.decoder(MODEL)(some) == [library.decode(s) for s in some]


def test_small_table_of_words(library, monkeypatch):
    """Words are forgotten and encoded again; long runs go one by one."""
    vocab = sentence_pieces.PieceVocabulary(MODEL)
    memo = sentence_pieces.PieceMemo(vocab.encode_words, entries=5)
    monkeypatch.setattr(sentence_pieces, "LONG", 4)
    for t in texts(random.Random(5), 300):
        got = b"".join(memo.of([vocab.words(t)])[0])
        assert got == b"".join(i.to_bytes(4, "little") for i in library.encode(t))


def test_long_words_take_time_in_proportion(library):
    for t in ("x" * 100_000, " " * 100_000, "ab" * 50_000):
        assert sentence_pieces.encoder(MODEL)([t])[0].tolist() == library.encode(t)


def test_digests(corpus, library):
    rows = [(1, None), (2, ""), (None, "lone"), (3, "Same text"), (3, "Same text"), (1 << 60, "word " * 30_000), (4, " "), (5, "▁")]
    df = corpus(rows).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("x"))
    got = [tuple(r) for r in sentence_pieces.piece_digests(df, MODEL).collect()]
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(got, key=str) == sorted(want, key=str)
    listed = {r.doc_id: r.ids for r in sentence_pieces.encode(df, MODEL).collect()}
    assert listed[3] == library.encode("Same text") and listed[1] == []
    assert sentence_pieces.piece_digests(corpus([]), MODEL).count() == 0
