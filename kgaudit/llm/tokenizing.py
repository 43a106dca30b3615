"""Token counts with the public tokenizers: whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import pre_tokenizers

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.exprs import narrow

# A text longer than this is encoded in chunks of about this many characters.
CHUNK_CHARS = 1 << 16
# Characters that two neighbouring chunks share at first; doubled until they align.
OVERLAP_CHARS = 1 << 9
# Tokens in a row that both encodings of an overlap must agree on.
AGREE = 8
# Entries that a task's table of encoded pieces may hold before it is emptied.
MEMO_ENTRIES = 400_000

# White space other than blank, tab and line feed; texts that hold some are not cut into pieces.
_ODD_SPACE = re.compile("[\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_ODD_ASCII = "\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WHITE = re.compile("[ \t\n]")
_RUNS = ["\x00", "\t", "  ", "\n\n", " \n", "\n "]
_PIECE = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+")
_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once per worker: ``tokenizers`` for .json, ``sentencepiece`` for .model."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def stable_cut(left: list[tuple], right: list[tuple], text: str) -> tuple[int, int] | None:
    """Positions (i, j) at which two encodings of an overlap can be joined, or None.

    ``left`` and ``right`` list (start, end, id) of their tokens in the whole text's
    characters. A join is stable where both start a token at the same white space bounded
    character, because no token rule here looks across the start of a word, and both agree
    on ``AGREE`` tokens on either side of it, so that neither is still under the influence
    of its own cut. The join in the middle of the overlap is taken.
    """
    at = {t[0]: j for j, t in enumerate(right) if t[1] > t[0]}
    found = []
    for i in range(AGREE, len(left) - AGREE + 1):
        start = left[i][0] if i < len(left) else None
        j = at.get(start)
        if j is None or j < AGREE or left[i - AGREE : i + AGREE] != right[j - AGREE : j + AGREE]:
            continue
        head = text[start - 1] if start else " "
        if (head in " \t\n") != (text[start] in " \t\n"):
            found.append((i, j))
    return found[len(found) // 2] if found else None


def chunked_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Token ids of a whole text, encoded in overlapping chunks that are spliced at stable joins.

    Where two encodings of an overlap do not align, the right chunk starts earlier, with
    twice the overlap, and so on; in the end it starts where the left one does, and the two
    chunks are encoded as one.
    """

    def encode(lo: int, hi: int) -> list[tuple]:
        e = tokenizer.encode(text[lo:hi], add_special_tokens=False)
        return [(lo + a, lo + b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]

    n, out, lo, hi = len(text), [], 0, min(chunk, len(text))
    tokens = encode(lo, hi)  # of the chunk that is still open on its right
    first = 0  # where its part begins
    while hi < n:
        width, end = overlap, min(hi + chunk, n)
        while True:
            start = hi - width
            if start <= lo:  # no room left: one chunk twice as long, so that a text that never aligns takes time in proportion
                hi = min(hi + max(chunk, hi - lo), n)
                tokens = encode(lo, hi)
                break
            if not _WHITE.search(text, start - 1, hi):  # no join is possible here
                width *= 2
                continue
            right = encode(start, end)
            shared_left = next((k for k, t in enumerate(tokens) if t[0] >= start), len(tokens))
            shared_right = next((k for k, t in enumerate(right) if t[1] > hi), len(right))
            cut = stable_cut(tokens[shared_left:], right[:shared_right], text)
            if cut is not None and shared_left + cut[0] >= first:
                out += [t[2] for t in tokens[first : shared_left + cut[0]]]
                tokens, first, lo, hi = right, cut[1], start, end
                break
            width *= 2
    return out + [t[2] for t in tokens[first:]]


def pieces(text: str) -> list[str] | None:
    """``text`` cut before the white space of each word; None if it holds unusual white space.

    The tokenizers' rules never join the end of a word with the white space behind it, so
    the ids of the pieces, one after the other, are the ids of the text.
    """
    if any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text):
        return None
    if any(r in text for r in _RUNS) or text.endswith((" ", "\n")):
        return _PIECE.findall(text)
    # Single blanks and line feeds only: each starts a piece.
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")


class PieceMemo:
    """Results for pieces of text that come again and again, in two tables of bounded size.

    Pieces of the newer table stay known for another generation when it is full. ``encode``
    turns a list of pieces into their results.
    """

    def __init__(self, encode, entries: int = MEMO_ENTRIES):
        self.encode, self.entries, self.known, self.older = encode, entries, {}, {}

    def of(self, texts: list[list[str]]) -> list[list]:
        """The results of each text's pieces."""
        if len(self.known) > self.entries:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for piece in set().union(*texts).difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                new.append(piece)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, self.encode(part), strict=True))
        return [list(map(known.__getitem__, t)) for t in texts]


def piece_lengths(path: str):
    """A function from pieces to their numbers of tokens."""
    tokenizer = load_tokenizer(path)
    return lambda part: [len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]


def by_ranks(path: str):
    """A function from texts to ids for a plain byte-level vocabulary of the file at ``path``, or None.

    Where merges are numbered in the order in which they apply, an id is its merge's rank, and
    the library for such ranks gives the same ids several times as fast.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges, pre = spec["model"].get("vocab", {}), spec["model"].get("merges", []), spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["normalizer"] is None and spec["model"]["type"] == "BPE"
    if not plain or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges)):
        return None
    # Byte-level vocabularies write a byte as itself where it prints, and others as characters from 256 on.
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(rest)}
    added = set(t["content"] for t in spec["added_tokens"])
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def piece_ids(path: str):
    """A function from pieces to their ids as little-endian 32-bit numbers.

    A byte-level vocabulary loses no byte, so words that start with white space and end without
    can be encoded as one text; the bytes of its tokens tell where each word's ids end.
    """
    tokenizer = load_tokenizer(path)
    lossless = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
    special = set(tokenizer.get_added_tokens_decoder())
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)
    fast = by_ranks(path) if lossless else None
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token.encode()) if i in special else len(token)  # one symbol stands for a byte

    def encode(part: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        words = [p for p in part if p[:1] in (" ", "\n") and not p[-1:].isspace()] if lossless else []
        # A special token's name could arise where words meet; the fast way doesn't know such names.
        joined = "".join(words)
        plain = fast if fast and not any(name in joined for name in names) else None
        found = plain(joined) if plain else tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids if words else []
        ids = np.array(found, "<u4")
        ends = np.cumsum(np.array([len(w.encode()) for w in words], np.int64))
        reached = np.cumsum(size[ids])
        stop = np.searchsorted(reached, ends) + 1
        raw, start = ids.tobytes(), 0
        for w, at in zip(words, (4 * stop).tolist(), strict=True):
            out[w] = raw[start:at]
            start = at
        rest = [p for p in part if p not in out]
        for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[p] = np.array(e.ids, "<u4").tobytes()
        return [out[p] for p in part]

    return encode


_MEMOS: dict[tuple, PieceMemo] = {}


def piece_memo(path: str, kind) -> PieceMemo:
    """The memo of a file and a kind of result (``piece_lengths``, ``piece_ids``), kept by the worker from task to task."""
    key = (path, kind.__name__)
    if key not in _MEMOS:
        _MEMOS[key] = PieceMemo(kind(path))
    return _MEMOS[key]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Counts equal those of the library on the whole text, without begin, end or other added
    tokens. Texts above ``chunk`` characters are encoded in overlapping chunks and spliced
    (``chunked_ids``), so that the memory of an encoding stays bounded; the others are counted
    word by word, each distinct word encoded once (``pieces``). A null or empty text has no
    tokens. Rows are independent: repeated rows and null ids come back as they are, and an
    empty table gives an empty result. Each task loads the file at ``path`` once.
    """

    def start():
        tokenizer = load_tokenizer(path)
        if path.endswith(".model"):
            return lambda texts: [[len(tokenizer.encode(t, num_threads=1)) for t in texts]]
        memo = piece_memo(path, piece_lengths)

        def count(texts: list[str]) -> list[list[int]]:
            cut = [pieces(t) if len(t) <= chunk else None for t in texts]
            known = iter(memo.of([c for c in cut if c is not None]))
            return [[sum(next(known)) if c is not None else len(chunked_ids(tokenizer, t, chunk)) for t, c in zip(texts, cut, strict=True)]]

        return count

    rows = narrow(docs, id_col, text_col)
    sized = rows.select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    counted = map_texts(sized, start, StructType([StructField("n_tokens", LongType())]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
