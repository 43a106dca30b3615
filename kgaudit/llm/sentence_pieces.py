"""SentencePiece encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds each word's best pair (the
smallest rank, the leftmost of equal ones) as a segmented minimum, merges all these pairs at
once, looks up the pairs that this makes and takes words without a pair out of the array. So a
word goes through the merges that the library makes one by one, and a round serves all words.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from kgaudit.llm.arrow import map_texts
from kgaudit.llm.exprs import narrow
from kgaudit.llm.tokenizing import PieceMemo

SPACE = "▁"
# Longer runs of symbols without a cut go through their merges one by one, from a heap.
LONG = 256
_NEVER = np.int32(np.iinfo(np.int32).max)
_WORD = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+")
_RUNS = ("\x00", "\t", "  ", "\n\n", " \n", "\n ")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """A replacement character for each byte that is no part of a character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceVocabulary:
    """A byte-fallback BPE model: which symbols there are, which pairs merge and in what order.

    Symbols are the characters that occur in pieces and the pieces themselves; any other
    character is symbol 0 and never merges.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, plain normalisation and no symbols of their own are read")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        chars = sorted({c for p in normal for c in p})
        names = chars + [p for p in normal if len(p) > 1]
        number = {s: n for n, s in enumerate(names, 1)}
        self.of_char = np.zeros(0x110000, np.int32)
        self.of_char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        # Symbols without an id of their own are written as the bytes of their character.
        self.id = np.array([-1] + [normal[s][0] if s in normal else -1 for s in names], np.int64)
        self.byte_id = np.zeros(256, np.int64)
        self.surface, self.kind = [b""] * len(model.pieces), {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface.encode()
            elif p.type == kinds.NORMAL:
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
        self.leading = frozenset(i for p, (i, _) in normal.items() if p.startswith(SPACE))
        self.silent = frozenset(i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL)
        self.names = [str(i) for i in range(len(model.pieces))]
        order = {s: r for r, s in enumerate(sorted({-score for _, score in normal.values()}))}
        pairs = {}
        for p, (_, score) in normal.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] << 32 | number[p[k:]]] = (order[-score], number[p])
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()] + [_NEVER], np.int32)
        self.pair_symbol = np.array([pairs[k][1] for k in self.pair_key.tolist()] + [0], np.int32)
        # Characters that no piece holds side by side: no merge ever crosses a place between such two.
        self.beside = np.array(sorted({number[a] << 32 | number[b] for p in normal for a, b in zip(p, p[1:], strict=False)}), np.int64)
        white = {SPACE, "\t", "\n"}
        self.cut_at_white = not any(b in white and a not in white for p in normal for a, b in zip(p, p[1:], strict=False))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of neighbouring symbols; the rank is ``_NEVER`` where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), max(0, len(self.pair_key) - 1))
        at = np.where(self.pair_key[at] == key, at, len(self.pair_key)) if len(self.pair_key) else np.zeros(len(key), np.int64)
        return self.pair_rank[at], self.pair_symbol[at]

    def words(self, text: str) -> list[str]:
        """A text with its leading blank, cut where white space follows a word."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")  # to the model both are the same
        if not self.cut_at_white:
            return [text]
        if any(r in text for r in _RUNS) or text.endswith((" ", "\n")):
            return _WORD.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")[1:]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        if not words:
            return []
        flat = "".join(words)
        points = np.frombuffer(flat.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum([0] + [len(w) for w in words])
        symbols, at = self.merge(self.of_char[points], starts[:-1])
        ids = self.id[symbols]
        bare = ids < 0
        raw = "".join(map(chr, points[at[bare]].tolist())).encode("utf-8", "surrogatepass")
        width = np.ones(len(ids), np.int64)
        width[bare] = 1 + (points[at[bare]] > 0x7F) + (points[at[bare]] > 0x7FF) + (points[at[bare]] > 0xFFFF)
        out = np.repeat(ids, width)
        out[np.repeat(bare, width)] = self.byte_id[np.frombuffer(raw, np.uint8)]
        data = out.astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(width)))[np.searchsorted(at, starts)] * 4
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, place of their first character) after all merges of the words that begin at ``starts``."""
        n = len(symbols)
        first = np.zeros(n, bool)
        first[starts[starts < n]] = True
        key = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        near = np.searchsorted(self.beside, key)
        first[1:] |= (near == len(self.beside)) | (self.beside[np.minimum(near, len(self.beside) - 1)] != key)
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for b, s in zip(begin[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
            one, at = self._one_by_one(symbols[b : b + s])
            done.append((one, at + b))
        word = np.repeat(np.arange(len(begin)), size)
        keep = np.repeat(size <= LONG, size)
        sym, at, word = symbols[keep], np.flatnonzero(keep), word[keep]
        rank, into = np.full(len(sym), _NEVER, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], into[inner] = self.pairs(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(begin, len(sym)))
            best = np.minimum.reduceat(rank, begin)
            if (best == _NEVER).any():  # compaction: finished words leave
                over = np.repeat(best == _NEVER, size)
                done.append((sym[over], at[over]))
                sym, at, word, rank, into = (x[~over] for x in (sym, at, word, rank, into))
                size, best = size[best != _NEVER], best[best != _NEVER]
                if not len(sym):
                    break
            found = np.flatnonzero(rank == np.repeat(best, size))
            found = found[np.concatenate(([True], word[found[1:]] != word[found[:-1]]))]  # each word's leftmost
            sym[found] = into[found]
            kept = np.ones(len(sym), bool)
            kept[found + 1] = False
            place = np.cumsum(kept) - 1
            sym, at, word, rank, into = (x[kept] for x in (sym, at, word, rank, into))
            here = place[found]
            for left in (here, here - 1):  # the pairs that the new symbol is the left and the right part of
                left = left[(left >= 0) & (left < len(sym))]
                same = np.zeros(len(left), bool)
                inner = left + 1 < len(sym)
                same[inner] = word[left[inner]] == word[left[inner] + 1]
                rank[left] = _NEVER
                some = left[same]
                rank[some], into[some] = self.pairs(sym[some], sym[some + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sym, at = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(at)
        return sym[order], at[order]

    def _one_by_one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of one long run, in the order of rank and place: its time grows with n log n."""
        n, sym = len(symbols), symbols.tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, into = self.pairs(symbols[:-1], symbols[1:])
        some = np.flatnonzero(rank != _NEVER)
        waiting = list(zip(rank[some].tolist(), some.tolist(), symbols[some].tolist(), symbols[some + 1].tolist(), into[some].tolist(), strict=True))
        heapq.heapify(waiting)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int) -> None:
            b = right[a]
            if a < 0 or b >= n:
                return
            pair = (sym[a], sym[b])
            if pair not in known:
                r, s = self.pairs(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = (int(r[0]), int(s[0]))
            r, s = known[pair]
            if r != _NEVER:
                heapq.heappush(waiting, (r, a, *pair, s))

        while waiting:
            _, a, x, y, s = heapq.heappop(waiting)
            b = right[a]
            if sym[a] != x or b >= n or sym[b] != y:
                continue  # one of the two has been merged meanwhile
            sym[a], sym[b] = s, -1
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            look(a)
            if left[a] >= 0:
                look(left[a])
        out = np.array(sym, np.int32)
        at = np.flatnonzero(out >= 0)
        return out[at], at

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; bytes that are no part of a character become U+FFFD each."""
        first = next((k for k, i in enumerate(ids) if i not in self.silent), len(ids))
        data = b"".join(map(self.surface.__getitem__, ids[first:]))
        if first < len(ids) and ids[first] in self.leading:
            data = data[1:]  # the blank that encoding puts in front
        return data.decode("utf-8", "each_byte")


_LOADED: dict[str, tuple[PieceVocabulary, PieceMemo]] = {}


def vocabulary(path: str) -> tuple[PieceVocabulary, PieceMemo]:
    """The vocabulary of a file and a bounded table of encoded words, once per worker."""
    if path not in _LOADED:
        vocab = PieceVocabulary(path)
        _LOADED[path] = (vocab, PieceMemo(vocab.encode_words))
    return _LOADED[path]


def encoder(path: str):
    """A function from texts to their ids, as arrays."""
    vocab, memo = vocabulary(path)
    return lambda texts: [np.frombuffer(b"".join(known), "<u4") for known in memo.of([vocab.words(t) for t in texts])]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: every whole text as the library of the model at ``path`` encodes it.

    No begin or end ids are added and nothing is sampled. A null or empty text has no ids.
    Rows are independent: repeated rows and null ids come back as they are, and an empty table
    gives an empty result. Other columns play no part.
    """

    def start():
        ids = encoder(path)
        return lambda texts: [[i.astype(np.int32) for i in ids(texts)]]

    return map_texts(narrow(docs, id_col, text_col), start, StructType([StructField("ids", ArrayType(IntegerType()))]))


def decoder(path: str):
    """A function from sequences of ids to their texts."""
    vocab, _ = vocabulary(path)
    return lambda sequences: [vocab.decode(s) for s in sequences]


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again.

    The first digest is of the decimal ids joined by commas, the second of the decoded text in
    UTF-8. Nulls, repeated rows and empty tables as in ``encode``.
    """

    def start():
        ids, text, names = encoder(path), decoder(path), vocabulary(path)[0].names

        def digest(texts: list[str]) -> list[list]:
            sequences = [i.tolist() for i in ids(texts)]
            listed = [hashlib.sha256(",".join(map(names.__getitem__, s)).encode()).hexdigest() for s in sequences]
            return [[len(s) for s in sequences], listed, [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in text(sequences)]]

        return digest

    added = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return map_texts(narrow(docs, id_col, text_col), start, added)
