"""SentencePiece encoding and decoding by a Viterbi pass in batches of numpy arrays.

A text is cut where no piece crosses; each distinct word is encoded once per worker. Words padded to equal lengths
advance together: rolling hashes of their substrings probe the sorted hashes of the pieces, all pieces that end at a
place compete for all words at once, and the maximum stores a back pointer. Two kinds of model exist:

* unigram: the best sum of scores wins.
* BPE: the best sum of scores is not what such a model means; its pieces are merges in order of their rank. A piece may
  only follow the one that the back pointer names if no merge across their border would have come before the merges
  that made the two (`consistent`, from the ranks and the halves of the pieces); such a path is all but unique. An exact
  check follows: a sequence of pieces is what the merges give if and only if that holds for each two neighbours, and
  distinct neighbours are few; words that fail it (their share is in the README) are merged step by step.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_others, table
from .token_files import tokenizer_path

MARK = "▁"
#: Before words of texts with runs of blanks, which are cut by an expression.
RAW = "\x01"
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Longer words of a BPE model are merged one by one, in time n log n; words are padded to multiples of PAD.
LONG, PAD = 256, 8
#: Bytes of words that a worker remembers, about, in each of two generations; words encoded together; texts of a batch.
REMEMBERED, TOGETHER, TEXTS = 48 << 20, 50_000, 2_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


class PieceModel:
    """Pieces with ids and scores. unigram says how they are chosen; bytes_at is the id of the piece of byte 0, if any."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unigram: bool, bytes_at: int | None = None, unknown: int = 0, prefix: bool = True, names: list[bytes] | None = None):
        self.pieces, self.unigram, self.bytes_at, self.unknown, self.prefix = pieces, unigram, bytes_at, unknown, prefix
        self.longest = max(map(len, pieces), default=1)
        self.powers = powers(max(LONG, self.longest))
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        keys = [(self.prefixes(self.matrix(ps, n))[:, -1] * MIX, ps) for n, ps in by_length.items()]
        flat = np.concatenate([k for k, _ in keys]) if keys else np.empty(0, "u8")
        order = np.argsort(flat)
        names_in_order = [p for _, ps in keys for p in ps]
        self.keys = flat[order]
        self.ids = np.array([pieces[names_in_order[i]][0] for i in order], "i4")
        self.scores = np.array([pieces[names_in_order[i]][1] for i in order], "f8")
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash; choose another BASE")
        self.sizes = np.array([len(names_in_order[i]) for i in order], "i4")
        self.texts = [names_in_order[i] for i in order]
        lead = (self.keys >> np.uint64(44)).astype("i8")
        self.first = np.searchsorted(lead, np.arange(1 << 20)).astype("i4")  # by leading bits of a hash: the first key that has them
        self.deep = int(np.bincount(lead, minlength=1).max()) if len(lead) else 0
        self.ended = np.append(self.keys, np.zeros(self.deep + 1, "u8"))
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        feed = any("\n" in p for p in pieces)
        self.cut = None if inner else re.compile(r" *[^ ]+| +" if feed else r"\n| *[^ \n]+| +")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.names = names
        self.checked: dict[int, bool] = {}
        self.counts = {"words": 0, "merged": 0}
        if not unigram:
            self._halves()

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        with open(path, "rb") as f:
            data = f.read()
        pieces, names, bytes_at, unknown, unigram, prefix, n = {}, [], None, 0, True, True, 0
        for key, value in fields(data):
            if key == 1:
                got = dict(fields(value))
                text, kind = got[1].decode(), got.get(3, 1)
                if kind in (1, 4):
                    pieces[text] = (n, float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
                elif kind == 2:
                    unknown = n
                elif kind == 6 and bytes_at is None:
                    bytes_at = n
                names.append(text.replace(MARK, " ").encode() if kind in (1, 4) else bytes([int(text[3:5], 16)]) if kind == 6 else b" \xe2\x81\x87 " if kind == 2 else b"")
                n += 1
            elif key == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
            elif key == 3:
                got = dict(fields(value))
                prefix = bool(got.get(3, 1))
                if got.get(1) != b"identity" or got.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
        return cls(pieces, unigram, bytes_at, unknown, prefix, names)

    def matrix(self, words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        h = np.zeros((len(chars), chars.shape[1] + 1), "u8")
        for j in range(chars.shape[1]):
            h[:, j + 1] = h[:, j] * BASE + chars[:, j].astype("u8") + np.uint64(1)
        return h

    def probe(self, h: np.ndarray, rows, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the piece that is the substring, or -1."""
        size = end - begin
        key = h[rows, end] - h[rows, begin] * self.powers[np.minimum(size, self.longest)]
        return self.look_up(np.where(size <= self.longest, key, np.uint64(0)))

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1: the sorted keys are entered by the leading bits."""
        key = key * MIX
        k = self.first[(key >> np.uint64(44)).astype("i8")]
        out = np.where(self.ended[k] == key, k, -1)
        for d in range(1, self.deep):  # two or three of all pieces share their leading bits with one before
            out = np.where(self.ended[k + d] == key, k + d, out)
        return out

    def _by_merges(self, h: np.ndarray, n: int, last: np.ndarray | None = None) -> list[np.ndarray]:
        """Ends of the pieces that merging step by step gives for each word of n characters; all words make their best
        merge in the same step. last: where the halves of the last merge of a word meet, if it became one piece."""
        count = len(h)
        out: list[np.ndarray] = [None] * count
        rows = np.arange(count)
        cuts = np.tile(np.arange(n + 1), (count, 1))

        def score(rows, begin, end):
            k = self.probe(h, rows, begin, end)
            return np.where(k >= 0, self.scores[k], -np.inf)

        s = score(rows[:, None], cuts[:, :-2], cuts[:, 2:]) if n > 1 else np.empty((count, 0))
        while len(rows):
            best = s.argmax(axis=1) if s.shape[1] else np.zeros(len(rows), "i8")  # the leftmost of equals
            there = np.arange(len(rows))
            over = s[there, best] == -np.inf if s.shape[1] else np.ones(len(rows), bool)
            for i in np.flatnonzero(over):
                out[rows[i]] = cuts[i, 1:].copy()
            rows, cuts, s, best = rows[~over], cuts[~over], s[~over], best[~over]
            if not len(rows):
                break
            width = cuts.shape[1]
            if last is not None and width == 3:
                last[rows] = cuts[:, 1]
            cuts = cuts[np.arange(width) != (best + 1)[:, None]].reshape(len(rows), width - 1)
            s = s[np.arange(width - 2) != best[:, None]].reshape(len(rows), width - 3)
            for k in (best - 1, best):  # the pairs that the new piece is part of
                ok = (k >= 0) & (k < s.shape[1])
                i, k = np.flatnonzero(ok), k[ok]
                if len(i):
                    s[i, k] = score(rows[i], cuts[i, k], cuts[i, k + 2])
        return out

    def _halves(self) -> None:
        """By piece: the two pieces of its last merge, its rank, and the latest rank of all merges that make it."""
        n = len(self.keys)
        self.left, self.right = np.full(n + 1, n), np.full(n + 1, n)  # number n: a character that is no piece
        self.rank, self.late = np.append(np.where(self.sizes == 1, -1.0, -self.scores), -1.0), np.full(n + 1, -1.0)
        self.whole = np.append(self.sizes == 1, True)  # pieces that merging makes of their own text
        self.lengths = np.append(self.sizes, 1)
        for size in range(2, self.longest + 1):
            own = np.flatnonzero(self.sizes == size)
            if not len(own):
                continue
            h = self.prefixes(self.matrix([self.texts[k] for k in own], size))
            last, rows = np.zeros(len(own), "i8"), np.arange(len(own))
            self._by_merges(h, size, last)
            ok = last > 0
            a, b = (np.where(k < 0, n, k) for k in (self.probe(h, rows, np.zeros_like(last), last), self.probe(h, rows, last, np.full_like(last, size))))
            self.left[own[ok]], self.right[own[ok]], self.whole[own] = a[ok], b[ok], ok
            self.late[own] = np.maximum(self.rank[own], np.maximum(self.late[a], self.late[b]))

    def consistent(self, h: np.ndarray, rows: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a at place `at` of a word: going back through the merges that made the two,
        at no time would the symbols beside the border have merged with each other first."""
        ok = self.whole[a] & self.whole[b]
        live = np.flatnonzero(ok)
        rows, at, a, b = rows[live], at[live], a[live], b[live]
        far = np.full(len(live), np.inf)
        la, ra, lb, rb = far, far, far, far  # when the symbols on either side became part of larger ones
        while len(live):
            k = self.probe(h, rows, at - self.lengths[a], at + self.lengths[b])
            rank = self.rank[k]
            when = np.maximum(rank, np.maximum(self.late[a], self.late[b]))
            crossed = (k >= 0) & ((when < la) | (when == la) & (rank < ra)) & ((when < lb) | (when == lb) & (rank <= rb))
            ok[live[crossed]] = False
            go = ~crossed & ((self.lengths[a] > 1) | (self.lengths[b] > 1))
            live, rows, at, a, b, la, ra, lb, rb = (x[go] for x in (live, rows, at, a, b, la, ra, lb, rb))
            first = (self.late[a] > self.late[b]) | (self.late[a] == self.late[b]) & (self.rank[a] > self.rank[b])  # the later one is taken apart
            la, ra = np.where(first, self.late[a], la), np.where(first, self.rank[a], ra)
            lb, rb = np.where(first, lb, self.late[b]), np.where(first, rb, self.rank[b])
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def _by_viterbi(self, h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(back, piece, lost) of words padded to one length: for each place the begin and the number of the piece that
        the best path ends with there (len(keys): a character that is no piece), and whether no path was consistent."""
        count, none = len(h), len(self.keys)
        best = np.full((count, h.shape[1]), -np.inf)
        back, piece = np.zeros(best.shape, "i4"), np.full(best.shape, none, "i4")
        best[:, 0], lost = 0, np.zeros(count, bool)
        worst = (self.scores.min() if len(self.scores) else 0.0) - 10.0  # a character that is no piece
        for j in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= j)
            own = h if len(live) == count else h[live]
            sizes = np.arange(min(j, self.longest), 0, -1)
            k = self.look_up(own[:, j : j + 1] - own[:, j - sizes] * self.powers[sizes])
            k[:, -1] = np.where(k[:, -1] < 0, none, k[:, -1])
            there = k >= 0
            if not self.unigram and j > 1:
                fits = np.zeros_like(there)
                for r, c in ((np.arange(len(live)), there.argmax(axis=1)), (None, None)):  # the longest, which mostly fits; then all others of the rest
                    if r is None:
                        r, c = np.nonzero(there & ~fits.any(axis=1)[:, None])
                    begin = j - sizes[c]
                    fits[r, c] = self.whole[k[r, c]]
                    r, c, begin = r[begin > 0], c[begin > 0], begin[begin > 0]
                    fits[r, c] &= self.consistent(h, live[r], begin, piece[live[r], begin], k[r, c])
                missed = ~fits.any(axis=1)
                lost[live[missed]] = True
                fits[missed, -1] = True
                there = fits
            value = np.where(there, best[live][:, j - sizes] + np.where(k == none, worst, self.scores[np.minimum(k, none - 1)]), -np.inf)
            pick = value.argmax(axis=1)  # the longest of equals
            rows = np.arange(len(live))
            best[live, j], back[live, j], piece[live, j] = value[rows, pick], j - sizes[pick], k[rows, pick]
        return back, piece, lost

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging gives just the two pieces, for packed pairs of numbers of pieces; remembered."""
        new = [p for p in np.unique(pairs).tolist() if p not in self.checked]
        if len(self.checked) + len(new) > 1_000_000:
            self.checked.clear()
            new = np.unique(pairs).tolist()
        groups: dict[int, list[int]] = {}
        for p in new:
            groups.setdefault(len(self.texts[p >> 20]) + len(self.texts[p & 0xFFFFF]), []).append(p)
        for n, own in groups.items():
            ends = self._by_merges(self.prefixes(self.matrix([self.texts[p >> 20] + self.texts[p & 0xFFFFF] for p in own], n)), n)
            for p, e in zip(own, ends):
                self.checked[p] = len(e) == 2 and e[0] == len(self.texts[p >> 20])
        return np.array([self.checked[p] for p in pairs.tolist()], bool)

    def _alone(self, word: str) -> list[str]:
        """Merges of one long word, by a heap."""
        n = len(word)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and end[j] - i <= self.longest and (got := self.pieces.get(word[i : end[j]])):
                heapq.heappush(heap, (-got[1], i, j, end[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != e:
                continue
            alive[j], end[i] = False, e
            if e < n:
                before[e] = i
                offer(i, e)
            if before[i] >= 0:
                offer(before[i], i)
        return [word[i : end[i]] for i in range(n) if alive[i]]

    def _ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        return [self.bytes_at + b for b in piece.encode("utf-8", "surrogatepass")] if self.bytes_at is not None else [self.unknown]

    def _joined(self, pieces: list[str]) -> list[int]:
        """ids of pieces; neighbours that are unknown have one id."""
        out: list[int] = []
        for p in pieces:
            ids = self._ids(p)
            if not (ids == [self.unknown] == out[-1:] and self.bytes_at is None):
                out += ids
        return out

    def segment(self, words: list[str]) -> list[list[int]]:
        """ids of each word; MARK stands for a space."""
        out: list[list[int]] = [[] for _ in words]
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG and not self.unigram:
                out[i] = self._joined(self._alone(w))
            elif w:
                groups.setdefault(-(-len(w) // PAD) * PAD, []).append(i)
        for n, where in groups.items():
            if n >= len(self.powers):
                self.powers = powers(n)
            for at in range(0, len(where), max(1, TOGETHER * 8 // n)):
                part = where[at : at + max(1, TOGETHER * 8 // n)]
                for i, ids in zip(part, self._segment([words[i] for i in part], n)):
                    out[i] = ids
        return out

    def _segment(self, words: list[str], n: int) -> list[list[int]]:
        lengths = np.array([len(w) for w in words])
        h = self.prefixes(self.matrix([w.ljust(n, "\0") for w in words], n))
        back, piece, lost = self._by_viterbi(h, lengths)
        rows, at, none = np.arange(len(words)), lengths.copy(), len(self.keys)
        steps, names = [], []  # from the last piece to the first one
        while len(rows):
            names.append(np.stack([rows, piece[rows, at], at]))
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        steps = np.concatenate(names[::-1], axis=1) if names else np.empty((3, 0), "i8")
        order = np.lexsort((steps[2], steps[0]))
        row, k, end = steps[:, order]
        if not self.unigram:
            pair = np.flatnonzero((row[1:] == row[:-1]) & (k[1:] != none) & (k[:-1] != none))
            fit = self._fit((k[pair].astype("i8") << 20) | k[pair + 1])
            lost[row[pair[~fit]]] = True
            self.counts["words"] += len(words)
            self.counts["merged"] += int(lost.sum())
        ids = self.ids[np.minimum(k, none - 1)] if none else k
        starts = np.searchsorted(row, np.arange(len(words) + 1)).tolist()
        unknown = np.zeros(len(words), bool)
        unknown[row[k == none]] = True
        flat, ends = ids.tolist(), end.tolist()
        out = []
        for i, w in enumerate(words):
            if lost[i]:
                out.append(self._joined(self._alone(w)))
            elif unknown[i]:
                e = [0, *ends[starts[i] : starts[i + 1]]]
                out.append(self._joined([w[x:y] for x, y in zip(e, e[1:])]))
            else:
                out.append(flat[starts[i] : starts[i + 1]])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each whole text as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(texts), TEXTS):
            block = [self._words(t) for t in texts[at : at + TEXTS]]
            known, older = self.known, self.older
            new = []
            for w in set().union(*block):
                if w not in known:
                    if w in older:
                        known[w] = older[w]
                    else:
                        new.append(w)
            for k in range(0, len(new), TOGETHER):
                some = new[k : k + TOGETHER]
                # a word stands after a space, which is part of it, unless it is raw or begins with a line feed
                whole = [w[1:] if w[:1] == RAW else w if w[:1] == "\n" else " " + w for w in some]
                parts = [self.cut.findall(w) if self.cut else [w] for w in whole]
                flat = self.segment([x.replace(" ", MARK) for p in parts for x in p])
                b = 0
                for w, p in zip(some, parts):
                    known[w] = array("I", flat[b] if len(p) == 1 else [x for ids in flat[b : b + len(p)] for x in ids]).tobytes()
                    self.held += len(w) + len(known[w]) + 180
                    b += len(p)
            out += [b"".join(map(known.__getitem__, b)) for b in block]
            if self.held > REMEMBERED:  # the words since then are the older generation, which is asked before a word is encoded anew
                self.known, self.older, self.held = {}, known, 0
        return out

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.cut and self.prefix and MARK not in text and RAW not in text and "  " not in text and text[0] not in " \n" and "\n " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        s = (" " if self.prefix else "") + text.replace(MARK, " ")
        return [RAW + w for w in self.cut.findall(s)] if self.cut else [RAW + s]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    forget_others(path, _models.clear)
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs and a column ids (array<int>) of the whole text; a null or empty text has none. A column ids is replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    docs = docs.drop("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in model(path).encode([t or "" for t in b.column("text").to_pylist()])]
            yield b.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(docs: DataFrame, path: str) -> DataFrame:
    """docs and a column decoded, the text of their ids; null ids decode to null."""
    from pyspark.sql.types import StringType, StructField, StructType

    docs = docs.drop("decoded")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = model(path)
            yield b.append_column("decoded", pa.array([None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in b.column("ids").to_pylist()], pa.string()))

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField("decoded", StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, their crc32 (little-endian unsigned 32-bit), the SHA-256 of the text that they decode to, and whether that is the text."""
    path = tokenizer_path("piece_bpe_32k.model")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(path)
        for p in batches:
            texts = [t or "" for t in p["text"]]
            ids = own.encode(texts)
            back = [own.decode(x) for x in ids]
            yield pd.DataFrame({"doc_id": p["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "decoded": back, "round_trip": [a == b for a, b in zip(texts, back)]})

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    got = docs.mapInPandas(each, "doc_id long, n_tokens long, ids_crc32 long, decoded string, round_trip boolean")
    return got.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "round_trip")


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
