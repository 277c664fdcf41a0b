"""Secret scans: all rules in one pass over the bytes of a text, by one combined deterministic automaton.

The whole expressions of all rules are compiled into one searching automaton. A batch of texts is cut after pairs of
bytes that lead every state to the same one, so that what came before doesn't matter; the pieces then advance together,
one byte each per step, through its transition array, and the few longest ones are walked to their ends alone. Where a
rule accepts for the last time in a row, its longest match ends; its reversed automaton finds the leftmost place, not
before the end of its last match, where that one begins. Every byte is thus read once, and those of matches once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import sliced, table


@dataclass(frozen=True)
class Rule:
    """Leftmost, longest matches of `whole` that do not overlap; from the first accepting byte of a match to its last
    one every byte accepts.

    head: what a match begins with; least: characters behind it without which a match is dropped. forms: (kind,
    expression) that a whole match must have; the first one that fits names it, and a match without is dropped.
    """

    kind: str
    whole: str
    head: str = ""
    least: int = 0
    forms: tuple[tuple[str, str], ...] = ()


#: The three base kinds first; fixed patterns.
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", _ASSIGN, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", forms=(("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),)),
    Rule(
        "service", r"(?:gh[pousr]_|xox[abprs]-|AIza)[A-Za-z0-9_-]+",
        forms=(("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"), ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"), ("map_key", r"AIza[A-Za-z0-9_-]{35}")),
    ),
    Rule("url_login", r"://[^ \n\t/@]+@", forms=(("url_login", r"://[A-Za-z0-9._~-]{1,64}:[^ \n\t/@:]{1,64}@"),)),
    Rule("card", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"),
)
#: Bytes of one piece, and of the texts that advance together; with fewer pieces left, each one is walked alone.
PIECE, TOGETHER, FEW = 512, 4_000_000, 24


def kinds_of(rules: tuple[Rule, ...]) -> list[str]:
    return [kind for r in rules for kind in ([k for k, _ in r.forms] or [r.kind])]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.kinds = kinds_of(rules)
        self.first_kind = np.cumsum([0, *(len(r.forms) or 1 for r in rules)])[:-1].tolist()
        self.search = a = Automaton([r.whole for r in rules], searching=True)
        self.back = [Automaton([r.whole], backwards=True) for r in rules]
        self.heads = [Automaton([r.head]) if r.head else None for r in rules]
        self.forms = [[re.compile(x.encode()) for _, x in r.forms] for r in rules]
        n, width = a.table.shape
        self.flat = (a.table * width).ravel()  # states as row offsets
        self.width, self.quiet = width, a.quiet * width
        two = a.table[a.table[:, :, None], np.arange(width)[None, None, :]].reshape(n, -1)  # after a pair of bytes
        self.known = np.where((two == two[0]).all(axis=0), two[0] * width, -1)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place after the byte, rules) wherever a match of a rule ends, in one pass over all bytes, in order."""
        if not len(data):
            return np.empty(0, "int64"), np.empty(0, "int64")
        kinds = self.search.classes[data]
        pairs = self.known[kinds[:-1].astype("int32") * self.width + kinds[1:]]
        sure = np.flatnonzero(pairs >= 0)
        where = np.searchsorted(sure, np.arange(PIECE, len(data), PIECE))
        cuts = np.unique(where[where < len(sure)])
        begins, state = np.append(0, sure[cuts] + 2), np.append(0, pairs[sure[cuts]]).astype("int32")
        begins, state = begins[begins < len(data)], state[begins < len(data)]
        lengths = np.diff(np.append(begins, len(data)))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths, state = begins[order], lengths[order], state[order]
        alone = int(lengths[FEW]) if len(lengths) > FEW else 0  # from there on, at most FEW pieces go on
        live = np.searchsorted(-lengths, -np.arange(alone), side="left")  # pieces longer than t
        found_at, found_state = [], []
        for t in range(alone):
            n = live[t]
            s = self.flat[state[:n] + kinds[begins[:n] + t]]
            state[:n] = s
            stop = s >= self.quiet
            if stop.any():
                i = np.flatnonzero(stop)
                found_at.append(begins[i] + t + 1)
                found_state.append(s[i])
        if len(lengths) and lengths[0] > alone:
            flat, quiet = self._listed(), self.quiet
            for k in range(int((lengths > alone).sum())):
                s, at, some, states = int(state[k]), int(begins[k]) + alone, [], []
                for c in kinds[at : begins[k] + lengths[k]].tobytes():
                    s = flat[s + c]
                    at += 1
                    if s >= quiet:
                        some.append(at)
                        states.append(s)
                found_at.append(np.array(some, "int64"))
                found_state.append(np.array(states, "int32"))
        if not found_at:
            return np.empty(0, "int64"), np.empty(0, "int64")
        at, rules = np.concatenate(found_at), self.search.accepts[np.concatenate(found_state) // self.width]
        order = np.argsort(at, kind="stable")
        return at[order], rules[order]

    def _listed(self) -> list[int]:
        if not hasattr(self, "_flat"):
            self._flat = self.flat.tolist()
        return self._flat

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, end, number of the kind) in bytes of each text, by start and kind."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (size == 0 or size + len(texts[to]) < TOGETHER):
                size += len(texts[to]) + 1
                to += 1
            joined = b"\xff".join(texts[at:to])  # 0xff is in no text and no rule goes on after it
            begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts[at:to]])])[:-1]
            places, masks = self.hits(np.frombuffer(joined, "uint8"))
            for r in range(len(self.rules)):
                ends = places[(masks >> r & 1).astype(bool)]
                ends = ends[np.diff(ends, append=-1) != 1]  # the last byte in a row
                which = np.searchsorted(begins, ends - 1, side="right") - 1
                text, upto = -1, 0
                for k, end in zip(which.tolist(), (ends - begins[which]).tolist()):
                    if k != text:
                        text, upto = k, 0
                    start = self.back[r].farthest(texts[at + k], end, -1, upto)
                    if start >= 0:
                        upto = end
                        kind = self._kind(r, texts[at + k], start, end)
                        if kind is not None:
                            out[at + k].append((start, end, kind))
            at = to
        for x in out:
            x.sort(key=lambda s: (s[0], s[2]))
        return out

    def _kind(self, r: int, text: bytes, start: int, end: int) -> int | None:
        head = self.heads[r].farthest(text, start) if self.heads[r] else start
        if end - head < self.rules[r].least:
            return None
        fits = [k for k, form in enumerate(self.forms[r]) if form.fullmatch(text, start, end)]
        if self.forms[r] and not fits:
            return None
        return self.first_kind[r] + (fits[0] if fits else 0)

    def code_point_spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out = self.spans(raw)
        for k, (b, found) in enumerate(zip(raw, out)):
            if found and len(b) != len(texts[k]):
                before = np.concatenate([[0], np.cumsum((np.frombuffer(b, "uint8") & 0xC0) != 0x80)])
                out[k] = [(int(before[s]), int(before[e]), r) for s, e, r in found]
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets) with secrets an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Null texts are empty and have no secrets; every row of docs has one row, equal doc_ids included. No shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in sliced(batches, 2000):
            found = own.code_point_spans([t or "" for t in b.column("text").to_pylist()])
            rows = [[{"kind": own.kinds[r], "start": s, "end": e} for s, e, r in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, secrets array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by a mask, overlapping ones by one; n_chars, if there, is counted anew."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for b in sliced(batches, 2000):
            texts = b.column("text").to_pylist()
            for k, found in enumerate(own.code_point_spans([t or "" for t in texts])):
                if found:
                    t, parts, at = texts[k], [], 0
                    for s, e, _ in found:
                        if s >= at:
                            parts += [t[at:s], mask]
                        at = max(at, e)
                    texts[k] = "".join(parts) + t[at:]
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: how many base secrets of each kind, a digest of their spans, and all spans as text. Null
    and empty texts have none; equal doc_ids have a row each."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


QUERIES = {"op1_secret_scans": op1_secret_scans}
ORACLES: dict[str, str] = {}
