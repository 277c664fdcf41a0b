"""Byte-level BPE by a file of ranks: encoding with the tokenizers library over Arrow batches, and decoding.

A rank file lists byte strings and their ranks; a text is cut by a pattern, and in each cut the neighbours whose joint
string has the least rank are merged, again and again. The library works on characters, so every byte is given one
(`byte_characters`), and a merge is stated for every way in which a listed string is made of two listed ones, in order
of its rank: then the library merges what the ranks say. Decoding reverses the table of characters. A token may end
inside a character: bytes are put together first and read as UTF-8 afterwards, and each token gets the characters that
its last byte completes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, table
from .token_files import tokenizer_path
from .tokens import WordTokenizer, byte_characters, kept_tokenizer


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file whose lines are a base64 string and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def spec_of(path: str, cuts: str) -> str:
    """A tokenizer of the library, as JSON, that gives the ids of a rank file; cuts: the pattern that cuts a text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, characters = read_ranks(path), byte_characters()
    written = {t: "".join(map(characters.__getitem__, t)) for t in ranks}
    merges = []
    for t, _ in sorted(ranks.items(), key=lambda x: x[1]):
        halves = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges += [(written[a], written[b]) for a, b in sorted(halves, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
    made = Tokenizer(models.BPE({written[t]: r for t, r in ranks.items()}, merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(cuts), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def tokenizer(path: str, cuts: str) -> WordTokenizer:
    return kept_tokenizer(f"{path}\n{cuts}", lambda: spec_of(path, cuts))


class Decoder:
    """Bytes and texts of ids. `vocabulary` is the library's: strings of byte characters and ids."""

    def __init__(self, vocabulary: dict[str, int]):
        byte = {ord(c): b for b, c in enumerate(byte_characters())}
        self.bytes = {i: bytes(map(byte.__getitem__, map(ord, t))) for t, i in vocabulary.items()}

    def __call__(self, ids: list[int]) -> bytes:
        """The bytes of ids one after the other; an id that the vocabulary lacks is an error."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def starts(self, ids: list[int]) -> np.ndarray:
        """For each id the place, in code points of the decoded text, of the character in which its first byte lies."""
        lengths = np.fromiter((len(self.bytes[i]) for i in ids), "int64", len(ids))
        begins = (np.frombuffer(self(ids), "u1") & 0xC0) != 0x80  # bytes that begin a character
        before = np.cumsum(begins) - 1
        return before[np.cumsum(lengths) - lengths] if len(ids) else np.empty(0, "int64")

    def parts(self, ids: list[int]) -> list[str]:
        """The text that each id completes: a character split over several ids goes to the last of them. Bytes that
        are no UTF-8 become U+FFFD; an unfinished character at the end becomes one of the last id."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes[i], k == len(ids) - 1) for k, i in enumerate(ids)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "int64"), *parts]), kind))


def encode(docs: DataFrame, ranks_file: str, cuts: str | None = None, column: str = "text") -> DataFrame:
    """docs with ids and starts: the ids of each text, and where in it (code points) the character lies in which each
    token begins. Null and empty texts have no ids. Columns of docs named ids or starts are replaced."""
    cuts = cuts or pattern()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "starts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, cuts)
        decoder = Decoder(own.library.get_vocab(with_added_tokens=False))
        for b in sliced(batches):
            ids = [np.frombuffer(x, "<u4").astype("int64") for x in own.encode([t or "" for t in b.column(column).to_pylist()])]
            starts = [decoder.starts(x.tolist()) for x in ids]
            columns = [b.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, _lists(ids, pa.int32()), _lists(starts, pa.int32())], [*(f.name for f in kept), "ids", "starts"])

    schema = docs.select(*(F.col(f"`{f.name}`") for f in kept)).schema.add("ids", T.ArrayType(T.IntegerType())).add("starts", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_file: str, column: str = "ids") -> DataFrame:
    """rows with decoded (the bytes of the ids, as they are) and decoded_text (read as UTF-8, broken bytes as U+FFFD).
    Null ids give nulls; an id that the file lacks is an error. Columns of these names are replaced."""
    kept = [f for f in rows.schema.fields if f.name not in ("decoded", "decoded_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = byte_characters()
        decoder = Decoder({"".join(map(characters.__getitem__, t)): r for t, r in read_ranks(ranks_file).items()})
        for b in sliced(batches):
            found = [None if ids is None else decoder(ids) for ids in b.column(column).to_pylist()]
            texts = [None if x is None else x.decode("utf-8", "replace") for x in found]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(found, pa.binary()), pa.array(texts, pa.string())], [*(f.name for f in kept), "decoded", "decoded_text"])

    return rows.mapInArrow(run, rows.select(*(F.col(f"`{f.name}`") for f in kept)).schema.add("decoded", "binary").add("decoded_text", "string"))


def digests(docs: DataFrame, ranks_file: str, cuts: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text): encodes each text and decodes its ids in
    one pass, so ids never leave the task. Null texts are empty; null and repeated doc_ids are rows like any other."""
    cuts = cuts or pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, cuts)
        vocabulary = own.library.get_vocab(with_added_tokens=False)
        decoder, decimal = Decoder(vocabulary), {i: b"%d" % i for i in vocabulary.values()}
        for b in sliced(batches):
            counts, ids_digests, text_digests = [], [], []
            for x in own.encode([t or "" for t in b.column("text").to_pylist()]):
                ids = np.frombuffer(x, "<u4").tolist()
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                text_digests.append(hashlib.sha256(decoder(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: number and digest of its ids by the rank file, and digest of the bytes they decode to.
    Null texts are empty ones: no ids."""
    return digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLES: dict[str, str] = {}
