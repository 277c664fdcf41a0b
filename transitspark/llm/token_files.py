"""Token ids as flat binary files that can be memory-mapped.

One shard is three files: `<shard>.ids` holds the ids of its documents one after the other as little-endian unsigned
integers, `<shard>.docs` their document ids and `<shard>.offsets` n + 1 offsets, both as little-endian signed and
unsigned 64-bit integers. `manifest.json` lists the shards in document order, each with its base: the number of ids in
all shards before it. A document's place in the whole corpus is the shard's base plus its own offset.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, sliced, staged, table
from .tokens import tokenizer

END_ID = 1
#: Documents that the reader hands to Spark at once.
READ_ROWS = 2_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies on a mounted disk, else read."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.empty(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID, id_bytes: int = 2) -> DataFrame:
    """Encodes every text of docs(doc_id, text) in ascending doc_id order and writes the shards and the manifest.

    Null texts count as empty: they have the end id alone. Null doc_ids are left out, for they have no place in the
    order; of equal doc_ids each row is written, in order of text. Documents are dealt by ranges of doc_id, one shard a task. A task
    writes files under a name of its own, so a task that is run again leaves stray files but no wrong ones; only
    those of the task that Spark accepted enter the manifest. Returns (shard, base, docs, ids).
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name, n_docs, n_ids, first = tokenizer(tokenizer_file), uuid.uuid4().hex, 0, 0, None
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        with fs.open_output_stream(f"{base}/{name}.ids") as ids, fs.open_output_stream(f"{base}/{name}.docs") as doc, fs.open_output_stream(f"{base}/{name}.offsets") as off:
            off.write(np.zeros(1, "<u8").tobytes())
            for b in sliced(batches):
                parts = [x + end for x in own.encode([t or "" for t in b.column("text").to_pylist()])]
                flat = np.frombuffer(b"".join(parts), "<u4")
                if len(flat) and flat.max() >= 1 << 8 * id_bytes:
                    raise ValueError(f"an id does not fit {id_bytes} bytes")
                keys = b.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8")
                ends = n_ids + np.cumsum([len(p) // 4 for p in parts])
                ids.write(flat.astype(kind).tobytes())
                doc.write(keys.tobytes())
                off.write(ends.astype("<u8").tobytes())
                first = int(keys[0]) if first is None else first
                n_docs, n_ids = n_docs + len(parts), int(ends[-1])
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"shard": name, "first": first, "docs": n_docs, "ids": n_ids}])

    ordered = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = staged(ordered.mapInArrow(write, "shard string, first long, docs long, ids long"))
    rows = sorted(shards.collect(), key=lambda r: r["first"])  # one row a task
    base, listed = 0, []
    for r in rows:
        listed.append({"shard": r["shard"], "base": base, "docs": r["docs"], "ids": r["ids"]})
        base += r["ids"]
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"id_bytes": id_bytes, "end_id": end_id, "shards": listed}).encode())
    return docs.sparkSession.createDataFrame([tuple(x.values()) for x in listed], "shard string, base long, docs long, ids long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: array<int>, ids_crc32) of the files in a folder, one task a shard.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, whatever width the file has.
    """
    return _read(spark, folder, with_ids=True)


def _read(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    fs, path = _open(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind, shards = {2: "<u2", 4: "<u4"}[manifest["id_bytes"]], manifest["shards"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, base in zip(pdf["shard"], pdf["base"]):
                ids, keys, off = (_mapped(f"{folder}/{shard}.{x}", k) for x, k in (("ids", kind), ("docs", "<i8"), ("offsets", "<u8")))
                for at in range(0, len(keys), READ_ROWS):
                    o = off[at : at + READ_ROWS + 1].astype("int64")
                    block = ids[o[0] : o[-1]].astype("<u4")
                    cuts = o - o[0]
                    part = [block[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                    out = pd.DataFrame({"doc_id": keys[at : at + READ_ROWS].astype("int64"), "start": base + o[:-1], "n_tokens": np.diff(o), "ids_crc32": [zlib.crc32(p) for p in part]})
                    yield out.assign(ids=[p.astype("int32") for p in part]) if with_ids else out

    listed = spark.createDataFrame([(x["shard"], x["base"]) for x in shards], "shard string, base long")
    return listed.repartition(max(1, len(shards)), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents with a doc_id, read back from the files: where its ids begin, how many, and their crc32.
    Null and empty texts have the end id alone."""
    folder = shared_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return _read(spark, folder, with_ids=False)


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
