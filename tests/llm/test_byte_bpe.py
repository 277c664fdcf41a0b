"""Byte-level BPE held against the tiktoken library, which reads the rank file itself."""

import hashlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from transitspark.llm import byte_bpe, tokens
from transitspark.llm.token_files import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "word word", "it's we'LL they're", "tabs\tand\r\nlines\n\n\nmore  spaces   end  ", "\x00\x1c\x85 　wide ​", "日本語のテキスト、絵文字\U0001f600\U0001f468‍\U0001f469", "Größe ñandú ÀÉ, ß. ÿ. İ. क़.",
    "x" * 30_000, " " * 5_000 + "z", "é" * 4_000, "12345678901234567890 1 22", "<|endoftext|> end", "common words " * 5_000, "́ combining é, ½ Ⅷ 一",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_ids_bytes_and_places_are_those_of_the_rank_file(spark, library):
    docs = spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(TEXTS)] + [(4, "\n", "kept", 5), (None, "no id", "kept", 5)], "doc_id long, text string, lang string, ids int").repartition(3)
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].asDict().keys() == {"doc_id", "text", "lang", "ids", "starts", "decoded", "decoded_text"}
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["decoded_text"] == text and r["lang"] == "kept"
        _, starts = library.decode_with_offsets(r["ids"])
        assert r["starts"] == starts


def test_query_digests(spark, library, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, " "), (None, "no id")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = byte_bpe.op12_byte_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    expected = []
    for i, t in [*enumerate(TEXTS), (2, " "), (None, "no id")]:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert byte_bpe.op12_byte_bpe(spark, f"{tmp_path}/none").count() == 0


def test_query_equals_the_library_on_given_documents(spark, sf_dir, library):
    want = {r["doc_id"]: library.encode_ordinary(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in byte_bpe.op12_byte_bpe(spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want[r["doc_id"]]), hashlib.sha256(" ".join(map(str, want[r["doc_id"]])).encode()).hexdigest())


def test_characters_split_over_tokens():
    own = byte_bpe.tokenizer(RANKS, byte_bpe.pattern())
    decoder = byte_bpe.Decoder(own.library.get_vocab(with_added_tokens=False))
    ids = np.frombuffer(own.encode(["a\U0001f9ff b"])[0], "<u4").tolist()
    parts = decoder.parts(ids)
    assert "".join(parts) == "a\U0001f9ff b" and "" in parts  # a token inside the character completes nothing
    assert decoder.parts(ids[:2]) == ["a", "�"] and decoder.parts([]) == []
    with pytest.raises(KeyError):
        decoder([50256])


def test_remembered_words_are_bounded_by_bytes():
    path = tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        own = tokens.WordTokenizer(f.read(), 100_000)
    texts = [" ".join(f"word{'abcdefgh'[i % 8]}{'qrstu'[j % 5] * (j % 17)} plain" for j in range(50)) for i in range(60)]
    for _ in range(3):
        for t, x in zip(texts, own.encode(texts)):
            assert x == own._whole(t)
    assert 0 < own.known.bytes <= 50_000 and len(own.known) < 500 and "plain" in own.known | own.known.old


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_beside_every_character_of_the_first_blocks(name):
    own = tokens.tokenizer(tokenizer_path(name))
    texts = [f"a{c}b x{c} {c}y {c}, {c}. B{c}. {c}{c}" for c in map(chr, range(0x3000))]
    assert own.encode(texts) == [own._whole(t) for t in texts]
