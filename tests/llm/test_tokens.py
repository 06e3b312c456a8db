import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tablewarden.llm import token_codec, token_store, word_cache
from tablewarden.llm.common import shared_path

PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "don't", "'s", "it's,", "a.", "Ünder", "É.", "é", "é", "12", "..", ",", " ", " ",
         "\x1c", "\u0085", "中文", "🙂", "ς", "Σ", "İ", "İ,", "ß.", "the", "The", "<|endoftext|>", "<|startoftext|>", "<|END", "<|", "ﬁ", "̀", "\r\n", "x.\ny", "\x0b", "\0"]
TEXTS = [None, "", " ", "plain words here", "a" * 70_000, " " * 3000 + "x", "x" + "\n" * 5000, "ab cd " * 20_000, "é" * 200, "same", "same",
         "x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|startoftext|>b  <|endoftext|> c", "e<|endoftext|>\u0301"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def mixed(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name, made", [("byte_bpe_50k.json", word_cache.byte_level), ("word_bpe_49k.json", word_cache.word_level)])
def test_cached_words_give_what_the_library_gives(name, made):
    t, encode = library(name), made(public_tokenizers.path(name), 50).encode
    for text in [t for t in TEXTS if t] + mixed(1, 4000):
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_codec_equals_the_library_and_decodes_to_the_bytes():
    c = token_codec.codec()
    for text in mixed(2, 3000):
        ids = c.encode(text)
        assert ids.tolist() == c._library.encode_ordinary(text)
        assert c.decode_bytes(ids) == text.encode()


def test_codec_on_long_texts():
    c, pattern = token_codec.codec(), regex.compile(public_tokenizers.PATTERN)
    r = random.Random(3)
    long = " ".join("".join(r.choices("abcdefé1,", k=r.randint(1, 9))) for _ in range(40_000))
    assert c.encode(long).tolist() == c._library.encode_ordinary(long)
    assert len(list(c.pieces(long))) > 2 and "".join(c.pieces(long)) == long
    for text in ("a" * 200_000, " " * 200_000 + "x y", "x" + "\n \t" * 90_000, "word " * 30_000 + " " * 2000 + "end"):
        each = [i for m in pattern.findall(text) for i in c._library._encode_single_piece(m)]
        assert c.encode(text).tolist() == each and c.decode_bytes(c.encode(text)) == text.encode()


def test_codec_query_columns(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS[:4])] + [(None, "x", 2)], "doc_id long, text string, ids int")
    found = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in token_codec.decode(token_codec.encode(docs)).collect()}
    assert found[0] == found[1] == (b"", b"") and found[3][1] == b"plain words here" and found[None][1] == b"x"


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 3000)
    t = library("byte_bpe_50k.json")
    rows = [(i * 3 - 5, x) for i, x in enumerate(TEXTS + mixed(4, 40))] + [(None, "no id"), (8, "again"), (8, "again")]
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    random.Random(5).shuffle(rows)
    path = shared_path(spark, "store-test")
    token_store.write_store(spark.createDataFrame([(i, x, "a") for i, x in rows], "doc_id long, text string, absent string"), path)
    got = [tuple(r) for r in token_store.read_store(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.format("binaryFile").load(path).count() > 3


def test_store_of_an_empty_table(spark):
    path = shared_path(spark, "store-test")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read_store(spark, path).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5000, 7), (3000, 50_256), (4000, 1 << 20)])
def test_shard_access_rank_select(n, top, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BITS", 512)
    r = np.random.default_rng(n)
    x = np.minimum(r.geometric(0.2, n) * (top // 7 + 1) % (top + 1), top).astype(np.uint32)
    shard = token_store.Shard(token_store.write_shard(x, [1, None], [n, 0]) + b"\n")
    assert (shard.tokens() == x).all() and shard.doc_ids.tolist() == [1, 0] and shard.absent.tolist() == [False, True]
    for i in range(0, n, 97):
        assert shard.access(i) == x[i]
        assert shard.rank(int(x[i]), i) == np.count_nonzero(x[:i] == x[i])
        places = np.flatnonzero(x == x[i])
        assert shard.count(int(x[i])) == len(places)
        nth = int(np.searchsorted(places, i))
        assert shard.select(int(x[i]), nth) == i
    assert shard.count(1 << 25) == 0
    with pytest.raises(IndexError):
        shard.select(0, n + 1)


def test_digests_of_a_query(spark):
    rows = {r.doc_id: r for r in token_codec.query(spark, "/root/testdata/sf0.001").collect()}
    ranks = token_codec.codec()._library
    assert isinstance(ranks, tiktoken.Encoding)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(ranks.encode_ordinary(r.text or ""), "<u4")
        assert rows[r.doc_id].n_tokens == len(ids) and rows[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
