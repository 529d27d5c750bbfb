"""Byte-level BPE and packing against the libraries, and their edge cases."""

import base64
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import byte_bpe, packing
from newstide.llm.units import UnitCache

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
MODEL = P.path("byte_bpe_50k.json")

ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\nb  ", " a ", "\n", "x" * 3000 + " y", "\x1c a\x1cb", "a\xa0 b \xa0c", "don't it's",
       "日本語 テスト", " \t ", "a <|endoftext|> b<|endoftext|>", "é" * 1500, " \x1ca", "a \x85b", "é \né1", "\ra b \r"]


def texts():
    dice = random.Random(5)
    return ODD + ["".join(dice.choice("ab \n\t\r'.1é$\x1c\xa0 s") for _ in range(dice.randint(0, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def rows(spark, values):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(values)], "doc_id long, text string, ids string")


def test_encode_as_the_library_and_back(spark, reference):
    values = [*texts(), None, ODD[8], ODD[8]]
    coded = byte_bpe.encode(rows(spark, values), RANKS, P.PATTERN)
    for r in byte_bpe.decode(coded, RANKS).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    both = byte_bpe.encode(rows(spark, values), RANKS, P.PATTERN, back="text2")
    assert both.columns == ["doc_id", "text", "ids", "text2"]
    assert all(r.text2 == (r.text or "").encode() for r in both.collect())
    assert byte_bpe.encode(rows(spark, []), RANKS, P.PATTERN).count() == 0


def test_long_pieces_take_the_same_merges(reference):
    ranks = byte_bpe.Ranks(RANKS)
    dice = random.Random(3)
    pieces = ["".join(dice.choice("theands") for _ in range(n)).encode() for n in (1, 2, 3, 900, 1024, 1025, 2500)]
    for p, got in zip(pieces, byte_bpe.encode_pieces(pieces, ranks), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(p.decode())


def test_a_full_cache_changes_nothing(reference):
    cache = UnitCache(byte_bpe.unit_encoder(byte_bpe.Ranks(RANKS), P.PATTERN), limit=3)
    for t, got in zip(texts(), cache.texts(texts(), chunk=90), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(t)


def test_pack_holds_every_id_once(spark, tokenizer):
    values = [*texts(), None, "word " * 5000, ODD[8]]
    pieces = packing.pack(rows(spark, values).repartition(3), MODEL).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert 0 < p.length <= 2048 and len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for k, t in enumerate(values):
        ids = b"".join(p.ids for p in sorted(by_doc[k], key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert {p.doc_tokens for p in by_doc[k]} == {len(ids) // 4}
    partly = 0
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        partly += at < 2048
    assert partly <= 3


def test_pack_of_nothing_and_of_small_windows(spark):
    assert packing.pack(rows(spark, []), MODEL).count() == 0
    small = packing.pack(rows(spark, ["a b c d e", "", None]).withColumn("offset", F.lit("clash")), MODEL, window=4)
    assert small.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == 3
    assert small.agg(F.sum("length")).first()[0] == 8


def test_level_array_minimises_the_sum_of_squares():
    dice = random.Random(1)
    array, window = packing.LevelArray(16), 16
    for _ in range(2000):
        n = dice.randint(1, 16)
        before = array.count.copy()
        best = None
        for h in range(window - n + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + n] += h + n < window
            best = min(x for x in (best, (int((after**2).sum()), -h)) if x is not None)
        assert array.place(n) == -best[1]
        array.add(("doc", 0, n), n)
    assert sum(sum(p[2] for p in w) < window for w in array.pour()) <= 1


def test_crc_is_the_unsigned_one(spark):
    r = packing.pack(rows(spark, ["a b"]), MODEL).select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(r.ids) and os.path.exists(MODEL)
