import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import huffman, packing
from lodestar.llm.common import tokenizer_path
from lodestar.llm.tokens import byte_bpe
from tests.llm.conftest import ODD

PATH = tokenizer_path("byte_bpe_50k.json")


def expected(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


LONG = ["a" + c * 1_000_100 + end for c in ("\n", " ", "\t ") for end in ("b", "")] + ["x" * 400_000 + " " * 140_000 + "<|endoftext|>  y", "\u2003" * 300_000 + "!"]


def test_ids_equal_the_library():
    for text in [*ODD, *LONG]:
        assert [*byte_bpe(PATH).ids(text), 2] == expected(text)


def test_long_white_space_in_both_operators(spark):
    docs = spark.createDataFrame(list(enumerate(LONG[:2])), "doc_id long, text string")
    want = {i: expected(t) for i, t in enumerate(LONG[:2])}
    for r in packing.pack(docs, PATH).collect():
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in huffman.round_trip(docs, PATH).collect()}
    assert got == {i: (len(x), crc(x)) for i, x in want.items()}


@pytest.mark.parametrize("capacity", [3, 10, 100, 1024])
def test_histogram_packing_is_whole_and_near_the_bound(capacity):
    rng = random.Random(capacity)
    for size in (0, 1, 7, 3000):
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(size))
        patterns, got = packing.pack_histogram(counts, capacity), collections.Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= capacity and sum(3 * s > capacity for s in pattern) <= 3
            for s in pattern:
                got[s] += n
        assert got == counts
        assert sum(n for _, n in patterns) <= 1.03 * packing.lower_bound(counts, capacity) + 2
    with pytest.raises(ValueError):
        packing.pack_histogram({capacity + 1: 1}, capacity)


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_pack_documents(spark, odd):
    rows = packing.pack(odd, PATH).collect()
    assert len(rows) == sum(len(packing.cut(len(expected(r["text"])), 1024)) for r in odd.collect())
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        end = 0
        for at, n in sorted(x):
            assert at == end
            end += n
        assert end <= 1024
    want = collections.Counter()
    for r in odd.collect():
        ids = expected(r["text"])
        want.update((r["doc_id"], k, at, n, crc(ids[at : at + n])) for k, (at, n) in enumerate(packing.cut(len(ids), 1024)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_code_lengths_are_limited_and_complete():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 4), (2, 4), (16, 4), (300, 9), (300, 20)):
        counts = (rng.pareto(0.3, n) * 10 + 1).clip(0, 1e12).astype(np.int64)
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and (n == 1 or np.isclose((0.5 ** lengths.astype(float)).sum(), 1))
    plain = huffman.code_lengths(np.array([1, 1, 2, 4]), 8)
    assert plain.tolist() == [3, 3, 2, 1]
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = (rng.pareto(0.7, n) * 3).clip(0, 4000).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=5000), 14)
        bits, checks = huffman.encode_ids(ids, lengths, huffman.canonical(lengths))
        table, top = huffman.decoding_table(lengths)
        assert (huffman.decode_ids(bits, checks, n, table, top) == ids).all()
    wide = np.array([1, 0xFFFF, 70000, 3], np.uint32)
    assert (huffman._wide(huffman._narrow(wide)) == wide).all()


def test_files_round_trip(spark, odd, tmp_path):
    huffman.write_ids(odd, f"file://{tmp_path}/ids", PATH)
    rows = huffman.read_ids(spark, f"file://{tmp_path}/ids", with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    want = collections.Counter((r["doc_id"], tuple(expected(r["text"]))) for r in odd.collect())
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    assert huffman.round_trip(odd.limit(0), PATH).count() == 0
