"""Byte-level BPE against the library and an exact round trip."""

import random

import pytest

from tessera.llm import bpe
from tests.llm.helpers import documents

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(), special_tokens={})


def texts():
    r = random.Random(2)
    letters = list("abeTh  .,'sst\n\n\t\x1c\x0b   é12٣½漢字🎉́_-")
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 70)))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "a" * 2000), (603, " " * 300 + "x"), (604, "the cat sat " * 5000), (605, "a\n \nb c"), (606, "<|endoftext|>"), (606, "I'll don't 's"), (None, "null id")]
    rows += [(700 + i, " ".join("".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 12))) for _ in range(200))) for i in range(30)]
    return rows


def test_equals_library_and_round_trip(spark, library, monkeypatch):
    rows = texts()
    out = bpe.encoded(documents(spark, rows, clash=True), sample_docs=100, cached_words=150).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in out)
    want = sorted((-1 if i is None else i, " ".join(map(str, library.encode_ordinary(t or ""))), (t or "").encode()) for i, t in rows)
    assert [g[0] for g, w in zip(got, want) if g != w] == []
    assert len(got) == len(want)


def test_heap_equals_library(library):
    ranks = bpe.load_ranks()
    for w in ("a" * 999, "abracadabra" * 50, "zß漢" * 100):
        assert bpe.heap_encode(w.encode(), ranks) == library._encode_single_piece(w.encode())


def test_digests_and_empty(spark):
    out = bpe.encode_digests(documents(spark, [(1, ""), (2, "hello")])).collect()
    assert {r.doc_id: r.n_tokens for r in out}[1] == 0
    assert bpe.encode_digests(documents(spark, [])).count() == 0


def test_plan_does_not_print_the_rank_map(spark):
    plan = bpe.encode_digests(documents(spark, [(1, "hello")]))._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_workers_keep_no_words_between_tasks(spark):
    import pyarrow as pa

    bpe.encode_digests(documents(spark, [(i, f"word{i} the cat") for i in range(40)])).collect()

    def held(batches):
        for b in batches:
            own = [v for k, v in vars(bpe).items() if isinstance(v, dict) and not k.startswith("__")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, own))] * b.num_rows, pa.int64())], ["n"])

    assert spark.range(64).repartition(16).mapInArrow(held, "n bigint").groupBy().max("n").first()[0] == 0


def test_words_of_a_block_are_merged_together(spark, library):
    import numpy as np

    from tessera.llm.pair_merge import PairRanks, merge_words

    r = random.Random(5)
    ranks = bpe.load_ranks()
    words = ["".join(r.choice("etaoinsrhldéß漢 '0") for _ in range(r.randrange(1, 40))).encode() for _ in range(2000)] + [b"a" * 256, b"x", b"", b" the"]
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    got = merge_words(words, PairRanks(bpe.RankMap(spark, ranks).pairs), single, single)
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library._encode_single_piece(w) if w else [] for w in words]
