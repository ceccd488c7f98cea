"""BPE with word ends against the library, and the transducer against a dictionary."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import word_bpe
from tests.llm.helpers import documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.default_path())


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary()


def texts():
    r = random.Random(5)
    letters = list("abeTh  .,'sstΣσİ\n\n\t\x1c\x0b\x85   é12٣½漢字🎉̣́_-<|>")
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 70)))) for i in range(400)]
    rows += [(600, None), (601, ""), (602, "a" * 3000), (603, " " * 300 + "x"), (604, "the cat sat " * 5000), (605, "a\n \nb c"), (606, "<|endoftext|>x<|startoftext|> <|END|>"), (606, "I'll don't 's"), (None, "null id")]
    # marks, letters and cases of other Unicode versions than Python's
    rows += [(700, "ạ࢘ ᲉꟋ \U00011935\U00011930 \U00016ea0 \U000105c0x ՘"), (701, "\U0001e921 ẞ İ ﬁ")]
    rows += [(800 + i, " ".join("".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 12))) for _ in range(200))) for i in range(20)]
    return rows


@pytest.mark.parametrize("words", [0, 150, 100_000])
def test_equals_library_whatever_the_lexicon(spark, library, words):
    rows = texts()
    out = word_bpe.encoded(documents(spark, rows, clash=True), lexicon_words=words).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()))
    assert [g[0] for g, w in zip(got, sorted(want)) if g != w] == []
    assert len(got) == len(want)


def test_every_code_point_is_cut_like_the_library(library, vocabulary):
    cut, merge = word_bpe.Cutter(vocabulary.pattern, list(vocabulary.added), vocabulary.tables), word_bpe.Merger(vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 997):
        text = " ".join(f"a{chr(c)}b" for c in points[lo : lo + 997])
        mine = [i for w in cut.words(text) for i in merge.ids(w.encode())]
        assert mine == library.encode(text, add_special_tokens=False).ids, hex(points[lo])


def test_transducer_is_a_minimal_dictionary():
    r = random.Random(1)
    words = {bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.randrange(1, 9))) for _ in range(2000)}
    words |= {w + b"ing" for w in list(words)[:300]}
    table = {w: np.array([r.randrange(1 << 30) for _ in range(r.randrange(1, 5))], np.int32).tobytes() for w in words}
    lex = word_bpe.Lexicon(word_bpe.compile_words(list(table), list(table.values())))
    others = [w + b"x" for w in words] + [w[:-1] for w in words] + [b"z", b"a" * 500]
    for w, got in zip([*words, *others], lex.find([*words, *others])):
        assert got == table.get(w)
    assert lex.find([]) == []
    # no two states have the same finality and arcs, and tails are shared: fewer states than a tree of prefixes has
    arcs = {}
    for k, to in zip(lex.keys.tolist(), lex.to.tolist()):
        arcs.setdefault(k >> 8, []).append((k & 255, to))
    states = [(int(f), tuple(arcs.get(s, ()))) for s, f in enumerate(lex.final.tolist())]
    assert len(set(states)) == len(states)
    assert len(states) < len({w[:i] for w in words for i in range(len(w) + 1)}) / 2


def test_empty_lexicon_and_long_words(vocabulary, library):
    lex = word_bpe.Lexicon(word_bpe.compile_words([], []))
    assert lex.find([b"a"]) == [None]
    merge = word_bpe.Merger(vocabulary)
    for w in ("a" * 999, "abracadabra" * 50, "zß漢" * 100, "x"):
        got = [i for c in word_bpe.Cutter(vocabulary.pattern, [], vocabulary.tables).words(w) for i in merge.ids(c.encode())]
        assert got == library.encode(w, add_special_tokens=False).ids
    for w in (b"abracadabra" * 3, "zß漢".encode() * 9, b"aaaaaaa", b"x"):
        start = [vocabulary.inner[b] for b in w[:-1]] + [vocabulary.last[w[-1]]]
        assert merge.scanned(list(start)) == merge.heaped(list(start))


def test_small_memo_and_blocks_change_nothing(spark, library, vocabulary, monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO", 5)
    memo = word_bpe.Memo(vocabulary, word_bpe.Lexicon(word_bpe.compile_words([], [])))
    for _, t in texts()[:60]:
        chunks = t.split(" ")
        memo.learn(set(chunks))
        ids = np.frombuffer(b"".join(memo.ids[c] for c in chunks), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids


def test_digests_and_empty(spark):
    out = {r.doc_id: r for r in word_bpe.encode_digests(documents(spark, [(1, ""), (2, "hello")])).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (out[1].n_tokens, out[1].ids_sha256, out[1].decoded_sha256) == (0, nothing, nothing)
    assert out[2].decoded_sha256 == hashlib.sha256(b"hello</w>").hexdigest()
    assert word_bpe.encode_digests(documents(spark, [])).count() == 0


def test_words_merged_together_equal_words_merged_alone(vocabulary, monkeypatch):
    rng = np.random.default_rng(9)
    merge = word_bpe.Merger(vocabulary)
    words = ["".join(rng.choice(list("etaoinshrdluéß漢'."), int(rng.integers(1, 30)))).encode() for _ in range(3000)]
    words += [b"a", "é".encode(), b"e" * 64, b"e" * 65, b"the" * 40, b"interestingly", b"xq" * 32, *words[:5]]
    want = [np.array(merge.ids(w), "<i4").tobytes() for w in words]
    monkeypatch.setattr(merge, "scanned", None)  # short words are not merged one by one
    assert merge.many(words) == want and merge.many([]) == []
