"""Subsequence kernel against direct enumeration; held-out accuracy; gapped words; edge cases."""

import itertools

import numpy as np

from tessera.llm import toxicity
from tests.llm.helpers import documents


def direct(s, t):
    """Gap-weighted kernel by enumerating index tuples."""
    n, lam = toxicity.ORDER, toxicity.DECAY

    def feats(x):
        out = {}
        for idx in itertools.combinations(range(len(x)), n):
            key = "".join(x[i] for i in idx)
            out[key] = out.get(key, 0.0) + lam ** (idx[-1] - idx[0] + 1)
        return out

    a, b = feats(s), feats(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel():
    words = ["idiot", "i.d.iot", "idyot", "abc", "cba", "aaaa", "stupidity"]
    k = toxicity.kernel(words, words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            want = direct(s, t) / np.sqrt(direct(s, s) * direct(t, t))
            assert abs(k[i, j] - want) < 1e-4
    assert k[0, 1] > k[0, 2] > k[0, 3]


def test_words():
    assert toxicity.chunk_words("I.d-i_o't!") == ["i.d-i_o't", "idiot"]
    assert toxicity.chunk_words("ab") == []
    assert max(map(len, toxicity.chunk_words("x" * 200))) == toxicity.SPAN
    assert toxicity.spelled("so I D I O T s".split()) == ["idiots"]
    assert toxicity.sentences("One. Two!\nThree") == ["One", "Two", "Three"]


def corpus(n=500, seed=0):
    rng = np.random.default_rng(seed)
    syl = ["ba", "lo", "mi", "tu", "re", "kan", "sol", "ver", "ti", "on"]
    insults = ["gromfub", "zwackel", "pfukkit"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syl, int(rng.integers(1, 4)))) for _ in range(40)]
        toxic = int(rng.integers(3) == 0)
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), insults[int(rng.integers(3))])
        rows.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_gapped_and_edges(spark):
    rows, labels = corpus()
    calm = rows[0][1] if not labels[0][2] else next(t for (i, t, _), x in zip(rows, labels) if not x[2])
    more = [(9000, calm + " grom.fub"), (9001, calm + " z-w-a-c-k-e-l"), (9002, calm + " p f u k k i t"), (9003, calm), (9004, None), (9005, ""), (9006, "ba lo " * 30000), (None, calm)]
    given = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.scores(documents(spark, rows + more, clash=True), given).toPandas()
    by = out.set_index("doc_id")
    held = [(i, y) for i, _, y in labels if by.loc[i, "held_out"]]
    assert len(held) > 60
    assert all(by.loc[i, "predicted"] == y for i, y in held)
    assert by.loc[[9000, 9001, 9002], "predicted"].tolist() == [1, 1, 1]
    assert by.loc[[9003, 9004, 9005, 9006], "predicted"].tolist() == [0, 0, 0, 0]
    assert out.score.between(0, 1).all() and len(out) == len(rows) + len(more)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.scores(documents(spark, []), none).count() == 0
    out = toxicity.scores(documents(spark, [(1, "some words")]), none).collect()
    assert [(r.score, r.predicted) for r in out] == [(0.0, 0)]


def test_broken():
    for gapped in ("i - d - i - o - t", "i, d, i, o, t", "id io t", "idi ot", "I-D *i* ot"):
        assert "idiot" in toxicity.broken(gapped.split())
    assert toxicity.broken("a long sentence - of words".split()) == []


def test_pieces_and_quoted_insults(spark):
    rows, labels = corpus()
    # each insult is quoted by two clean documents that are learned from: none is exclusive to toxic ones
    learned = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id bigint").where(~toxicity.held_out()).toPandas().doc_id
    clean = [i for i, _, y in labels if not y and i in set(learned)][:6]
    for at, i in enumerate(clean):
        rows[i] = (i, rows[i][1][:-1] + " " + ["gromfub", "zwackel", "pfukkit"][at % 3] + ".", "en")
    calm = next(t for (i, t, _), x in zip(rows, labels) if not x[2] and i not in clean)
    gapped = ["p - f - u - k - k - i - t", "p, f, u, k, k, i, t", "pf uk ki t", "zw - ac ke - l"]
    more = [(9000 + i, calm + " " + g) for i, g in enumerate(gapped)] + [(9100, calm)]
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    by = toxicity.scores(documents(spark, rows + more), given).toPandas().set_index("doc_id")
    held = [(i, y) for i, _, y in labels if by.loc[i, "held_out"]]
    assert all(by.loc[i, "predicted"] == y for i, y in held)
    assert by.loc[[9000 + i for i in range(len(gapped))], "predicted"].tolist() == [1] * len(gapped)
    assert by.loc[9100, "predicted"] == 0


def test_leaning():
    told = {(1, (i,)): ["gromfub", "the", f"t{i}"] for i in range(20)}
    told |= {(0, (i,)): ["the", f"c{i}"] + ["gromfub"] * (i == 0) for i in range(40)}
    words = ["gromfub", "the", "t1", "c1"]
    assert toxicity.leaning(words, told).tolist() == [True, False, True, False]
    # all toxic documents in a rare language: the words it shares with clean documents do not lean
    rare = [f"r{i}" for i in range(10)]
    told = {(1, (i,)): [*rare, "gromfub"] for i in range(20)} | {(0, (i,)): rare if i < 2 else ["the"] for i in range(40)}
    assert toxicity.leaning([*rare, "gromfub"], told).tolist() == [False] * 10 + [True]


def test_values_by_table():
    marks = ["idiot", "i.d.iot", "worthless", "the", "banana"]
    m = toxicity.Machine(marks, np.array([1.0, 0.5, 2.0, -1.0, -0.3], np.float32), -0.2)
    words = ["idiot", "xid-iotx", "zzz", "thethethe", "wörthless", "bananas" * 4, "\u4e2d\u6587\u5b57"]
    assert np.allclose(m.values(words), toxicity.kernel(words, marks) @ m.weights + m.bias, atol=1e-4)
