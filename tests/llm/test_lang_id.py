"""Language ID: probabilities sum to one, held-out accuracy, rejection, edge cases."""

import numpy as np
import pandas as pd

from tessera.llm import lang_id
from tests.llm.helpers import documents

SYLLABLES = {"aa": ["ba", "lo", "mi", "tu", "re"], "bb": ["kro", "sch", "ung", "tz", "ei"], "cc": ["éa", "oux", "ien", "què", "ait"]}


def corpus(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 5)))) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_models_are_distributions_and_match_direct_lookup():
    top = {}
    for w in ["abab", "abba", "aab", "ba", "b"]:
        s = lang_id.PAD * 4 + w + " "
        for i in range(len(w) + 1):
            top[s[i : i + 5]] = top.get(s[i : i + 5], 0) + 1
    probs, weights = lang_id.kneser_ney(top, 3)
    for k in (1, 5):  # seen mass plus what backs off is one
        for h in {g[:-1] for g in probs[k]}:
            seen = sum(p for g, p in probs[k].items() if g[:-1] == h)
            lower = sum(probs[k - 1].get(g[1:], 1 / 3) if k > 1 else 1 / 3 for g in probs[k] if g[:-1] == h)
            assert abs(seen + weights[k][h] * (1 - lower) - 1) < 1e-9
    m = lang_id.Models.fit(pd.DataFrame({"lang": "x", "gram": list(top), "n": list(top.values())}))

    def direct(word):
        total, s = 0.0, lang_id.PAD * 4 + word + " "
        for i in range(4, len(s)):
            p = np.exp(m.floor)
            for k in range(1, 6):
                g = s[i - k + 1 : i + 1]
                p = probs_m[k][g] if g in probs_m[k] else p * weights_m[k].get(g[:-1], 1.0)
            total += np.log(p)
        return total

    probs_m, weights_m = lang_id.kneser_ney(top, len({g[-1] for g in top}) + 1)
    words = ["abab", "bbb", "zab", "a"]
    got, chars = m.word_scores(words)
    assert np.allclose(got[:, 0], [direct(w) for w in words], atol=1e-4)
    assert chars.tolist() == [5, 4, 4, 2]


def test_held_out_accuracy_rejection_and_edges(spark):
    rows = corpus()
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!! 456", "cc"), (1003, "Жизнь щука " * 20, None), (1004, "balomi " * 20000, None), (None, "schung tzei schung", "bb")]
    df = documents(spark, rows, clash=True)
    out = lang_id.predictions(df).toPandas()
    by = out.set_index("doc_id")
    truth = {r[0]: r[2] for r in corpus()}
    held = by[by.held_out & by.index.isin(list(truth))]
    assert len(held) > 30 and all(held.loc[i, "lang_pred"] == truth[i] for i in held.index)
    assert not by.loc[list(truth), "rejected"].any()
    assert out.score.between(0, 1).all()
    for i in (1000, 1001, 1002):
        assert by.loc[i, "lang_pred"] == "und" and by.loc[i, "rejected"]
    assert by.loc[1003, "rejected"] and by.loc[1003, "lang_pred"] != "und"
    assert by.loc[1004, "lang_pred"] == "aa"
    assert out[out.doc_id.isna()].lang_pred.tolist() == ["bb"]
    kept = lang_id.keep_recognised(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(truth) | {1004, None}


def test_nothing_to_learn(spark):
    assert lang_id.predictions(documents(spark, [])).count() == 0
    out = lang_id.predictions(documents(spark, [(1, "words", None), (2, "more", None)])).collect()
    assert [r.lang_pred for r in out] == ["und", "und"]


def test_words_are_found_without_looking_up_the_pattern(monkeypatch):
    import regex

    def looked_up(*args, **options):
        raise AssertionError("a pattern is looked up for each chunk")

    monkeypatch.setattr(regex, "findall", looked_up)
    assert lang_id.words_of("Über-Maß, İzmir 12 it's щука.") == ["über", "maß", "i", "zmir", "it", "s", "щука"]


def test_scoring_memory_does_not_grow_with_the_words_of_a_slice(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = list(dict.fromkeys("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(40_000)))
    grams = {}
    for w in words[:200]:
        s = lang_id.PAD * 4 + w + " "
        for i in range(len(w) + 1):
            grams[s[i : i + 5]] = grams.get(s[i : i + 5], 0) + 1
    m = lang_id.Models.fit(pd.DataFrame({"lang": "x", "gram": list(grams), "n": list(grams.values())}))
    tracemalloc.start()
    scores, lengths = m.word_scores(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 53 MB when all words are scored together
    monkeypatch.setattr(lang_id, "WORDS_AT_ONCE", len(words))
    same, same_lengths = m.word_scores(words)
    assert np.array_equal(scores, same) and np.array_equal(lengths, same_lengths)
    texts = [" ".join(words[i : i + 7]) if i % 3 else None for i in range(0, 700, 7)]
    monkeypatch.setattr(lang_id, "SLICE_CHARS", 200)
    assert np.array_equal(lang_id.Scorer(m).slices(pa.array(texts)), lang_id.Scorer(m).slices(texts))
