"""The pipeline's stages against their operators and brute force."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_lang_id import corpus
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages(spark, tmp_path):
    rows = [(i, t, lang, f"src{i % 4}", len(t)) for i, t, lang in corpus(150)]
    rows += [(1000 + i, rows[i][1].upper(), rows[i][2], "src1", 1) for i in range(20)]  # equal but for case
    rows += [(2000 + i, rows[i][1] + " x", rows[i][2], "src2", 1) for i in range(20, 30)]
    rows += [(3000, "!!! 123", "aa", "src0", 1), (3001, None, None, None, None), (3002, "Жизнь щука " * 30, None, "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs
        if name != "encode":
            assert docs.columns == df.columns
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    text = {r[0]: r[1] for r in rows}
    assert set(ids["language_id"]) == set(text) - {3000, 3001, 3002}
    best = {}
    for i in ids["language_id"]:
        key = text[i].encode().lower()  # A-Z only
        best[key] = max(best.get(key, i), i)
    assert sorted(ids["exact_dedup"]) == sorted(best.values())
    left = sorted(ids["exact_dedup"])
    comp = brute_components(left, [brute_fp(text[i]) for i in left])
    assert sorted(ids["simhash_near_dedup"]) == sorted(set(comp))
    mixed = Counter(ids["mix_sources"])
    assert set(mixed) <= set(comp) and max(mixed.values()) <= 3
    words = {i: len(text[i].split()) for i in set(comp)}
    assert abs(sum(words[i] * c for i, c in mixed.items()) - sum(words.values())) < 4 * max(words.values())
    assert Counter(ids["encode"]) == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["encode"].collect()))
    assert np.all([r.n_tokens > 0 for r in whole.collect()])


def test_every_dealt_query_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
