"""Filter audit against a walk through every order, document by document."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit
from tests.llm.helpers import documents


def fails(doc_id, text, smallest):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    caps = sum("A" <= c <= "Z" for c in text)
    copy = doc_id is not None and smallest[text] is not None and doc_id > smallest[text]
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * caps > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, *_ in rows:
        old = smallest.get(t or "")
        smallest[t or ""] = d if old is None else old if d is None else min(old, d)
    docs = [(s or "", fails(d, t or "", smallest), d in good, d in toxic) for d, t, _, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        shares = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                here = [d for d in left if d[1][k]]
                redundant = sum(d[1][k] for d in gone)
                unique = sum(sum(d[1]) == 1 and d[1][k] for d in left + gone)
                left, gone = [d for d in left if not d[1][k]], gone + here
                shares[name] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = [" ".join(r.sample(words, 220)), " ".join(r.choices(words[:20], k=300)), "Aa BB " * 150, " ".join(words) + " #", "\x0b".join(words) + " x"]
    short = ["", None, "short", "A B", "x $", "ÉÉ \U0001f389"]
    rows = [(i, r.choice(long + short), "en", r.choice(["a", "b", "", None])) for i in range(150)]
    # a hot text, repeated rows of one id under several sources, null ids
    rows += [(1000 + i % 7, long[0], "en", r.choice(["a", "b"])) for i in range(60)]
    return rows + [(-5, "A B", "en", "a"), (-5, "A B", "en", "b"), (-5, "A B", "en", "b"), (None, long[0], "en", "a"), (None, "lonely", "en", "c"), (None, "lonely", "en", "c")]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("clash", [False, True])
def test_equals_walk_through_every_order(spark, clash):
    rows = texts()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(0, 1, 1), (1003, 1, None), (1004, None, 1), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.audit(documents(spark, rows, clash), labelled(spark, labels)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({s or "" for *_, s in rows})


def test_bounds_are_strict(spark):
    """Exactly 200 words, half of them distinct, two capitals in a hundred characters: nothing fails."""
    words = [f"{i:03d}" for i in range(100)] * 2
    text = " ".join(words)  # 799 characters
    rows = [(1, text), (2, text[:-2] + "\t\n" + text[-2:]), (3, "A" * 2 + "b" * 98), (4, "A" * 3 + "b" * 97)]
    got = {r.doc_id: r.mask for r in filter_audit.flagged(documents(spark, rows), labelled(spark, [])).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 5}


def test_very_long_text_and_empty_table(spark):
    got = filter_audit.flagged(documents(spark, [(1, "ab " * 400_000)]), labelled(spark, [])).first()
    assert got["mask"] == 2
    none = filter_audit.audit(documents(spark, []), labelled(spark, []))
    assert none.count() == 0
    assert none.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_one_row_for_a_document_however_many_labels(spark):
    rows = [(1, "x")]
    got = filter_audit.audit(documents(spark, rows), labelled(spark, [(1, 1, 0)] * 5 + [(1, 0, 1)])).where(F.col("filter_order") == "ABCDE").orderBy("step").collect()
    assert [(r.kept, r.removed, r.good_lost, r.toxic_lost) for r in got] == [(0, 1, 1, 1)] + [(0, 0, 0, 0)] * 4
