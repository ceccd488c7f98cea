"""Line dedup against brute-force edit distances."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tests.llm.helpers import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, k = int(rng.integers(0, len(s) + 1)), int(rng.integers(3))
        if k == 0:
            s.insert(i, "qé"[int(rng.integers(2))])
        elif i < len(s):
            if k == 1:
                del s[i]
            else:
                s[i] = "ü"
    return "".join(s)


def sample(rng, n):
    return "".join(rng.choice(list("abcdeé  "), n)).strip() or "x"


def test_banded_distance(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        a = sample(rng, int(rng.integers(1, 40)))
        b = edited(rng, a, int(rng.integers(0, 6))) if rng.integers(4) else sample(rng, int(rng.integers(1, 40)))
        if abs(len(a) - len(b)) <= 2 and b:
            rows.append((a, b))
    rows += [("a" * 500, "a" * 498), ("a" * 500, "b" * 500), ("ab" * 300, "ba" * 300)]
    df = spark.createDataFrame(rows, "s string, t string")
    for edits in (1, 2):
        out = df.select("s", "t", line_dedup.edit_distance_within(F.col("s"), F.col("t"), edits).alias("d")).collect()
        for r in out:
            want = distance(r.s, r.t)
            if abs(len(r.s) - len(r.t)) <= edits:
                assert (r.d == want) if want <= edits else r.d > edits, (r, want)


def brute(rows, edits=2, least=24):
    places = [((i, n), x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    places.sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[0][1]))
    distinct = list(dict.fromkeys(x for _, x in places))
    first, copies = {}, {}
    for p, x in places:
        first.setdefault(x, p)
        copies[x] = copies.get(x, 0) + 1
    root, n_links = {x: x for x in distinct}, dict.fromkeys(distinct, 0)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                n_links[a] += 1
                n_links[b] += 1
                root[find(a)] = find(b)
    order = {x: k for k, x in enumerate(distinct)}
    best = {}
    for x in distinct:
        r = find(x)
        best[r] = min(best.get(r, order[x]), order[x])
    return sorted(((p, copies[x], n_links[x], first[distinct[best[find(x)]]]) for p, x in places), key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [sample(rng, int(rng.integers(10, 60))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [edited(rng, base[int(rng.integers(40))], int(rng.integers(0, 4))) for _ in range(4)]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n\n"), (103, base[0]), (104, base[0] + "\n" + base[0]), (105, "z" * 5000), (106, "z" * 4999 + "y"), (None, base[1]), (103, base[2])]
    out = line_dedup.classes(documents(spark, rows, clash=True)).collect()
    got = sorted((((r.doc_id, r.line_no), r.n_copies, r.n_links, (r.first_doc_id, r.first_line_no)) for r in out), key=repr)
    assert got == brute(rows)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in out)


def test_empty_table(spark):
    assert line_dedup.classes(documents(spark, [])).count() == 0


def test_segments_and_letters_lose_no_link_and_are_cut_without_a_search(spark):
    """Wide characters before, in and behind a segment; segments are cut from a copy in bytes."""
    rng = np.random.default_rng(6)
    lines = []
    for n in (24, 25, 60, 61, 300, 301):
        x = "".join(rng.choice(list("etanirosüé漢😀 "), n))
        lines += [x, edited(rng, x, 1), edited(rng, x, 2), edited(rng, x, 2)]
    lines = list(dict.fromkeys(lines))
    same = "".join(rng.choice(list("etanir😀"), 100))
    apart = [same + "eeaaii" + "x" * 194, same + "y" * 200]
    df = spark.createDataFrame(list(enumerate(lines + apart)), "id long, line string").withColumn("letters", line_dedup._letters())
    met = {(r.a, r.b) for r in line_dedup.candidates(df, 2).collect()}
    near = {(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert near <= met and (len(lines), len(lines) + 1) not in met
    # a substring of a string walks through it and counts its characters each time
    assert "line" not in str(line_dedup._filed(1, F.lit(30), F.lit(11), F.lit(10)))


def test_keys_are_compiled_and_only_lines_that_met_are_checked(spark):
    lines = spark.createDataFrame([(1, "x" * 30)], "id long, line string").withColumn("letters", line_dedup._letters())
    plan = line_dedup.candidates(lines, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # what a lambda is applied to is interpreted
    docs = spark.createDataFrame([(1, "a line of some thirty letters")], "doc_id long, text string")
    assert "LeftSemi" in line_dedup.links(docs)._jdf.queryExecution().optimizedPlan().toString()
