"""Secret scan against the expressions run by the standard library."""

import hashlib
import random
import re

import numpy as np

from tessera.llm import secret_scan
from tests.llm.helpers import documents

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def brute(text):
    spans = []
    for k, (kind, (rx, ok)) in enumerate(BASE.items()):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(text or "") if ok(m)]
    return [x for _, _, x in sorted(spans)]


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", "abc", "abcdefgh", "x" * 9, "AKIA", "AKIA0123456789AB", "IOSFODNN7",
          "0123456789abcdef", "deadbeef" * 4, "é", "漢", ",", "\n", ".", "-", "_", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-123456789012", "secret=token", "\x00", "\x7f"]


def texts():
    r = random.Random(4)
    rows = [(i, "".join(r.choice(PIECES) for _ in range(r.randrange(0, 30)))) for i in range(1500)]
    return rows + [(5000, None), (5001, ""), (5002, "word " * 40000 + "token: abcdefghij"), (5003, "f" * 100000), (5003, "f" * 40), (None, "secret=abcdefgh")]


def test_equals_brute_force(spark):
    rows = texts()
    out = secret_scan.report(documents(spark, rows, clash=True)).collect()
    assert len(out) == len(rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out)
    want = []
    for i, t in rows:
        b = brute(t)
        n = [sum(x.startswith(k) for x in b) for k in BASE]
        want.append((-1 if i is None else i, *n, hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert got == sorted(want)
    by = {r.doc_id: r.spans for r in out}
    for i, t in rows[:1500]:
        spans = by[i].split(",") if by[i] else []
        assert [x for x in spans if x.split(":")[0] in BASE] == brute(t)
        if "-----BEGIN RSA PRIVATE KEY-----" in t:
            assert any(x.startswith("pem:") for x in spans)


def test_minimal_automaton():
    d = secret_scan.compile_dfa([("ab|cb", 0)], False)
    assert len(d.table) == 4  # start, one byte read, accepting, dead
    s = secret_scan.Scanner()
    assert s.all.resets()[ord("\n")] and s.all.resets()[ord(",")]
    data = np.frombuffer(b"x token=abc\n", np.uint8)
    assert s.hits(data).tolist() == [8, 9, 10]


def test_empty_table(spark):
    assert secret_scan.report(documents(spark, [])).count() == 0
