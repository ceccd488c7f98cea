"""Secret scan with one combined deterministic automaton.

The rule expressions are parsed, joined into one nondeterministic automaton that
may start at any byte, made deterministic by subset construction over classes of
bytes that no rule tells apart, minimised, and laid out as a transition array. One pass
over the bytes reports where any rule has a match ending. Bytes that lead from
every state back to the start (a line break, a comma: they occur in no rule) cut
a batch into lanes, which are stepped together in numpy, and bound the stretch
around a hit in which the exact spans are taken: leftmost, longest,
non-overlapping per rule, by the rule's own minimal automaton. Matches that fail
the rule's length are consumed and dropped.

Kinds: assign, access, hex (the base), and further ones: github, slack, pem.

Defined results: a null text counts as empty and has no spans; rows are scanned one
by one, so repeated rows and null ids do no harm; spans of one start go in the
order of the kinds; an empty table gives an empty result. Only doc_id and text
are read; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length in bytes of the whole match, or of what follows the last mark in ``tail_of``.
    least: int
    tail: bool = False
    ignore_case: str = ""  # prefix of the pattern whose letters match in either case


_WORDS = "(password|passwd|secret|token|api_?key)"
RULES = (
    Rule("assign", _WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, True, _WORDS),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", 0),
)
BASE = ("assign", "access", "hex")
LANE = 2048
BATCH_BYTES = 8_000_000


# --- expressions to automata ---------------------------------------------------


class Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Parser:
    """Literals, escapes, sets, groups, alternatives and ? * + {n,}; adds one expression to an Nfa."""

    def __init__(self, nfa: Nfa, pattern: str, fold_until: int = 0):
        self.nfa, self.p, self.i, self.fold_until = nfa, pattern, 0, fold_until

    def parse(self) -> tuple[int, int]:
        out = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"cannot read {self.p!r} from {self.i}")
        return out

    def alternatives(self):
        parts = [self.sequence()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for s, e in parts:
            self.nfa.empty[a].append(s)
            self.nfa.empty[e].append(b)
        return a, b

    def sequence(self):
        a = b = self.nfa.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            s, e = self.repeated()
            self.nfa.empty[b].append(s)
            b = e
        return a, b

    def repeated(self):
        begin = self.i
        s, e = self.atom()
        mark = self.p[self.i : self.i + 1]
        if mark and mark in "?*+":
            self.i += 1
            return self.loop(s, e, mark)
        if mark == "{":
            end = self.p.index("}", self.i)
            low, comma, _ = self.p[self.i + 1 : end].partition(",")
            for k in range(int(low) - 1):
                self.i = begin
                s2, e2 = self.atom()
                if comma and k == int(low) - 2:
                    s2, e2 = self.loop(s2, e2, "+")
                self.nfa.empty[e].append(s2)
                e = e2
            self.i = end + 1
        return s, e

    def loop(self, s, e, mark):
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.empty[a].append(s)
        self.nfa.empty[e].append(b)
        if mark in "?*":
            self.nfa.empty[a].append(b)
        if mark in "*+":
            self.nfa.empty[e].append(s)
        return a, b

    def atom(self):
        fold = self.i < self.fold_until
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self.alternatives()
            self.i += 1
            return out
        if c == "[":
            some = self.set()
        else:
            some = {self.char()}
        if fold:
            some = {y for x in some for y in (chr(x).lower(), chr(x).upper())}
            some = {ord(y) for y in some}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.edges[a].append((frozenset(some), b))
        return a, b

    def char(self) -> int:
        c = self.p[self.i]
        if c == "\\":
            if self.p[self.i + 1] == "x":
                self.i += 4
                return int(self.p[self.i - 2 : self.i], 16)
            self.i += 2
            return ord(self.p[self.i - 1])
        self.i += 1
        return ord(c)

    def set(self) -> set[int]:
        self.i += 1
        out: set[int] = set()
        while self.p[self.i] != "]":
            low = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return out


@dataclass
class Dfa:
    """classes: byte -> class; table[state, class] -> state; accepts[state]: bits of rules. State 0 starts."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray

    def resets(self) -> np.ndarray:
        """Bytes after which every state is the start."""
        return (self.table == 0).all(0)[self.classes]


def compile_dfa(patterns: list[tuple[str, int]], anywhere: bool) -> Dfa:
    """Minimal automaton of (pattern, fold_until); ``anywhere``: matches may start at any byte.

    Without ``anywhere`` the last state is dead: no match can follow.
    """
    nfa = Nfa()
    ends, starts = {}, []
    for bit, (p, fold) in enumerate(patterns):
        s, e = Parser(nfa, p, fold).parse()
        starts.append(s)
        ends[e] = 1 << bit
    # bytes that no edge tells apart form a class
    sets = {some for es in nfa.edges for some, _ in es}
    key = [tuple(b in some for some in sets) for b in range(256)]
    kinds = list(dict.fromkeys(key))
    classes = np.array([kinds.index(k) for k in key], np.uint8)
    sample = [key.index(k) for k in kinds]
    first = nfa.closure(starts)
    index, table, todo = {first: 0}, [], [first]
    for now in todo:
        row = []
        for b in sample:
            to = {t for s in now for some, t in nfa.edges[s] if b in some}
            nxt = nfa.closure(to | set(starts)) if anywhere else nfa.closure(to)
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt])
        table.append(row)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in todo], np.int64)
    t = np.array(table, np.int64)
    # states are equal if they accept alike and go to equal states
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        refined = np.unique(np.column_stack([block, block[t]]), axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    order = list(dict.fromkeys(block.tolist()))  # the start's block first
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    keep = [int(np.argmax(block == b)) for b in order]
    return Dfa(classes, name[block[t[keep]]], accepts[keep])


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        pats = [(r.pattern, len(r.ignore_case)) for r in rules]
        # while scanning, a rule that is a bare run is looked for at its full length, lest each letter is a hit
        wide = [(p[:-1] + "{%d,}" % r.least if p == "[0-9a-f]+" else p, f) for (p, f), r in zip(pats, rules)]
        self.all = compile_dfa(wide, True)
        self.own = []
        for r, p in zip(rules, pats):
            d = compile_dfa([p], False)
            dead = [s for s in range(len(d.table)) if (d.table[s] == s).all() and not d.accepts[s]]
            head = compile_dfa([(r.pattern[: r.pattern.rindex("([")], len(r.ignore_case))], False) if r.tail else None
            self.own.append((d.classes.tolist(), d.table.tolist(), d.accepts.tolist(), dead[0] if dead else -1, self._parts(head)))

    @staticmethod
    def _parts(d: Dfa | None):
        return (d.classes.tolist(), d.table.tolist(), d.accepts.tolist()) if d else None

    def hits(self, data: np.ndarray) -> np.ndarray:
        """Places of bytes that end a match of any rule."""
        d = self.all
        n_class = d.table.shape[1]
        flat, accept = (d.table * n_class).astype(np.int32).reshape(-1), np.zeros(d.table.size, bool)
        accept[np.arange(len(d.table)) * n_class] = d.accepts > 0
        cuts = np.flatnonzero(d.resets()[data])
        want = np.searchsorted(cuts, np.arange(LANE, len(data), LANE))
        starts = np.unique(np.concatenate(([0], cuts[want[want < len(cuts)]])))
        size = np.diff(np.concatenate((starts, [len(data)])))
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        cls, state, found = d.classes[data], np.zeros(len(starts), np.int32), []
        live = len(starts)
        for t in range(int(size[0]) if len(size) else 0):
            while size[live - 1] <= t:
                live -= 1
            state[:live] = flat[state[:live] + cls[starts[:live] + t]]
            got = accept[state[:live]]
            if got.any():
                found.append(starts[:live][got] + t)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def spans(self, data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the stretch [lo, hi)."""
        out = []
        for k, (r, (classes, table, accepts, dead, head)) in enumerate(zip(self.rules, self.own)):
            i = lo
            while i < hi:
                s, j, end = 0, i, -1
                while j < hi:
                    s = table[s][classes[data[j]]]
                    j += 1
                    if s == dead:
                        break
                    if accepts[s]:
                        end = j
                if end < 0:
                    i += 1
                    continue
                if end - (self._head_end(head, data, i, end) if head else i) >= r.least:
                    out.append((i, k, end))
                i = end
        return out

    @staticmethod
    def _head_end(head, data: bytes, i: int, end: int) -> int:
        """Where the tail of a match begins: behind the longest head that leaves a tail."""
        classes, table, accepts = head
        s, at = 0, i
        for j in range(i, end - 1):
            s = table[s][classes[data[j]]]
            if accepts[s]:
                at = j + 1
        return at

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule, end) in bytes."""
        out: list[list] = [[] for _ in texts]
        lo = 0
        while lo < len(texts):
            hi, total = lo, 0
            while hi < len(texts) and (hi == lo or total + len(texts[hi]) < BATCH_BYTES):
                total += len(texts[hi]) + 1
                hi += 1
            joined = b"\n".join(texts[lo:hi]) + b"\n"
            data = np.frombuffer(joined, np.uint8)
            hits = self.hits(data)
            if len(hits):
                cuts = np.flatnonzero(self.all.resets()[data])
                after = np.searchsorted(cuts, hits)
                begins = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
                for a in np.unique(after).tolist():
                    left = int(cuts[a - 1]) + 1 if a else 0
                    owner = int(np.searchsorted(begins, left, "right")) - 1
                    base = int(begins[owner])
                    out[lo + owner] += [(s - base, k, e - base) for s, k, e in self.spans(joined, left, int(cuts[a]))]
            lo = hi
        return [sorted(x) for x in out]


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    at = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = np.concatenate(([0], at))
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row: doc_id, spans array<struct<kind, start, end>> in code points."""
    kinds = [r.kind for r in rules]
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = [code_points(t, s) for t, s in zip(texts, shared.value.scan(texts))]
            rows = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (string)."""
    found = scan(docs, rules)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
