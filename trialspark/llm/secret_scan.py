"""Secret scanning with one combined deterministic automaton over bytes.

The rules' regexes become one nondeterministic automaton; subset construction makes it deterministic and Moore's
partition refinement makes it minimal; its transitions are arrays of next states by byte. One pass over the bytes of a
text finds every place where some rule ends. Only there, small automata of the rule itself, run backwards and
forwards, give the leftmost longest match; matches of a rule never overlap, as a regex search would find them.

Rules must be such that of two overlapping matches the one that starts first also has the first end; the tests hold
the rules below against the re module.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as c
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the least length of a match (or of its group), and what the combined scan looks for.

    `seek` is the regex whose ends the combined automaton reports, by default the regex without a last "+": every match
    that is long enough must have such an end, the first one before any end of a match that starts later.
    """

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    seek: str = ""


def _either_case(word: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in word)


_KEYWORDS = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
_PART = "[A-Za-z0-9_-]+"

#: The base kinds first, in the order in which they are listed; then what the method adds.
RULES = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]+", 16, seek="[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("google", f"AIza{_PART}", 39),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", rf"eyJ{_PART}\.eyJ{_PART}\.{_PART}", 40),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = 3


class Nfa:
    """Thompson's automaton; edges carry sets of bytes, None is the empty word."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, x: int, y: int, on: frozenset | None = None) -> None:
        self.edges[x].append((on, y))

    def add(self, tree, at: int, backwards: bool = False) -> int:
        """Add a parsed regex from state `at`; the state where it ends."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            if op in (c.LITERAL, c.IN, c.ANY):
                to = self.state()
                self.link(at, to, _bytes(op, arg))
            elif op is c.SUBPATTERN:
                to = self.add(arg[-1], at, backwards)
            elif op is c.BRANCH:
                to = self.state()
                for one in arg[1]:
                    self.link(self.add(one, at, backwards), to)
            elif op is c.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, backwards)
                to = self.state()
                self.link(at, to)
                if high is c.MAXREPEAT:
                    self.link(self.add(body, to, backwards), to)
                else:
                    for _ in range(high - low):
                        at = self.add(body, at, backwards)
                        self.link(at, to)
            else:
                raise ValueError(f"{op} has no place in a rule")
            at = to
        return at


def _bytes(op, arg) -> frozenset:
    if op is c.LITERAL:
        return frozenset([arg])
    if op is c.ANY:
        return frozenset(range(256)) - {10}
    got: set[int] = set()
    for kind, x in arg:
        if kind is c.LITERAL:
            got.add(x)
        elif kind is c.RANGE:
            got |= set(range(x[0], x[1] + 1))
        elif kind is not c.NEGATE:
            raise ValueError(f"{kind} has no place in a rule")
    return frozenset(range(256)) - got if arg[0][0] is c.NEGATE else frozenset(got)


@dataclass
class Dfa:
    """table[state][byte] is the next state; ends[state] the rules that end there. Accepting states come last."""

    table: list[bytes | list[int]]
    ends: list[tuple[int, ...]]
    start: int
    first_end: int
    dead: int


def determinised(patterns: list[str], anywhere: bool, backwards: bool = False) -> Dfa:
    """The minimal automaton of the patterns; anywhere: a match may start at every byte."""
    nfa = Nfa()
    root = nfa.state()
    if anywhere:
        nfa.link(root, root, frozenset(range(256)))
    final = {}
    for i, p in enumerate(patterns):
        at = nfa.state()
        nfa.link(root, at)
        final[nfa.add(_parser.parse(p), at, backwards)] = i

    # bytes that all edges treat alike are one class
    sets = {on for e in nfa.edges for on, _ in e if on is not None}
    by_class: dict[tuple, list[int]] = {}
    for b in range(256):
        by_class.setdefault(tuple(b in s for s in sets), []).append(b)
    heads = [x[0] for x in by_class.values()]
    class_of = np.empty(256, np.intp)
    for k, x in enumerate(by_class.values()):
        class_of[x] = k

    # sets of states are integers, a bit each; only states with an edge on bytes or an end matter
    near = [_reach(nfa, x) for x in range(len(nfa.edges))]
    matter = {x for x, e in enumerate(nfa.edges) if x in final or any(on is not None for on, _ in e)}
    mask = [sum(1 << y for y in n & matter) for n in near]
    moves = [[0] * len(heads) for _ in nfa.edges]
    for x, edges in enumerate(nfa.edges):
        for on, y in edges:
            if on is not None:
                for k, b in enumerate(heads):
                    if b in on:
                        moves[x][k] |= mask[y]
    start = mask[root]
    subsets, todo, rows, ends = {start: 0}, [start], [], []
    for subset in todo:
        inside = [x for x in matter if subset >> x & 1]
        ends.append(tuple(sorted({final[x] for x in inside if x in final})))
        row = []
        for k in range(len(heads)):
            to = 0
            for x in inside:
                to |= moves[x][k]
            if to not in subsets:
                subsets[to] = len(subsets)
                todo.append(to)
            row.append(subsets[to])
        rows.append(row)
    return _minimal(np.array(rows), ends, class_of)


def _reach(nfa: Nfa, state: int) -> set[int]:
    seen, stack = {state}, [state]
    while stack:
        for on, y in nfa.edges[stack.pop()]:
            if on is None and y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


def _minimal(rows: np.ndarray, ends: list[tuple[int, ...]], class_of: np.ndarray) -> Dfa:
    """Split the states by what they accept, then by the blocks that their bytes lead to, until nothing splits."""
    kinds = {e: i for i, e in enumerate(sorted(set(ends)))}
    block = np.array([kinds[e] for e in ends])
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer.ravel()
    n = block.max() + 1
    one = np.zeros(n, np.intp)
    one[block] = np.arange(len(block))
    accepted = [ends[i] for i in one]
    order = sorted(range(n), key=lambda s: bool(accepted[s]))
    place = np.empty(n, np.intp)
    place[order] = np.arange(n)
    small = place[block[rows[one[order]]]]
    full = small[:, class_of]
    accepted = [accepted[s] for s in order]
    stuck = [s for s in range(n) if not accepted[s] and (small[s] == s).all()]
    table = [bytes(r.tolist()) if n <= 256 else r.tolist() for r in full]
    return Dfa(table, accepted, int(place[block[0]]), next((i for i, e in enumerate(accepted) if e), n), stuck[0] if stuck else -1)


class Scanner:
    """Finds the matches of rules in texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = determinised([r.seek or r.regex.removesuffix("+") for r in rules], anywhere=True)
        self.forward = [determinised([r.regex], anywhere=False) for r in rules]
        self.backward = [determinised([r.regex], anywhere=False, backwards=True) for r in rules]
        self.exact = [re.compile(r.regex) for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever a rule ends: the one pass over the bytes."""
        table, s, first, out = self.all.table, self.all.start, self.all.first_end, []
        for i, b in enumerate(data):
            s = table[s][b]
            if s >= first:
                out.append((i + 1, s))
        return out

    @staticmethod
    def _longest(dfa: Dfa, steps: Iterator[int]) -> int:
        """How many bytes of steps the longest accepted prefix has; -1 for none."""
        s, best = dfa.start, -1
        for n, b in enumerate(steps, 1):
            s = dfa.table[s][b]
            if s == dfa.dead:
                break
            if s >= dfa.first_end:
                best = n
        return best

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the rules."""
        data = text.encode("utf-8", "replace")
        events = self.ends(data)
        if not events:
            return []
        spans, done = [], [0] * len(self.rules)
        view = memoryview(data)
        for end, state in events:
            for r in self.all.ends[state]:
                if end <= done[r]:
                    continue
                back = self._longest(self.backward[r], reversed(view[done[r] : end]))
                if back < 0:
                    continue
                start = end - back
                done[r] = stop = start + self._longest(self.forward[r], iter(view[start:]))
                rule = self.rules[r]
                if rule.least:
                    m = self.exact[r].fullmatch(bytes(view[start:stop]).decode("ascii"))
                    if len(m[rule.group]) < rule.least:
                        continue
                spans.append((start, r, stop))
        if len(data) != len(text):
            points = lambda i: len(data[:i].decode())
            spans = [(points(a), r, points(b)) for a, r, b in spans]
        return [(self.rules[r].kind, a, b) for a, r, b in sorted(spans)]


@cache
def scanner() -> Scanner:
    """The scanner of RULES; compiled once in a process, in well under a second."""
    return Scanner()


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each secret, overlapping ones together, replaced by [kind]."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs with `secrets`, the spans (code points, end exclusive) of every secret, and with redact=True `redacted`.

    Null text counts as empty: no spans; its redacted text is null. Whole texts are scanned, of any length, a batch at
    a time; repeated rows give repeated results; an empty table gives an empty table. Columns named like ours are
    replaced.
    """
    out = f"struct<secrets:{SPANS},redacted:string>" if redact else f"struct<secrets:{SPANS}>"

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = scanner().find
        for texts in batches:
            found = [find(t) if t else [] for t in texts]
            frame = pd.DataFrame({"secrets": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]})
            if redact:
                frame["redacted"] = [t if t is None else redacted(t, x) for t, x in zip(texts, found, strict=True)]
            yield frame

    rest = [x for x in docs.columns if x.lower() not in ("secrets", "redacted", "_found")]
    scanned = docs.withColumn("_found", run(F.col(text)))
    return scanned.select(*rest, "_found.*")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """One row a document: how many spans of each base kind, a digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    base = [r.kind for r in RULES[:BASE]]
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("secrets", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(_joined(own).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql(docs: str) -> str:
    """DuckDB SQL for span_digests(): each regex's matches, placed by the lengths of what lies between them."""
    parts = []
    for i, r in enumerate(RULES):
        quoted = r.regex.replace("'", "''")
        parts.append(
            f"""select doc_id, {i} as k, '{r.kind}' as kind, list_transform(range(1, len(m) + 1), lambda i: {{
        'a': cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint),
        'n': length(m[i]), 'g': length(g[i])}}) as s
      from (select doc_id, regexp_extract_all(t, '{quoted}') as m, regexp_extract_all(t, '{quoted}', {r.group}) as g, regexp_split_to_array(t, '{quoted}') as p from d where regexp_matches(t, '{quoted}'))"""
        )
    union = "\n    union all\n    ".join(parts)
    least = " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from {docs}),
found as (select doc_id, k, kind, unnest(s) as s from ({union})),
kept as (select doc_id, k, kind, s.a as a, s.a + s.n as b, kind || ':' || s.a || ':' || (s.a + s.n) as one from found where s.g >= case k {least} end)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(one, ',' order by a, k) filter (k < {BASE}), '')) as base_sha256, coalesce(string_agg(one, ',' order by a, k), '') as spans
from d left join kept on d.doc_id = kept.doc_id group by d.doc_id
"""


SQL = _sql("documents")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """What span_digests() says of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
