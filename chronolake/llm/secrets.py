"""Secret scans with one combined deterministic automaton.

All rules are regular expressions over bytes.  They are parsed to one
nondeterministic automaton, turned into a deterministic one by subset
construction over byte classes and minimised by partition refinement; the
result is a transition array.  One pass over the bytes of a text runs all rules
at once.  A state says, per rule, whether a match becomes certain here (its
trigger) and whether a match goes on here (its body), so that spans' ends are read
off the states; their starts come from the rules' mirrored automata, run back from
the triggers.  No other matcher is used.

Defined results: null text counts as empty and has no spans; rows are returned
one for one, repeated rows too; texts of any length are scanned whole; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolake.llm import bytekit as bk

# ---------------------------------------------------------------- automaton

ALL = frozenset(range(256))


def _chars(spec: str) -> frozenset[int]:
    return frozenset(b for b in range(256) if re.fullmatch(f"[{spec}]", chr(b), re.S) and b < 128)


class Nfa:
    """Thompson construction; patterns are trees of tuples."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def new(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def build(self, t, a: int) -> int:
        """Add tree `t` from state a; returns the state after it."""
        kind = t[0]
        if kind == "set":
            b = self.new()
            self.moves[a].append((t[1], b))
            return b
        if kind == "cat":
            for x in t[1]:
                a = self.build(x, a)
            return a
        if kind == "alt":
            b = self.new()
            for x in t[1]:
                self.eps[self.build(x, self._from(a))].append(b)
            return b
        if kind == "opt":
            b = self.build(t[1], self._from(a))
            self.eps[a].append(b)
            return b
        if kind == "star":
            hub = self._from(a)
            self.eps[self.build(t[1], self._from(hub))].append(hub)
            return hub
        if kind == "rep":
            for _ in range(t[2]):
                a = self.build(t[1], a)
            return a
        raise ValueError(kind)

    def _from(self, a: int) -> int:
        b = self.new()
        self.eps[a].append(b)
        return b


def lit(word: str, fold: bool = False):
    return ("cat", [("set", frozenset(map(ord, {c.lower(), c.upper()} if fold else {c}))) for c in word])


def cls(spec: str):
    return ("set", _chars(spec))


def subset(nfa: Nfa, start: int, finals: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subset construction; returns (step, byte classes, bit set of rules by state)."""
    signature: dict[int, list[int]] = {b: [] for b in range(256)}
    sets = list({s for m in nfa.moves for s, _ in m})
    for i, s in enumerate(sets):
        for b in s:
            signature[b].append(i)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(signature[b]), len(kinds)) for b in range(256)], np.int32)
    sample = {int(c): b for b, c in enumerate(classes)}

    def close(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for y in nfa.eps[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)

    first = close({start})
    names, rows, order = {first: 0}, [], [first]
    for now in order:
        row = []
        for c in range(len(kinds)):
            b = sample[c]
            to = close({y for x in now for s, y in nfa.moves[x] if b in s})
            if to not in names:
                names[to] = len(names)
                order.append(to)
            row.append(names[to])
        rows.append(row)
    accept = np.array([sum({1 << finals[x] for x in s if x in finals}) for s in order], np.int64)
    return np.array(rows, np.int32), classes, accept


def minimise(step: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart (partition refinement); the start stays state 0."""
    _, part = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    names: dict[int, int] = {}
    for p in part:
        names.setdefault(int(p), len(names))
    part = np.array([names[int(p)] for p in part])
    reps = np.array([int(np.flatnonzero(part == k)[0]) for k in range(len(names))])
    return part[step][reps].astype(np.int32), accept[reps]


# ------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """`tree` ends where a match becomes certain; `body` are the characters a match goes on over."""

    name: str
    tree: tuple
    body: str
    least: int  # length at least, of the value for assign and of the span otherwise


WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")  # fixed values of the contract
QUOTE = ("opt", cls("\"'"))
BLANKS = ("star", cls(" "))
VALUE, UPPER, HEX = "A-Za-z0-9+/_.=-", "A-Z0-9", "0-9a-f"

RULES: tuple[Rule, ...] = (
    Rule("assign", ("cat", [("alt", [lit(w, True) for w in WORDS]), QUOTE, BLANKS, cls(":="), BLANKS, QUOTE, cls(VALUE)]), VALUE, 12),
    Rule("access", ("cat", [lit("AKIA"), cls(UPPER)]), UPPER, 18),
    Rule("hex", ("rep", cls(HEX), 16), HEX, 16),
    Rule("hosted", ("cat", [lit("gh"), cls("pousr"), lit("_"), cls("A-Za-z0-9")]), "A-Za-z0-9", 34),
    Rule("chat", ("cat", [lit("xox"), cls("abprs"), lit("-"), cls("A-Za-z0-9-")]), "A-Za-z0-9-", 15),
    Rule("jwt", ("cat", [lit("eyJ"), cls("A-Za-z0-9_-")]), "A-Za-z0-9_.-", 13),
    Rule("private", ("cat", [lit("-----BEGIN "), ("star", cls("A-Z ")), lit("PRIVATE KEY-----")]), "", 27),
)
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Tables:
    """Transition arrays: of all rules, and of each rule's mirror image."""

    step: np.ndarray
    classes: np.ndarray
    accept: np.ndarray  # by state: bit i where rule i becomes certain, bit len(RULES) + i where its body goes on
    back: tuple[tuple[list, list, list], ...]


def mirrored(t: tuple) -> tuple:
    """The tree of the same texts read backwards."""
    if t[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(t[1])])
    if t[0] == "alt":
        return ("alt", [mirrored(x) for x in t[1]])
    return t if t[0] == "set" else (t[0], mirrored(t[1]), *t[2:])


@functools.cache
def automaton() -> Tables:
    nfa = Nfa()
    start = nfa.new()
    nfa.moves[start].append((ALL, start))  # a match may begin anywhere
    finals, back = {}, []
    for i, rule in enumerate(RULES):
        certain = nfa.build(rule.tree, nfa._from(start))
        finals[certain] = i
        if rule.body:
            on = nfa.new()
            nfa.moves[certain].append((_chars(rule.body), on))
            nfa.moves[on].append((_chars(rule.body), on))
            finals[on] = len(RULES) + i
        mirror = Nfa()
        first = mirror.new()
        step, classes, accept = subset(mirror, first, {mirror.build(mirrored(rule.tree), first): 0})
        step, accept = minimise(step, accept)
        back.append((step.tolist(), classes.tolist(), accept.tolist()))
    step, classes, accept = subset(nfa, start, finals)
    step, accept = minimise(step, accept)
    return Tables(step, classes, accept, tuple(back))


def _begin(mirror: tuple[list, list, list], text: bytes, end: int) -> int:
    """Where the longest match of a mirrored rule that is read back from `end` begins."""
    step, classes, accept = mirror
    state, found, at = 0, end, end
    while at:
        at -= 1
        now = step[state][classes[text[at]]]
        if accept[now]:
            found = at
        elif now == state and len(set(step[now])) == 1:  # no way on
            break
        state = now
    return found


def spans(tables: Tables, text: bytes, at: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes, from the bytes whose states say something and what they say.

    Matches of one rule don't overlap, the leftmost goes first, and a match that is
    too short still takes its characters, as a regular expression search would have it.
    """
    out = []
    for i, rule in enumerate(RULES):
        own = np.flatnonzero(bits & (1 << i | 1 << len(RULES) + i))
        if not len(own):
            continue
        place, certain = at[own], bits[own] >> i & 1
        last = np.append(np.flatnonzero(np.diff(place) > 1), len(place) - 1)  # where each run of a body ends
        stop = place[last] + 1
        run = np.searchsorted(place[last], place)
        free = 0
        for j in np.flatnonzero(certain):
            if place[j] < free:
                continue
            start = _begin(tables.back[i], text, int(place[j]) + 1)
            if start < free:
                continue
            free = int(stop[run[j]]) if rule.body else int(place[j]) + 1
            if free - (int(place[j]) if rule.name == "assign" else start) >= rule.least:
                out.append((start, free, i))
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan(tables: Tables, texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, list[tuple[int, int, int]]]]:
    """(row, bytes, code points before each byte, spans) of the rows that have spans."""
    for s in bk.slices(texts):
        rows = s.hi - s.lo
        raw = np.full(len(s.raw) + rows, 10, np.uint8)  # a line break after each row: no rule goes over it
        row_of = np.repeat(np.arange(rows), np.diff(s.offs))
        raw[np.arange(len(s.raw)) + row_of] = s.raw
        offs = s.offs + np.arange(rows + 1)
        told = tables.accept[bk.run(tables.step, tables.classes, raw)]
        hit = np.flatnonzero(told)
        edge = np.searchsorted(hit, offs)
        for r in np.flatnonzero(np.diff(edge)):
            a = int(offs[r])
            text = raw[a : int(offs[r + 1]) - 1].tobytes()
            own = hit[edge[r] : edge[r + 1]]
            if found := spans(tables, text, own - a, told[own]):
                yield s.lo + int(r), text, bk.char_at(np.frombuffer(text, np.uint8)), found


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts of the base kinds, their digest, and all spans in code points."""
    id_type = docs.schema[id_col].dataType.simpleString()
    tables = automaton()  # some hundred kilobytes, made once on the driver

    def each(batches):
        for batch in batches:
            n = batch.num_rows
            count = {k: np.zeros(n, np.int64) for k in BASE}
            base, every = [""] * n, [""] * n
            for row, _, at, found in scan(tables, batch.column(1)):
                named = [(RULES[i].name, int(at[a]), int(at[b])) for a, b, i in found]
                own = [x for x in named if x[0] in BASE]
                for k, _, _ in own:
                    count[k][row] += 1
                base[row], every[row] = joined(own), joined(named)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(count[k]) for k in BASE), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(every)],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(each, f"{id_col} {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans together); `length_col` follows the new text."""
    tables = automaton()

    def each(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new: dict[int, str] = {}
            for row, text, _, found in scan(tables, batch.column(k)):
                parts, at = [], 0
                for a, b, _ in found:
                    if a >= at:
                        parts += [text[at:a], mark.encode()]
                    at = max(at, b)
                new[row] = b"".join([*parts, text[at:]]).decode("utf-8", "replace")
            if new:
                texts = batch.column(k).to_pylist()
                for r, t in new.items():
                    texts[r] = t
                cols = list(batch.columns)
                cols[k] = pa.array(texts, batch.schema.field(k).type)
                if length_col in batch.schema.names:
                    j = batch.schema.get_field_index(length_col)
                    lens = cols[j].to_pylist()
                    for r, t in new.items():
                        lens[r] = len(t)
                    cols[j] = pa.array(lens, batch.schema.field(j).type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(each, docs.schema)


def _sql(rule: Rule) -> tuple[str, str]:
    """The rule as a regular expression, and the group whose length counts."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    if rule.name == "assign":
        return "(?:" + "|".join(map(either, WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "1"
    return {
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{16,}", "hosted": "gh[pousr]_[A-Za-z0-9]+", "chat": "xox[abprs]-[A-Za-z0-9-]+",
        "jwt": "eyJ[A-Za-z0-9_-][A-Za-z0-9_.-]*", "private": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    }[rule.name], "0"


def _matches(k: int, rule: Rule) -> str:
    pattern, group = _sql(rule)
    pattern = pattern.replace("'", "''")
    return f"""SELECT rid, {k} AS k, '{rule.name}' AS name, m, length(g) >= {rule.least} AS holds,
  CAST(sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
FROM (SELECT rid, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM (
  SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')))
WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)"""


#: Every rule's matches by a regular expression search; their places from the lengths of what lies between them.
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches(k, r) for k, r in enumerate(RULES))}),
s AS (SELECT rid, k, name || ':' || a || ':' || (a + length(m)) AS span, a FROM f WHERE holds)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""
