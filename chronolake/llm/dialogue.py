"""Repair of conversation structure by a dynamic program shared over a prefix trie.

A conversation's rows, in order of turn, are written as a signature: a letter a
row that tells its role's initial and its fault.  Distinct signatures are range
sorted, and a task walks its range as a prefix trie: the path to the signature
before is kept as a stack, the common part stays, and a layer of the dynamic
program is made once for each node of the trie.  A layer has, for each state of
the wanted pattern, the least cost and enough to order the edits behind it, in
constant space; the answer is read off by walking back from the signature's end.

Conversations are never gathered: rows are sorted by conversation and turn and
read as a stream, first without their texts for the signatures, then with them,
each conversation's answer in front, for the repaired messages.  What grows with
one conversation is its signature and audit (a byte a row each), and its sort,
which spills.  Where a row stands first with its role and text is found by an
aggregation on that pair, so a conversation of a third of all rows is spread, too.

Defined results: a null in any column counts as one space, in the digest of the
damage too, except that rows are ordered and counted by the turns themselves,
nulls first; rows of one turn go by role, then digest of role and text; an empty
role can't be kept; initials are compared as they are ("User" is not user); rows
repeated in the table are rows; a conversation whose rows are all dropped has
zeros and empty strings; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import stored

SPACES = r"\x20\x09-\x0D"
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
#: States of `(s?(ua)+)?`: nothing yet, a system message, a user's message, an assistant's; where an initial leads.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3


def letter(initial: Column, fault: Column) -> Column:
    """A row's letter: 4 times its initial's place (3 for any other) and its fault's, from `A`."""
    place = F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    return F.chr(F.lit(65) + 4 * place + fault)


def read(code: str) -> tuple[str, str]:
    k = ord(code) - 65
    return (INITIALS + "x")[k // 4], FAULTS[k % 4]


class Layer:
    """Least costs after some rows: for each state (cost, rank, inserts, state before them, letter, state of the layer before).

    The edits of a state are those of the layer before, a letter for the row, then inserts.  What comes before
    the inserts ends in the row's letter and has one such letter a row, so none is another's beginning, and `rank`
    orders them; edits compare by rank, then by their inserts.
    """

    __slots__ = ("blank", "cells", "duplicate", "illegal", "initial", "truncated")


def _closed(layer: Layer, bases: dict[int, tuple]) -> Layer:
    """Inserts after the bases (state -> cost, rank, letter, state before)."""
    cells: list[tuple | None] = [None] * len(STEP)
    for state, (cost, rank, did, before) in bases.items():
        at, k = state, 0
        while k < 3:  # a third insert comes back to a state that fewer reach
            new = (cost + INSERT * k, rank, k, state, did, before)
            if cells[at] is None or new[:3] < cells[at][:3]:
                cells[at] = new
            at, k = (3 if at == 2 else 2), k + 1
    layer.cells = cells
    return layer


def root() -> Layer:
    out = Layer()
    out.blank = out.duplicate = out.truncated = out.illegal = 0
    out.initial = ""
    return _closed(out, {0: (0, 0, "", 0)})


def grown(up: Layer, code: str) -> Layer:
    """The layer one row further."""
    initial, fault = read(code)
    out = Layer()
    out.initial = initial
    out.blank, out.duplicate, out.truncated = (n + (fault == f) for n, f in zip((up.blank, up.duplicate, up.truncated), FAULTS[1:]))
    out.illegal = up.illegal + (bool(up.initial) and up.initial + initial not in ("su", "ua", "au"))
    found: dict[int, tuple] = {}

    def offer(state: int, cost: int, order: tuple, did: str, before: int) -> None:
        if state not in found or (cost, order) < found[state][:2]:
            found[state] = (cost, order, did, before)

    for p, cell in enumerate(up.cells):
        if cell is None:
            continue
        cost, rank, inserts = cell[:3]
        tail = "I" * inserts
        offer(p, cost + DELETE, (rank, tail + "D"), "D", p)
        if fault in ("blank", "duplicate"):
            continue
        late = TRUNCATED if fault == "truncated" else 0
        if initial in STEP[p]:
            offer(STEP[p][initial], cost + KEEP + late, (rank, tail + "K"), "K", p)
        offer(3 if p == 2 else 2, cost + REROLE + late, (rank, tail + "R"), "R", p)
    ranks = {order: r for r, order in enumerate(sorted({o for _, o, _, _ in found.values()}))}
    return _closed(out, {s: (cost, ranks[order], did, before) for s, (cost, order, did, before) in found.items()})


def answer(path: list[Layer]) -> tuple[int, str]:
    """Least cost and first audit of the rows that `path` (from the root) stands for."""
    cost, *_, state = min((*path[-1].cells[s][:3], s) for s in FINAL if path[-1].cells[s] is not None)
    audit = []
    for layer in reversed(path):
        _, _, inserts, _, did, state = layer.cells[state]
        audit.append("I" * inserts)
        audit.append(did)
    return cost, "".join(reversed(audit))


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(signatures: DataFrame) -> DataFrame:
    """Answers for distinct signatures, sorted by range so that neighbours share their prefixes."""

    def each(batches):
        path, last = [root()], ""
        for batch in batches:
            rows = []
            for now in batch.column(0).to_pylist():
                same = 0
                for a, b in zip(last, now):
                    if a != b:
                        break
                    same += 1
                del path[same + 1 :]
                for code in now[same:]:
                    path.append(grown(path[-1], code))
                last, top = now, path[-1]
                rows.append((now, top.blank, top.duplicate, top.truncated, top.illegal, *answer(path)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 6) else pa.int64()) for i, c in enumerate(zip(*rows))], names=[x.split()[0] for x in ANSWER.split(", ")]) if rows else _nothing()

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(each, ANSWER)


def _nothing() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.string() if i in (0, 6) else pa.int64()) for i in range(7)], names=[x.split()[0] for x in ANSWER.split(", ")])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of `conv_id:turn` modulo 20, nulls as one space (turns stay)."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.where("damage > 0").select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def _places(rows: DataFrame) -> DataFrame:
    """`rows` with the keys they are sorted by: conversation, turn, role, digest of role and text."""
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    return rows.withColumn("digest", digest)


ORDER = ["turn", "role", "digest"]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of `rows` (conv_id, turn, role, text)."""
    rows = _places(rows)
    last = F.regexp_extract("text", f"([^{SPACES}])[{SPACES}]*$", 1)
    kind = F.when(last == "", FAULTS.index("blank")).when(last.isin(".", "!", "?"), FAULTS.index("none")).otherwise(FAULTS.index("truncated"))
    same = ["conv_id", "role", "digest"]
    narrow = rows.select("conv_id", "turn", "role", "digest", kind.alias("kind")).groupBy(*same, "turn", "kind").agg(F.count("*").alias("n"))
    key = F.struct(F.col("turn").isNotNull(), "turn")  # null turns come first
    firsts = narrow.groupBy(*same).agg(F.min(key).alias("first"))
    met = narrow.alias("r").join(firsts.alias("f"), [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same])
    leads = F.struct(F.col("r.turn").isNotNull(), F.col("r.turn")) == F.col("f.first")
    initial = F.substring("r.role", 1, 1)
    again = F.when(F.col("kind") == FAULTS.index("blank"), F.col("kind")).otherwise(F.lit(FAULTS.index("duplicate")))
    letters = F.concat(letter(initial, F.when(leads, F.col("kind")).otherwise(again)), F.repeat(letter(initial, again), F.col("n").cast("int") - 1))
    marked = met.select("r.conv_id", "r.turn", "r.role", "r.digest", letters.alias("letters"))
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def each(batches):
        done: list[tuple] = []
        now, parts, low, seen, distinct, kind = None, [], None, None, 0, None

        def close():
            if parts:
                done.append((now[0], "".join(parts), 0 if low is None else seen - low + 1 - distinct))

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if now is None or now[0] != conv:
                    close()
                    now, parts, low, seen, distinct = (conv,), [], None, None, 0
                parts.append(more)
                if turn is not None and turn != seen:
                    low, seen, distinct = turn if low is None else low, turn, distinct + 1
            if len(done) >= 1024:
                yield _facts(done, kind)
                done.clear()
        close()
        if done:
            yield _facts(done, kind)

    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "letters")
    return ordered.mapInArrow(each, f"conv_id {id_type}, signature string, gaps long")


def _facts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, signature, gaps = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(signature, pa.string()), pa.array(gaps, pa.int64())], names=["conv_id", "signature", "gaps"])


def audits(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation."""
    facts = stored(signatures(rows), "signatures")
    known = facts.join(solved(facts), "signature").drop("signature")
    every = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.alias("e").join(known.alias("k"), F.col("e.conv_id").eqNullSafe(F.col("k.conv_id")), "left").select(
        "e.conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit")
    )


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the messages that the audits leave, in order of conversation and place.

    A conversation lies in one partition, its messages one after the other.
    """
    id_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    body = _places(rows).select("conv_id", F.lit(1).alias("part"), *ORDER, "text", F.lit("").alias("audit"))
    heads = answers.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(turn_type).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), "audit")
    ordered = body.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    schema = f"conv_id {id_type}, place long, edit string, turn {turn_type}, role string, text string"

    def each(batches):
        audit, at, place, led = "", 0, 0, False
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def told(conv, turn, role, text, edit):
            nonlocal place, led
            if edit == "K":
                led = led or (place == 0 and role.startswith("s"))
            else:
                role = "assistant" if (place - led) % 2 else "user"
            out.append((conv, place, edit, turn, role, text))
            place += 1

        def inserts(conv):
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                told(conv, None, None, "", "I")
                at += 1

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "place", "edit", "turn", "role", "text"])

        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string()]
            for conv, part, turn, role, text, audit_of in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "audit"))):
                if part == 0:
                    audit, at, place, led = audit_of, 0, 0, False
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        told(conv, turn, role, text, edit)
                inserts(conv)
            if out:
                yield full()
                out.clear()

    return ordered.select("conv_id", "part", "turn", "role", "text", "audit").mapInArrow(each, schema)


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of messages as `repaired` leaves them: sha256 of `role:text` lines."""
    id_type = messages.schema["conv_id"].dataType.simpleString()

    def each(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append((now[0], sha.hexdigest()))
                    now, sha = (conv,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            kind = batch.schema.field(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind), pa.array([h for _, h in done])], names=["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return messages.select("conv_id", "role", "text").mapInArrow(each, f"conv_id {id_type}, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of `conversations`: audit of `rows` (its own if not given) and digest of the repaired messages."""
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))) if rows is None else rows
    answers = stored(audits(conversations, rows), "audits")
    told = digests(repaired(rows, answers))
    empty = hashlib.sha256(b"").hexdigest()
    return answers.alias("a").join(told.alias("d"), F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left").select("a.*", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The whole contract: damage by a table-driven crc32, faults, the dynamic program as a recursion over rows, repaired messages.
REPAIR_SQL = r"""
WITH RECURSIVE
bytes AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS crc FROM range(256) t(b)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS damage FROM keyed, bytes),
after AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE damage > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), sha256(length(role) || ':' || role || ':' || text)) AS i FROM after),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM told),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
edits(src, initial, edit, cost, dst) AS (VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2),
  (0, NULL, 'R', 3, 2), (1, NULL, 'R', 3, 2), (2, NULL, 'R', 3, 3), (3, NULL, 'R', 3, 2), (0, NULL, 'D', 4, 0), (1, NULL, 'D', 4, 1), (2, NULL, 'D', 4, 2), (3, NULL, 'D', 4, 3)),
inserts(src, more, dst) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
reached AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, dst AS state, {'cost': CAST(3 * length(more) AS BIGINT), 'audit': more} AS best FROM facts, inserts WHERE src = 0
  UNION ALL
  SELECT s.conv_id, r.i, c.dst, min({'cost': CAST(s.best.cost + e.cost + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END + 3 * length(c.more) AS BIGINT), 'audit': s.best.audit || e.edit || c.more})
  FROM reached s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1
    JOIN edits e ON e.src = s.state AND (e.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.initial = r.initial)))
    JOIN inserts c ON c.src = e.dst
  GROUP BY s.conv_id, r.i, c.dst),
best AS (SELECT conv_id, min(best) AS best FROM reached s JOIN facts f USING (conv_id) WHERE s.i = f.n AND state IN (0, 3) GROUP BY conv_id
  UNION ALL SELECT NULL, min(best) FROM reached s, facts f WHERE s.conv_id IS NULL AND f.conv_id IS NULL AND s.i = f.n AND state IN (0, 3) HAVING count(*) > 0),
letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS j FROM best WHERE best.audit <> ''),
lined AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
kept AS (SELECT l.conv_id, l.j, l.edit, r.role, r.text, r.initial, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS place
  FROM lined l LEFT JOIN r ON l.edit <> 'I' AND l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i WHERE l.edit <> 'D'),
roles AS (SELECT *, place - max((place = 1 AND edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY conv_id) AS nth FROM kept),
lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM roles GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(b.best.cost, 0) AS cost, coalesce(b.best.audit, '') AS audit, coalesce(l.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
  LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""
