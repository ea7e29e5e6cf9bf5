"""Fill-in-the-middle over ropes.

A rope is a balanced tree whose leaves hold stretches of the text, cut only where
a unit ends, and whose nodes cache units and code points below them.  A text is
split at two unit ranks, each going down one path; the three subtrees are joined
again in another order with sentinels between, and nothing but the leaf at a cut
is copied.  The way back builds a rope of the output and splits it at code-point
ranks, those of the sentinels.

A unit is a word with the white space before it; white space at the text's end
is a unit of its own.  Cuts and form come from a digest of the document's id.

Defined results: null text is empty and stays plain; a null id counts as the
empty text in the digest; a text that holds a sentinel stays plain; repeated rows
each give a row; a text may be of any length (its rope has a leaf for each 4096
code points; one longer word is one leaf); an empty table gives an empty result;
other columns are kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACE, OTHER = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]")
LEAF = 4096


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (`text`) or a node (`left`, `right`), with its units, code points and height."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope(0, 0)


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(sum(1 for _ in UNIT.finditer(text)) if units is None else units, len(text), 0, text) if text else EMPTY


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def join(a: Rope, b: Rope) -> Rope:
    """`a` before `b`, heights kept within one of each other at every node by rotations."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        low = join(a.right, b)
        if low.height <= a.left.height + 1:
            return _node(a.left, low)
        if low.left.height > low.right.height:
            return _node(_node(a.left, low.left.left), _node(low.left.right, low.right))
        return _node(_node(a.left, low.left), low.right)
    if b.height > a.height + 1:
        low = join(a, b.left)
        if low.height <= b.right.height + 1:
            return _node(low, b.right)
        if low.right.height > low.left.height:
            return _node(_node(low.left, low.right.left), _node(low.right.right, b.right))
        return _node(low.left, _node(low.right, b.right))
    return _node(a, b)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of `text`, its leaves ending where units end."""
    cuts, at = [0], 0
    while at + size < len(text):
        word = OTHER.search(text, at + size - 1)
        end = SPACE.search(text, word.end()) if word else None
        if end is None:
            break
        at = end.start()
        cuts.append(at)
    row = [leaf(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)])]
    while len(row) > 1:
        row = [_node(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or code points, by="chars") and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= getattr(tree, by):
        return tree, EMPTY
    if tree.left is None:
        if by == "chars":
            return leaf(tree.text[:rank]), leaf(tree.text[rank:])
        for _, m in zip(range(rank), UNIT.finditer(tree.text)):
            at = m.end()
        return leaf(tree.text[:at], rank), leaf(tree.text[at:], tree.units - rank)
    before = getattr(tree.left, by)
    if rank < before:
        a, b = split(tree.left, rank, by)
        return a, join(b, tree.right)
    a, b = split(tree.right, rank - before, by)
    return join(tree.left, a), b


def choose(doc_id, n: int, text: str, seed: int, fim_share: int, spm_share: int) -> tuple[str, int, int]:
    """Form and the two unit ranks of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or c % 100 >= fim_share:
        return "plain", low, high
    return "spm" if d % 100 < spm_share else "psm", low, high


def rearrange(tree: Rope, low: int, high: int, form: str) -> tuple[Rope, Rope, Rope]:
    """The rope in the order of `form`, with its prefix and middle."""
    head, suffix = split(tree, high)
    prefix, middle = split(head, low)
    first, second = ((SUFFIX, suffix), (PREFIX, prefix)) if form == "spm" else ((PREFIX, prefix), (SUFFIX, suffix))
    out = EMPTY
    for mark, part in (first, second, (MIDDLE, middle)):
        out = join(join(out, leaf(mark)), part)
    return out, prefix, middle


def invert(output: str, form: str) -> str:
    """The text behind an output: its rope is split at the sentinels and joined in reading order."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    a, rest = split(split(rope(output), len(first), "chars")[1], at - len(first), "chars")
    rest = split(rest, len(second), "chars")[1]
    b, rest = split(rest, output.index(MIDDLE, at + len(second)) - at - len(second), "chars")
    middle = split(rest, len(MIDDLE), "chars")[1]
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return str(join(join(prefix, middle), suffix))


NEW = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_share: int = 50, spm_share: int = 80) -> DataFrame:
    """`docs` with (n, form, prefix_chars, middle_chars, output); the lengths are null where the form is plain."""
    kept = docs.drop(*(c for c in docs.columns if c in NEW))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in NEW.items())])
    names = kept.columns

    def each(batches):
        for batch in batches:
            rows, held = {k: [] for k in NEW}, 0
            low = 0
            for i, (doc_id, text) in enumerate(zip(batch.column(names.index(id_col)), batch.column(names.index(text_col)))):
                text = text.as_py() or ""
                tree = rope(text)
                form, a, b = choose(doc_id.as_py(), tree.units, text, seed, fim_share, spm_share)
                out, prefix, middle = (text, None, None) if form == "plain" else rearrange(tree, a, b, form)
                for k, v in zip(NEW, (tree.units, form, prefix and prefix.chars, middle and middle.chars, str(out))):
                    rows[k].append(v)
                held += len(text)
                if held > 1 << 22 or i + 1 == batch.num_rows:  # a batch's outputs aren't held together
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, i + 1 - low).columns, pa.array(rows["n"], pa.int64()), pa.array(rows["form"], pa.string()), pa.array(rows["prefix_chars"], pa.int64()), pa.array(rows["middle_chars"], pa.int64()), pa.array(rows["output"], pa.string())], names=[*names, *NEW])
                    rows, held, low = {k: [] for k in NEW}, 0, i + 1

    return kept.mapInArrow(each, schema)


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """`outputs` with the text rebuilt from output and form alone."""

    @F.pandas_udf("string")
    def back(output, form):
        return output.combine(form, invert)

    return outputs.withColumn(to, back(F.col(output_col), F.col(form_col)))


#: Digests of outputs and rebuilt texts, for all documents.
FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
k AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
