"""N-gram Jaccard join: near copies by word shingles, with filters under several token orders.

Tokens are hashed word shingles.  Under any order of all tokens, two sets whose
similarity reaches the threshold share one of their first ``n - ceil(t n) + 1``
tokens.  An order here is a hash of the token, with widespread tokens last.
Candidates are nodes that share a prefix token under the first order; of these, only
pairs that share one under every other order too are verified on whole sets.

No group is expanded into all its pairs: equal sets are one node; of a prefix
token with many nodes only links to a leader are tried first, and only nodes
that stay in another component than the rest of such a group are compared with
its other members after that, on whole sets.  So no link between components is lost.

Node ids and tokens are 64-bit hashes: among 1e9 different sets a chance of
about 0.03 that any two fall together.

Defined results: a null or empty text, or one without words, has no tokens and
links to nothing; fewer words than the shingle length make one shingle; texts of any
length are read whole; rows are returned one for one, repeated rows too; null ids
take part, a component's id is its smallest id that isn't null; extra columns are
ignored (`join`) or kept (`keep_one`), whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm.bytekit import planes, unplaned
from chronolake.llm.common import cut_parts, discard, stored, tidy
from chronolake.llm.components import bitmap, components, marked

ORDERS = (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)
WIDE = 4  # tokens of more texts than this come last in every order
FEW = 4  # a prefix token's nodes are listed as pairs up to so many, and as links to a leader beyond; both are filtered alike
FLUSH = 4_000_000  # tokens that a task gathers before it sends them on
BUCKET = 1 << 20  # prefix tokens in a bucket, about
MEET = 256  # nodes of a block


def token_sets(s: bk.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = bk.Words(s)
    return bk.sorted_sets(*bk.shingles(w.hash(), w.first, k))


def node_ids(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit hash of each set (as signed); 0 for the empty set."""
    n = np.diff(offs)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bk.mix(tokens ^ np.uint64(0x5BD1E995F00D)))))
    more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bk.mix(tokens * np.uint64(0xFF51AFD7ED558CCD)))))
    h = bk.mix((total[offs[1:]] - total[offs[:-1]]) ^ bk.mix(more[offs[1:]] - more[offs[:-1]] + n.astype(np.uint64)))
    return np.where(n > 0, h | np.uint64(1), np.uint64(0)).view(np.int64)


def _members(docs: DataFrame, k: int, text_hash: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, node) of every row, and its `text_hash` if one is given."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = [] if text_hash is None else [text_hash.alias("text_hash")]

    def each(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for s in bk.slices(batch.column(1)):
                t, o = token_sets(s, k)
                n[s.lo : s.hi], node[s.lo : s.hi] = np.diff(o), node_ids(t, o)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), *batch.columns[2:]], names=["doc_id", "n_shingles", "node", *batch.schema.names[2:]])

    return docs.select("doc_id", "text", *more).mapInArrow(each, f"doc_id {id_type}, n_shingles long, node long" + ", text_hash long" * len(more))


def _new_sets(batches, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, offsets, nodes) of the sets of a partition, each set once as far as memory of half a million nodes goes."""
    seen: set[int] = set()
    for batch in batches:
        for s in bk.slices(batch.column(0)):
            t, o = token_sets(s, k)
            node = node_ids(t, o)
            keep = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    keep[i] = True
            if len(seen) > 500_000:
                seen = set()
            n = np.diff(o)
            yield t[np.repeat(keep, n)], np.concatenate(([0], np.cumsum(n[keep]))), node[keep]


def _rank(tokens: np.ndarray, offs: np.ndarray, seed: int, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by an order of all tokens: (positions into tokens, row of each)."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    key = bk.mix(tokens ^ np.uint64(seed)) >> np.uint64(1)
    if last is not None:
        key |= last.astype(np.uint64) << np.uint64(63)
    out = np.empty(len(tokens), np.int64)
    for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        out[x:y] = np.argsort(key[x:y]) + x
    return out, row


def _prefix(t: np.ndarray, o: np.ndarray, percent: int, order: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the prefix tokens of each set under an order, row by row."""
    rank, row = _rank(t, o, ORDERS[order], marked(wide, t))
    n = np.diff(o)
    place = np.arange(len(t)) - o[:-1][row]
    ok = place < (n - -(-percent * n // 100) + 1)[row]
    return rank[ok], row[ok]


def _widespread(texts: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Bitmap of tokens in more than WIDE texts, of those in the first half of a text under the first order.

    A task counts what it reads first and sends a token WIDE + 1 times at most, however many of its texts hold it.
    """

    def tokens(batches):
        held, size = [], 0
        for t, o, _ in _new_sets(batches, k):
            if len(t):
                order, row = _rank(t, o, ORDERS[0], None)
                place = np.arange(len(t)) - o[:-1][row]
                held.append(t[order[place < -(-np.diff(o)[row] // 2)]])
                size += len(held[-1])
            if size > FLUSH:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    def send(held):
        v, c = np.unique(np.concatenate(held), return_counts=True)
        v = np.repeat(v, np.minimum(c, WIDE + 1))
        bucket = (v % np.uint64(buckets)).astype(np.int64)
        v = v[np.argsort(bucket, kind="stable")]
        edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        some = np.flatnonzero(np.diff(edge))
        rows = [planes(v[edge[b] : edge[b + 1]]) for b in some]  # sorted in each bucket, so that high bytes shrink
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(edge)[some], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "n", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        parts = [unplaned(x, n, np.uint64) for n, x in zip(table.column("n").to_pylist(), table.column("tokens").to_pylist(), strict=True)]
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        return pa.table({"t": v[c > WIDE].view(np.int64)})

    found = stored(texts.mapInArrow(tokens, "bucket int, n int, tokens binary").groupBy("bucket").applyInArrow(count, "t long"), "widespread")
    bits = bitmap(found, "t")
    discard(found)
    return bits


def _groups(texts: DataFrame, k: int, percent: int, wide, buckets: int) -> DataFrame:
    """Prefix tokens of the first order that several nodes have: (nodes, sizes, weight), weight the number of tokens of the same nodes."""

    kind = pa.schema({"bucket": pa.int32(), "token": pa.binary(), "node": pa.binary(), "n": pa.binary(), "run": pa.binary()})

    def prefixes(batches):
        for t, o, node in _new_sets(batches, k):
            if not len(t):
                continue
            n = np.diff(o)
            at, row = _prefix(t, o, percent, 0, wide.value)
            t = t[at]
            bucket = (t % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            t, row, bucket = t[by], row[by], bucket[by]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))))  # runs of one node
            edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
            cut = np.searchsorted(new, edge)
            run = np.diff(np.append(new, len(t))).astype(np.int32)
            of, size = node[row[new]], n[row[new]].astype(np.int32)
            rows = [
                {"bucket": b, "token": t[edge[b] : edge[b + 1]].tobytes()}
                | {c: v[cut[b] : cut[b + 1]].tobytes() for c, v in (("node", of), ("n", size), ("run", run))}
                for b in np.flatnonzero(np.diff(edge)).tolist()
            ]
            yield pa.RecordBatch.from_pylist(rows, kind)

    def gather(table: pa.Table) -> pa.Table:
        col = lambda c, d: np.frombuffer(b"".join(table.column(c).to_pylist()), d)
        t = col("token", np.uint64)
        run = col("run", np.int32)
        node, n = np.repeat(col("node", np.int64), run), np.repeat(col("n", np.int32), run)
        order = np.lexsort((node, t))
        t, node, n = t[order], node[order], n[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (node[1:] != node[:-1])
        t, node, n = t[new], node[new], n[new]
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(t)))
        start, size = start[size > 1], size[size > 1]
        held: dict[bytes, int] = {}
        at: list[tuple[int, int]] = []
        weight: list[int] = []
        for a, c in zip(start.tolist(), size.tolist(), strict=True):
            key = node[a : a + c].tobytes()
            if key in held:  # tokens of the same nodes are one group
                weight[held[key]] += 1
            else:
                held[key] = len(at)
                at.append((a, c))
                weight.append(1)
        nodes, sizes = ([x[a : a + c] for a, c in at] for x in (node, n))
        return pa.table({"nodes": pa.array(nodes, pa.list_(pa.int64())), "sizes": pa.array(sizes, pa.list_(pa.int32())), "weight": pa.array(weight, pa.int32())})

    packed = texts.mapInArrow(prefixes, "bucket int, token binary, node binary, n binary, run binary")
    return packed.groupBy("bucket").applyInArrow(gather, "nodes array<long>, sizes array<int>, weight int")


def _pairs_of(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of the nodes of groups of up to FEW, if sizes allow."""

    def each(batches):
        for batch in batches:
            xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for nodes, sizes in zip(batch.column(0), batch.column(1), strict=True):
                v, n = np.asarray(nodes.values), np.asarray(sizes.values).astype(np.int64)
                i, j = np.triu_indices(len(v), 1)
                ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                xs.append(v[i[ok]])
                ys.append(v[j[ok]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])

    return groups.where(F.size("nodes") <= FEW).mapInArrow(each, "x long, y long")


def _families(groups: DataFrame) -> DataFrame:
    """(leader, nl, node, n) of the groups of more than FEW: a group's leader is the node with the largest part of its
    prefix in such groups, which is the text that the others are copies of, and groups with one leader are a family."""
    large = groups.where(F.size("nodes") > FEW).select(F.xxhash64("nodes").alias("g"), "weight", F.explode(F.arrays_zip("nodes", "sizes")).alias("m"))
    large = stored(large.select("g", "weight", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("n")), "large")
    score = large.groupBy("node").agg((F.sum("weight") / F.first("n")).alias("score"))
    leader = large.join(score, "node").groupBy("g").agg(F.max(F.struct("score", "node", "n")).alias("top"))
    return large.join(leader.select("g", F.col("top.node").alias("leader"), F.col("top.n").alias("nl")), "g").select("leader", "nl", "node", "n").distinct()


def _within(families: DataFrame, label: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links in families whose nodes aren't in one component yet.

    The nodes outside a family's main component meet all its nodes, block by block; a
    block's overlaps are counted at once and only links between components come out.
    """
    own = families.select("leader", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    count = own.groupBy("leader", "label").agg(F.count("*").alias("c"))
    main = count.groupBy("leader").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"), F.sum("c").alias("size"))
    main = main.where("labels > 1").select("leader", F.col("top.label").alias("main"), F.col("size"), (F.col("size") - F.col("top.c")).alias("odd"))
    own = stored(own.join(main, "leader"), "odd")
    if own.isEmpty():
        return own.select(F.col("node").alias("x"), F.col("node").alias("y"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(MEET)).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    odd = own.where("label <> main").select("leader", "node", "label", mine("odd").alias("i"), every("size").alias("j"), F.lit(True).alias("asks"))
    rest = own.select("leader", "node", "label", every("odd").alias("i"), mine("size").alias("j"), F.lit(False).alias("asks"))
    meet = odd.union(rest).join(_sets(own.select("node"), texts, k), "node")

    def each(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        node, lab = table.column("node").to_numpy(), table.column("label").to_numpy()
        col = table.column("tokens").combine_chunks()
        n = np.diff(np.asarray(col.offsets))
        _, ident, times = np.unique(np.asarray(col.flatten()), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(node)), n)
        ok = times[ident] > 1
        _, ident = np.unique(ident[ok], return_inverse=True)
        of = of[ok]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        common = np.zeros((len(a), len(b)), np.float32)
        place = np.zeros(len(node), np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        by = np.argsort(ident, kind="stable")
        ident, of = ident[by], of[by]
        for lo in range(0, int(ident.max(initial=-1)) + 1, 8192):
            p, q = np.searchsorted(ident, (lo, lo + 8192))
            left, right = np.zeros((len(a), 8192), np.float32), np.zeros((len(b), 8192), np.float32)
            i, w = of[p:q], ident[p:q] - lo
            left[place[i[asks[i]]], w[asks[i]]] = 1
            right[place[i[~asks[i]]], w[~asks[i]]] = 1
            common += left @ right.T
        joint = n[a][:, None] + n[b][None, :] - common
        x, y = np.nonzero((100 * common >= percent * joint) & (lab[a][:, None] != lab[b][None, :]))
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (u := parent.get(v, v)) != v:
                v = u
            return v

        kept = []
        for i, j in zip(a[x].tolist(), b[y].tolist(), strict=True):
            u, v = root(int(lab[i])), root(int(lab[j]))
            if u != v:
                parent[u] = v
                kept.append((i, j))
        i, j = (np.array([r[c] for r in kept], np.int64) for c in (0, 1))
        return pa.table({"x": pa.array(node[i]), "y": pa.array(node[j])})

    return meet.groupBy("leader", "i", "j").applyInArrow(each, "x long, y long")


def _sets(nodes: DataFrame, texts: DataFrame, k: int, percent: int = 0, wide=None) -> DataFrame:
    """(node, tokens) of the given nodes, once each; with `wide` also their prefix tokens under each order but the first."""
    asked = texts.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))
    more = [f"prefix{i}" for i in range(1, len(ORDERS))] if wide is not None else []

    def lists(v: np.ndarray, offs: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(v.view(np.int64)))

    def sets(batches):
        for t, o, node in _new_sets(batches, k):
            ok = marked(asked.value, node.view(np.uint64))
            n = np.diff(o)
            t, o, node = t[np.repeat(ok, n)], np.concatenate(([0], np.cumsum(n[ok]))), node[ok]
            cols = [pa.array(node), lists(t, o)]
            for i in range(1, len(more) + 1):
                at, row = _prefix(t, o, percent, i, wide.value)
                cols.append(lists(t[at], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(node)))))))
            whole = pa.RecordBatch.from_arrays(cols, names=["node", "tokens", *more])
            for a in range(0, len(node), 500):
                yield whole.slice(a, 500)

    found = texts.mapInArrow(sets, ", ".join(["node long", "tokens array<long>", *(f"{c} array<long>" for c in more)]))
    return found.join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, wide) -> DataFrame:
    """The pairs that share a prefix token under every order and whose whole sets reach the threshold."""
    found = stored(_sets(pairs.select(F.col("x").alias("node")).union(pairs.select("y")), texts, k, percent, wide), "sets")
    both = lambda p, c: p.join(found.select(F.col("node").alias("x"), F.col(c).alias("tx")), "x").join(found.select(F.col("node").alias("y"), F.col(c).alias("ty")), "y")
    for i in range(1, len(ORDERS)):
        pairs = both(pairs, f"prefix{i}").where(F.arrays_overlap("tx", "ty")).select("x", "y")
    common = F.size(F.array_intersect("tx", "ty"))
    good = stored(both(pairs, "tokens").where(common * 100 >= percent * (F.size("tx") + F.size("ty") - common)).select("x", "y"), "links")
    discard(found)
    return good


def links(texts: DataFrame, tokens: int, k: int = 5, percent: int = 80) -> DataFrame:
    """Verified pairs of nodes that connect what similar pairs connect.  `tokens`: about the number of tokens of all texts."""
    buckets = max(48, cut_parts(texts), math.ceil(tokens / (2 * BUCKET)))
    wide = texts.sparkSession.sparkContext.broadcast(_widespread(texts, k, buckets))
    tidy(texts.sparkSession)
    groups = stored(_groups(texts, k, percent, wide, buckets), "groups")
    families = stored(_families(groups), "families")
    fits = 100 * F.least("n", "nl") >= percent * F.greatest("n", "nl")
    star = families.where((F.col("node") != F.col("leader")) & fits).select(F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y"))
    pairs = stored(_pairs_of(groups, percent).union(star).distinct(), "pairs")
    discard(groups)
    good = _verified(pairs, texts, k, percent, wide)
    discard(pairs)
    wide.unpersist()
    return good.union(stored(_within(families, components(good), texts, k, percent), "links"))


def _classes(members: DataFrame, texts: DataFrame, k: int, percent: int, row: Column) -> DataFrame:
    """(node, least, label) of every node but the empty one: the smallest `row` of the node and its component."""
    tokens = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    label = components(links(texts, tokens, k, percent))
    # linked nodes are few beside the rows; nodes of many rows are summed up before they meet
    least = members.where("node <> 0").groupBy("node").agg(F.min(row).alias("least"))
    return least.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`."""
    members = stored(_members(docs, k), "members")
    least = _classes(members, docs.select("text"), k, percent, F.col("doc_id"))
    whole = least.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stored(least.join(whole, "label").select("node", "component_id"), "classes")
    return members.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, that with the smallest id; rows without words and rows with a null id all stay.

    A row is known by its id and a hash of its text: an id on texts of several components stays once in each of which it is the smallest.
    Of rows that differ in other columns only, that with the smallest digest of all columns stays.  Columns may have any names and types.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    digest = F.xxhash64(F.to_json("row"))
    members = stored(_members(docs.select("doc_id", "text"), k, F.xxhash64("text")), "members")
    least = _classes(members, docs.select("text"), k, percent, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    first = least.groupBy("label").agg(F.min("least").alias("least")).where("least IS NOT NULL").select(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash"))
    one = rows.groupBy("id", "hash").agg(F.min(digest).alias("one")).join(first, ["id", "hash"])
    empty = members.where("node = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(None).cast("long").alias("one")).distinct()
    kept = stored(one.unionByName(empty), "kept")
    out = rows.join(kept, ["id", "hash"]).where((digest == F.col("one")) | F.col("one").isNull())
    copies = Window.partitionBy("id", "hash").orderBy("id")  # equal rows, in the join's own order: texts aren't sorted again
    out = out.withColumn("copy", F.row_number().over(copies)).where("copy = 1 OR one IS NULL").select("row.*")
    return out.unionByName(docs.where("doc_id IS NULL"))


#: The contract's sets, links and components by plain joins and a recursion.
JOIN_SQL = r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS sh FROM w),
node AS (SELECT sh, dense_rank() OVER (ORDER BY sh) AS c, rid, doc_id FROM s),
cls AS (SELECT c, any_value(sh) AS sh, len(any_value(sh)) AS n, min(doc_id) AS least FROM node WHERE len(sh) > 0 GROUP BY c),
tok AS (SELECT c, n, unnest(sh) AS t FROM cls),
pair AS (SELECT a.c AS x, b.c AS y FROM tok a JOIN tok b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
reach(c, r) AS (SELECT c, c FROM cls UNION SELECT reach.c, y FROM reach JOIN edge ON reach.r = edge.x),
label AS (SELECT reach.c, min(least) AS component_id FROM reach JOIN cls ON cls.c = reach.r GROUP BY reach.c)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM node LEFT JOIN label USING (c)
"""
