"""Exact n-gram Jaccard join: classes of documents linked by similar shingle sets.

The join is a sparse product of the document by n-gram incidence with its transpose, made in blocks of n-grams:

1. documents with equal sets share a node, so copies are never paired; one of them stands for all;
2. n-grams are counted by blocks of their hash space (see :mod:`blocks`), and every node learns which of its n-grams others
   have too; a node with fewer of those than any partner's overlap must have (a bound from its size) is done;
3. the other nodes meet where they share one of their rarest n-grams and their sizes allow a link; what meets, however
   indirectly, is a neighbourhood;
4. inside a neighbourhood overlap counts accumulate block by block, and pairs below the bound of their sizes are dropped.  A
   large neighbourhood is spread over tasks and compared with a few of its nodes at a time, until all nodes whose links
   could still matter, those outside the largest class found, have been compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, words
from .store import small_batches, written

SHINGLE = 5
#: A link needs at least this many hundredths.
PERCENT = 80
#: Nodes in a tile of a neighbourhood, heavy ones counted as several; a task compares those of two tiles at most.
TILE = 192
#: Tiles of a neighbourhood that are all compared with each other; a larger one is compared with some of its nodes at a time.
TILES = 12
#: Nodes of small neighbourhoods that one task compares, and whose rarest n-grams one task groups, on average.
NODES = 2_000
#: Bytes of a set's shared n-grams that count as a node: sets of many more count as several where tasks are filled.
WEIGHT = 32 << 10
#: Bytes of sets that are grouped at once.
SETS = 12 << 20
#: Edges that one task contracts, on average.
EDGES = 100_000
_SALTS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row number, hash) of the distinct shingles, ascending; A-Z count as lower case.

    A text with fewer words than a shingle has one, all its words; a text without words has none.
    """
    for row, off, data in words.chunks(texts):
        _, _, h, first = words.runs(data, off, words.SPACE, words.LOWER)
        t, w = words.windows(h, first, k)
        count = np.diff(first)
        for few in range(1, k):
            own = np.flatnonzero(count == few)
            if len(own):
                total = np.full(len(own), few, np.uint64)
                for j in range(few):
                    total = words.mix(total ^ h[first[own] + j])
                t, w = np.concatenate((t, own)), np.concatenate((w, total))
        order = np.argsort(w)
        t, w = t[order], w[order]
        order = np.argsort(t.astype(np.uint16) if len(off) <= 1 << 16 else t, kind="stable")
        t, w = t[order], w[order]
        fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (w[1:] != w[:-1]))) if len(t) else np.zeros(0, bool)
        yield row, len(off) - 1, t[fresh], w[fresh]


def _signatures(n: int, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, 63-bit and 64-bit signature) of every text's set."""
    size = np.bincount(t, minlength=n)
    start, out = blocks.runs(t), []
    for salt in _SALTS:
        sums = np.zeros(n, np.uint64)
        if len(start):
            sums[t[start]] = np.add.reduceat(words.mix(w ^ salt), start)
        out.append(words.mix(sums + size.astype(np.uint64)))
    return size, (out[0] >> np.uint64(1)).astype(np.int64), out[1].view(np.int64)


def _node_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.grouped(batches, words.CHUNK):
            for row, n, t, w in shingle_sets(batch.column(2), k):
                size, name, check = _signatures(n, t, w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(size, pa.int64()), pa.array(name), pa.array(check)], names=["id", "bucket", "n", "name", "check"])

    return run


def _own_sets(texts: pa.Table, k: int, names: np.ndarray, checks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place among the names, set number, hash) of the sets that a bucket's texts stand for, each set once."""
    order = np.lexsort((checks, names))
    left = dict(zip(zip(names[order].tolist(), checks[order].tolist(), strict=True), order.tolist(), strict=True))
    for _, n, t, w in shingle_sets(blocks.column(texts, "text"), k):
        _, name, check = _signatures(n, t, w)
        place = np.array([left.pop(x, -1) for x in zip(name.tolist(), check.tolist(), strict=True)], np.int64)
        own = place[t] >= 0
        number = np.cumsum(place >= 0) - 1
        yield place[place >= 0], number[t[own]], w[own]


def _sieve_task(k: int, plan: blocks.Layout):
    """Sends the truncated n-grams of a bucket's sets, and how many of its sets have each."""

    def run(texts: pa.Table, sets: pa.Table) -> pa.Table:
        words.release()
        if not len(texts) or not len(sets):
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        found = [blocks.truncated(w, plan) for _, _, w in _own_sets(texts, k, sets["name"].to_numpy(), sets["check"].to_numpy())]
        found = np.sort(np.concatenate(found))
        start = blocks.runs(found)
        out = blocks.sent(texts["bucket"][0].as_py(), found[start], np.diff(np.append(start, len(found))), plan)
        words.trim()
        return out

    return run


def _suspect_task(k: int, plan: blocks.Layout, percent: int):
    """(node, n, shared): sets that may have a partner, with their n-grams that others may have too: 8 bytes of hash and one of how common it is."""

    def run(texts: pa.Table, others: pa.Table) -> pa.Table:
        words.release()
        node, size, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        sets = others.filter(others["name"].is_valid())
        if len(texts) and len(sets):
            known, rank = blocks.answered(others["data"])
            names = sets["node"].to_numpy()
            for place, number, w in _own_sets(texts, k, sets["name"].to_numpy(), sets["check"].to_numpy()):
                n = np.bincount(number, minlength=len(place))
                at = blocks.located(known, blocks.truncated(w, plan))
                hit = at >= 0
                count = np.bincount(number[hit], minlength=len(place))
                some = (count * 100 >= n * percent) & (count > 0)
                keep = hit & some[number]
                raw = np.empty((int(keep.sum()), 9), np.uint8)
                raw[:, :8] = w[keep].view(np.uint8).reshape(-1, 8)
                raw[:, 8] = rank[at[keep]]
                cuts = np.concatenate(([0], np.cumsum(count[some])))
                node.append(names[place[some]])
                size.append(n[some])
                shared.append(blocks.binary(cuts, raw.tobytes(), 9))
        out = pa.table({"node": pa.array(np.concatenate(node)), "n": pa.array(np.concatenate(size), pa.int64()), "shared": pa.chunked_array(shared, pa.binary())})
        words.trim()
        return out

    return run


def _features(shared: bytes) -> np.ndarray:
    """Hashes, the rarest first and then by value."""
    raw = np.frombuffer(shared, np.uint8).reshape(-1, 9)
    found = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
    return found[np.lexsort((found, raw[:, 8]))]


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap of linked sets of these sizes: percent / (100 + percent) of their sum, rounded up."""
    return -(-percent * (a + b) // (100 + percent))


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root
        root = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _prefix_task(percent: int, many: int):
    """(block, hash, low, high, node): where nodes can meet.  Of a group's nodes with one n-gram, those whose sizes allow links
    are joined at once (a row with low = -1 joins ``hash`` and ``node``) and go on as one entry with their range of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.grouped(batches, SETS):
            node, n, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            found, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i in range(len(batch)):
                features = _features(parts[i].as_py())
                alone = n[i] - len(features)
                take = n[i] - -(-percent * n[i] // 100) + 1 - alone
                found.append(features[: max(0, take)])
                own.append(np.full(len(found[-1]), i))
            found, own = np.concatenate(found), np.concatenate(own)
            order = np.lexsort((n[own], found))
            found, own = found[order], own[order]
            if not len(found):
                continue
            tie = (found[1:] == found[:-1]) & (100 * n[own[:-1]] >= percent * n[own[1:]])
            start = np.flatnonzero(np.concatenate(([True], ~tie)))
            stop = np.append(start[1:], len(found)) - 1
            block = (found[start] % np.uint64(many)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(found[start].view(np.int64)), pa.array(n[own[start]], pa.int64()), pa.array(n[own[stop]], pa.int64()), pa.array(node[own[start]])], names=["block", "hash", "low", "high", "node"])
            if tie.any():
                a, b = components(node[own[:-1][tie]], node[own[1:][tie]])
                yield pa.RecordBatch.from_arrays([pa.array((a % many).astype(np.int32)), pa.array(a), pa.array(np.full(len(a), -1)), pa.array(np.full(len(a), -1)), pa.array(b)], names=["block", "hash", "low", "high", "node"])

    return run


def _reach(group: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest ``high`` of a group so far, groups ascending: their number times that of distinct values is under 2**62."""
    values, rank = np.unique(high, return_inverse=True)
    base = group * len(values)
    return values[np.maximum.accumulate(base + rank) - base]


def _meet_task(percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, low, high, node = (table[c].to_numpy() for c in ("hash", "low", "high", "node"))
        edge = low < 0
        a, b = hashes[edge], node[edge]
        hashes, low, high, node = (x[~edge] for x in (hashes, low, high, node))
        if len(hashes):
            order = np.lexsort((low, hashes))
            hashes, low, high, node = (x[order] for x in (hashes, low, high, node))
            start = blocks.runs(hashes)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(hashes))))
            reach = _reach(group, high)
            tie = (group[1:] == group[:-1]) & (100 * reach[:-1] >= percent * low[1:])
            a, b = np.concatenate((a, node[:-1][tie])), np.concatenate((b, node[1:][tie]))
        if len(a):
            a, b = components(a, b)
            a, b = a[a != b], b[a != b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _contract_task(table: pa.Table) -> pa.Table:
    a, b = components(table["a"].to_numpy(), table["b"].to_numpy())
    a, b = a[a != b], b[a != b]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def connected(edges: DataFrame, each: int = EDGES) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (a, b).

    Tasks contract parts of about ``each`` edges to stars.  Where that takes more than one part, every node's larger
    neighbours, then its smaller ones, are hung on the smallest of them, in turns, until nothing changes; the turns grow
    with the logarithm of the longest path.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    parts = -(-edges.count() // each)
    edges = written(edges.withColumn("part", F.pmod(F.xxhash64("a", F.lit(6)), F.lit(max(1, parts)))).groupBy("part").applyInArrow(_contract_task, "a long, b long"), "edges")
    before = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Counts of common n-grams of every left and right set, accumulated over blocks of n-grams."""
    sets = left + right if left is not right else left
    found = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column = np.unique(found, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (at, at + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        total += part[: len(left)] @ (part if left is right else part[len(left) :]).T
    return total.astype(np.int64)


def _linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return overlap >= least_overlap(a[:, None], b[None, :], percent)


def _tile_task(percent: int):
    """(a, b): links that join what the nodes of the same group (a neighbourhood, or two tiles of one) join."""

    def run(table: pa.Table) -> pa.Table:
        group, node, n, parts = table["group"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy(), table["shared"]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(group, kind="stable")
        for own in np.split(order, blocks.runs(group[order])[1:]):
            sets = [_features(parts[int(i)].as_py()) for i in own]
            x, y = np.nonzero(np.triu(_linked(_overlaps(sets, sets), n[own], n[own], percent), 1))
            if len(x):
                a, b = components(node[own[x]], node[own[y]])
                out_a.append(a[a != b])
                out_b.append(b[a != b])
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    return run


def _tiled(near: DataFrame, percent: int, tile: int, many: int) -> DataFrame:
    """Links inside neighbourhoods of a few tiles: every two tiles of one meet in a group."""
    tiles = F.ceil(F.col("many") / tile).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(9)), tiles).cast("int")
    others = F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), tiles - 1), lambda t: t != own))
    rows = near.withColumn("other", F.explode(others)).withColumn("group", F.xxhash64("home", F.least("other", own), F.greatest("other", own)))
    rows = rows.withColumn("part", F.when(tiles > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("home"), F.lit(many))))
    return rows.select("part", "group", "node", "n", "shared").groupBy("part").applyInArrow(_tile_task(percent), "a long, b long")


def _pivot_task(percent: int):
    """Links between a part of a large neighbourhood and its nodes that are compared in this turn."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            n, m = left["n"].to_numpy(), right["n"].to_numpy()
            x, y = np.nonzero(_linked(_overlaps([_features(p.as_py()) for p in left["shared"]], [_features(p.as_py()) for p in right["shared"]]), n, m, percent))
            a, b = left["node"].to_numpy()[x], right["node"].to_numpy()[y]
            a, b = a[a != b], b[a != b]
            if len(a):
                a, b = components(a, b)
                a, b = a[a != b], b[a != b]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _large(nodes: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links that join what large neighbourhoods join, of their nodes (home, node, n, shared, many)."""
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(9)), F.ceil(F.col("many") / tile)).cast("int"))
    state = written(nodes.select("home", "node", F.col("node").alias("root"), F.lit(False).alias("done"), "many"), "state")
    links, take, turns = None, tile, 0
    while True:
        classes = state.groupBy("home", "root").agg(F.count("*").alias("size"))
        largest = classes.groupBy("home").agg(F.max_by("root", F.struct("size", "root")).alias("top"))
        open_ = written(state.join(largest, "home").where("root <> top and not done").select("home", "node", "many"), "open")
        if open_.isEmpty():
            break
        # each open node takes its turn by a hash, about ``take`` of a neighbourhood's and all where no more are left
        share = F.shiftrightunsigned(F.xxhash64("node", F.lit(4 + turns)), 11) / float(1 << 53)
        count = open_.groupBy("home").agg(F.count("*").alias("left"))
        turn = written(open_.join(count, "home").where(share * F.col("left") < take).select("home", "node", "many"), "turn")
        turns += 1
        if turn.isEmpty():
            continue
        pivots = nodes.join(turn.select("node"), "node", "left_semi").select(*[F.col(c).alias(c) for c in ("home", "node", "n", "shared", "many")]).withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("many") / tile) - 1).cast("int"))))
        found = nodes.groupBy("home", "salt").cogroup(pivots.groupBy("home", "salt")).applyInArrow(_pivot_task(percent), "a long, b long")
        links = written(found if links is None else found.unionByName(links), "links")
        if links.isEmpty():
            state = state.join(turn.select("node", F.lit(True).alias("now")), "node", "left").select("home", "node", "root", F.coalesce("now", "done").alias("done"), "many")
        else:
            roots = connected(links).withColumnRenamed("root", "new")
            state = state.join(roots, "node", "left").join(turn.select("node", F.lit(True).alias("now")), "node", "left").select("home", "node", F.coalesce("new", "root").alias("root"), F.coalesce("now", "done").alias("done"), "many")
        state = written(state, "state")
        take = min(take * 4, 16 * tile)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = SHINGLE, percent: int = PERCENT, each: int = blocks.EACH, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id that links of at least ``percent`` hundredths reach.

    Words lie between 0x20 and 0x09-0x0D, with A-Z in lower case.  A text without words, or null, has no shingles and is
    linked with nothing.  Rows with equal sets are linked; repeated ids are no obstacle; a null id gets a component of its
    own only if no other id is in it.  Sets count as equal by 127 bits of two signatures: among 10**10 sets two different ones
    agree with a probability under 10**-18; shingles of two sets by 64 bits.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    plan = blocks.layout(size, each)
    rows = docs.select(F.col(id_col).alias("id"), blocks.bucket([F.col(id_col), text], plan).alias("bucket"), text.alias("text"))
    members = written(rows.mapInArrow(_node_task(k), f"id {rows.schema['id'].dataType.simpleString()}, bucket int, n long, name long, check long"), "members")
    sets = members.where("n > 0").groupBy("name", "check").agg(F.min("id").alias("first"), F.min("bucket").alias("bucket"), F.max("n").alias("n"))
    # sets that agree in one signature alone get names of their own
    sets = sets.withColumn("node", F.col("name") + F.row_number().over(Window.partitionBy("name").orderBy("check")) - 1)
    sets = written(sets, "sets")
    texts = rows.select("bucket", "text")
    own = sets.select("bucket", "name", "check", "node")
    sieved = texts.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_sieve_task(k, plan), blocks.SENT)
    answers = sieved.groupBy("block").applyInArrow(blocks.common, blocks.TOLD)
    others = own.withColumn("data", F.lit(None).cast("binary")).unionByName(answers, allowMissingColumns=True)
    suspects = texts.groupBy("bucket").cogroup(others.groupBy("bucket")).applyInArrow(_suspect_task(k, plan, percent), "node long, n long, shared binary")
    suspects = written(suspects, "suspects")
    weight = F.ceil((F.octet_length("shared") + 1) / WEIGHT)
    many = max(64, -(-(suspects.agg(F.sum(weight)).first()[0] or 0) // NODES))
    met = suspects.mapInArrow(_prefix_task(percent, many), "block int, hash long, low long, high long, node long").groupBy("block").applyInArrow(_meet_task(percent), "a long, b long")
    homes = connected(met)
    heavy = homes.join(suspects.select("node", weight.alias("weight")), "node").groupBy("root").agg(F.sum("weight").alias("many"))
    homes = homes.join(heavy, "root").select("node", F.col("root").alias("home"), "many")
    near = written(suspects.join(homes, "node"), "near")
    few = F.col("many") <= tile * tiles
    links = _tiled(near.where(few), percent, tile, many)
    if not near.where(~few).isEmpty():
        links = links.unionByName(_large(near.where(~few), percent, tile))
    roots = connected(links)
    known = written(sets.join(roots, "node", "left").select("name", "check", "first", F.coalesce("root", "node").alias("root")), "roots")
    known = known.join(known.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("name", "check", "component_id")
    # copies of one text are a hot key of the left side, which adaptive execution splits
    some = members.where("n > 0").join(known, ["name", "check"], "left").select("id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
