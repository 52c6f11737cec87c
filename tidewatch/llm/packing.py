"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Texts are cut into pieces of at most one sequence, and pieces are dealt to blocks of bounded size by a hash.  Islands evolve
packings of a block independently: crossover injects whole well-filled bins of one parent into the other, bins that hold
the same pieces are dissolved, and their other pieces are put back by best fit, largest first.  Between epochs every
island's elite also enters the next island's population.  Pieces of a block's poorly filled bins are dealt anew into
fewer blocks until one block is left.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .store import small_batches, written

CAPACITY = 4096
END = 1
#: Pieces of a block, on average.
BLOCK = 5_000
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
#: Crossovers of an island in an epoch, and how many in a row may bring nothing.
CHILDREN = 60
IDLE = 12
#: Runs whose ids a task remembers.
CACHE = 1_000_000
#: Bytes: 0 white space, 1 letters and other scripts, 2 digits, 3 marks.
_KIND = np.full(256, 3, np.uint8)
_KIND[np.flatnonzero(words.SPACE)] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2


class Encoder:
    """Token ids of whole texts by a tokenizer that drops white space and never joins letters with digits or marks.

    Texts are cut into runs of letters (with all bytes of other scripts), single digits and runs of marks, all at once over
    a chunk of bytes; a run's ids come from a hash table of runs met before, and only new runs reach the tokenizer.  Words
    whose ids aren't those of their runs, with an apostrophe or with a run of other scripts that doesn't begin and end in a
    letter, go to the tokenizer whole, and so do texts with the literal of a special token.  The table is emptied when it is
    full.  A run counts as one met before where two independent 64-bit hashes agree; where only the first does, its word goes
    to the tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words that are Latin letters alone in their normal form and lower case skip the steps that make them so
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.bits, self.count = 16, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.used = 0
        self.start, self.length, self.whole, self.check = (np.zeros(1 << 12, kind) for kind in (np.int32, np.int32, bool, np.uint64))
        self.pool = np.zeros(1 << 14, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.odd: dict[bytes, np.ndarray] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers of hashes; -1 for new ones."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            got = self.keys[slot]
            hit = got == h[left]
            out[left[hit]] = self.slots[slot[hit]]
            on = ~hit & (got != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.slots[slot[won]] = entry[won]
            h, entry, slot = h[~won], entry[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _learn(self, h: np.ndarray, check: np.ndarray, runs: list[bytes]) -> None:
        if self.count + len(h) > self.limit:
            self.clear()
        texts = [x.decode() for x in runs]
        low = [x.lower() for x in texts]
        easy = [x.isalpha() and (x.isascii() or x == t and max(x) < "\u0250" and unicodedata.is_normalized("NFC", x)) for x, t in zip(low, texts, strict=True)]
        quick = iter(self.plain.encode_batch_fast([x for x, e in zip(low, easy, strict=True) if e], add_special_tokens=False))
        slow = iter(self.tokenizer.encode_batch_fast([x for x, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False))
        ids = [next(quick if e else slow).ids for e in easy]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        size, end = int(lengths.sum()), self.count + len(h)
        self.start, self.length, self.whole, self.check = (_room(x, end) for x in (self.start, self.length, self.whole, self.check))
        self.check[self.count : end] = check
        self.pool = _room(self.pool, self.used + size)
        self.start[self.count : end] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count : end] = lengths
        self.pool[self.used : self.used + size] = np.fromiter((i for x in ids for i in x), self.pool.dtype, size)
        self.used += size
        self.whole[self.count : end] = np.fromiter(("'" in x or not (x.isascii() or x[0].isalpha() and x[-1].isalpha()) for x in low), bool, len(low))
        entry = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        if self.count * 4 > len(self.keys) * 3:
            while self.count * 4 > 3 << self.bits:
                self.bits += 1
            used = self.keys != 0
            old, old_entry = self.keys[used], self.slots[used]
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, old_entry)
        self._put(h, entry)

    def _word(self, word: bytes) -> np.ndarray:
        got = self.odd.get(word)
        if got is None:
            got = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32)
            if len(self.odd) > 50_000:
                self.odd.clear()
            self.odd[word] = got
        return got

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places where each text's ids begin and the last one's end) of the texts of a chunk, without end marks."""
        ids, cut = self._plain(data, off)
        raw = data.tobytes()
        if not any(x in raw for x in self.special):
            return ids, cut
        own = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in range(len(own)):
            text = raw[off[i] : off[i + 1]]
            if any(x in text for x in self.special):
                own[i] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in own])))

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        begins = np.empty(len(data), bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == 2
        heads = off[:-1][off[1:] > off[:-1]]
        begins[heads] = True
        edge = np.flatnonzero(begins)
        stop = np.append(edge[1:], len(data))
        real = kind[edge] != 0
        start, stop = edge[real], stop[real]
        first = np.searchsorted(start, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        h = words.hashes(data, start, stop, words.LOWER)
        h = np.where(h == 0, np.uint64(1), h)
        check = words.hashes(data, start, stop, words.LOWER, 1)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            fresh, at, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            at, before = new[at], self.count
            self._learn(fresh, check[at], [raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
            entry[new] = before + inverse
            if self.count != before + len(fresh):  # the table was emptied on the way
                again = np.flatnonzero(self._find(h) < 0)
                fresh, at = np.unique(h[again], return_index=True)
                at = again[at]
                self._learn_more(fresh, check[at], [raw[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)])
                entry = self._find(h)
        begin, length, pool = self.start[entry].astype(np.int64), self.length[entry].astype(np.int64), self.pool
        odd = self.whole[entry] | (self.check[entry] != check)
        if odd.any():
            raw = data.tobytes()
            lone = np.ones(len(start), bool)
            lone[1:] = (stop[:-1] != start[1:]) | begins_text(off, start[1:])
            word = np.cumsum(lone) - 1
            ends = np.append(np.flatnonzero(lone)[1:], len(start))
            parts, size = [pool[: self.used]], self.used
            for w in np.unique(word[odd]).tolist():
                a, b = int(np.searchsorted(word, w)), int(ends[w])
                ids = self._word(raw[start[a] : stop[b - 1]])
                length[a:b] = 0
                begin[a], length[a] = size, len(ids)
                parts.append(ids)
                size += len(ids)
            pool = np.concatenate(parts)
        total = np.concatenate(([0], np.cumsum(length)))
        index = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
        return pool[index], total[first]

    def _learn_more(self, h: np.ndarray, check: np.ndarray, runs: list[bytes]) -> None:
        """Learns what a chunk needs beyond the limit; the next new run empties the table again."""
        limit, self.limit = self.limit, 1 << 62
        self._learn(h, check, runs)
        self.limit = limit


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """``x``, or a copy half as long again if it is too short."""
    if size <= len(x):
        return x
    out = np.zeros(max(size, len(x) + (len(x) >> 1)), x.dtype)
    out[: len(x)] = x
    return out


def begins_text(off: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a text begins at these places."""
    at = np.searchsorted(off, start)
    return off[np.minimum(at, len(off) - 1)] == start


def _pieces_task(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in words.kept:
            words.kept[path] = Encoder(path)
        coder = words.kept[path]
        for batch in words.grouped(batches, words.CHUNK, keep=True):
            row, piece, start, length, crc = [], [], [], [], []
            for first, off, data in words.chunks(batch.column(1)):
                ids, cut = coder.encode(data, off)
                raw, cut = ids.astype("<u4").tobytes(), cut.tolist()
                for i in range(len(off) - 1):
                    own = raw[4 * cut[i] : 4 * cut[i + 1]] + tail
                    for k, b in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[b : b + 4 * capacity]
                        row.append(first + i)
                        piece.append(k)
                        start.append(b // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text's ids and end mark, cut every ``capacity``; nulls are empty texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces_task(tokenizer, capacity, end), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open bins by free space: the set bits of ``mask`` are the free spaces that some bin has."""

    def __init__(self, free: np.ndarray):
        self.by: dict[int, list[int]] = {}
        self.mask, self.n = 0, len(free)
        for b, f in enumerate(free.tolist()):
            if f > 0:
                self.add(b, f)

    def add(self, b: int, free: int) -> None:
        got = self.by.get(free)
        if got:
            got.append(b)
        else:
            self.by[free] = [b]
            self.mask |= 1 << free

    def put(self, size: int, capacity: int) -> int:
        """The fullest bin that the piece still fits in, else a new one."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            got = self.by[free]
            b = got.pop()
            if not got:
                self.mask ^= 1 << free
        else:
            b, free = self.n, capacity
            self.n += 1
        if free > size:
            self.add(b, free - size)
        return b


def _fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, free: np.ndarray, capacity: int) -> np.ndarray:
    open_bins = _Bins(free)
    put = open_bins.put
    bins[order] = [put(s, capacity) for s in sizes[order].tolist()]
    return bins


def _fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(bins, sizes)
    return (-len(fill), float(((fill / capacity) ** 2).sum()))


def _cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, pick: np.random.Generator) -> np.ndarray:
    """Whole bins of ``b``, the well filled ones first, injected into ``a``."""
    fill = np.bincount(b, sizes)
    keys = fill / capacity + pick.random(len(fill)) * 0.02
    chosen = np.zeros(len(fill), bool)
    chosen[np.argsort(-keys)[: max(1, int(len(fill) * pick.uniform(0.2, 0.5)))]] = True
    given = chosen[b]
    gone = np.zeros(a.max() + 1, bool)
    gone[a[given]] = True
    own = np.bincount(a, sizes, len(gone))
    gone[own < capacity * 0.97] |= pick.random(int((own < capacity * 0.97).sum())) < 0.5  # some poor bins go with them
    loose = np.flatnonzero(gone[a] & ~given)
    stay = ~gone[a] & ~given
    names = np.full(len(gone) + len(fill), -1, np.int64)
    child = np.where(given, b + len(gone), a)
    used = np.unique(child[given | stay])
    names[used] = np.arange(len(used))
    child = np.where(given | stay, names[child], -1)
    free = capacity - np.bincount(child[child >= 0], sizes[child >= 0], len(used)).astype(np.int64)
    return _fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], child, free, capacity)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int, *, capacity: int = CAPACITY, population: int = POPULATION, children: int = CHILDREN) -> np.ndarray:
    """The best packing (a bin number for each piece) after a round of crossovers that starts from ``elites``."""
    pick = np.random.default_rng(seed)
    none = np.zeros(0, np.int64)
    pool = [np.asarray(x, np.int64) for x in elites]
    while len(pool) < population:
        noise = pick.uniform(0.9, 1.1, len(sizes)) if pool or seed % ISLANDS else 1.0
        pool.append(_fit(sizes, np.argsort(-sizes * noise, kind="stable"), np.empty(len(sizes), np.int64), none, capacity))
    least, idle = -(-int(sizes.sum()) // capacity), 0
    scored = sorted(((_fitness(x, sizes, capacity), i, x) for i, x in enumerate(pool)), key=lambda x: x[:2], reverse=True)
    for k in range(children):
        if -scored[0][0][0] <= least or idle == IDLE:
            break
        a, b = pick.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        if pick.random() < 0.5:
            a, b = b, a
        child = _cross(scored[a][2], scored[b][2], sizes, capacity, pick)
        best = scored[0][0]
        scored = sorted([*scored, (_fitness(child, sizes, capacity), len(pool) + k, child)], key=lambda x: x[:2], reverse=True)[:population]
        idle = 0 if scored[0][0] > best else idle + 1
    return scored[0][2]


def _alone(run):
    return lambda key, items: run(key, items, None)


def _with_elites(run):
    return lambda key, items, elites: run(key, items, elites)


def _round(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(row, length, block, bin) of one round: islands evolve and exchange elites, the best packing of a block stays."""
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(blocks)), F.lit(blocks)).cast("long").alias("block"))
    at = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    elites = None

    for epoch in range(epochs):

        def run(key, pdf, got, epoch=epoch):
            import pandas as pd

            pdf = pdf.sort_values("row")
            sizes = pdf["length"].to_numpy(np.int64)
            start = [] if got is None else [np.asarray(x, np.int64) for x in got.sort_values("home")["bins"]]
            best = evolve(sizes, start, (int(key[0]) * epochs + epoch) * ISLANDS + int(key[1]), capacity=capacity)
            count, squares = _fitness(best, sizes, capacity)
            return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins": [best.tolist()], "count": [-count], "squares": [squares]})

        kind = "block long, island int, bins array<int>, count long, squares double"
        if elites is None:
            best = at.groupBy("block", "island").applyInPandas(_alone(run), kind)
        else:
            moved = elites.select("block", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"), F.col("island").alias("home"), "bins")
            best = at.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(_with_elites(run), kind)
        elites = written(best, "elites")
    winner = elites.groupBy("block").agg(F.min_by("bins", F.struct("count", -F.col("squares"), "island")).alias("bins"))

    def unpack(key, a, b):
        import pandas as pd

        a = a.sort_values("row")
        return pd.DataFrame({"row": a["row"], "length": a["length"], "block": key[0], "bin": b["bins"].iloc[0]})

    return dealt.groupBy("block").cogroup(winner.groupBy("block")).applyInPandas(unpack, "row long, length long, block long, bin int")


def pack(cut: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Rows of :func:`pieces` with sequence_id and offset: every piece once, sequences gapless and at most ``capacity`` long.

    Pieces of full length are sequences by themselves.  Order within a sequence is arbitrary, ids of sequences are any
    distinct numbers.  Repeated rows are packed separately; an empty table gives an empty result.
    """
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = cut.where(F.col("length") < capacity).select("row", "length")
    count, done, level = left.count(), [], 0
    while count:
        blocks = max(1, -(-count // block))
        got = written(_round(left, blocks, capacity, islands, epochs), "packed")
        fill = got.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        got = got.join(fill, ["block", "bin"]).withColumn("sequence_id", F.lit(level << 56) + F.shiftleft(F.col("block"), 20) + F.col("bin"))
        poor = F.col("fill") < int(capacity * 0.98)
        if blocks == 1:
            done.append(got)
            break
        done.append(got.where(~poor))
        left = got.where(poor).select("row", "length")
        before, count = count, left.count()
        if count > before // 2:  # too little has settled for another round to help
            done[-1] = got
            break
        level += 1
    if not done:
        return cut.select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    placed = done[0].select("row", "sequence_id", "block", "bin", "length")
    for x in done[1:]:
        placed = placed.unionByName(x.select("row", "sequence_id", "block", "bin", "length"))
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    spots = placed.select("row", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return cut.join(spots, "row", "left").select(*[c for c in cut.columns if c != "row"], F.coalesce("sequence_id", F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))
