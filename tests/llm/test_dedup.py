from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import brute
from tidewatch.llm import blocks, jaccard, queries, substring, words

KIND = "doc_id long, text string, key string, told string, node long, block int, n long"


def table(spark, docs):
    return spark.createDataFrame([(d["doc_id"], d["text"], "x", "y", 1, 2, 3) for d in docs], KIND)


def near_copies(seed: int) -> list[dict]:
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for base in range(6):
        words = [pick.choice(vocabulary) for _ in range(120)]
        for _ in range(pick.choice([1, 4, 25])):
            own = list(words)
            for _ in range(pick.choice([0, 1, 2, 3, 4])):
                own[pick.randrange(len(own))] = pick.choice(vocabulary)
            docs.append(" ".join(own))
    shared = " ".join(pick.choice(vocabulary) for _ in range(60))
    docs += [shared + " " + " ".join(pick.choice(vocabulary) for _ in range(40)) for _ in range(8)]
    docs += ["a b c d e"] * 3 + ["A b C d e", "a b", "A  b", "a", "", " \t\n", None, None, "long " * 20_000, "long " * 20_001]
    pick.shuffle(docs)
    return [{"doc_id": 3 * i + 1, "text": t} for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    docs = near_copies(seed)
    rows = substring.remove_repeats(table(spark, docs)).collect()
    got = {r["id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows}
    assert len(rows) == len(docs) and got == brute.repeats(docs)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_repeats_edges(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = table(spark, [{"doc_id": 5, "text": words}, {"doc_id": 5, "text": words}, {"doc_id": 7, "text": words}, {"doc_id": None, "text": words}])
    got = sorted((r["id"] if r["id"] is not None else 99, r["n_removed"]) for r in substring.remove_repeats(docs).collect())
    assert got == [(5, 0), (5, 0), (7, 20), (99, 20)]
    assert substring.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"tile": 3, "tiles": 2}), (3, {"tile": 2, "tiles": 1})])
def test_classes_equal_brute_force(spark, seed, options):
    docs = near_copies(seed)
    rows = jaccard.classes(table(spark, docs), **options).collect()
    assert len(rows) == len(docs) and {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.classes(docs)


def test_connected_in_many_parts(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201)]
    random.Random(4).shuffle(edges)
    got = {r["node"]: r["root"] for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long"), each=5).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_classes_edges(spark):
    same = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [{"doc_id": 4, "text": same}, {"doc_id": 4, "text": same}, {"doc_id": None, "text": same}, {"doc_id": None, "text": "alone here"}, {"doc_id": 2, "text": None}])
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect() if r["component_id"] is not None)
    assert got == [("2", 0, 2), ("4", 26, 4), ("4", 26, 4), ("None", 26, 4)]
    assert jaccard.classes(docs.where("false")).count() == 0


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    """Nothing is removed or linked where one word alone, a run that defeats hashes modulo a power of two, differs."""
    rest = " ".join(f"w{i}" for i in range(12))
    docs = [{"doc_id": i, "text": f"{rest[:18]} {thue_morse(n, *ab)} {rest[18:]}"} for i, ab in enumerate(("ab", "ba", "ab"))]
    assert {r["id"]: r["n_removed"] for r in substring.remove_repeats(table(spark, docs)).collect()} == {0: 0, 1: 0, 2: 13}
    short = [{"doc_id": i, "text": "one two " + thue_morse(n, *ab)} for i, ab in enumerate(("ab", "ba", "ab"))]
    assert {r["id"]: r["component_id"] for r in jaccard.classes(table(spark, short)).collect()} == {0: 0, 1: 1, 2: 0}


def test_hashes_tell_ranges_apart():
    pick = random.Random(7)
    every = sorted({"".join(pick.choice("ab") for _ in range(pick.choice([1, 3, 7, 8, 9, 15, 16, 17, 40, 600]))) for _ in range(3000)})
    found = []
    for row, off, data in words.chunks(pa.array([" ".join(every), "X " + " ".join(every).upper()])):
        for seed in (0, 1):
            start, end, first = words.places(data, off)
            h = words.hashes(data, start, end, words.LOWER, seed)
            assert len(set(h[: len(every)].tolist())) == len(every) and (h[first[1] + 1 :] == h[: first[1]]).all()
            found.append(h)
    assert not (found[0] == found[1]).any()


def test_bytes_sent_do_not_grow_with_the_blocks():
    """What a bucket of 12 MB of text sends is as much for 64 blocks as for 32,768, which 400 GB have."""
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 2_100_000, np.uint64) * np.uint64(2))
    sizes = []
    for bits in (6, 9, 12, 15):
        plan = blocks.Layout(64, bits, 46)
        short = np.unique(blocks.truncated(hashes, plan))
        rows = blocks.sent(1, short, np.ones(len(short), np.int64), plan)
        assert (np.sort(np.concatenate([blocks.unpacked(x.as_py()) for x in rows["data"]])) >> np.uint64(2) == short).all()
        sizes.append(rows.nbytes)
    assert max(sizes) <= 1.1 * min(sizes)
    large = blocks.layout(100 << 40)
    n = (100 << 40) / 6
    assert n / large.buckets / (1 << large.bits) >= blocks.ROW / 4  # hashes of a row, however large the input


@pytest.mark.parametrize("seed", [1, 2])
def test_links_on_the_bound(spark, seed):
    """Sets whose overlap is just 80 hundredths of their union, and one shingle less."""
    pick = random.Random(seed)
    docs = []
    for i in range(40):
        both, left = 4 * pick.randrange(2, 30), 0
        alone = both // 4 + (i % 2)
        left = pick.randrange(alone + 1)
        common = [f"c{i}.{j}" for j in range(both + 4)]
        docs += [" ".join([f"l{i}.{j}" for j in range(left)] + common), " ".join(common + [f"r{i}.{j}" for j in range(alone - left)])]
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(docs)]
    want = brute.classes(docs)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table(spark, docs)).collect()} == want
    assert sum(c != i for i, (_, c) in want.items()) == 20


def test_queries_on_the_table(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op2_substring(spark, small).collect()}
    assert got == brute.repeats(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard(spark, small).collect()} == brute.classes(docs)


def test_rolling_hashes_are_polynomials():
    """Every window's hash is its own polynomial's, wherever it stands; windows that differ in one entry differ."""
    import numpy as np
    from tidewatch.llm import words

    entries = np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.uint64)
    entries[200:213] = entries[40:53]
    got = words.rolling(entries, 13)
    for i in (0, 1, 40, 200, 487):
        total = 0
        for v in entries[i : i + 13].tolist():
            total = (total * int(words._STEP) + v) % (1 << 64)
        assert got[i] == words.mix(np.array([total], np.uint64))[0]
    assert got[40] == got[200] and len(np.unique(got)) == len(got) - 1
    assert len(words.rolling(entries[:12], 13)) == 0


def test_meetings_beyond_many_groups():
    """A meeting in the last of more groups than 40 bits of sizes leave room for."""
    import numpy as np
    import pyarrow as pa
    from tidewatch.llm import jaccard

    n = (1 << 23) + 5
    hashes = np.concatenate((np.arange(n), [n - 1]))
    size = np.full(n + 1, 20)
    table = pa.table({"hash": hashes, "low": size, "high": size, "node": np.arange(n + 1) + 7})
    got = jaccard._meet_task(80)(table).to_pydict()
    assert sorted(got["a"] + got["b"]) == [n + 6, n + 7]
    group, high = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 3, 9, 2, 1, 1 << 50])
    assert jaccard._reach(group, high).tolist() == [5, 5, 9, 2, 2, 1 << 50]


def test_overlaps_of_large_sets_are_exact():
    import numpy as np
    from tidewatch.llm import jaccard

    sets = [np.arange(0, 120_000, dtype=np.uint64), np.arange(1, 120_001, dtype=np.uint64), np.arange(60_000, 60_010, dtype=np.uint64)]
    assert jaccard._overlaps(sets, sets).tolist() == [[120_000, 119_999, 10], [119_999, 120_000, 10], [10, 10, 10]]
