import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldsmith.llm import anchors, induced, joins, simhash, substrings, suffix_trees
from foldsmith.llm.components import components
from tests.llm.cases import copied_rows, edge_rows, frame, words


def bytes_removed(rows, window=200):
    seen = Counter()
    data = [(r[1] or "").encode() for r in rows]
    for b in data:
        seen.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for r, b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def spans_of(df, digest):
    out = []
    for r in df.collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        out.append((r["doc_id"], r[1], removed, len(r["spans"]), digest(r["kept"])))
    return Counter(out)


@pytest.mark.parametrize("seed, hot", [(0, None), (1, 1)])
def test_substrings_against_brute_force(spark, monkeypatch, seed, hot):
    if hot is not None:
        monkeypatch.setattr(substrings, "HOT", hot)  # every gram is split by whole windows
    rows = [r for r in edge_rows() if r[0] != 8] + copied_rows(seed)
    rows.append((900, "ab" * 300, "en", "s", 0))  # overlapping repeats in one text
    df = frame(spark, rows, extra=True)
    got = spans_of(substrings.remove_repeats(df), lambda k: hashlib.sha256(bytes(k)).hexdigest())
    assert got == bytes_removed(rows)


def words_removed(rows, window=50):
    owner = {}
    last = 1 << 63
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            rank = last if r[0] is None else r[0]
            owner[key] = min(owner.get(key, last), rank)
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < (last if r[0] is None else r[0]):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        runs = sum(k in gone and k - 1 not in gone for k in range(len(w)))
        out.append((r[0], len(w), len(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed, hot", [(2, None), (3, 1)])
def test_word_windows_against_brute_force(spark, monkeypatch, seed, hot):
    if hot is not None:
        monkeypatch.setattr(suffix_trees, "HOT", hot)
    rows = edge_rows() + copied_rows(seed)
    rows.append((901, "la la zu " * 300, "en", "s", 0))
    df = frame(spark, rows, extra=True)
    got = spans_of(suffix_trees.remove_repeats(df), lambda k: hashlib.sha256(k.encode()).hexdigest())
    assert got == words_removed(rows)


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_of_equal_polynomial_hashes_differ(spark):
    """Thue-Morse words and their complements are equal under any polynomial modulo 2**64."""
    before, after = " ".join(f"x{k}" for k in range(200)), " ".join(f"y{k}" for k in range(200))
    rows = [(k, f"{before} {thue_morse(1024, k)} {after}", "en", "s", 0) for k in range(2)]
    got = spans_of(suffix_trees.remove_repeats(frame(spark, rows)), lambda k: hashlib.sha256(k.encode()).hexdigest())
    assert got == words_removed(rows) and {r[2] for r in got} == {0, 400}


def test_white_space_between_words_does_not_count(spark, monkeypatch):
    monkeypatch.setattr(anchors, "LOT_BYTES", 300)  # texts and words at the edges of lots
    some = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(some), "en", "s", 0), (2, " \n" + "\t\x0b ".join(some) + " end\r\n", "en", "s", 0)]
    rows += [(3, "q" * 2000 + " " + "  ".join(some[20:90]), "en", "s", 0)]
    got = spans_of(suffix_trees.remove_repeats(frame(spark, rows)), lambda k: hashlib.sha256(k.encode()).hexdigest())
    assert got == words_removed(rows)


@pytest.mark.parametrize("heavy", [1, 1000])
def test_lookups_find_what_plain_joins_find(spark, monkeypatch, heavy):
    monkeypatch.setattr(joins, "HEAVY", heavy)
    rng = random.Random(heavy)
    rows = [(rng.choice([None, *range(60)]), rng.randrange(3), f"t{k}") for k in range(400)] + [(7, 1, "hot")] * 200
    left = spark.createDataFrame(rows, "a long, b long, t string").repartition(5)
    counts = Counter((r[0], r[1]) for r in rows)
    side = [(a, b, n, f"s{n}") for (a, b), n in counts.items() if n > 2] + [(None, 9, 1, "none"), (900, 0, 1, "none")]
    right = spark.createDataFrame(side, "a long, b long, n long, v string")
    values = {(a, b): (n, v) for a, b, n, v in side}
    for how in ("left", "inner"):
        for weight in (None, "n"):
            got = Counter(tuple(r) for r in joins.looked_up(left, right, ["a", "b"], how, weight).collect())
            plain = [(*r, *values.get(r[:2], (None, None))) for r in rows if how == "left" or r[:2] in values]
            assert got == Counter(plain)
    none = joins.looked_up(left, right.where("false"), ["a", "b"])
    assert none.count() == len(rows) and none.where("v IS NOT NULL").count() == 0
    keyed = left.where("a IS NOT NULL")
    for how in ("inner", "left_semi"):
        got = joins.balanced(keyed, right.where("a IS NOT NULL"), ["a", "b"], "n", how)
        assert got.count() == sum(r[0] is not None and r[:2] in values for r in rows)
    plan = joins.looked_up(left, right, ["a", "b"], "inner")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_nothing_to_remove(spark):
    empty = frame(spark, [])
    assert substrings.remove_repeats(empty).count() == 0
    assert suffix_trees.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("limit", [4, 50, 10_000])
def test_deep_nodes_hold_all_equal_windows(limit):
    rng = np.random.default_rng(limit)
    passage = rng.integers(0, 9, 80)
    text = np.concatenate([rng.integers(0, 9, 200), passage, rng.integers(0, 9, 40), passage, np.zeros(150, int)])
    starts = np.arange(len(text) - suffix_trees.WINDOW + 1)
    wanted = defaultdict(set)
    for s in starts.tolist():
        wanted[text[s : s + suffix_trees.WINDOW].tobytes()].add(s)
    nodes = [set(n.tolist()) for n in suffix_trees.deep_nodes(text, starts, limit)]
    assert sorted(map(sorted, nodes)) == sorted(sorted(v) for v in wanted.values() if len(v) > 1)


def test_suffix_arrays_by_induction():
    rng = random.Random(5)
    for n in (0, 1, 2, 50, 400):
        for symbols in (1, 2, 5):
            s = np.array([rng.randrange(symbols) for _ in range(n)], np.int64)
            b = bytes(s.tolist())
            array = induced.suffix_array(s, symbols)
            assert array.tolist() == sorted(range(n), key=lambda i: b[i:])
            if n > 1:
                assert induced.by_doubling(s).tolist() == array.tolist()
                common = induced.permuted_prefixes(s, array, 30)
                for x, y in zip(array[:-1].tolist(), array[1:].tolist()):
                    size = 0
                    while size < 30 and max(x, y) + size < n and b[x + size] == b[y + size]:
                        size += 1
                    assert common[y] == size


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 256, 120)
    text = np.concatenate([rng.integers(0, 256, 77), passage, rng.integers(0, 256, 31), passage])
    at, low, high, fp = anchors.owned(text, np.array([len(text)]), 60, 12)
    place = {s: (a - s, f) for a, x, y, f in zip(at, low, high, fp) for s in range(x, y + 1)}
    assert sorted(place) == list(range(len(text) - 59))
    for k in range(61):
        assert place[77 + k] == place[77 + 120 + 31 + k]


def test_long_texts_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_UNITS", 100)
    pieces = [p for lot in anchors.blocks(np.array([0, 30, 450, 100]), 20) for p in lot]
    starts = {(t, s) for t, a, b in pieces for s in range(a, b - 19)}
    assert starts == {(t, s) for t, n in enumerate([0, 30, 450, 100]) for s in range(n - 19)}


def groups_by_distance(rows):
    fps = [simhash.fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for r, x in zip(rows, label):
        if r[0] is not None:
            smallest[x] = min(smallest.get(x, r[0]), r[0])
    return Counter((r[0], f, smallest.get(x)) for r, f, x in zip(rows, fps, label))


def test_simhash_groups_against_all_pairs(spark):
    rows = edge_rows() + copied_rows(6)
    got = simhash.near_duplicates(frame(spark, rows, extra=True)).collect()
    found = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got)
    assert found == groups_by_distance(rows)


@pytest.mark.parametrize("group", [3, 2048])
def test_links_connect_all_within_distance(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # small: keys are split again and again
    rng = random.Random(group)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        fps.add(center)
        for _ in range(12):
            x = center
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()}
    assert all(bin(a ^ b).count("1") for a, b in found)

    def classes(pairs):
        label = {f: f for f in fps}
        for a, b in pairs:
            if label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
        sets = defaultdict(set)
        for k, v in label.items():
            sets[v].add(k)
        return sorted(map(sorted, sets.values()))

    near = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2]
    assert classes(found) == classes(near)


def test_fingerprint_by_definition():
    import xxhash

    text = "Éa AB c\n d AB c d"
    w = "Éa ab c d ab c d".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(5)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert simhash.fingerprint(text) == bits
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)


def test_one_document_of_each_group_stays(spark):
    rows = copied_rows(7, count=20)
    rows += rows[:3] + [(None, "no id", "en", "s", 0)]
    kept = simhash.stage(spark, frame(spark, rows, extra=True), "").collect()
    wanted = sorted({c for _, _, c in groups_by_distance(rows) if c is not None})
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == wanted
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.stage(spark, frame(spark, []), "").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {(r["a"], r["b"]) for r in components(df).collect()}
    assert got == {(k, 0) for k in range(1, 41)} | {(k, 100) for k in range(101, 130)}
