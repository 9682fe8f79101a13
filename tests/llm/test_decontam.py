import random

import numpy as np
import pytest

from foldsmith.llm import decontam
from tests.llm.cases import edge_rows, frame


def plain_tiles(item, text, shortest):
    """Greedy string tiling by definition: the longest unmarked match, first places first."""
    used_item, used_text, tiles = set(), set(), []
    while True:
        best = None
        for at in range(len(text)):
            for p in range(len(item)):
                n = 0
                while (
                    at + n < len(text)
                    and p + n < len(item)
                    and text[at + n] == item[p + n]
                    and at + n not in used_text
                    and p + n not in used_item
                ):
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (at, p, n)
        if best is None:
            return sorted(tiles)
        at, p, n = best
        used_text |= set(range(at, at + n))
        used_item |= set(range(p, p + n))
        tiles.append(best)


@pytest.mark.parametrize("seed", range(20))
def test_tiles_against_the_definition(seed):
    rng = random.Random(seed)
    item = [f"w{k}" for k in range(rng.randint(12, 40))]
    cut = rng.randint(5, len(item) - 5)
    text = ["x"] * rng.randint(0, 6) + item[cut:] + ["y"] * rng.randint(0, 3) + item[:cut]
    text[rng.randrange(len(text))] = "z"
    index = decontam.Index.of([(1, " ".join(item))], decontam.MIN_TILE)
    got = [tiles for _, _, tiles in index.matches(" ".join(text))]
    expected = plain_tiles(item, text, decontam.MIN_TILE)
    # Among matches of one length any may be first; the covered words are the same here,
    # where no word repeats.
    assert sum(t[2] for tiles in got for t in tiles) == sum(t[2] for t in expected)


@pytest.mark.parametrize("shared", [5, 6, 9])
def test_items_longer_than_what_is_shared(shared):
    """The search length starts far above the covered stretch, which may be of any size."""
    item = [f"w{k}" for k in range(59)]
    index = decontam.Index.of([(7, " ".join(item))], decontam.MIN_TILE)
    text = "a b " + " ".join(item[20 : 20 + shared]) + " c"
    assert list(index.matches(text)) == [(0, 59, [(2, 20, shared)])]
    for n in range(12):
        made = decontam.window_hashes(np.arange(n, dtype=np.uint64), 9)
        assert len(made) == max(0, n - 8)


def test_reordered_passages_are_caught_and_clean_rows_stay(spark):
    rng = random.Random(3)
    item = [f"w{k}" for k in range(40)]
    parts = [item[a : a + 10] for a in range(0, 40, 10)]
    rng.shuffle(parts)
    rows = edge_rows() + [
        (100, "start " + " and ".join(" ".join(p) for p in parts), "en", "s1", 0),
        (101, "start " + " ".join(item[:10]) + " end", "en", "s1", 0),
        (102, " ".join(item).upper(), "en", "s1", 0),
    ]
    docs = frame(spark, rows, extra=True)
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "too short"), (1, " ".join(item))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = decontam.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in pairs) == [(100, 1), (100, 1), (102, 1), (102, 1)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 2
    assert decontam.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
