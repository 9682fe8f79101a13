import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldsmith.llm import chat, packing, warc
from foldsmith.session import BATCH_CONF, new_path
from tests.llm.cases import copied_rows, edge_rows, frame

TURNS = "conv_id long, turn int, role string, text string"


def turns(long=0):
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "user", "### user: \\### </turn> \\</turn>\n"),
        (1, 2, "assistant", "\\"),
        (1, 3, "user", None),
        (1, 4, "assistant", "two\n</turn>"),
        (1, 5, "user", "left over"),
        (2, 0, "user", "nobody answers"),
        (3, 0, "assistant", ""),
        (3, 0, "assistant", ""),
        (None, 0, "user", "a"),
        (None, 1, "assistant", "b" * 5000),
        (4, None, None, "no role"),
        (4, 1, "a:b\\", "odd role"),
        (-7, 0, "user", chat.HARD),
        (-7, 1, "assistant", chat.HARD),
    ]
    return rows + [(9, k, ("user", "assistant")[k % 2], f"t{k} ###") for k in range(long)]


def ordered(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(g)] for c, g in groups.items()}


def test_examples_hold_every_reply_once(spark):
    rows = turns(long=2 * chat.BLOCK + 9)
    df = spark.createDataFrame(rows, TURNS).withColumn("block", F.lit("x")).repartition(3)
    got = chat.expand(df).collect()
    expected = Counter()
    for conv, all_ in ordered(rows).items():
        for k, (role, text) in enumerate(all_):
            if role == "assistant":
                expected[conv, tuple(all_[: k + 1]), text] += 1
            elif k + 1 == len(all_):
                expected[conv, tuple(all_), ""] += 1
    read = Counter(
        (r["conv_id"], tuple(chat.parse(r["text"])), chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]))
        for r in got
    )
    assert read == expected
    assert chat.expand(df.limit(0)).count() == 0


def test_digests_of_conversations(spark):
    rows = turns(long=600)
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(spark.createDataFrame(rows, TURNS))).collect()}
    assert got.keys() == ordered(rows).keys()
    for conv, all_ in ordered(rows).items():
        said = "".join(t for r, t in all_ if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in all_)
        row = got[conv]
        assert row["n_turns"] == len(all_) and row["loss_chars"] == len(said)
        assert row["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("targets", [None, {"s1": 3.0, "s2": 1.0}])
def test_pieces_hold_every_id_once(spark, targets):
    from tokenizers import Tokenizer

    rows = [r for r in edge_rows() + copied_rows(2) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    path = packing.default_tokenizer()
    pieces = packing.pack(frame(spark, rows, extra=True), path, targets).collect()
    model = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == {r[0] for r in rows}
    for doc, text, *_ in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    filled = []
    for number in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[number], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        filled.append(at)
    assert sorted(by_sequence) == list(range(len(filled)))
    assert all(n == packing.SEQUENCE for n in filled[:-1]) and 0 < filled[-1] <= packing.SEQUENCE


def test_windows_follow_the_mixture(spark):
    """Windows are equal parts of all tokens; after each, every queue has given its share."""
    rows = [(k, "word " * 200, "en", ("s1", "s1", "s1", "s2")[k % 4], 0) for k in range(400)]
    pieces = packing.pack(frame(spark, rows), packing.default_tokenizer(), window=4).collect()
    total = {s: sum(p["length"] for p in pieces if p["source"] == s) for s in ("s1", "s2")}
    count = round(sum(total.values()) / (4 * packing.SEQUENCE))
    assert count > 5
    for k in range(1, count + 1):
        due = {s: k * n // count for s, n in total.items()}
        edge = sum(due.values())
        given = Counter()
        for p in pieces:
            if p["sequence_id"] * packing.SEQUENCE + p["offset"] < edge:
                given[p["source"]] += p["length"]
        # Only a piece that a window's edge cuts could differ, and none is.
        assert given == due


def whole(pieces):
    """No gap, no overlap, nothing lost."""
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert (p["sequence_id"], p["offset"]) == divmod(at, packing.SEQUENCE)
        at += p["length"]
    return at


def test_small_sources_keep_their_share_in_every_window(spark):
    # Sources of 12 and 6 documents, all below the quantum, one of them NULL.
    names = [f"a{k:03}" for k in range(300)] + [None]
    rows = [(s, j) for k, s in enumerate(names) for j in range(12 if k % 2 else 6)]
    rows = [(i, "word " * 10, "en", s, 0) for i, (s, _) in enumerate(rows)]
    pieces = packing.pack(frame(spark, rows), packing.default_tokenizer(), sequence=2048, window=2).collect()
    assert whole(pieces) == 11 * len(rows)
    total = Counter()
    for p in pieces:
        total[p["source"]] += p["length"]
    assert max(total.values()) < packing.MIN_QUANTUM * 11 * len(rows) / 4096
    for edge in range(2048, 11 * len(rows), 2048):
        given = Counter()
        for p in pieces:
            if p["sequence_id"] * 2048 + p["offset"] < edge:
                given[p["source"]] += p["length"]
        for s, n in total.items():
            assert abs(given[s] - n * edge / (11 * len(rows))) <= 22 + 0.05 * n


def test_targets_of_small_sources_are_kept(spark):
    rows = [(k, "word " * 10, "en", "large", 0) for k in range(2000)]
    rows += [(3000 + k, "word " * 10, "en", s, 0) for k, s in enumerate(["tiny", "tiny", None, "other"])]
    targets = {"large": 100.0, "tiny": 50.0, None: 50.0}
    pieces = packing.pack(frame(spark, rows), packing.default_tokenizer(), targets, window=2).collect()
    assert whole(pieces) == 11 * len(rows)
    place = defaultdict(list)
    for p in pieces:
        place[p["source"]].append(p["sequence_id"] * packing.SEQUENCE + p["offset"])
    assert max(place["tiny"]) < 200 and max(place[None]) < 200
    assert min(place["other"]) == 11 * len(rows) - 11  # no target: last


def test_ids_of_every_low_letter_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["\u018fliyev", "\u018f li", "in \u018fliyev's \u01b7ord, \u0186"]
    for c in map(chr, range(0x250)):
        texts += [c, f"{c}li", f"li{c}li", f"li{c}", f"a {c} b", f"ab, {c}li's x{c}"]
    got = packing.WordTokenizer(packing.default_tokenizer()).encode(texts)
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [t for t, g, w in zip(texts, got, wanted) if np.frombuffer(g, "<u4").tolist() != w]


def test_signs_after_an_apostrophe_are_cut_as_the_tokenizer_cuts_them():
    words = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["a '.. b", "x'-- y", "it's '' x'..y", "'!?", "a..' b", "don't!!'", "ab-cd, ef", "A1B22 zz9"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("abXY'.,-! 019\u00e9\u00b5\n"), 25)) for _ in range(3000)]
    assert words.encode(texts) == [words._whole(t) for t in texts]


def batch_sizes(names, types, rows, size):
    """One row a batch: in two of its columns how many rows and bytes there were."""

    def run(batches):
        for batch in batches:
            row = {rows: len(batch), size: batch.nbytes}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, types)], names=names)

    return run


@pytest.mark.parametrize("repeats", [1, 5000])
def test_workers_get_texts_and_ids_in_small_batches(spark, monkeypatch, repeats):
    text = F.repeat(F.lit("ab "), repeats)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text"))
    settings = [spark.conf.get(key, None) for key in BATCH_CONF]
    names = ["doc_id", "source", "part", "before", "n", "ids"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    with monkeypatch.context() as patch:
        patch.setattr(packing, "_tokenize", lambda path: batch_sizes(names, types, "before", "n"))
        texts = packing.tokenized(docs, "").collect()
    assert sum(r["before"] for r in texts) == 2000
    assert max(r["before"] for r in texts) <= 512 and max(r["n"] for r in texts) < 5_000_000
    names = [c.strip().split()[0] for c in packing.PIECES_ROW.split(",")]
    types = [pa.int64()] * 7 + [pa.string()]
    with monkeypatch.context() as patch:
        patch.setattr(packing, "_cut", lambda plan, sequence: batch_sizes(names, types, "start", "length"))
        ids = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sum(r["start"] for r in ids) == 2000
    assert max(r["start"] for r in ids) <= 512 and max(r["length"] for r in ids) < 5_000_000
    assert [spark.conf.get(key, None) for key in BATCH_CONF] == settings


def test_packing_of_no_rows(spark):
    assert packing.pack(frame(spark, []), packing.default_tokenizer()).count() == 0


def pages():
    large = "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 600
    return [
        (1, "http://a.b/c?d#e", large),
        (2, "http://a.b/c d\r\nX: y", large),
        (5, "http://z", large),
        (3, None, "small"),
        (4, "no scheme", "small"),
        (6, "http://n", None),
        (7, "http://n", "\r\n\r\n"),
        (8, "http://n", "x\n" * 300_000),
        (9, "http://n", "\r\n\r\n" * 400),
        (10, "http://n", ""),
    ]


def test_archives_give_back_every_payload(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    df = df.withColumn("digest", F.lit("mine")).repartition(2)
    path = new_path(spark, "archives")
    warc.write(df, path)
    rows = warc.assemble(warc.read(spark, path)).collect()
    got = {int(r["metadata"]["fields"]["page-id"]): r for r in rows}
    assert len(rows) == len(got) == len(pages())
    for page, _, html in pages():
        r = got[page]
        assert r["request"]["concurrent_to"] == r["main"]["record_id"]
        assert r["main"]["payload_digest"] == hashlib.sha1((html or "").encode()).hexdigest()
        if page in (1, 2):
            assert r["main"]["type"] == "revisit" and r["original"]["page-id"] == "5"
            assert r["main"]["refers_to"] == got[5]["main"]["record_id"]
        else:
            assert r["main"]["type"] == "response" and r["main"]["payload"] == (html or "")
            assert r["main"]["digest_ok"] and r["original"] is None


def test_repeated_pages_and_no_pages(spark):
    rows = [pages()[0]] * 2 + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for some, n in ((df, 2), (df.limit(0), 0)):
        path = new_path(spark, "archives")
        warc.write(some, path)
        assert warc.assemble(warc.read(spark, path)).count() == n
