import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldsmith.llm import licenses, pii, quality
from tests.llm.cases import copied_rows, edge_rows, frame, words


def measures(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in t),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_measures(spark):
    rows = edge_rows() + copied_rows(1)
    rows.append((999, "one two three\none two three\n \n*#a|b&<>\none two three", "en", "s1", 1))
    got = quality.judge(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    expected = Counter((r[0], *measures(r[1])) for r in rows)
    assert Counter((r["doc_id"], *[r[m] for m in quality.MEASURES]) for r in got) == expected
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_host_rates_are_shrunk(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "en", "large", 0) for k in range(40)]
    rows += [(100 + k, "short", "en", "bad", 0) for k in range(40)]
    rows += [(150, good, "en", "bad", 0), (160, "short", "en", "single", 0)]
    rows += [(200 + k, good, "en", None, 0) for k in range(3)]
    kept = {r["doc_id"] for r in quality.judge(frame(spark, rows)).where("kept").collect()}
    assert 150 not in kept  # a good document of a bad host
    assert {*range(40), 200, 201, 202} <= kept


def test_quality_stage_keeps_columns_and_bears_no_rows(spark):
    empty = frame(spark, [])
    assert quality.judge(empty).count() == 0
    staged = quality.stage(spark, frame(spark, edge_rows(), extra=True), "")
    assert staged.columns == frame(spark, [], extra=True).columns


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return ",".join(
        f"{k}:{m.start()}:{m.end()}"
        for k, p in PATTERNS.items()
        for m in re.finditer(p, text or "")
        if passes(k, m.group())
    )


HARD = [
    "é a@b.c_d@e.f g@h.i.j. @x a@b %+-@a-b.c-d.e\U0001f600k@l.m",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.255.0255 1.2.3 1..2.3.4 00000000000000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111  111111111111 5 5-5",
    "+1 (386) 555-3733, +1+2 333 444 555 + 1 +12 +49.30.1234567-8( +123456789012345678",
    "a" * 20_000 + " " + "1 " * 20_000 + "." * 2_000 + "x@" + "a." * 3_000,
    "9" * 5_000 + "+" * 3_000 + "+1" + "-" * 5_000,
]


def test_personal_data_matches_the_plain_patterns(spark):
    rows = edge_rows() + [(100 + k, t, "en", "s", 0) for k, t in enumerate(HARD)]
    got = pii.detect(frame(spark, rows, extra=True)).select("_id", pii.rendered("_base").alias("b")).collect()
    assert Counter((r["_id"], r["b"]) for r in got) == Counter((r[0], base(r[1])) for r in rows)


def test_terms_that_disclose_are_spans(spark):
    # "Zorblatt" stands near one address only, in different texts; "the" stands everywhere.
    near = [f"note {k} the mail of Zorblatt is zed@mail.example for the year {k}" for k in range(4)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(near)]
    rows += [(50 + k, f"the mail of someone number {k} is the same", "en", "s", 0) for k in range(40)]
    found = pii.detect(frame(spark, rows)).select("_id", pii.rendered("_spans").alias("s"))
    spans = {r["_id"]: r["s"] for r in found.collect()}
    at = near[0].index("Zorblatt")
    assert f"term:{at}:{at + 8}" in spans[0].split(",")
    assert not [s for s in spans.values() if "term" in s and "email" not in s]
    assert all(spans[50 + k] == "" for k in range(40))
    staged = {r["doc_id"]: r["text"] for r in pii.stage(spark, frame(spark, rows), "").collect()}
    assert "[EMAIL]" in staged[0] and "[TERM]" in staged[0] and "Zorblatt" not in staged[0]
    assert staged[50] == rows[4][1]


def test_terms_are_spans_wherever_they_stand(spark):
    # Far from the address, in texts without it, names of two letters, numbers, repeated rows.
    far = "the mail of someone is the same " * 20
    rows = [(k, f"{k} Bo Zorblatt {far} zed@mail.example {far} badge 77123 {far} Zorblatt", "en", "s", 0) for k in range(9)]
    rows += [(20, "Zorblatt and BO are someone, the mail", "en", "s", 0)] * 2
    rows += [(50 + k, f"and are {far} number {k}", "en", "s", 0) for k in range(400)]
    found = pii.detect(frame(spark, rows)).select("_id", pii.rendered("_spans").alias("s"))
    spans = {r["_id"]: r["s"].split(",") for r in found.collect()}
    marks = lambda text, *words: {f"term:{m.start()}:{m.end()}" for w in words for m in re.finditer(rf"\b{w}\b", text)}
    for doc, text, *_ in rows[:9]:
        wanted = marks(text, "Bo", "Zorblatt", "77123", "badge")
        assert len(wanted) == 5 and {s for s in spans[doc] if s.startswith("term")} == wanted
    assert set(spans[20]) == marks(rows[9][1], "Zorblatt", "BO")
    assert all(spans[50 + k] == [""] for k in range(400))
    staged = pii.stage(spark, frame(spark, rows), "").collect()
    assert len(staged) == len(rows)
    assert not [r for r in staged if "Zorblatt" in r["text"] or "77123" in r["text"]]


def plain_terms(rows):
    """Terms that disclose, by the definition."""
    bags, named = [], []
    for _, text, *_ in rows:
        cut = re.sub(r"\S+@\S+", " ", text)
        bags.append({w.lower() for w in re.findall(r"[^\W_]+", cut) if len(w) > 1})
        named.append(set(re.findall(r"\S+@\S+", text)))
    terms = set()
    for e in set().union(*named):
        own = [k for k, x in enumerate(named) if e in x]
        for t in set().union(*(bags[k] for k in own)):
            both = [k for k in own if t in bags[k]]
            n, n_t = len(rows), sum(t in x for x in bags)
            if len({rows[k][1] for k in both}) >= 3 and len(own) < n:
                pmi = math.log2(len(both) * n / (len(own) * n_t))
                terms |= {t} if pmi >= 0.9 * math.log2(n / len(own)) else set()
    return terms


def test_terms_by_the_definition(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        who = [i for i in range(6) if rng.random() < 0.08]
        text = [f"name{i}" for i in who if rng.random() < 0.9] + [f"m{i}@ex.org" for i in who]
        text += [f"name{rng.randrange(6)}"] * (rng.random() < 0.1) + rng.choices([f"w{j}" for j in range(60)], k=12)
        rng.shuffle(text)
        rows += [(k, " ".join(text), "en", "s", 0)] * rng.choice([1, 1, 1, 3])
    wanted = plain_terms(rows)
    got = {
        r["t"][int(a) : int(b)].lower()
        for r in pii.detect(frame(spark, rows)).join(frame(spark, rows), F.col("_id") == F.col("doc_id"))
        .select(F.col("text").alias("t"), pii.rendered("_spans").alias("s")).collect()
        for kind, a, b in [x.split(":") for x in r["s"].split(",") if x]
        if kind == "term"
    }
    assert wanted and got == wanted


def test_replacement_of_overlapping_spans(spark):
    text = "ab +1 22.33.44.55 cd"
    rows = [(1, text, "en", "s", 0), (2, None, "en", "s", 0), (3, "clean", "en", "s", 3)]
    staged = pii.stage(spark, frame(spark, rows, extra=True), "")
    got = {r["doc_id"]: r["text"] for r in staged.collect()}
    assert got[1].startswith("ab [") and got[1].endswith("] cd") and "22" not in got[1]
    assert got[2] is None and got[3] == "clean"
    assert pii.stage(spark, frame(spark, []), "").count() == 0


@pytest.fixture(scope="module")
def classifier(spark):
    return licenses.fit(frame(spark, copied_rows(3)))


def test_licence_families_are_found(spark, classifier):
    rows, wanted = edge_rows(), {}
    for k, (family, texts) in enumerate(licenses.TEMPLATES.items()):
        for j, text in enumerate(texts):
            doc = 1000 + 10 * k + j
            wanted[doc] = family
            rows.append((doc, f"First words of a text.\n{text} And more words here.\nend", "en", "s", 0))
    plain = [r for r in copied_rows(4)]
    plain.append((5000, "His driving license was apache red\nthe public general version of the work", "en", "s", 0))
    found = licenses.by_document(*licenses.scan(frame(spark, rows + plain, extra=True), classifier=classifier))
    got = found.collect()
    assert len(got) == len(rows + plain)
    families = {r["doc_id"]: r["license"] for r in got}
    right = sum(families[d] == f for d, f in wanted.items())
    assert right >= 0.95 * len(wanted)
    assert all(families[r[0]] == licenses.UNKNOWN for r in plain + edge_rows())
    counted = {r["doc_id"]: r["n_paragraphs"] for r in got}
    assert counted[1] == counted[2] == counted[3] == 0 and counted[1000] == 3


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this""",
}


def test_wrapped_notices_are_found(spark, classifier):
    rows, wanted = [], {}
    for family, text in WRAPPED.items():
        for mark in ("", "# ", " * ", "// ", "dnl "):
            for end in ("\n", "\r\n"):
                wanted[len(rows)] = family
                lines = [mark + line for line in text.split("\n")]
                rows.append((len(rows), end.join(["Some words.", "", *lines, "", "la la"]), "en", "s", 0))
    filler = " ".join(f"v{k} of the" for k in range(300))
    # In a long block, and beside another notice.
    rows.append((900, f"{filler}\n{WRAPPED['mit']}\n{filler}", "en", "s", 0))
    rows.append((901, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "en", "s", 0))
    # The two-grams of a notice far from each other, or in different blocks, are no notice.
    apart = WRAPPED["bsd"].replace("\n", " ").split(" ")[:20]
    rows.append((902, f" {filler} ".join(f"{a} {b}" for a, b in zip(apart, apart[1:])), "en", "s", 0))
    rows.append((903, "\n\n".join(f"{a} {b}" for a, b in zip(apart, apart[1:])), "en", "s", 0))
    found = licenses.by_document(*licenses.scan(frame(spark, rows), classifier=classifier)).collect()
    got = {r["doc_id"]: (r["license"], r["families"], r["n_license_paragraphs"]) for r in found}
    assert {d: got[d] for d in wanted} == {d: (f, f, 1) for d, f in wanted.items()}
    assert got[900] == ("mit", "mit", 1) and got[901][1:] == ("apache-2.0,mit", 2)
    assert got[902] == got[903] == (licenses.UNKNOWN, "", 0)


def test_classifier_on_held_out_rows(spark, classifier):
    rows = licenses.training_rows(["some words of a text without a notice"] * 20, seed=7)
    labelled = spark.createDataFrame([(t, f) for t, f, _ in rows], "text string, wanted string")
    scored = classifier.predict(labelled, "text")
    right = scored.select(F.avg((F.col("family") == F.col("wanted")).cast("double"))).first()[0]
    assert right > 0.9


def test_licences_of_no_rows(spark, classifier):
    found = licenses.by_document(*licenses.scan(frame(spark, []), classifier=classifier))
    assert found.count() == 0


def test_base_digest_of_nothing(spark):
    got = pii.detect(frame(spark, [(1, None, "en", "s", 0)]))
    digest = got.select(F.sha2(pii.rendered("_base"), 256)).first()[0]
    assert digest == hashlib.sha256(b"").hexdigest()
