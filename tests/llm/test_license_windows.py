"""Windows over line breaks against comparing every window of every text."""

import random
import re

from textloom.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
DOCS = "doc_id long, text string, id string, label string"


def every_window(text, percent=80, stretch=120, whole=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, template in license_scan.TEMPLATES:
        s = set(template.split())
        size = -(-stretch * len(template.split()) // 100)
        least = len(s) if len(s) <= whole else -(-percent * len(s) // 100)
        place = None
        for i in range(len(words)):
            n = len(s & set(words[i : i + size]))
            if words[i] not in s or n < least:
                continue
            end = min(len(words), i + size)
            if place and i <= place[2]:
                place = (label, place[1], end, max(place[3], n / len(s)))
            else:
                out += [place] if place else []
                place = (label, i, end, n / len(s))
        out += [place] if place else []
    return len(words), sorted(out)


def test_windows_equal_comparing_all(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + [f"x{i}" for i in range(20)]
    texts = [None, "", " ", MIT, MIT.replace("\n", "\r\n * ").upper()]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            keep = [w for w in t if rng.random() < rng.choice([1, 0.95, 0.8, 0.6])]
            if rng.random() < 0.3:
                keep.insert(rng.randint(0, len(keep)), rng.choice(vocabulary))
            words += keep + rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30]))
        texts.append("".join(w + rng.choice([" ", " ", "\n", ", "]) for w in words))
    texts.append(" ".join(rng.choices(vocabulary, k=30_000)) + " " + MIT)
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, MIT, "", ""), (None, MIT, "", "")]  # repeated and null ids
    got = license_scan.scan_windows(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *every_window(t)) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, sorted(map(tuple, r.places))) for r in got), key=repr) == want
    for r in got:
        assert r.labels == ",".join(sorted({p.label for p in r.places})) and r.n_places == len(r.places) and r.score == max([0.0, *(p.share for p in r.places)])
    assert license_scan.scan_windows(spark.createDataFrame([], DOCS)).count() == 0


def test_a_wrapped_notice_is_met_and_one_word_tells_short_ones_apart(spark):
    texts = [MIT, "Released under the MIT License.", "the GNU General\nPublic License", "GNU Lesser General\nPublic License", "bsd released a thing long ago and many words went by under the old roof before any license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in license_scan.scan_windows(rows).orderBy("doc_id").collect()] == ["mit", "mit", "", "lgpl", ""]
