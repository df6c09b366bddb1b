"""Null and repeated ids in the dedup operators: no row is lost, rewritten, doubled or used to link strangers."""

import hashlib

import pytest

from textloom.llm import components as components_module
from textloom.llm import exact_dedup, ngram_join
from textloom.llm.common import discard, scratch, shared_dir, staged

DOCS = "doc_id long, text string, _row string, id int, token string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "t") for i, t in rows], DOCS)


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_components_of_null_and_repeated_ids(spark):
    a, b, c, d, e = map(words, "abcde")
    rows = [(1, a), (2, b), (None, a + " x"), (None, b + " x"), (50, c), (50, d), (9, c + " x"), (60, d + " x"), (None, e), (None, e + " x"), (5, ""), (None, None), (2**63 - 1, a + " y")]
    got = ngram_join.near_components(docs_of(spark, rows), 5, 80)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = [(1, 1), (2, 2), (None, 1), (None, 2), (50, 9), (50, 50), (9, 9), (60, 50), (None, None), (None, None), (5, 5), (None, None), (2**63 - 1, 1)]
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_drop_near_copies_keeps_one_row_of_each_component(spark):
    a, b, c = map(words, "abc")
    docs = docs_of(spark, [(7, a), (7, a), (3, a + " x"), (None, b), (None, b + " x"), (None, c), (4, ""), (None, ""), (4, "")])
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(((r.doc_id, r.text.split(" x")[0]) for r in rows), key=repr) == sorted([(3, a), (None, b), (None, c), (4, ""), (None, ""), (4, "")], key=repr)
    assert {(r["_row"], r.id, r.token) for r in rows} == {("r", 1, "t")}
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0


def test_ids_at_the_end_of_the_range(spark):
    a = words("a")
    got = ngram_join.near_components(docs_of(spark, [(2**63 - 2, a), (2**63 - 2, a + " x"), (-(2**63), a), (None, a), (2**62, words("b"))])).collect()
    assert sorted((r.component_id for r in got)) == [-(2**63)] * 4 + [2**62]


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN", 10**9)
    rows = [(i, words("s", 30) + f" u{i} " + words("s", 12) + (" tail" * (i % 3))) for i in range(60)] + [(100 + i, words(f"k{i}")) for i in range(5)]
    before = sorted(map(tuple, ngram_join.near_components(docs_of(spark, rows), 4, 85).collect()))
    for sample, often in ((50, 2),):
        monkeypatch.setattr(ngram_join, "SAMPLE", sample)
        monkeypatch.setattr(ngram_join, "OFTEN", often)
        assert sorted(map(tuple, ngram_join.near_components(docs_of(spark, rows), 4, 85).collect())) == before


@pytest.mark.parametrize("salts", [1, 5])
def test_exact_dedup_counts_every_row(spark, salts):
    rows = [(None, "u"), (None, "v"), (None, "v "), (3, "v"), (3, "w"), (3, "w"), (8, "w"), (9, "z")]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), salts=salts).collect()
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in "uvwz"}
    top = 2**63 - 1
    want = [(None, None, 1, True, sha["u"]), (None, top, 3, False, sha["v"]), (None, top, 3, True, sha["v"]), (3, top, 3, False, sha["v"]), (3, 3, 3, True, sha["w"]), (3, 3, 3, True, sha["w"]), (8, 3, 3, False, sha["w"]), (9, 9, 1, True, sha["z"])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_staged_tables_are_deleted(spark):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark, "kept"):
        kept = staged(spark.range(5), "kept")
        lost = staged(spark.range(3), "lost")
        assert lost.count() == 3
    assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    discard(kept)
    assert set(os.listdir(folder)) == before


def test_a_family_around_the_threshold_in_rounds(spark, monkeypatch):
    import random

    from tests.llm.test_llm import brute_components

    rng = random.Random(3)
    base, texts = words("f", 60).split(), []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = rng.choice("xyz")
        texts.append(" ".join(copy))
    pairs = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda p, sets, percent: pairs.append(1) or verified(p, sets, percent))
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(docs_of(spark, list(enumerate(texts))), 4, 85).collect()}
    assert got == dict(enumerate(brute_components(texts, 4, 85)[1]))
    assert len(pairs) == 1 + len(ngram_join.ROUNDS)


@pytest.mark.parametrize("one_task", [components_module.ONE_TASK, 0])
def test_components_by_either_path(spark, monkeypatch, one_task):
    import random

    rng, tables = random.Random(5), []
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 450)] + [(2**62, -(2**62)), (900, 900)]
    want = {n: n for a, b in links if a != b for n in (a, b)}
    for _ in links:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    monkeypatch.setattr(components_module, "staged", lambda df, name: tables.append(name) or staged(df, name))
    got = components_module.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert bool(tables) == (one_task == 0)  # few links need no star step
    assert components_module.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


@pytest.mark.parametrize("one_task", [components_module.ONE_TASK, 0])
def test_near_components_need_few_tables(spark, monkeypatch, one_task):
    import random

    from tests.llm.test_llm import brute_components

    rng = random.Random(8)
    base, texts, tables = words("f", 60).split(), [words(f"o{i % 9}") for i in range(20)], []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = rng.choice("xyz")
        texts.append(" ".join(copy))
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    for module in (ngram_join, components_module):
        monkeypatch.setattr(module, "staged", lambda df, name: tables.append(name) or staged(df, name))
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(docs_of(spark, list(enumerate(texts))), 4, 85).collect()}
    assert got == dict(enumerate(brute_components(texts, 4, 85)[1]))
    assert one_task == 0 or len(tables) <= 32
