"""The library's operators on literal rows: positive and negative cases, nulls, blanks and ties."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.vocabulary import gloss_tags
from textloom.operators import books, generation, labeling, layout, lexical, metrics, morphology, ranks, responses, retrieval, rules, search, stats, tagging
from textloom.plans import queries
from textloom.sources import readers, sinks
from textloom.streaming import ledger


def one(spark, text, f):
    """f applied to a one-row table with the text."""
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "f,text,want",
    [
        (tx.strip, "\n a \t", "a"), (tx.first_translation, "fish, big / small (sp)", "fish"), (tx.first_translation, "a (b), c", "a"), (tx.after_colon, "x: y: z ", "y: z"),
        (tx.after_colon, " none ", "none"), (tx.senses, "a, ,b ,", ["a", "b"]), (tx.clean_gloss, "k.o. fish (sp.)", "kind of. fish (species.)"), (tx.clean_gloss, "1sg; (2pl poss) (123).", "first person singular"),
        (tx.clean_source, "(12) a. text\nmore", "text more"), (tx.clean_source, "b: x", "x"), (tx.clean_translation, "say 'a \"b\" c' now", 'a "b" c'), (tx.clean_translation, "“unpaired (see 3)", "unpaired"),
        (tx.clean_translation, "text [x]", "text"), (tx.clean_translation, "t (A et al)", "t"), (tx.clean_translation, "t (B 2021)", "t"), (tx.clean_translation, "it's", "it's"),
        (tx.finetune_translation, "Translation: “hello”", "hello"), (tx.finetune_translation, "x ‘ a ’ y", "a"), (tx.finetune_source, "'a'", "a"), (tx.finetune_source, "'", "'"),
        (tx.igt_class, "", "reject"), (tx.igt_class, "dog.pl see-pst 1sg", "IGT"), (tx.igt_class, "this is the text that is in the book of the year", "English"), (tx.igt_class, "fremde Wörter", "unknown"),
        (tx.tokens, "It's a-b 9, É", ["it's", "a-b", "9"]), (tx.estimated_tokens, "abcdefg", 1), (tx.n_words, "  ", 0), (tx.sentences, "One. Two! Three", ["One.", "Two!", "Three"]),
        (lambda c: tx.quoted_final(c, 2), 'x Final Output: "a" \n "b c "', "b c"), (lambda c: tx.quoted_final(c, 1), "none", None), (tx.parsed_translation, "English_Translation: hi\n```", "hi"),
        (tx.parsed_translation, "a\n b \n\n", "b"), (lambda c: tx.highlighted(c, "a.b"), "xA.By a+b", "x<mark>A.B</mark>y a+b"), (lambda c: tx.phrase_count(c, "of the"), "Of the, soft the of the", 2),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, text, f) == want


def test_grammar_marks(spark):
    got = {g: one(spark, g, lambda c: F.struct(*[v.alias(k) for k, v in tx.grammar(c).items()])).asDict() for g in ("(pl) (sg)", "1sg excl incl", "x 2sg 3sg")}
    assert got["(pl) (sg)"] == {"number": "Plur", "person": None, "possessive": None, "clusivity": None}
    assert got["1sg excl incl"] == {"number": None, "person": "1", "possessive": True, "clusivity": "Exclusive"}
    assert got["x 2sg 3sg"]["person"] == "3"


@pytest.mark.parametrize("text,want", [("", [0] * 8), ("ab é-1", [6, 2, 5 / 6, 1, 1 / 6, 1, 2.5, 0.5])])
def test_structure(spark, text, want):
    got = one(spark, text, lambda c: F.array(*tx.structure(c).values()))
    assert got == pytest.approx(want)


# layout


def book(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "book long, line_no long, text string, size double")


def test_sections_and_collapse(spark):
    rows = [("before", 10.0), ("A", 1.0), ("x", 10.0), ("B", 2.0), ("C", 2.0), ("D", 1.0), ("y", 10.0), ("E", 1.0), ("F", 2.0), ("z", 10.0), ("G", 1.0)]
    found = layout.sections(book(spark, rows), F.when(F.col("size") < 5, F.col("size").cast("int")))
    assert sorted((r.section, r.heading, r.level, r.text) for r in found.collect()) == [(1, "A", 1, "x"), (2, "B", 2, ""), (3, "C", 2, ""), (4, "D", 1, "y"), (5, "E", 1, ""), (6, "F", 2, "z"), (7, "G", 1, "")]
    got = sorted((r.section, r.heading, r.level, r.text) for r in layout.collapse_empty(found).collect())
    assert got == [(1, "A", 1, "x"), (2, "B C D", 2, "y"), (5, "E", 1, ""), (6, "F", 2, "z"), (7, "G", 1, "")]


def test_main_and_heading_sizes(spark):
    h = layout.size_histogram(book(spark, [("aa", 9.0), ("bb", 8.0), ("H", 14.0), ("I", 12.0), ("J", 12.0)]))
    assert layout.main_size(h).first().main_size == 9.0  # a tie goes to the first
    assert [(r.level, r["size"]) for r in layout.heading_sizes(h, 9.0, 0.5, 1, 1, 2).orderBy("level").collect()] == [(1, 14.0), (2, 12.0)]
    assert [r["size"] for r in layout.heading_sizes(h, 9.0, 0.5, 1, 2).collect()] == [12.0]


def test_clusters_columns_and_heights(spark):
    spans = spark.createDataFrame([(1, i, y) for i, y in enumerate([0.0, 1.0, 11.0, 21.0, 22.0, 32.0])], "k long, i long, y double")
    assert [r.cluster for r in layout.gap_clusters(spans, ["k"], "y", "i").orderBy("i").collect()] == [1, 1, 2, 3, 3, 4]
    x = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 1.004, 1.0, 5.0, 7.0])], "k long, i long, x double")
    assert [(r.position, r.n) for r in layout.column_positions(x, ["k"], "x", "i").orderBy("rank").collect()] == [(5.0, 2), (1.0, 2)]
    assert layout.merged_gaps([10, 10.2, 10.1, 3, 3, 50]) == (10, 3)
    assert layout.merged_gaps([10]) == (10, 5) and layout.merged_gaps([]) == (None, None)
    assert one(spark, "5", lambda c: layout.quantised(c.cast("double"))) == 4.0
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "k long, i long, v string")
    assert [r.f for r in layout.forward_filled(rows, ["k"], "i", "v", "f").orderBy("i").collect()] == [None, "a", "a", "b"]
    c = spark.createDataFrame([(1, 0, 0.0), (1, 1, 3.2), (1, 2, 13.2)], "k long, i long, y double")
    assert [r.continuation for r in layout.continuation(c, ["k"], "y", "i", F.lit(3.0)).orderBy("i").collect()] == [False, True, False]


# labels

S, G, T, O = "SOURCE", "GLOSS", "TRANSLATION", "OTHER"  # noqa: E741


def rewritten(spark, roles, texts=None):
    rows = spark.createDataFrame([(1, i, (texts or {}).get(i, "x"), r) for i, r in enumerate(roles)], "book long, line_no long, text string, role string")
    return [r.new_role for r in labeling.rewrite_roles(rows).orderBy("line_no").collect()]


@pytest.mark.parametrize(
    "roles,at,want",
    [
        ([O, S, O], 1, O), ([T, S, O], 1, S), ([O, S, G, T], 0, S), ([S, S, T], 1, G), ([O, S, O, T], 1, S), ([O, T, O], 1, O), ([S, T, O], 1, T), ([S, T, T], 1, G), ([G, S, S, T], 2, G),
        ([G, G, G], 1, S), ([O, G, G, S], 1, S), ([S, S, S, G], 1, G), ([O, G, T], 0, S), ([S, O, T], 1, G), ([S, G, O], 2, T), ([S, O, S], 1, G), ([T, O, T], 1, T), ([O, O, O], 1, O), ([S, G, T], 1, G),
    ],
)
def test_role_rules(spark, roles, at, want):
    assert rewritten(spark, roles)[at] == want


def test_lines_of_digits_are_other(spark):
    assert rewritten(spark, [S, G, T], {0: "12. -", 2: ""}) == [O, G, T]


def test_parallel_blocks(spark):
    def blocks(roles):
        rows = spark.createDataFrame([(1, i, f"{r[0]}{i}", r) for i, r in enumerate(roles)], "book long, line_no long, text string, role string")
        return [(r.source, r.gloss, r.translation) for r in labeling.parallel_blocks(rows).orderBy("block").collect()]

    assert blocks([S, T, S, T]) == [("S0", "", "T1"), ("S2", "", "T3")]
    assert blocks([S, G, T, O, S, O, T, T]) == [("S0", "G1", "T2")]
    assert blocks([T, T, S, T, S]) == [("S2", "", "T3")]
    assert blocks([S, G, T, T, G]) == [("S0", "G1 G4", "T2 T3")]


def test_context_and_scores(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate("ab")], "book long, line_no long, text string")
    got = labeling.context_window(rows).orderBy("line_no").select(labeling.context_text().alias("c")).collect()
    assert got[0].c == "PREV_3] [PREV_2]  [PREV]  [CURR] a [NEXT] b [NEXT_2]  [NEXT_3] "
    s = labeling.scored(rows, lambda t: {S: F.when(t == "a", 3.0).otherwise(1.0), O: F.lit(1.0)}).orderBy("line_no").collect()
    assert [(r.role, r.pred_conf, r.second) for r in s] == [(S, 0.75, O), (O, 0.5, S)]
    unsure = spark.createDataFrame([(O, 0.5, S), (O, 0.99, S), (T, 0.1, S)], "r string, c double, s string").select(labeling.confident(F.col("r"), F.col("c"), F.col("s")).alias("x"))
    assert [r.x for r in unsure.collect()] == [S, O, T]


# tags


def test_keyword_tags(spark):
    k = tagging.keyword_table(spark, {"a": ["Noun ", "noun", "of verb"], "b": ["verb"]})
    docs = spark.createDataFrame([(1, "Noun", "verb, form of verb. Verb"), (2, None, None)], "id long, h string, t string")
    got = {(r.id, r.tag): (r.body, r.heading, r.score, r.strong, r["rank"]) for r in tagging.keyword_tags(docs, "id", "h", "t", k).collect()}
    assert got == {(1, "a"): (1, 2, 5.0, True, 1), (1, "b"): (3, 0, 3.0, False, 2)}


# rules


def test_distinct_merge_and_codify(spark):
    rows = spark.createDataFrame(
        [(1, "N", "m", None, None, "c1", "app1", "d2", "t1", "N/A", 1, 1), (2, "N", "m", None, None, "c2", "app2", "d1", None, "long", 1, 2), (3, "N", "m", None, None, "c3", "app3", "d1", "t2", "more", 2, None)],
        "ord long, target_pos string, morpheme string, unimorph_feature string, unimorph_value string, category string, application_string string, description string, semantic_trigger string, context_dependency string, section_id long, paragraph_id long",
    )
    (m,) = rules.merge_rules(rows).collect()
    assert (m.category, m.description, m.semantic_trigger, m.context_dependency) == ("c2", "d1 | d2", "t1 | t2", "long AND more")
    assert [tuple(x) for x in m.section_paragraph_ids] == [(1, 1), (1, 2)]
    assert [r.ord for r in rules.distinct_on(rows, ["description"], ["ord"]).orderBy("ord").collect()] == [1, 2]
    assert rules.merge_rules(rows.where("context_dependency = 'N/A'")).first().context_dependency == "N/A"
    kept = spark.createDataFrame([("No applicable rule found.",), (" ",), (None,), ("x",)], "description string")
    assert [r.description for r in rules.with_rule(kept).collect()] == ["x"]
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rule_id long, description string")
    result = spark.createDataFrame([(1, "A", "l"), (2, None, None)], "rule_id long, description string, lrl_code string")
    assert [tuple(r) for r in rules.codify(base, result).orderBy("rule_id").collect()] == [(1, "A", "l"), (2, None, ""), (3, "c", "")]
    f = rules.first_match(base, spark.createDataFrame([(1, 5, "z"), (1, 4, "y")], "rule_id long, o long, k string"), "rule_id", "o", ["k"])
    assert [r.k for r in f.orderBy("rule_id").collect()] == ["y", "Unknown", "Unknown"]
    g = rules.tag_features(spark.createDataFrame([(1, "dog-1SG=nope.pl")], "i long, g string"), "i", "g", gloss_tags(spark))
    assert sorted((r.feature, r.value) for r in g.collect()) == [("NUMBER", "PLUR"), ("NUMBER", "SG"), ("PERSON", "1")]


# lexical


def test_matching(spark):
    assert lexical.greedy_matches("The dog=s big dog house", ["dog", "dog house", "-s", "hous", "BIG"]) == [("dog", 4), ("BIG", 10), ("dog house", 14)]
    s = spark.createDataFrame([(1, "The dog=s big dog house"), (2, "none")], "id long, text string")
    w = spark.createDataFrame([("dog",), ("dog house",), ("-s",), ("BIG",)], "word string")
    assert sorted((r.id, r.word, r.start) for r in lexical.longest_matches(s, w, "id").collect()) == [(1, "BIG", 10), (1, "dog", 4), (1, "dog house", 14)]
    m = lexical.whitespace_matches(spark.createDataFrame([(1, "Big, dog house.")], "id long, text string"), w, "id")
    assert [(r.word, r["rank"]) for r in m.orderBy("rank").collect()] == [("dog house", 1), ("big", 2), ("dog", 3)]
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (1, "=s", "p"), (1, "S", "no")], "ord long, word string, translation string")
    got = lexical.lookup_words(spark.createDataFrame([(1, "a=s b-a")], "id long, text string"), d, "id")
    assert sorted((r.word, r.translations) for r in got.collect()) == [("=s", "p"), ("a", "x; y")]
    r = spark.createDataFrame([("=ab", "N"), ("ab", "N"), ("abc", "AUX"), ("abc", None)], "w string, p string")
    assert [x.k for x in r.select(lexical.replaceable(F.col("w"), F.col("p")).alias("k")).collect()] == [False, False, False, True]


@pytest.mark.parametrize("rows,join", [(10**6, "BroadcastHashJoin"), (0, "ShuffledHashJoin")])
def test_lookup_last_equals_looking_up_each_word(spark, rows, join):
    rng = random.Random(5)
    text = lambda letters, n: "".join(rng.choices(letters, k=rng.randrange(n)))
    sentences = [(k % 50, text("ab=- \t\né\U0001f600\uffff", 30)) for k in range(90)] + [(60, None), (61, ""), (None, "a=b"), (62, " = - ")]
    entries = [(i, w, rng.choice([None, "", "x", "y; z"])) for i, w in enumerate([text("ab=-é\U0001f600\uffff", 7) for _ in range(300)] + ["=", "-", "=a", "=a", "=a", "a", "==a", "=a-b", "aaaaab", "aaaaaa", "a b", "", None, "=a b"])]
    senses = {}
    for _, w, t in entries:
        senses.setdefault(w, []).append(t)
    want = {}
    for key, s in sentences:
        tokens = re.findall(r"[^ \t\n]+", s or "")
        parts = [p for t in tokens for p in re.split("[=-]", t) if p]
        want.setdefault(key, []).extend({*tokens, *parts, *("=" + p for p in parts)} & {*senses} - {""})
    want = {(k, len(ws), w := max(ws, key=str.encode), "; ".join(t for t in senses[w][:2] if t is not None)) for k, ws in want.items() if ws}
    docs, words = spark.createDataFrame(sentences, "id long, text string"), spark.createDataFrame(entries, "ord long, word string, translation string")
    got = lexical.lookup_last(docs, words, "id", rows=rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 40
    each = lexical.lookup_words(docs, words, "id", rows=rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("word", "translations")).alias("m")).select("id", "n", "m.*")
    assert sorted(map(tuple, each.collect()), key=repr) == sorted(want, key=repr)
    plan = lexical.lookup_last(docs, words, "id", rows=rows)._jdf.queryExecution().sparkPlan().toString()
    assert join in plan and "SortMergeJoin" not in plan


def test_dictionary_lookup_does_not_sort_words_by_document(spark, tmp_path):
    spark.createDataFrame([(1, "a=s b-a"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a one, two"), (1, "=s a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["dictionary_lookup"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, 3, "b", "=s a b")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[doc_id" in plan and "SortAggregate" not in plan  # that sorts all words of a task first


# retrieval and generation


def test_top_k_ties_and_self(spark):
    items = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], None])], "item_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.item_id, r.score) for r in retrieval.top_k(q, items, 9).orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert retrieval.top_k(q.limit(0), items, 2).count() == 0
    assert retrieval.pick_boundaries([0.5, 0.1, 0.4, 0.9], 20, 10, 0) == [2, 3]
    assert retrieval.pick_boundaries([0.5, 0.1, 0.4, 0.9], 20, 10, 3) == [2] and retrieval.pick_boundaries([0.1], 5, 10) == []


def test_top_k_blocks_equal_comparing_all(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 4)), 1)
    vectors[[5, 50]] = 0
    vectors[60:70] = vectors[10]  # ties
    kinds = [None if i % 11 == 0 else "abc"[i % 3] for i in range(90)]
    items = spark.createDataFrame([(i, kinds[i], vectors[i].tolist()) for i in range(90)] + [(99, "a", None)], "item_id long, kind string, embedding array<double>")
    ids = [*range(0, 90, 3), 1000]
    q = spark.createDataFrame([(i, vectors[i % 90].tolist(), i % 2) for i in ids] + [(2000, None, 0)], "query_id long, embedding array<double>, odd long")
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)

    def want(i, k, one_a_kind):
        order = sorted((x for x in range(90) if x != i), key=lambda x: (-round(float(unit[i % 90] @ unit[x]) / 2 + (x % 2 == i % 2), 6), x))
        seen = set()
        return [x for x in order if not one_a_kind or not (kinds[x] in seen or seen.add(kinds[x]))][:k]

    def score(s, a, b):
        return s / 2 + (a["odd"].to_numpy()[:, None] == b["item_id"].to_numpy()[None, :] % 2)

    for sense in (None, "kind"):
        got = retrieval.top_k(q, items, 3, places=6, score=score, sense=sense, others_only=True, query_block=7, item_block=13).collect()
        for i in ids:
            assert [r.item_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want(i, 3, sense), (i, sense)
        assert {r.query_id for r in got} == set(ids)


def test_row_numbers_equal_sorting_each_group(spark):
    rng = np.random.default_rng(4)
    keys = rng.permutation(4000).tolist()
    rows = [(None if x % 50 == 0 else "hot" if x % 3 else f"g{x % 7}", x, "clash") for x in keys] + [("hot", None, "clash")]
    df = spark.createDataFrame(rows, "g string, i long, index string").repartition(5)
    got = {(r.g, r.i): r.n for r in ranks.row_numbers(df, "g", ["i"], "n", pieces=9).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r[1] for r in rows if r[0] == g), key=lambda i: -1 if i is None else i)
        want |= {(g, i): n for n, i in enumerate(mine)}
    assert got == want
    texts = {(r.g, r.s): r.n for r in ranks.row_numbers(df.selectExpr("g", "cast(i as string) s"), "g", ["s"], "n").where("g = 'g0'").collect()}
    assert [s for (_, s), _ in sorted(texts.items(), key=lambda x: x[1])] == sorted(s for _, s in texts)
    assert ranks.row_numbers(df.limit(0), "g", ["i"], "n").count() == 0


def test_chunks_buckets_quota(spark):
    assert generation.next_fit([9, 1, 1, 2, 5, 5], 4) == [0, 1, 1, 1, 2, 3] and generation.next_fit([4, 1], 4) == [0, 1] and generation.next_fit([], 4) == []
    rows = spark.createDataFrame([(i, "g") for i in range(21)], "i long, g string")
    b = generation.nested_buckets(rows, "g", "i").groupBy("bucket").count().collect()
    assert {r.bucket: r["count"] for r in b} == {5: 6, 10: 11, 15: 16, 20: 21}
    one_, two = (spark.createDataFrame(x, "i long, g string") for x in ([(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (5, "a"), (6, "b"), (7, "b"), (8, "c"), (9, "c"), (10, "c")]))
    got = generation.quota_backfill([one_, two], "g", "i", 3, 2).orderBy("quota_no", "i").collect()
    assert [(r.stage, r.g, r.i) for r in got] == [(0, "a", 1), (0, "a", 2), (1, "b", 6), (1, "b", 7), (1, "c", 8), (1, "c", 9)]
    assert generation.quota_backfill([one_, two], "g", "i", 0, 2).count() == 0
    assert one(spark, "x", lambda c: generation.templated("a {t} {u}", t=c)) == "a x {u}"


# responses and search


@pytest.mark.parametrize(
    "text,want",
    [
        ("x\n```yaml\nfinal_sentence: a b\nenglish_translation: c\n```\nbye", ("a b", "c")), ("Final sentence: **s**\nEnglish translation:\n t ", ("s", "t")), ("nothing", ("", "")), (None, ("", "")),
        ("source: a [note]\ntranslation: b Rule #3", ("a", "b")), ("final sentence: " + "because the rule " * 9, ("", "")),
    ],
)
def test_final_answer(text, want):
    assert responses.final_answer(text) == want


def test_yaml_rows_and_lines(spark):
    assert responses.yaml_rows("```yaml\n- a: 1\n  b: [y, x]\n- c\n```", ("a", "b")) == [{"a": "1", "b": "x, y"}]
    assert responses.yaml_rows("a: [", ("a",)) == []
    got = responses.extracted_rules(spark.createDataFrame([("k", "a: 1\n---\na: 2")], "key string, text string"), ("a", "b")).orderBy("ord").collect()
    assert [(r.key, r.ord, r.a, r.b) for r in got] == [("k", 0, "1", None), ("k", 1, "2", None)]
    assert one(spark, "x\nsource: s\n translation: t: u", lambda c: F.struct(*responses.last_two_lines(c))) == ("s", "t: u")
    assert one(spark, "one", lambda c: responses.last_two_lines(c)[0]) is None
    assert one(spark, "source: a\nSource: b", lambda c: responses.last_labelled(c, "source")) == "b"


def test_search(spark):
    rows = spark.createDataFrame([("b", 1, "The C++ [x]", None), ("a", 2, "c++", "C++"), ("a", 1, "none", "")], "book string, idx long, s string, t string")
    got = search.ranked(search.exact_hits(rows, " c++ ", ["s", "t"]), "book", "idx").collect()
    assert [(r.book, r.idx, r.matched_in) for r in got] == [("a", 2, "s, t"), ("b", 1, "s")]
    assert search.partial_ratio("abc", "xxABCxx") == 100 and search.partial_ratio("", "x") == 0 and 60 < search.partial_ratio("abcd", "zzabxdzz") < 90
    assert [r.idx for r in search.fuzzy_hits(rows, "nane", ["s", "t"], 75.0).collect()] == [1]
    assert search.entry_matches(rows, "X]", "s", "t").count() == 1


def brute_partial_ratio(a, b):
    """Every window, each with the plain table of the longest common subsequence."""

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, e in enumerate(y):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(x) + len(y))

    a, b = sorted((a.casefold(), b.casefold()), key=len)
    m = len(a)
    ratios = [ratio(a, b[max(0, i) : i + m]) for i in range(1 - m, len(b))]
    return max([*ratios, *([ratio(b, a[max(0, i) : i + m]) for i in range(1 - m, m)] if len(b) == m else [])])


def test_partial_ratio_scores_every_window():
    rng = random.Random(6)
    lengths = [(1, 1), (1, 9), (7, 7), (11, 60), (16, 40), (17, 50), (32, 40), (33, 70), (64, 90), (65, 100), (130, 150)]
    for m, n in lengths * 4:
        a, b = ("".join(rng.choices("abcé 😀"[: rng.randint(2, 6)], k=k)) for k in (m, n))
        assert search.partial_ratio(a, b) == pytest.approx(brute_partial_ratio(a, b)), (a, b)
    text = "the cat ran; for an hour the dog sand fox " * 1000 + "x" * 20000 + "the amd for"
    assert search.partial_ratio("the and for", text) == pytest.approx(100 * 10 / 11)


def test_fuzzy_search_covers_documents_and_benchmark(spark, tmp_path):
    words = "the and for then lands fort he an or zzz qqq xxx".split()
    rng = random.Random(7)
    texts = {name: [(i, " ".join(rng.choices(words[: rng.choice([3, 9, 12])], k=rng.randint(1, 12)))) for i in range(20)] + [(99, None)] for name in ("benchmark", "documents")}
    for name, idx in (("benchmark", "item_id"), ("documents", "doc_id")):
        spark.createDataFrame(texts[name], f"{idx} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.book, r.item_id): r.score for r in queries.queries()["corpus_search_fuzzy"](spark, str(tmp_path)).collect()}
    scores = {(name, i): brute_partial_ratio("the and for", t) for name, rows in texts.items() for i, t in rows if t}
    assert got == pytest.approx({k: v for k, v in scores.items() if v >= 60}, abs=1e-5)


# metrics and statistics


def test_metrics(spark):
    rows = [("same", 1, "the cat sat on the mat", "the cat sat on the mat"), ("none", 2, "a b c d e", "v w x y z"), ("edit", 3, "the cat sat on a mat", "the cat sat on the mat"), ("edit", 4, None, "x"), ("edit", 5, "y", "")]
    got = {r.k: r for r in metrics.corpus_scores(spark.createDataFrame(rows, "k string, id long, hypothesis string, reference string"), ["k"]).collect()}
    assert (got["same"].BLEU, got["same"].ChrF, got["same"].ChrFpp) == (100, 100, 100)
    assert (got["none"].BLEU, got["none"].ChrF) == (0, 0)
    want = 100 * math.exp(sum(map(math.log, (5 / 6, 3 / 5, 2 / 4, 1 / 3))) / 4)
    assert got["edit"].BLEU == pytest.approx(want, abs=0.01) and (got["edit"].n_evaluated, got["edit"].n_skipped) == (1, 2)
    assert metrics.bleu([3, 1, 0, 0], [4, 3, 2, 1], 5) == pytest.approx(100 * math.exp(1 - 5 / 4) * (3 / 4 * 1 / 3 * 1 / 4 * 1 / 4) ** 0.25)
    assert metrics.tokens_13a("Hi, 1,000.5 ok.") == ["Hi", ",", "1,000.5", "ok", "."]


def test_statistics(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)], "g string, v long")
    r = stats.box_statistics(rows, "g", "v").first()
    assert (r.q1, r.median, r.q3, r.low, r.high, r.outliers) == (2, 3, 4, 1, 4, 1)
    c = spark.createDataFrame([("a", "N"), ("a", None), ("b", "V"), ("b", "N")], "g string, p string")
    assert sorted((r.g, r.p, r.n, r.percent) for r in stats.class_shares(c, "g", "p").collect()) == [("a", "N", 1, 50.0), ("b", "N", 1, 50.0), ("b", "V", 1, 50.0)]


# files and ledgers


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "x_parallel_sentences_cleaned.json").write_text('﻿{"sentences": [{"source": "a", "gloss": null,},]}', encoding="utf-8")
    (tmp_path / "y_cleaned.json").write_text('[{"source": "b"}, {"source": "c"}]')
    got = readers.envelope_or_list(spark, str(tmp_path), "source: string, gloss: string").select(readers.book_of(F.col("file")).alias("b"), "ord", "source").orderBy("b", "ord").collect()
    assert [tuple(r) for r in got] == [("x", 0, "a"), ("y", 0, "b"), ("y", 1, "c")]
    (tmp_path / "l.jsonl").write_text('{"a": 1,}\n\n{"a": "2"}\n')
    assert [r.a for r in readers.tolerant_jsonl(spark, str(tmp_path / "l.jsonl"), "a string").collect()] == ["1", "2"]
    (tmp_path / "d.csv").write_text("page,line_idx,continuation,col1,col2\n1,2,True,a,b\n1,3\n")
    assert [tuple(r) for r in readers.dictionary_csv(spark, str(tmp_path / "d.csv")).collect()] == [(1, 2, True, "a", "b")]
    (tmp_path / "t.tsv").write_text("file\tstatus\nf\told\ng\tx\nf\tnew\n")
    assert sorted((r.file, r.status) for r in readers.tsv_log(spark, str(tmp_path / "t.tsv")).collect()) == [("f", "new"), ("g", "x")]
    assert readers.or_empty(lambda: spark.read.parquet(str(tmp_path / "missing")), spark, "a long").count() == 0
    rows = spark.createDataFrame([("g", i, f"s{i}", "t\nu") for i in range(5)], "g string, i long, s string, t string")
    sinks.in_parts(rows, str(tmp_path / "parts"), "g", "i", 2)
    assert sorted((r.part, r["count"]) for r in spark.read.json(str(tmp_path / "parts")).groupBy("part").count().collect()) == [(0, 2), (1, 2), (2, 1)]
    sinks.aligned_text(rows, str(tmp_path / "aligned"), "s", "t", "i")
    assert spark.read.text(str(tmp_path / "aligned/t")).count() == 5 and sinks.is_complete(spark, str(tmp_path / "aligned/t")) and not sinks.is_complete(spark, str(tmp_path))
    assert readers.Config.of({"target_words": 9, "other": 1}).target_words == 9
    roles = spark.createDataFrame([("a_train.jsonl",), ("train_baseline.jsonl",), ("x_test.jsonl",), ("z",)], "f string").select(readers.role_of(F.col("f")).alias("r"))
    assert [r.r for r in roles.collect()] == ["train", "train_baseline", "test", "other"]


def test_ledger(spark):
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "completed"), ("b", 1, "in_progress")], "key string, at long, status string")
    got = ledger.latest(log, "key", "at").select("key", ledger.next_step(F.col("status")).alias("s")).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", "download"), ("b", "wait")]
    requests = spark.createDataFrame([("a", "p"), ("b", "q")], "key string, prompt string")
    left = ledger.remaining(requests, ledger.latest(log, "key", "at"), "key")
    assert [r.response for r in ledger.run_batches(left, ledger.echo).collect()] == ["english_translation: q"]
    assert [r.response for r in ledger.run_batches(left, None).collect()] == [""]
    assert sinks.upserted(log, spark.createDataFrame([("b", 9, "completed")], log.schema), "key", "at").where("status = 'completed'").count() == 2


# books and morphology


def test_paragraphs_and_books(spark):
    assert one(spark, "a|long example text here|s|mm|z", lambda c: books.trimmed_examples(c)) == "as | mmz"
    assert one(spark, "a|b|z", lambda c: books.trimmed_examples(c)) == "a|b|z"
    c = spark.createDataFrame([("q", 1, 0, "long text here"), ("q", 1, 1, "x"), ("q", 2, 0, "x"), ("q", 3, 0, "y")], "q string, r long, ref_no long, text string")
    assert [(r["rank"], r.text) for r in books.best_paragraphs(c, "q", "r", 2).orderBy("rank").collect()] == [(1, "x"), (2, "y")]
    p = spark.createDataFrame([(1, 1, "H", 1, 0, "p"), (1, 1, "H", 1, 1, "q"), (1, 2, "", 1, 0, "r"), (1, 3, "E", 0, None, None)], "book long, section long, heading string, level int, index int, text string")
    assert books.book_text(p).first().text == "## H\np\nq\nr\n# E"
    rows = spark.createDataFrame([(1, i, a, b, i > 0) for i, (a, b) in enumerate([(None, "x"), ("a", "b"), ("", "y"), ("c", "d"), (None, "e"), (None, "f")])], "page long, i long, a string, b string, continuation boolean")
    assert [r.i for r in books.between_full_rows(rows, "page", "i", ["a", "b"]).orderBy("i").collect()] == [1, 2, 3, 4]
    assert books.dictionary_pages(rows, "page", ["a", "b"], 5, 50, 2).count() == 1 and books.dictionary_pages(rows, "page", ["a", "b"]).count() == 0
    assert books.averaged_rows([0, 1.5, 3.5, 3.0]) == [0, 0, 1, 1]
    lines = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate([("no", 0.0), ("(1) a", 5.0), ("b", 5.0), ("out", 1.0), ("c", 5.0), ("(2) d", 5.0)])], "book long, i long, text string, x double")
    assert [(r.span, r.text) for r in books.marked_spans(lines, "book", "i").orderBy("i").collect()] == [(1, "(1) a"), (1, "b"), (2, "(2) d")]
    r = spark.createDataFrame([(1, "Plural of"), (2, "Plural of"), (3, "the dative"), (4, "none")], "ord long, description string")
    assert [x.ord for x in books.rules_for(r, number="Plur", case="Dat").collect()] == [1, 3] and books.rules_for(r).count() == 0
    assert books.bullets(r, "description", "description", "ord").where("description = 'Plural of'").first().bullets == "- Plural of\n- Plural of"


def test_morphology(spark):
    tokens = [("Dogs", "dog", "NOUN", "N", {"Number": "Plur", "Gender": "Masc"}), ("ran", "run", "VERB", "V", {"Tense": "Past"}), ("cats", "cat", "NOUN", "N", {"Number": "Plur"}), ("x", "dog", "PROPN", "N", {})]
    df = spark.createDataFrame([(tokens,)], f"t {morphology.TOKENS}")
    got = df.select(*[c.alias(k) for k, c in morphology.summary(F.col("t")).items()], morphology.shown(F.col("t")).alias("s"), morphology.pos_of_gloss(F.col("t"), F.lit(" DOG "), "X").alias("p"), morphology.pos_of_gloss(F.col("t"), F.lit("no"), "X").alias("d")).first()
    assert (got.tense, got.number, got.plural_word, got.genders, got.p, got.d) == ("Past", "Plur", "cats", ["Masc"], "NOUN", "X")
    assert got.s.split("\n")[1] == "- run: {}"
    assert one(spark, "dog", lambda c: morphology.gloss_of(c, F.lit("The DOGS run"), F.lit("the dog.PL run"))) == "dog.PL"
    assert one(spark, "dog", lambda c: morphology.gloss_of(c, F.lit("dog"), F.lit(""))) == ""
    assert one(spark, "dog.PL=x", morphology.base_of) == "dog"


def test_collapse_takes_in_a_section_of_the_same_level(spark):
    rows = [("A", 1.0), ("B", 1.0), ("body", 10.0), ("C", 1.0), ("D", 2.0), ("x", 10.0)]
    found = layout.sections(book(spark, rows), F.when(F.col("size") < 5, F.col("size").cast("int")))
    got = sorted((r.section, r.heading, r.level, r.text) for r in layout.collapse_empty(found).collect())
    assert got == [(1, "A B", 1, "body"), (3, "C", 1, ""), (4, "D", 2, "x")]


def test_merged_gaps_join_in_order_of_sight_below_the_width():
    assert layout.merged_gaps([12, 12.5, 12]) == (12.5, 12)
    assert layout.merged_gaps([12.4, 12, 12.6, 5, 5, 5]) == (12.4, 5)


def test_visual_lines_and_most_common(spark):
    rows = [(1, 0, 9.0, 0.0, 10.0, "f", 8.0, "b"), (1, 1, 1.0, 3.9, 14.0, "f", 8.0, "a"), (1, 2, 5.0, 8.0, 18.0, "g", 9.0, "long word"), (1, 3, 6.0, 8.5, 18.0, "f", 8.0, " ")]
    spans = spark.createDataFrame(rows, "page long, i long, x0 double, y0 double, y1 double, font string, size double, text string")
    got = layout.visual_lines(spans, ["page"], "i").orderBy("line").collect()
    assert [(r.n, r.text, r.x0, r.common_size) for r in got] == [(2, "a b", 1.0, 8.0), (2, "long word", 5.0, 9.0)]
    assert layout.most_common(spans, ["page"], "font", "i").first().font == "f"


def test_fallback_answers_keep_translations_and_guard_sources():
    long = "the river should flow because " * 5
    assert responses.final_answer(f"Final output: s t\ntranslation: {long}") == ("s t", long.strip())
    assert responses.final_answer(f"source: {long}\nresult: u") == ("u", "")
    assert responses.final_answer("source: the original sentence\nfinal fragment: v") == ("v", "")


def test_first_items_ties_come_in_file_order(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    for n, copies in enumerate((1, 9)):  # Spark reads the larger file, here the second, before the other
        rows = spark.range(300).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(20.0).alias("l_quantity"), F.lit(str(n)).alias("l_returnflag"), F.explode(F.array(*[F.lit(f"{c}") for c in range(copies)])).alias("l_linestatus"))
        rows.toPandas().to_parquet(tmp_path / f"part-{n}.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(2):
        (tmp_path / f"part-{n}.parquet").rename(tmp_path / "lineitem.parquet" / f"part-{n}.parquet")
    got = queries.first_items(spark, str(tmp_path)).collect()
    assert len(got) == 300 and all((r.l_returnflag, r.l_linestatus) == ("0", "0") for r in got)


def test_answers_are_parsed_in_small_batches(spark):
    got = responses.final_answers(spark.createDataFrame([(1, "source: a\ntranslation: b"), (2, None)], "id long, text string"))
    assert [tuple(r) for r in got.orderBy("id").select("source", "translation").collect()] == [("a", "b"), ("", "")]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()  # a batch of Arrow takes 10,000 texts of any length


def test_line_heights_fold_many_keys_in_a_batch(spark):
    nan = float("nan")
    rows = [(1, 0.0), (1, -0.0), (1, 10.0), (1, 13.0), (1, 13.0), (1, None), (1, nan), (2, 4.0), (3, None), (4, 1.0), (4, 11.0), (None, 2.0)]
    got = layout.line_heights(spark.createDataFrame([(k, y, i) for i, (k, y) in enumerate(rows)], "k long, y double, i long"), "k", "y", "i")
    assert {r.k: (r.normal, r.continuation) for r in got.collect()} == {1: (10.0, 3.0), 2: (None, None), 3: (None, None), 4: (10.0, 5.0), None: (None, None)}
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # one call of Python a key


def test_top_k_holds_few_scores_at_a_time(spark):
    def score(similarity, q, i):
        assert similarity.size <= retrieval.SCORES
        return similarity

    items = spark.range(5000).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.col("id") % 7).alias("embedding"))
    got = retrieval.top_k(items.where("item_id < 200").withColumnRenamed("item_id", "query_id"), items, 2, score=score).collect()
    assert len(got) == 400 and {(r.query_id % 7, r.item_id) for r in got if r.rank == 1} == {(k, k) for k in range(7)}


def test_visual_lines_deal_the_spans_once(spark, monkeypatch):
    monkeypatch.setattr(layout, "SPANS", 10)
    rows = [(p, i, float(i), float(i // 2 * 9), float(i // 2 * 9 + 4), f"f{i % 2}", 1.0 + i % 2, "ab" if i % 2 else "c") for p in range(50) for i in range(4)] + [(None, 0, 0.0, 0.0, 1.0, "f", 1.0, "x")]
    got = layout.visual_lines(spark.createDataFrame(rows, "page long, i long, x0 double, y0 double, y1 double, font string, size double, text string"), ["page"], "i")
    assert got.rdd.getNumPartitions() == 21 and len(got.collect()) == 100
    assert all((r.n, r.text, r.common_size) == (2, "c ab", 2.0) for r in got.collect())
