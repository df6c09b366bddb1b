"""The stages of the pipeline on small tables with null and repeated ids."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)


def kept(rows):
    return sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_near_dedup_of_null_and_repeated_ids(spark):
    a, b, c, d, e, f = map(words, "abcdef")
    rows = [(5, a), (None, a + " x"), (None, b), (None, c), (None, c + " x"), (3, d), (3, d + " x"), (3, e), (2, e + " x"), (9, f), (9, None), (-4, "")]
    got = kept(corpus_pipeline.near_dedup(spark, docs_of(spark, rows), ""))
    # of c and of d either row may stay, as ids do not tell them apart
    plain = [x for x in got if (x[1] or "")[:1] not in ("c", "d")]
    assert plain == sorted([(5, a), (None, b), (2, e + " x"), (9, f), (9, None), (-4, "")], key=repr)
    assert [x[0] for x in got if (x[1] or "").startswith("c")] == [None] and [x[0] for x in got if (x[1] or "").startswith("d")] == [3]
    assert corpus_pipeline.near_dedup(spark, docs_of(spark, rows).limit(0), "").count() == 0


def test_exact_dedup_keeps_one_row_of_equal_texts(spark):
    rows = [(7, "b"), (7, "b"), (7, " b"), (None, "c"), (None, "c "), (None, "d"), (None, "d"), (4, "d"), (8, "e"), (8, "f"), (1, "f"), (None, None), (None, " "), (2**63 - 1, "g"), (None, "g"), (6, "h")]
    got = kept(corpus_pipeline.exact_dedup(spark, docs_of(spark, rows), ""))
    assert [x for x in got if x[1] != "g"] == sorted([(7, " b"), (None, "c "), (4, "d"), (8, "e"), (1, "f"), (None, " "), (6, "h")], key=repr)
    assert [x[1] for x in got].count("g") == 1
    assert corpus_pipeline.exact_dedup(spark, docs_of(spark, rows).limit(0), "").count() == 0


def alone(spark, rows):
    """Documents with a clashing column."""
    return docs_of(spark, rows).withColumnRenamed("n_chars", "_row")


def test_quality_keeps_what_the_model_accepts(spark, tmp_path):
    good, bad = [(i, "good plain words here. " * 9 + str(i)) for i in range(60)], [(100 + i, "b@d$$ w&&rds** " * 9 + str(i)) for i in range(60)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(0, 1, 0), (None, 1, 0), (7, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = good + bad + [(3, good[3][1]), (None, good[4][1]), (None, bad[4][1]), (None, "good plain words here. " * 30_000)]
    docs = alone(spark, rows)
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert kept(got) == sorted([r for r in rows if not (r[1] or "").startswith("b@d")], key=repr)
    assert corpus_pipeline.quality(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mixture_takes_rows_by_whole_passes_and_a_rest(spark):
    rows = [(i // 2 if i < 20 else None, words(f"w{i}_", 5)) for i in range(40)] + [(90, None), (91, "")]
    docs = alone(spark, rows)
    got = corpus_pipeline.mixture(spark, docs, "")
    assert got.columns == docs.columns
    taken = [r.text for r in got.collect()]
    # one source: 150 per cent of 200 words, so every row once and half of them twice
    counts = [taken.count(t) for _, t in rows[:40]]
    assert sum(5 * c for c in counts) == 300 and set(counts) == {1, 2}
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_packing_keeps_every_word(spark):
    rows = [(1, words("a", 5000)), (None, words("b", 3)), (1, words("a", 2)), (2, None), (3, " ")]
    got = corpus_pipeline.packing(spark, alone(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.piece, r.n_tokens) for r in got), key=repr) == sorted([(1, 0, 4096), (1, 1, 904), (None, 0, 3), (1, 0, 2)], key=repr)


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    """run() against plain Python: what stays of copies, how often it is taken, and that every word taken is packed."""
    base = [words(f"t{i}_", 30 + i) for i in range(24)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " more") for i, t in enumerate(base[:6])] + [(200 + i, f" {t}") for i, t in enumerate(base[6:9])] + [(None, base[9]), (5, base[10])]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # t6 to t8 stay as the longer text, with a blank before; t10 as its smallest id
    ids = {i: i for i in range(24)} | {6 + i: 200 + i for i in range(3)} | {10: 5}
    size = {}
    for n, i in ids.items():
        size.setdefault(i, []).append(30 + n)
    packed = {}
    for r in found:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert set(packed) == set(size)
    for i, sizes in size.items():
        assert packed[i] in {a * x + b * y for x in (1, 2) for y in ((1, 2) if len(sizes) == 2 else (0,)) for a, b in [(sizes * 2)[:2]]}
    total = sum(30 + n for n in range(24))
    assert abs(sum(packed.values()) - 1.5 * total) <= 54
