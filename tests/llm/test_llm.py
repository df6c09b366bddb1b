"""The training-data operators against brute force, on small tables with nulls, blanks, ties and repeated rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_pairs, exact_dedup, fingerprints, html_text, license_scan, mixing, ngram_join, packing, quality_gam, url_filters
from textloom.llm.components import components

DOCS = "doc_id long, text string, source string, id string, n int, token string"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, (sources or {}).get(i, "s"), "x", 5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# exact dedup


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a b", "ab", "a\tb ", " ab\n", "c d", "cd", "é f", None, "", "  "]) for _ in range(60)] + ["x" * 20000, "x " * 20000]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs_of(spark, texts), salts=3).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for i, t in enumerate(texts):
        group = [j for j in range(len(texts)) if norm[j] == norm[i]]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        want = (keep, len(group), keep == i, hashlib.sha256(norm[i].encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want
    kept = exact_dedup.drop_copies(docs_of(spark, texts), salts=3)
    assert kept.columns == docs_of(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, "a", "s", "", 0, ""), (4, "a", "s", "", 0, ""), (7, "b", "s", "", 0, ""), (7, "b", "s", "", 0, "")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(None, 4, 2, False), (4, 4, 2, True), (7, 7, 2, True), (7, 7, 2, True)], key=repr)


# n-gram Jaccard join


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sets, comp


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 60)])
def test_near_components_match_brute_force(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(25)]
    texts = [None, "", " \n", "One", "one", "Two words", "two words", "É x y z"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 7)):  # near copies, chains of them, and exact copies
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 60))]) for _ in range(15)]  # one shared passage
    sets, comp = brute_components(texts, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs_of(spark, texts), k, percent).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_near_components_of_nothing(spark):
    assert ngram_join.near_components(empty(spark)).count() == 0
    got = ngram_join.near_components(docs_of(spark, [None, ""])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 0, 0), (1, 0, 1)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 100), (60, 50), (50, 60)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50}


# packing


def test_bucket_bounds_have_least_padding():
    rng = random.Random(3)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 9))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

        got = packing.bucket_bounds(lengths, counts, k)
        assert len(got) <= k and got[-1] == max(lengths)
        best = min(padding([*b, max(lengths)]) for n in range(k) for b in itertools.combinations(sorted(lengths)[:-1], n))
        assert padding(got) == best
    assert packing.bucket_bounds([], [], 4) == []


def test_pack_keeps_every_word_and_the_budget(spark):
    rng = random.Random(5)
    texts = [None, "", " "] + ["w " * rng.choice([1, 2, 3, 9, 10, 11, 25, 33]) for _ in range(80)] + ["long " * 1005]
    rows = packing.pack(docs_of(spark, texts), max_len=10, buckets=3, budget=40, salts=4).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.piece, r.start, r.n_tokens) for r in rows if r.doc_id == i)
        n = len((t or "").split())
        assert [m[0] for m in mine] == list(range(-(-n // 10))) and sum(m[2] for m in mine) == n
        assert all(m[1] == 10 * m[0] and 0 < m[2] <= 10 for m in mine)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 40
        if (bucket, batch + 1) in batches:
            assert len(slots) == 40 // bucket
    assert packing.pack(empty(spark)).count() == 0
    again = packing.pack(docs_of(spark, texts).repartition(7), max_len=10, buckets=3, budget=40, salts=4).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


# mixing


def test_weighted_targets():
    assert mixing.weighted_targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    got = mixing.weighted_targets([10, 1000, 0, 5], [3, 1, 2, 3])
    assert got[0] == 20 and got[2] == 0 and got[3] == 10 and sum(got) == pytest.approx(1.5 * 1015)
    assert mixing.weighted_targets([], []) == []


def test_route_is_a_largest_flow_of_least_cost():
    rng = random.Random(9)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        members = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        capacity = [rng.randint(0, 3) for _ in range(n)]
        quotas = [rng.randint(0, 4) for _ in range(m)]

        def cost(totals):
            return sum(max(0, t - c) for t, c in zip(totals, capacity, strict=True))

        flow = mixing.route(capacity, members, quotas)
        totals = [sum(f.values()) for f in flow]
        assert all(v >= 0 for f in flow for v in f.values()) and all(t <= 2 * c for t, c in zip(totals, capacity, strict=True))
        assert all(sum(f.get(s, 0) for f in flow) <= quotas[s] for s in range(m))
        best = (0, 0)
        options = [[x for x in itertools.product(*[range(quotas[s] + 1) for s in members[p]]) if sum(x) <= 2 * capacity[p]] for p in range(n)]
        for pick in itertools.product(*options):
            given = [sum(x[members[p].index(s)] for p, x in enumerate(pick) if s in members[p]) for s in range(m)]
            if all(g <= q for g, q in zip(given, quotas, strict=True)):
                best = max(best, (sum(map(sum, pick)), -cost([sum(x) for x in pick])))
        assert (sum(totals), -cost(totals)) == best


def test_taken_words_come_near_their_targets(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randint(0, 60) for _ in range(900)] + [None]
    sources = {i: rng.choice(["a", "a", "a", "b", "ü", "Z", None]) for i in range(901)}
    docs = docs_of(spark, texts, sources)
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == 901
    order = sorted({s for s in sources.values() if s}) + [None]
    sizes = [sum(len((t or "").split()) for i, t in enumerate(texts) if sources[i] == s) for s in order]
    targets = mixing.weighted_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken <= 2 * r.size and r.taken == r.repeats * r.size
        assert r.source_size == sizes[order.index(s)] and r.target == pytest.approx(targets[order.index(s)])
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, targets, strict=True))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(docs.repartition(5)).collect()))
    assert mixing.taken_words(empty(spark)).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"], 10) for i in range(60)] + [(99, [], 10)]
    docs = spark.createDataFrame(rows, "doc_id long, tags array<string>, size long")
    got, plan = mixing.mix(docs, lambda names, sizes: [300.0, 250.0], sources=F.col("tags"), zone_docs=5)
    assert [(p["name"], p["size"], p["taken"]) for p in plan] == [("a", 400, 300), ("b", 400, 250)]
    rows = got.collect()
    assert len(rows) == 61 and sum(r.repeats * r.size for r in rows) == 550 and max(r.repeats for r in rows) == 1
    assert [r.repeats for r in rows if r.id == 99] == [0]


# url filters


def page(links=()):
    return "<p>" + "".join(f'<a href="{x}">x</a>' for x in links)


def test_url_rules_and_hosts(spark):
    urls = {1: "https://A.Example.NET/en/1?x=/de/", 2: "http://example.net/de/", 3: "http://xexample.com/de/1", 4: "http://b.example.com/de/?q", 5: "ftp://z.org/fr/a#b", 6: None, 7: "no scheme", 8: "http://n.net?x/", 9: "x://h://y/z"}
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in urls.items()], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"), 3: ("xexample.com", "/de/1", None, "allow"),
        4: ("b.example.com", "/de/", "example.com/de/", "block"), 5: ("z.org", "/fr/a", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("n.net", "", None, "allow"), 9: ("h:", "//y/z", None, "allow"),
    }
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_distrust_flows_against_links_and_trust_along_them(spark):
    rows = [
        ("http://spam.net/x", ["http://other.com/"]), ("http://good.org/fr/1", ["http://friend.com/a", "//both.com"]),
        ("http://farm.com/1", ["http://SPAM.net/x", "/local"]), ("http://far.com/1", ["http://farm.com/"]),
        ("http://friend.com/1", []), ("http://both.com/1", ["http://spam.net/"]), ("http://other.com/1", []), ("http://alone.com/1", ["http://alone.com/2"]),
    ]
    pages = spark.createDataFrame([(i, u, page(x)) for i, (u, x) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filters.filter_urls(pages).collect()}
    # a plain iteration on a dictionary
    hosts = [re.match(r"\w+://([^/]*)", u)[1] for u, _ in rows]
    edges = {}
    for h, (_, links) in zip(hosts, rows, strict=True):
        for x in links:
            m = re.match(r"(?:https?:)?//([^/]*)", x)
            if m and m[1].lower() != h:
                edges[h, m[1].lower()] = edges.get((h, m[1].lower()), 0) + 1
    t0, d0 = {"good.org": 1.0}, {"spam.net": 1.0}
    t, d = dict(t0), dict(d0)
    for _ in range(url_filters.ROUNDS):
        nt, nd = dict(t0), dict(d0)
        for (a, b), w in edges.items():
            nt[b] = nt.get(b, 0) + 0.85 * t.get(a, 0) * w / sum(v for (x, _), v in edges.items() if x == a)
            nd[a] = nd.get(a, 0) + 0.85 * d.get(b, 0) * w / sum(v for (_, y), v in edges.items() if y == b)
        t, d = nt, nd
    for h in hosts:
        assert got[h].trust == pytest.approx(t.get(h, 0), abs=2e-6) and got[h].distrust == pytest.approx(d.get(h, 0), abs=2e-6)
        if got[h].rule is None:
            assert got[h].verdict == ("block" if d.get(h, 0) > t.get(h, 0) + 1e-6 else "allow")
    assert got["farm.com"].verdict == "block" and got["far.com"].verdict == "block" and got["friend.com"].verdict == "allow"


def test_ranks_go_on_until_they_have_converged(spark):
    chain = [("http://spam.net/x", [])] + [(f"http://h{i}.com/", [f"http://h{i - 1}.com/" if i > 1 else "http://spam.net/x"]) for i in range(1, 15)]
    pages = spark.createDataFrame([(i, u, page(x)) for i, (u, x) in enumerate(chain)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filters.filter_urls(pages).collect()}
    for i in range(1, 15):
        assert got[f"h{i}.com"].distrust == pytest.approx(0.85**i, abs=2e-6) and got[f"h{i}.com"].verdict == "block"


def test_ranks_of_cycles_solve_their_equations(spark):
    links = {"spam.net": ["a.com"], "good.org/fr": ["a.com", "b.com"], "a.com": ["b.com", "spam.net"], "b.com": ["c.com", "a.com"], "c.com": ["a.com"], "d.com": ["c.com", "d.com"]}
    pages = spark.createDataFrame([(i, f"http://{u}/", page([f"http://{x}/" for x in links[u]])) for i, u in enumerate(links)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filters.host_ranks(url_filters.judged(pages), pages, damping=0.5).collect()}
    hosts = [u.split("/")[0] for u in links]
    w = np.array([[float(a != b and b in links[u]) for b in hosts] for a, u in zip(hosts, links, strict=True)])
    forth = w / np.maximum(w.sum(1, keepdims=True), 1)
    back = w / np.maximum(w.sum(0, keepdims=True), 1)
    trust = np.linalg.solve(np.eye(6) - 0.5 * forth.T, [float(h == "good.org") for h in hosts])
    distrust = np.linalg.solve(np.eye(6) - 0.5 * back, [float(h == "spam.net") for h in hosts])
    for h, t, d in zip(hosts, trust, distrust, strict=True):
        assert (got[h].trust if h in got else 0) == pytest.approx(t, abs=1.1e-6) and (got[h].distrust if h in got else 0) == pytest.approx(d, abs=1.1e-6)


# license scans


def test_license_join_equals_comparing_all(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + [f"x{i}" for i in range(30)]
    lines = [" ".join(rng.sample(t.split(), rng.randint(1, len(t.split()))) + rng.sample(vocabulary, rng.randint(0, 5))) for _, t in license_scan.TEMPLATES for _ in range(12)]
    texts = [None, "", "cc by CC-BY mit\nlicense", "The GNU General\n Public License, v3. gnu general public license"] + ["\n".join(rng.sample(lines, rng.randint(1, 6))).upper() for _ in range(60)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(at, label) for p, label in license_scan.PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        met = set()
        shares = [0.0]
        for line in low.split("\n"):
            block = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for label, template in license_scan.TEMPLATES:
                s = set(template.split())
                if 100 * len(s & block) >= license_scan.PERCENT * len(s):
                    met.add(label)
                    shares.append(len(s & block) / len(s))
        r = got[i]
        starts = [at for at, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and r.labels == ",".join(sorted({x for _, x in places} | met))
        assert r.score == pytest.approx(1.0 if places else max(shares))
    assert license_scan.scan_licenses(empty(spark)).count() == 0


# main text


def test_main_text_leaves_out_the_frame():
    p = (
        '<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><a href="/">Site</a> name</header><nav><ul><li><a href=x>Menu</a><li>b</ul></nav>'
        '<div class="cookie-notice">We use cookies on this site and hope that you like them very much indeed.</div><!-- no --><script>var t="</p>no";</script>'
        "<article><h1>Title &amp; more</h1><p><b>First\n\n part<br><p>Second &#233;&nbsp;x</p><aside>Aside no</aside><ul><li>Item</li></ul>"
        '<form><label>Mail</label><input><textarea>no</textarea><button>Go</button></form><p>Last <a href="y">link</a>.</p></article>'
        '<section class="comments"><p>A reader says a lot of things here, far more than sixteen words, all of them about the article that stands above.</p></section>'
        '<div id="sidebar"><p>Side text</p></div><footer>&copy; foot</footer>'
    )
    assert html_text.main_text(p) == "Title & more First part Second é x Item Last link ."[:-2] + "."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""


def test_main_text_without_an_article_element():
    body = "This paragraph has quite a few words, so that it can only be the running text of the page, and it goes on for a while."
    p = f'<div class="menu"><a href=a>One</a> <a href=b>Two</a></div><div><a href=a>Home</a><p>{body}</p><p>{body}</p></div><div class="footer">Legal words of the footer</div>'
    assert html_text.main_text(p) == f"{body} {body}"


def test_main_text_inside_a_wrapper():
    body = "This paragraph has quite a few words, so that it can only be the running text of the page, and it goes on for a while."
    article = f"<article><h1>Title</h1><p>{body}</p><aside>Aside no</aside></article>"
    for start, end in (("<form id=aspnetForm>", "</form>"), ("<div class='sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='has-sidebar comments-open'>", "</div>"), ("<div>", "</div>")):
        frame = "<nav><a href=x>Menu</a></nav><div class=ad>Buy this</div><footer>Legal words</footer>"
        assert html_text.main_text(f"<body>{start}{article}{frame}{end}") == f"Title {body}"
        assert html_text.main_text(f"<body>{start}<div><p>{body}</p><p>{body}</p></div>{frame}{end}") == f"{body} {body}"
    # frames inside the article, and articles named as boilerplate inside a frame, are left out
    assert html_text.main_text(f'<main><p>{body}</p><div class="comments"><article class="comment"><p>{body} no</p></article></div><form><p>{body[:40]} no</p></form></main>') == body
    assert html_text.main_text(f'<article><p>{body}</p></article><div class="comments"><article class="comment"><p>{body} no</p></article></div>') == body


def test_extract_text_of_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (2, "u", "<article><p>x 😀", 4)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    assert got == [(1, None, "", 0), (2, "u", "x 😀", 3)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# quality


def test_gam_learns_curves_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality_gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    alone = quality_gam.fit(x[:2000], y[:2000], pairs=0)
    assert (alone.score(x[2000:]) >= 0.5).tolist() != (model.score(x[2000:]) >= 0.5).tolist()


def test_gam_of_one_label_or_none_is_constant():
    x = np.zeros((5, len(quality_gam.FEATURES)))
    assert quality_gam.fit(x[:0], np.zeros(0)).score(x).tolist() == pytest.approx([0.5] * 5)
    assert quality_gam.fit(x, np.ones(5)).score(x).tolist() == pytest.approx([6 / 7] * 5)


def test_quality_scores_every_row(spark):
    texts = [None, ""] + [("good words here. " * 9 if i % 2 else "b@d$$ w&&rds** " * 9) + str(i) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2 if i > 1 else None, 0) for i in range(122)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    model = quality_gam.train(docs, labels)
    rows = {r.doc_id: r for r in quality_gam.score_quality(docs, model).collect()}
    assert len(rows) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(rows[i].predicted == i % 2 for i in range(2, 122)) and any(r.held_out for r in rows.values())
    assert sorted(r.doc_id for r in quality_gam.keep_good(docs, model).collect()) == sorted(i for i in rows if rows[i].predicted)
    assert quality_gam.score_quality(empty(spark), model).count() == 0


# fingerprints


def test_scores_equal_the_entropy_of_each_window():
    data = np.frombuffer(("The quick brown fox. " * 9 + "aaaa" * 40 + "éü" * 30).encode(), dtype=np.uint8)
    got = fingerprints.scores(data)
    for i in range(len(got)):
        _, c = np.unique(data[i : i + 64], return_counts=True)
        entropy = 6 - (c * np.log2(c)).sum() / 64
        assert abs(got[i] - entropy / 6 * 1000) <= 1.01


def plain_digest(text, ranks):
    n = len(text) - 63
    s = fingerprints.scores(np.frombuffer(text, dtype=np.uint8)) if n > 0 else []
    points = [0] * max(0, n)
    for i in range(n):
        window = [(int(ranks[s[j]]), j) for j in range(i, min(n, i + 64))]
        if min(window)[0] < fingerprints.SCORES:
            points[min(window)[1]] += 1
    return [i for i in range(n) if points[i] >= min(16, max(1, n // 4))]


def test_digests_do_not_depend_on_their_neighbours():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta9", "épsilon"]) + str(rng.randint(0, 999)) for _ in range(n)).encode() for n in (0, 1, 8, 30, 400, 3000)] + [b"a" * 500]
    ranks = fingerprints.rarity(fingerprints.score_counts(texts))
    together = fingerprints.digests(texts, ranks)
    for t, d in zip(texts, together, strict=True):
        (alone,) = fingerprints.digests([t], ranks)
        assert alone[0] == d[0] and (alone[1] == d[1]).all()
        selected = plain_digest(t, ranks)
        assert d[0] == (len({t[i : i + 64] for i in selected}) or (1 if t else 0))
        assert fingerprints.from_string(fingerprints.as_string(d))[0] == d[0]
        assert fingerprints.likeness(d, d) == 1.0
    assert fingerprints.likeness(together[0], together[4]) == 0.0


def test_each_document_meets_the_next(spark):
    rng = random.Random(8)
    texts = [None, "", "short"] + [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 9999)) for _ in range(rng.randint(5, 300))) for _ in range(40)]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs, buckets=6).collect()}
    assert len(got) == len(texts)
    ranks = fingerprints.rarity(fingerprints.score_counts([(t or "").encode() for t in texts]))
    one = lambda t: fingerprints.digests([t.encode()], ranks)[0]
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == fingerprints.as_string(one(t)) and r.edited_fingerprint == fingerprints.as_string(one(e))
        assert r.near_edited == pytest.approx(fingerprints.likeness(one(t), one(e))) and r.near_next == pytest.approx(fingerprints.likeness(one(t), one(after)))
    assert fingerprints.compare_with_next(empty(spark)).count() == 0
    assert fingerprints.compare_with_next(docs_of(spark, ["only one"])).first().near_next == 1.0


# preference formatting


def test_preferences_share_the_longest_prefix(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", "same"), (3, 0, None, None), (3, 1, "assistant", ""), (4, 0, "user", "only"), (1, 0, "user", "q"), (None, 0, "user", "z")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", "ok"), (2, 0, "user", "same"), (3, 0, None, None), (3, 1, "user", "")]
    schema = "pair_id long, turn long, role string, text string"
    parts = chat_pairs.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema))
    got = sorted((r.pair_id, r.part, r.turn, r.role, r.trained) for r in parts.collect())
    assert got == sorted(
        [(1, "prompt", 0, "user", False), (1, "prompt", 1, "assistant", False), (1, "prompt", 2, "user", False), (1, "chosen", 3, "assistant", True), (1, "rejected", 3, "assistant", True), (1, "rejected", 4, "user", False),
         (2, "prompt", 0, "user", False), (3, "prompt", 0, None, False), (3, "chosen", 1, "assistant", True), (3, "rejected", 1, "user", False), (4, "chosen", 0, "user", False)],
    )
    one = {r.pair_id: r for r in chat_pairs.records(parts).collect()}
    assert one[1].prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nr<|im_end|>\n"
    assert one[1].rejected == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert [tuple(s) for s in one[1].rejected_trained] == [(0, len("<|im_start|>assistant\nbad<|im_end|>\n"))]
    assert one[2].chosen == "" and one[2].chosen_trained == []
    none = spark.createDataFrame([], schema)
    assert chat_pairs.format_preferences(none, none).count() == 0
