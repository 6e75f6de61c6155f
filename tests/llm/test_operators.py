"""Each operator against brute force on a small fixture with nulls, empty and repeated rows, and extra columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import base, context_tree, decontaminate, hyper_lang, licences, line_dedup, mixing, quality_rules, simhash, token_counts, url_filter

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
DOCS = [
    (1, LINE + "\nshort line\n\nshort line", "en", "a"),
    (2, LINE.replace("kappa", "kapa") + "\nanother one", "en", "a"),
    (3, LINE + "\nshort line\n\nshort line", "en", "b"),
    (4, None, "fr", "b"),
    (5, "", None, None),
    (6, "   \n\t", "fr", None),
    (7, "déjà vu être élève garçon où ça été\nLicensed under the Apache License, Version 2.0.", "fr", "c"),
    (8, "x " * 9_000, "en", "c"),
    (8, "x " * 9_000, "en", "c"),
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({"n": F.lit(1), "key": F.lit("k"), "size": F.lit("s"), "label": F.lit("l")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in base.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}}
    assert base.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://a.net/x", '<link rel="canonical" href="https://example.org/es/1">'), (2, "https://www.example.org/es/1/?utm_source=1", ""), (3, "http://b.net/y?ref=3", '<meta http-equiv="refresh" content="0; url=http://a.net/x#f">'), (4, "http://c.net/z", "<link href=/q rel=canonical>"), (5, "http://c.net/q", '<LINK rel="canonical" href="http://d.com/fr/1">'), (6, "http://d.com/fr/1", None), (7, None, ""), (8, "nohost", ""), (9, "HTTP://EXAMPLE.ORG/en/12?x=1#a", ""), (9, "HTTP://EXAMPLE.ORG/en/12?x=1#a", "")]
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [tuple(r) for r in url_filter.filter_urls(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(url_filter.SQL).fetchall()))
    assert {g[0]: g[4] for g in got} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, LINE), (2, "déjà vu être élève garçon où ÇA été"), (3, None), (4, ""), (5, "nothing like it in any of these texts at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 2)} and got[1, 1] == 1 and 0.9 < got[2, 1] < 1
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 4
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 == decontaminate.find_leaks(empty, items).count()


def test_align():
    s = decontaminate.Search()
    assert decontaminate.align(np.array([9, 1, 2, 3, 8]), np.array([1, 2, 3]), s) == (6, 1, 4)
    assert decontaminate.align(np.array([1, 2, 7, 3, 4]), np.array([1, 2, 3, 4]), s)[0] == 7


def test_edited_leaks(spark):
    """Edited copies of items of every length against the alignment of whole texts: none is missed that shares a seed."""
    draw, s = random.Random(4), decontaminate.Search()
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(4, 41)]
    texts = {}
    for n, text in items:
        for share in (0, 0.15, 0.3):
            own = text.split()
            for k in [n // 2] if not share else [k for k in range(n) if draw.random() < share]:
                own[k] = draw.choice(("other", "more words here", f"{own[k]} too"))
            texts[len(texts)] = (n, " ".join(["before"] * 30 + own + ["after"] * 30))
        own = text.split()
        texts[len(texts)] = (n, " ".join([*own[:4], *["between"] * (n - 5), *own[4:]]))
    want = {}
    for i, (n, t) in texts.items():
        a, b = decontaminate.terms(t), decontaminate.terms(dict(items)[n])
        known = {w: k for k, w in enumerate(b)}
        score = decontaminate.align(np.array([known.get(w, -1) for w in a]), np.arange(n), s)[0]
        if score >= s.least * s.match * n and any(a[j : j + 4] == b[k : k + 4] for j in range(len(a) - 3) for k in range(n - 3)):
            want[i, n] = score
    got = decontaminate.find_leaks(spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()} == want and len(want) > 100


def test_mixing(spark, docs, empty):
    assert mixing.share_targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 60) == {"a": 20.0, "b": 40.0}
    flow = mixing.route({"x": (["a"], 10), "y": (["a", "b"], 10)}, {"a": 15, "b": 10}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "a") == 15 and sum(v for (_, s), v in flow.items() if s == "b") == 10
    got = mixing.mix_sources(docs)
    assert {"size", "source_size", "target", "taken", "key"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(DOCS) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_language(spark, docs, empty):
    made = hyper_lang.predict(docs, hyper_lang.learn(docs), keep=tuple(docs.columns)).collect()
    assert {r["lang_pred"] for r in made if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert {r["doc_id"]: r["lang_pred"] for r in made if r["doc_id"] in (7, 8)} == {7: "fr", 8: "en"} and all(0 <= r["score"] <= 1 for r in made)
    assert hyper_lang.learn(empty) == {} and hyper_lang.predict(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_lm(spark, docs):
    held = F.coalesce(base.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    got = context_tree.score_texts(docs, held).collect()
    counts = collections.Counter()
    for i, t, *_ in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, *_ in DOCS:
        w = [*words(t), "\n"]
        want[i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert context_tree.score_texts(docs, F.lit(True)).where("n_known <> 0").count() == 0
    assert context_tree.score_texts(docs.limit(0), F.lit(False)).count() == 0


def brute_tree(texts, train, depth):
    """log10 P of each text by the tree of all contexts, node by node: estimates and weights from the texts of ``train``."""
    data = [bytes(depth) + t.encode().lower() + b"\0" for t in texts]
    counts = collections.defaultdict(lambda: [0, 0])
    walk = lambda raw: [(raw[i - depth : i], [(1 << k | raw[i] >> (8 - k), raw[i] >> (7 - k) & 1) for k in range(8)]) for i in range(depth, len(raw))]
    for raw, some in zip(data, train):
        for ctx, path in walk(raw) if some else []:
            for node, bit in path:
                for d in range(depth + 1):
                    counts[ctx[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    longer = collections.defaultdict(set)
    for ctx, node in list(counts):
        if ctx:
            longer[ctx[1:], node].add((ctx, node))
    memo = {}

    def whole(key):
        if key not in memo:
            own = kt(*counts[key]) if key in counts else 0.0
            memo[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(whole(k) for k in longer[key])) - math.log(2)
        return memo[key]

    def ahead(key_ctx, node, d):
        n0, n1 = counts.get((key_ctx[depth - d :], node), (0, 0))
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return own
        key = (key_ctx[depth - d :], node)
        w = math.exp((kt(n0, n1) if key in counts else 0.0) - math.log(2) - whole(key))
        return w * own + (1 - w) * ahead(key_ctx, node, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for ctx, path in walk(raw) for node, bit in path for p in [ahead(ctx, node, 0)]) for raw in data]


@pytest.mark.parametrize("depth, split, block", [(3, 2, 4_000_000), (5, 2, 40), (4, 1, 25)])
def test_tree_against_brute_force(spark, depth, split, block):
    """All contexts, a model of one block or of several, texts not learned from included."""
    texts = ["banana bandana", "Ban the banana", "", "an", "nothing like it", "ban ban ban ban"]
    train = [True, True, True, False, False, True]
    tree = context_tree.Tree(depth=depth, split=split, block=block)
    df = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, train))], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in context_tree.model_scores(df, context_tree.train(df, tree), tree, "doc_id").collect()}
    want = brute_tree(texts, train, depth)
    assert all(abs(got[k] - w) < 1e-4 * max(1, abs(w)) for k, w in enumerate(want))


def test_lines(spark, docs, empty):
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1] == LINE + "\nshort line\n" and out[2] == "another one" and out[3] == "" and out[4] is None and out[6] == "   \n\t"
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(empty).count() == 0


def test_long_band_lists(spark):
    """A family of more variants than are paired: those near the first join, strangers stay."""
    base_words = LINE.split()
    rows = [(k, " ".join(base_words[:k] + [f"edit{k}"] + base_words[k + 1 :])) for k in range(24)] + [(99, LINE), (100, " ".join(reversed(base_words)))]
    gone = {r["doc_id"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = near_classes(rows)
    assert gone == want and 100 not in gone


def runs(t):
    return {t[k : k + 5] for k in range(max(1, len(t) - 4))}


def near_classes(rows):
    """The ids of all lines but the first of each class, by comparing every pair."""
    sets, first = [runs(t.lower()) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    return {rows[k][0] for k, f in enumerate(first) if f != k}


def test_edited_lines(spark):
    """Lines of 8 to 24 words with one word replaced, against every pair; the edit is seen at each offset."""
    draw, rows = random.Random(8), []
    for n in range(8, 25):
        for _ in range(3):
            own = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 8))) for _ in range(n)]
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join([*own[: n // 2], "edit", *own[n // 2 + 1 :]]))]
    want = near_classes(rows)
    assert {r["doc_id"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want and len(want) > 20


def test_lines_without_spaces(spark):
    """Lines that are one long token differ by what follows its start; a family of edited copies against every pair."""
    own = LINE.split()
    rows = [(1, "https://www.example.org/a/1"), (2, "https://www.other.net/b"), (3, "今天天气很好我们一起去公园散步然后回家吃饭看书"), (4, "今天天气很好我们一起去公园的路上遇见了一位老朋友"), (5, "0123456789ab" + "c" * 40), (6, "0123456789abdefghijklmnop")]
    rows += [(10 + k, " ".join(own[:k] + [f"edit{k}"] + own[k + 1 :])) for k in range(24)] + [(99, LINE), (100, " ".join(reversed(own)))]
    want = near_classes(rows)
    assert {r["doc_id"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want and min(want) > 10


def test_tokens(spark, docs):
    got = token_counts.count_tokens(docs).collect()
    coding = token_counts.encoder(token_counts.VOCABULARY)[0]
    total = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    want = collections.Counter()
    for i, t, *_ in DOCS:
        want[i] += len(coding.encode_ordinary(t)) if t else 0
    assert total == want
    n, crossing = token_counts.attribute(np.array([0, 3]), np.array([0, 2]), np.array([2, 6]), 6)
    assert n.tolist() == [1, 1] and crossing.tolist() == [0, 1]


def test_simhash(spark, docs, empty):
    def brute(t):
        w = words(t)
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_classes(docs).collect()]
    assert sorted(map(str, ((i, f) for i, f, _ in got))) == sorted(map(str, ((i, brute(t)) for i, t, *_ in DOCS)))
    assert {i: c for i, _, c in got if i in (1, 3, 4, 5, 6)} == {1: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert simhash.simhash_classes(empty).count() == 0


def test_simhash_long_lists(spark):
    """64 neighbours of one value share byte pairs and exceed what is paired; all are one class."""
    values = [0x1234_5678_9ABC_DEF0] + [0x1234_5678_9ABC_DEF0 ^ (1 << k) for k in range(60)] + [0x7FFF_0000_FFFF_0000]
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"))
    labels = {r["node"]: r["label"] for r in base.connected_components(edges).collect()}
    assert len({labels[v] for v in values[:-1]}) == 1 and values[-1] not in labels


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in quality_rules.quality_filter(docs, labels).collect())
    want = collections.Counter()
    for i, t, *_ in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        want[i, len(w), len(lines) - len(set(lines)), len(covered), len(w) >= 50 and 2 * len(covered) <= len(w)] += 1
    assert got == want and quality_rules.quality_filter(empty, labels.limit(0)).count() == 0


def test_decision_list():
    draw = np.random.default_rng(1)
    x = {k: draw.random(900) for k in quality_rules.FEATURES}
    bad = (x["symbol_rate"] > 0.7) | (x["repeat_rate"] > 0.8)
    rules = quality_rules.learn_rules(dict(x), bad)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality_rules._covers(r, x)
    assert (hit == bad).mean() > 0.97


def test_licences(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code code"), (3, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (4, "d/e.py", None), (5, None, ""), (6, "a/b/x.py", "Licensed under CC BY 4.0.\n" + "word " * 50)]
    got = {r["id"]: (r["licence"], r["effective"], r["from_dir"]) for r in licences.scan_licences(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a/b"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, None, None), 5: (None, None, None), 6: ("CC-BY-4.0", "CC-BY-4.0", None)}


def test_licence_of_repeats_and_paragraphs(spark):
    """A bound that skips a line must hold for it, and a notice may be broken over lines; against every template without the bound."""
    known, words = licences.Templates(), licences._Words()
    draw = random.Random(9)
    vocabulary = [*known.idf, *(f"other{k}" for k in range(40))]
    for _ in range(400):
        terms = draw.choices(vocabulary, k=draw.randint(1, 12)) * draw.randint(1, 4)
        score, name = known.best(terms)
        assert known.best(terms, 0.75) == ((score, name) if score >= 0.75 else known.best(terms, 0.75)) and (score < 0.75 or known.best(terms, 0.75)[1] == name)
    text = "All rights reserved. " * 33 + " ".join(f"x{k}" for k in range(800))
    assert licences.judge(text, known, 0.75, words)[0] == "proprietary"
    broken = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files\n\ncode"
    assert licences.judge(broken, known, 0.75, words)[0] == "MIT"
    files = [(k, f"x/{k % 2}/f{k}", "Released under the MIT License." if k == 4 else "code") for k in range(9)] * 2
    got = collections.Counter((r["id"], r["effective"]) for r in licences.scan_licences(spark.createDataFrame(files, "id long, path string, text string").withColumn("dir__", F.lit(1))).collect())
    assert got == {(k, None if k % 2 else "MIT"): 2 for k in range(9)}
    assert licences.scan_licences(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_leaks_of_items_of_one_id(spark):
    items = spark.createDataFrame([(7, "one two three four five"), (7, "six seven eight nine ten"), (None, "uno dos tres cuatro cinco")], "item_id int, text string")
    rows = spark.createDataFrame([("a", "x one two three four five"), ("b", "six seven eight nine ten y"), (None, "uno dos tres cuatro cinco"), ("d", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows, items).collect()} == {("a", 7), ("b", 7), (None, None)}


def test_bundle_of_short_and_long_texts():
    profile = hyper_lang.Profile(part=7)
    texts = ["banana", "", "the quick brown fox jumps over the lazy dog " * 3, "ab", "zebra crossing"] * 3
    for _, n, distinct, owner, place, counts in hyper_lang._counted(texts, profile):
        dense = np.zeros((n, len(distinct)))
        dense[owner, place] = counts
        want = dense @ hyper_lang.gram_vectors(distinct, profile).astype(float)
        assert np.allclose(hyper_lang.bundle(n, distinct, owner, place, counts, profile), want)


def test_links_against_every_pair(spark):
    draw = random.Random(12)
    values = list({draw.getrandbits(63) for _ in range(40)})
    for _ in range(160):
        values.append(draw.choice(values) ^ (1 << draw.randrange(63)) ^ (1 << draw.randrange(63)))
    values = sorted(set(values))
    label = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()}
    got = {r["node"]: r["label"] for r in base.connected_components(simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    assert {v: got.get(v, v) for v in values} == label


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(5)
    rows = [(k, "w " * draw.randint(1, 30), draw.choice("abc")) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("sources", F.lit("mine"))
    got = mixing.mix_sources(df).collect()
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30 and own[0]["sources"] == "mine"
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(3)).collect()))
