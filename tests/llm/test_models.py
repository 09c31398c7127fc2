"""Toxicity, line field, suffix tree and URL verdicts against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tallymark.llm import examples, line_crf, suffix_tree, toxicity, urls
from tallymark.llm.common import fold


def held(key, folds=5):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


def random_index(seed=1, n=300, terms=12):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, terms)) < 0.25, rng.random((n, terms)), 0.0)
    x = x[x.any(1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5], x[9] = x[4], x[4]
    most = np.maximum.reduceat(x, np.arange(0, len(x), toxicity.BLOCK), axis=0).T
    return toxicity.Index({f"t{k}": k for k in range(terms)}, np.ones(terms), np.arange(len(x))[::-1].copy(),
                          rng.integers(0, 2, len(x)).astype(float), x, most, 0.1, (np.array([0., 1]), np.array([0., 1])))


def test_blocks_find_the_exact_neighbours():
    index = random_index()
    for k in range(60):
        at = np.flatnonzero(index.weights[k])
        found, sims = index.nearest(at, index.weights[k, at], 15)
        all_sims = np.round(index.weights[:, at] @ index.weights[k, at], 12)
        order = [j for j in np.lexsort((index.ids, -all_sims)) if all_sims[j] > 0][:15]
        assert found.tolist() == order and np.allclose(sims, all_sims[order])


def test_monotone_curve_is_monotone():
    rng = np.random.default_rng(2)
    v = rng.random(200).round(2)
    x, p = examples.monotone(v, (rng.random(200) < v).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all() and 0 < p.min() and p.max() < 1


def test_toxic_words_are_learnt_and_edges_defined(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):
        ws = rng.choice(vocab, 40).tolist()
        if k % 5 == 0:
            for at in rng.integers(0, 40, 3):
                ws[at] = rng.choice(["vile", "nasty"])
        rows.append((k, " ".join(ws), int(k % 5 == 0)))
    extra = [(1000, None), (1001, ""), (1002, "VILE nasty!"), (1002, "VILE nasty!"), (None, "w1")]
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(*e, 2) for e in extra], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(extra)
    assert all(r.held_out == (held(r.doc_id) == 0) for r in out)
    assert all(by[k].predicted == y for k, _, y in rows if held(k) == 0)
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and by[1002].neighbours
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_all_words_of_the_examples_count(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{int(j)}" for j in rng.zipf(1.5, 25) % 500) + (" vile" if k % 4 == 0 else "")) for k in range(120)]
    rows += [(200 + k, "once upon a fixed phrase") for k in range(5)] + [(300, "upon a"), (301, "unheard of"), (302, None)]
    label = {k: int(k % 4 == 0) for k, _ in rows if k < 300}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(list(label.items()), "doc_id long, toxic int"))
    known = {k: Counter((t or "").split()) for k, t in rows}
    learnt = [k for k in label if held(k) != 0]
    terms = sorted({w for k in learnt for w in known[k]})
    assert list(index.terms) == terms
    n, positive, weight = len(learnt), sum(label[k] for k in learnt), {}
    for w in terms:
        a, b = (min(len({k for k in learnt if w in known[k] and label[k] == y}),
                    len({p for k in learnt if label[k] == y for ws in [dict(rows)[k].split()] for p, t in zip(["", *ws], ws) if t == w}))
                for y in (1, 0))
        cells = [(a, (a + b) * positive / n), (b, (a + b) * (n - positive) / n),
                 (positive - a, (n - a - b) * positive / n), (n - positive - b, (n - a - b) * (n - positive) / n)]
        ratio = 2 * sum(s * math.log(s / e) for s, e in cells if s) if a * (n - positive) > b * positive else 0.0
        weight[w] = (1 + ratio) * (math.log((1 + len(rows)) / (1 + sum(w in c for c in known.values()))) + 1)

    def vector(counts):
        v = np.array([(1 + math.log(counts[w])) * weight[w] if counts[w] else 0.0 for w in terms])
        return v / (np.linalg.norm(v) or 1)

    matrix = np.array([vector(known[k]) for k in learnt])
    for r in toxicity.score(docs, index).collect():
        sims = np.round(matrix @ vector(known[r.doc_id]), 9)
        expected = np.sort(sims[sims > 0])[::-1][:toxicity.NEIGHBOURS]
        assert np.allclose(r.similarities, expected, atol=1e-6)
        assert all(abs(sims[learnt.index(k)] - s) < 1e-6 for k, s in zip(r.neighbours, r.similarities, strict=True))
        assert bool(r.neighbours) == (r.doc_id not in (301, 302))


def test_marginals_match_all_labellings():
    rng = np.random.default_rng(4)
    counts, stay = np.array([3, 1, 5, 2]), rng.normal(size=(2, 2))
    bad = rng.normal(size=11)
    p, log_z, moves = line_crf.marginals(bad, stay, counts)
    at, expected_moves = 0, np.zeros((2, 2))
    for k, n in enumerate(counts):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(bad[at + i] * y[i] for i in range(n)) + sum(stay[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
        assert math.isclose(log_z[k], math.log(w.sum()))
        assert np.allclose(p[at:at + n], [(w * [y[i] for y in paths]).sum() / w.sum() for i in range(n)])
        for y, x in zip(paths, w / w.sum(), strict=True):
            for i in range(n - 1):
                expected_moves[y[i], y[i + 1]] += x
        at += n
    assert np.allclose(moves, expected_moves)


def test_line_field_learns_junk(docs, labels, rows, no_docs):
    field = line_crf.fit(docs, labels)
    out = line_crf.score(docs, field)
    found = out.select("doc.doc_id", "doc.text", "held_out", "score", "predicted").collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (held(r.doc_id) == 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == 1 for r in found if r.text and "%%%" not in r.text and len(r.text) > 60)
    assert sum(r.predicted == 0 for r in found if r.text and "%%%" in r.text) >= 4
    assert line_crf.keep_good(docs, labels).columns == docs.columns
    assert line_crf.keep_good(no_docs, labels).count() == 0
    assert {r.score for r in line_crf.score(docs, line_crf.fit(docs, labels.limit(0))).select("score").collect()} == {
        1 / (1 + np.exp(-line_crf._logit(np.array(1.0))))}


def test_suffix_tree_scores(docs, rows, no_docs):
    out = suffix_tree.score(docs, fold("doc_id", 7) != 2).collect()
    assert len(out) == len(rows)
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    c = Counter(w for k, t in rows if held(k, 7) != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for k, t in rows:
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        expected[k, held(k, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    by = {}
    for r, s in sorted(((r.n_tokens, r.score) for r in out if r.n_tokens == 1)):
        by.setdefault(r, set()).add(s)
    assert all(len(s) == 1 for s in by.values())
    assert suffix_tree.score(no_docs, fold("doc_id", 7) != 2).count() == 0


def test_tree_is_a_distribution_and_uses_the_longest_suffix():
    texts = ["abab abc", "abd", "", None, "b a b"]
    grams, n = np.unique(suffix_tree.grams(suffix_tree.symbols(texts)[0]), return_counts=True)
    rows = []
    for depth in range(suffix_tree.DEPTH + 1):
        by = Counter()
        for g, k in zip(grams.tolist(), n.tolist(), strict=True):
            by[(g >> 8) & ((1 << 8 * depth) - 1), g & 255] += k
        rows += [(depth, c, s, k) for (c, s), k in by.items()]
    rows = pd.DataFrame(rows, columns=["depth", "context", "symbol", "n"])
    tree = suffix_tree.build(rows, int(n.sum()))
    p = 10.0 ** tree.log10
    seen = [s for s in range(256) if tree.column[s] < p.shape[1] - 1]
    may_follow = [tree.column[s] for s in seen if s != suffix_tree.BEFORE]
    unseen = suffix_tree.SYMBOLS - len(may_follow)
    assert np.allclose(p[:, may_follow].sum(1) + unseen * p[:, -1], 1, atol=1e-5)
    one = tree.score(["abz"])[0]
    raw = suffix_tree.symbols(["abz"])[0]
    total = 0.0
    for at in range(suffix_tree.DEPTH, len(raw)):
        node = 0
        for back in range(1, suffix_tree.DEPTH + 1):
            node_ = tree.child[node, tree.column[raw[at - back]]]
            if not node_:
                break
            node = node_
        total += tree.log10[node, tree.column[raw[at]]]
    assert math.isclose(one, total, rel_tol=1e-6)


def plain_log10(texts, learnt, least):
    """log10 of each symbol of all texts, by counting every context of the learnt texts one by one."""
    depth_, shared = suffix_tree.DEPTH, suffix_tree.SHARED
    pad = bytes([suffix_tree.BEFORE]) * depth_
    spell = lambda t: pad + b" ".join((t or "").encode().lower().split()) + bytes([suffix_tree.END])
    follow = {}
    for text, yes in zip(texts, learnt, strict=True):
        raw = spell(text)
        for at in range(depth_, len(raw) if yes else 0):
            for d in range(depth_ + 1):
                follow.setdefault(raw[at - d: at], Counter())[raw[at]] += 1
    kept = {c for c in follow if len(c) <= shared}
    for c, n in follow.items():
        if len(c) > shared and sum(n.values()) >= least:
            up, of = follow[c[1:]], sum(n.values())
            gain = sum(k * math.log(k * sum(up.values()) / (of * up[x])) for x, k in n.items())
            if gain > 0.5 * len(n) * math.log(of):
                kept |= {c[k:] for k in range(len(c))}
    out = []
    for text in texts:
        raw, total = spell(text), 0.0
        for at in range(depth_, len(raw)):
            root = follow.get(b"", Counter())
            p = (root[raw[at]] + 1) / (sum(root.values()) + suffix_tree.SYMBOLS)
            for d in range(1, depth_ + 1):
                c = raw[at - d: at]
                if c not in kept:
                    break
                p = (follow[c][raw[at]] + suffix_tree.PULL * p) / (sum(follow[c].values()) + suffix_tree.PULL)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("shared_runs", [0, 40, 10 ** 6])
def test_the_suffix_table_matches_plain_counts(spark, monkeypatch, shared_runs):
    monkeypatch.setattr(suffix_tree, "RUNS", shared_runs)
    monkeypatch.setattr(suffix_tree, "CHUNK", 50)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["ab", "abc", "bcd", "é", "Cab", "漢字", "d"], 12)) for _ in range(25)] + [None, "", "zz new"]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.score for r in suffix_tree.score(docs, fold("doc_id", 7) != 2).collect()}
    expected = plain_log10(texts, [held(k, 7) != 2 for k, _ in rows], suffix_tree.LEAST)
    assert all(math.isclose(out[k], expected[k], rel_tol=1e-5) for k, _ in rows) and len(out) == len(rows)


def test_a_small_language_keeps_its_contexts_in_a_large_corpus(spark):
    small = [(k, "qwxyvk " * 4) for k in range(3)]
    large = [(100 + k, "the same old words again and again " * 6000) for k in range(12)]

    def scored(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id: r.score for r in suffix_tree.score(docs, fold("doc_id", 7) != 9).where("doc_id < 100").collect()}

    alone, among = scored(small), scored(small + large)
    assert all(among[k] > alone[k] - 2 for k in alone)


def plain_split(name, counts, total):
    """The most probable words by all earlier cuts of each end; of equal ones the longest last word."""
    best, cut = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - urls.LONGEST_WORD), end):
            piece = name[start:end]
            p = math.log(counts[piece] / total) if counts.get(piece) else math.log(1 / (total + 1)) - len(piece) * math.log(10)
            options.append((best[start] + p, -start))
        value, start = max(options)
        best.append(value)
        cut.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[cut[end]:end])
        end = cut[end]
    return words[::-1]


def all_splits(name):
    """Every way to cut the name."""
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in all_splits(name[k:]):
            yield [name[:k], *rest]


def test_best_split_is_the_most_probable():
    rnd, counts = random.Random(7), {"the": 50, "he": 9, "t": 3, "art": 20, "heart": 4, "a": 30, "ar": 2, "rt": 2, "hear": 1}
    total = sum(counts.values())

    def p(w):
        return math.log(counts[w] / total) if w in counts else math.log(1 / (total + 1)) - len(w) * math.log(10)

    for _ in range(60):
        name = "".join(rnd.choice("thear") for _ in range(rnd.randint(1, 10)))
        found = plain_split(name, counts, total)
        assert math.isclose(sum(map(p, found)), max(sum(map(p, w)) for w in all_splits(name)))


def test_names_are_split_in_stretches_as_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(urls, "STRETCH", 30)
    rnd, counts = random.Random(3), {"the": 50, "he": 9, "t": 3, "art": 20, "heart": 4, "a": 30, "ar": 2, "rt": 2, "hear": 1, "éa": 7}
    names = {"".join(rnd.choice(["t", "h", "e", "a", "r", "t", "é"]) for _ in range(rnd.choice([1, 5, 29, 30, 31, 49, 50, 61, 400]))) for _ in range(120)}
    out = urls.split_names(spark.createDataFrame([(n,) for n in names], "name string").repartition(3),
                           spark.createDataFrame(list(counts.items()), "word string, n long"), sum(counts.values())).collect()
    assert {r.name: r.words for r in out} == {n: plain_split(n, counts, sum(counts.values())) for n in names}


def test_a_very_long_host_is_judged(spark):
    host = "theheart" * 25_000
    pages = spark.createDataFrame([(1, f"http://{host}.org/x", "<p>the heart</p>"), (2, "http://the.net/es/", "the"), (3, "http://com/", "")],
                                  "page_id long, url string, html string")
    out = {r.page_id: r for r in urls.judge(pages).collect()}
    assert out[1].host == f"{host}.org" and out[1].verdict in ("allow", "block") and out[1].block_log_odds is not None


def test_verdicts_are_those_of_a_plain_bayes(spark):
    """The whole operator again, page by page."""
    rnd = random.Random(12)
    vocab = ["the", "cheap", "pills", "news", "river", "art", "shop"]
    hosts = ["".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 3))) + rnd.choice([".example.com", ".net", ".org", "12.org", ".com"]) for _ in range(40)]
    rows = [(k, f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'de', 'Shop-7'])}/{rnd.choice(vocab)}{rnd.randint(0, 30)}?q=1",
             f"<p>{' '.join(rnd.choice(vocab) for _ in range(12))}</p>") for k in range(400)]
    rows += [rows[0], (401, None, "the"), (402, "http://zzz/", None), (403, "http://123.4/5", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r for r in urls.judge(pages).collect()}

    counts = {}
    for _, _, page in rows:
        for w in re.split("[^a-z]+", re.sub("<[^>]*>", " ", (page or "").lower())):
            if 1 <= len(w) <= 20:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())

    def tokens(text):
        return re.findall(r"[^\W0-9_]+|#", re.sub("[0-9]+", "#", text.lower()))

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        return host.lower(), re.match("[^?#]*", rest[len(host):])[0]

    def ruled(host, path):
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    def bag(host, path):
        named = [w for t in tokens(host) for w in (["#"] if t == "#" else plain_split(t, counts, total))]
        return [("host", w) for w in named] + [("path", w) for w in tokens(path)]

    seen = {"block": {}, "allow": {}}
    pages_of = {"block": 0, "allow": 0}
    words = set()
    for _, url, _ in rows:
        host, path = parts(url)
        verdict, held = ruled(host, path), bag(host, path)
        words.update(held)
        if verdict:
            pages_of[verdict] += 1
            for w in held:
                seen[verdict][w] = seen[verdict].get(w, 0) + 1
    v, b, a = len(words), sum(seen["block"].values()), sum(seen["allow"].values())
    for k, url, _ in rows:
        host, path = parts(url)
        verdict, r = ruled(host, path), found[k]
        if verdict is None:
            odds = math.log((pages_of["block"] + 1) / (pages_of["allow"] + 1)) + sum(
                math.log((seen["block"].get(w, 0) + 1) / (b + v + 1)) - math.log((seen["allow"].get(w, 0) + 1) / (a + v + 1)) for w in bag(host, path))
            assert r.block_log_odds == pytest.approx(odds, abs=1e-9)
            verdict = "block" if odds > 0 else "allow"
        assert (r.host, r.path, r.verdict) == (host, path, verdict)


def test_url_verdicts(spark):
    some = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q=/es/", "http://x.net/es/2", "http://net/fr/", "http://xnet/fr/",
            "http://example.com", "http://example.com/en", "no scheme", "", None, "ftp://h.org/de/3#://z", "http://?x", "://com/",
            "http://thethe.org/en/12", "http://a.example.com/en/1"]
    pages = spark.createDataFrame([(k, u, "<p>the ha the</p>", "h", "r") for k, u in enumerate(some)],
                                  "page_id long, url string, html string, host string, rule string")
    out = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(out) == len(some)
    assert [out[k].rule for k in range(9)] == [
        "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, "com/", None, None]
    assert [out[k].verdict for k in (0, 1, 2, 3, 6)] == ["block", "allow", "block", "block", "allow"]
    assert (out[1].host, out[1].path) == ("www.example.com", "/en/x") and (out[9].host, out[9].path) == ("", "")
    assert (out[10].host, out[10].path) == ("h.org", "/de/3") and out[12].rule == "com/" and out[11].host == ""
    assert {r.verdict for r in out.values()} == {"allow", "block"} and out[14].verdict == out[0].verdict
    assert urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [3, 100])
def test_the_sample_is_bounded(docs, labels, bound):
    rows = examples.labelled(docs, labels, "quality", bound).collect()
    assert len(rows) == min(bound, len(rows)) and len({r.id for r in rows}) == len(rows)
    assert all(held(r.id) != 0 and r.text is not None for r in rows)
