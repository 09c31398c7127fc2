"""Similarity joins, components and the pipeline against brute force."""

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tallymark.llm import grid_join, jaccard
from tallymark.llm.common import saved
from tallymark.llm.components import components


def roots(nodes, links):
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))) if ws else frozenset()


def linked(sets):
    return [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:] if x and y and 100 * len(x & y) >= 90 * len(x | y)]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(rnd.randrange(300, 340), rnd.randrange(300, 340)) for _ in range(25)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({x for p in links for x in p}, links)
    alone = {a for a, b in links if a == b}
    assert found == {k: v for k, v in expected.items() if k in found} and set(expected) - set(found) <= alone
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_classes(docs, rows, no_docs):
    sets = [(k, shingles(t)) for k, t in rows]
    root = roots({k for k, _ in sets if k is not None}, linked([s for s in sets if s[0] is not None]))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    assert found == sorted(((k, len(s), root.get(k)) for k, s in sets), key=str)
    assert jaccard.classes(no_docs).count() == 0


@pytest.mark.parametrize("order", range(4))
def test_a_repeated_id_keeps_each_of_its_texts(spark, order):
    """Id 5 comes with three texts; 7, 9 and 3 are near copies of one of them each, 11 of none."""
    words = [[f"{name}{k}" for k in range(90)] for name in "abcd"]
    near = [" ".join([*ws[:-1], "end"]) for ws in words]
    rows = [(5, " ".join(words[0])), (5, " ".join(words[1])), (5, " ".join(words[2])), (7, near[0]), (9, near[1]), (6, near[2]),
            (11, near[3]), (5, " ".join(words[1])), (20, " ".join(words[1])), (21, " ".join(words[2]))]
    random.Random(order).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(order + 1)
    found = {r.doc_id: r.component_id for r in jaccard.classes(frame).collect()}
    assert found == {5: 5, 6: 5, 7: 5, 9: 5, 20: 5, 21: 5, 11: 11}


def test_long_lists_and_borders(spark):
    """A thousand near copies that share all lists, and sets whose similarity is just at and just under the limit."""
    rnd = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(1300):
        ws = list(base)
        for at in rnd.sample(range(120), rnd.choice([0, 1, 2, 3])):
            ws[at] = f"x{rnd.randrange(40)}"
        texts.append(" ".join(ws))
    for extra in range(1, 15):
        texts += [" ".join(f"s{extra}_{k}" for k in range(102)), " ".join(f"s{extra}_{k}" for k in range(102 + extra))]
    sets = [(k, shingles(t)) for k, t in enumerate(texts)]
    frame = saved(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    found = {r.doc_id: r.component_id for r in jaccard.classes(frame).collect()}
    unlike = {s: k for k, s in reversed(sets)}
    links = linked([(k, s) for s, k in unlike.items()]) + [(unlike[s], k) for k, s in sets]
    assert found == roots(range(len(texts)), links)


def test_one_document_of_each_group_stays(docs, rows):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    root = roots({k for k, _ in sets}, linked(sets))
    expected = sorted([(k, t) for k, t in set(rows) if k is not None and root[k] == k] + [r for r in rows if r[0] is None], key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == expected


def test_vectors(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 8))
    points = np.concatenate([points, points[:200] + rng.normal(size=(200, 8)) * 0.1, np.repeat(points[:1], 700, 0),
                             points[1] * (1 + rng.random((600, 1))) + rng.normal(size=(600, 8)) * 0.01])
    rows = [(k, v.tolist()) for k, v in enumerate(points)]
    odd = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [None] + [1.0] * 7, [math.inf] + [1.0] * 7]
    odd = [(5000 + k, v) for k, v in enumerate(odd)] + [(6000, [1.0, 0.0]), (6001, [2.0, 0.0]), (6002, [1.0, 1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, n int, id int").repartition(5)
    found = {r.vec_id: r for r in grid_join.near_duplicates(frame).collect()}
    assert len(found) == len(rows) + len(odd)
    x = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    root = roots(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))])
    for k in range(len(rows)):
        assert (found[k].n_links, found[k].component_id) == (near[k].sum() - 1, root[k])
        assert found[k].kept == (root[k] == k)
    assert all(found[k].n_links == 0 and found[k].component_id == k for k in range(5000, 5006))
    assert (found[6000].n_links, found[6001].component_id, found[6002].n_links) == (1, 6000, 0)
    assert found[None].n_links == 0 and found[None].component_id is None
    assert grid_join.near_duplicates(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, rows, labels, tmp_path):
    """Clashing and odd columns survive all stages but the last, and every stage works on what the one before kept."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = saved(stage(spark, before, str(tmp_path)))
        counts.append(kept.count())
        if name != "best-fit packing":
            assert kept.columns == docs.columns
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect()), key=str) == sorted(map(tuple, kept.select(columns).collect()), key=str)


def test_pipeline_of_an_empty_table(spark, no_docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bounds_of_the_jaccard_join_lose_nothing(spark, monkeypatch):
    """Cell counts never understate an overlap, full cells included; marks have every id, however few bits there are."""
    rng = np.random.default_rng(8)
    for n, m in [(0, 3), (1, 1), (5, 9), (500, 530), (4000, 3900), (1, 4000)]:
        pool = rng.integers(0, 1 << 58, n + m)
        x, y = np.unique(pool[:n]), np.unique(rng.permutation(pool)[:m])
        shared = len(np.intersect1d(x, y))
        assert jaccard.most_shared(jaccard.cell_counts(x), jaccard.cell_counts(y)) >= shared
    same_cell = np.arange(2000, dtype=np.int64) << 20
    assert jaccard.most_shared(jaccard.cell_counts(same_cell), jaccard.cell_counts(same_cell)) >= 2000
    ids = [*range(0, 90_000, 7), -5, 2 ** 62 + 1]
    frame = saved(spark.createDataFrame([(k,) for k in ids], "id long"))
    for most in (1 << 28, 1 << 16):
        monkeypatch.setattr(jaccard, "MARKS", most)
        found = jaccard.marks(frame)
        at = jaccard._bit(np.array(ids, np.int64), 8 * len(found))
        assert (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all() and 8 * len(found) <= most
    assert not jaccard.marks(frame.limit(0)).any()
