"""The grouped prefix join, importance resampling and the filter audit, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import CLASH, TEXTS

from tidewater.llm import common, filteraudit, importance, jaccardjoin


def _docs(spark, rows, clash=True):
    out = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return out.withColumns({c: F.lit("x") for c in (*CLASH, "of", "at", "prefix", "rank", "weight", "part", "fails")}) if clash else out


EDGES = [(i, t, [None, "", "a"][n % 3]) for n, (i, t) in enumerate(TEXTS)]


# ---- similarity join


def _components(texts):
    """doc_id -> (size, component) for texts with different ids."""
    sets = {}
    for i, t in texts:
        w = brute.solid_words(t)
        sets[i] = {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        return i if label[i] == i else root(label[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _variants(seed, groups, each, words, changes):
    rnd, out = random.Random(seed), []
    shared = [f"common{k}" for k in range(40)]
    for g in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        base[: len(shared) // 2] = shared[: len(shared) // 2]
        for _ in range(each):
            own = list(base)
            for _ in range(rnd.randrange(changes)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            out.append((len(out) + 1, " ".join(own)))
    return out


@pytest.mark.parametrize(("hot_rows", "links", "few", "split"), [(50_000, 10_000, 16, 4096), (6, 2, 2, 3), (6, 2, 1000, 3)])
def test_components_of_variants(spark, monkeypatch, hot_rows, links, few, split):
    monkeypatch.setattr(jaccardjoin, "CELL_ROWS", 64)
    monkeypatch.setattr(jaccardjoin, "FEW_MEMBERS", few)
    monkeypatch.setattr(jaccardjoin, "NEAREST", 1)
    monkeypatch.setattr(jaccardjoin.verify, "__defaults__", (links,))
    monkeypatch.setattr(jaccardjoin.crowd_pairs, "__defaults__", (None, split))
    texts = _variants(1, 12, 10, 60, 5) + [(1000 + i, "same text again and again and again") for i in range(9)]
    docs = _docs(spark, [(i, t, None) for i, t in texts])
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.similar_components(docs, hot_rows=hot_rows).collect()}
    want = _components(texts)
    assert out == want
    assert 12 < len({c for _, c in want.values()}) < 120


def test_levels_change_no_result(spark, monkeypatch):
    texts = _variants(2, 6, 8, 50, 4)
    docs = _docs(spark, [(i, t, None) for i, t in texts], clash=False)
    want = _components(texts)
    for level in (np.zeros(jaccardjoin.COUNTERS, np.uint8), np.arange(jaccardjoin.COUNTERS, dtype=np.int64).astype(np.uint8)):
        monkeypatch.setattr(jaccardjoin, "levels", lambda *_, level=level: level)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.similar_components(docs).collect()} == want


def test_counters_have_every_shingle(spark):
    texts = [t for _, t in _variants(3, 3, 5, 40, 3)]
    level = jaccardjoin.levels(spark.createDataFrame([(t,) for t in texts], "text string"))
    count = Counter(int(h) % jaccardjoin.COUNTERS for t in texts for h in jaccardjoin.shingles_of([t.encode()])[1])
    assert all(level[k] == int(math.frexp(max(n, 1))[1]) for k, n in count.items())


def test_signatures_rule_out_no_link():
    """Two signatures, folded to one length, differ in no more bits than their sets in shingles."""
    texts = [t.encode() for _, t in _variants(4, 6, 6, 90, 30)] + [b"a b c", b"", b"one two three four five six"]
    text, h = jaccardjoin.shingles_of(texts)
    n = np.bincount(text, minlength=len(texts))
    sig = [np.frombuffer(x, np.uint64) for x in jaccardjoin.signatures_of(text, h, n)]
    sets = [set(h[text == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            words = min(len(sig[i]), len(sig[j]))
            assert np.bitwise_count(jaccardjoin.folded(sig[i], words) ^ jaccardjoin.folded(sig[j], words)).sum() <= len(sets[i] ^ sets[j])


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    docs = _docs(spark, [(i, t, None) for i, t in _variants(6, 3, 4, 40, 3)])
    out = jaccardjoin.similar_components(docs)
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    assert left == ["jaccard-components", "jaccard-rows"] and out.count() == 12
    assert jaccardjoin.similar_components(docs.where("false")).count() == 0


def test_join_on_edge_rows(spark):
    docs = _docs(spark, EDGES)
    out = jaccardjoin.similar_components(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in EDGES)
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by_id[3] == [(0, 3)] and by_id[4] == [(0, 4)]  # the empty set links with nothing
    assert {c for _, c in by_id[15] + by_id[16]} == {15}
    assert sorted(n for n, _ in by_id[None]) == [0, 4] and {c for _, c in by_id[None]} == {None}
    want = _components([(i, t) for i, t, _ in EDGES if i not in (None, 16)])
    assert all(by_id[i] == [w] for i, w in want.items())
    assert jaccardjoin.similar_components(docs.where("false")).count() == 0


def test_short_texts_are_one_shingle(spark):
    rows = [(1, "a b c"), (2, "A  b\tc"), (3, "a b c d"), (4, "a b c d e"), (5, "b c d e a"), (6, "a b c d e")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.similar_components(_docs(spark, [(i, t, None) for i, t in rows])).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 4)}


# ---- resampling


def _features(text):
    w = brute.words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _resampled(texts, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in texts for f in _features(x)), Counter(bucket(f) for x in target for f in _features(x))
    size, goal = sum(s.values()), sum(t.values())
    rows = []
    for i, x in texts:
        f = _features(x)
        weight = sum(math.floor(1000 * math.log((t[bucket(a)] + 1) * (size + 10_000) / ((s[bucket(a)] + 1) * (goal + 10_000)))) for a in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute.words(x))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return Counter((*r[:4], rank[r].pop() if rank.get(r) else None) for r in rows)


@pytest.mark.parametrize("ranges", [1_000_000, 3])
def test_resampling(spark, monkeypatch, ranges):
    monkeypatch.setattr(importance.draw, "__defaults__", (5, 20, ranges))
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice(["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta9"]) + rnd.choice(["", "", "x"]) for _ in range(rnd.randrange(5, 60)))) for i in range(400)]
    texts += [(i, t) for i, t, _ in EDGES]
    target = ["alpha beta gamma", None, "", "Delta zeta9 alpha"]
    docs = _docs(spark, [(i, t, None) for i, t in texts])
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = Counter(tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == _resampled(texts, target)
    assert importance.resample(docs.where("false"), spark.createDataFrame([], "text string")).count() == 0


def test_many_ranges_have_the_same_numbers(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), (F.col("id") % 7).alias("weight"), F.pmod(F.hash("id"), F.lit(90)).cast("long").alias("score"))
    want = sorted((tuple(r) for r in importance.draw(rows, 60, 20, 1000).collect()), key=str)
    assert sorted((tuple(r) for r in importance.draw(rows, 60, 20, 2).collect()), key=str) == want
    assert sum(r[4] is not None for r in want) == 300


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_suffix_array(depth):
    rnd = np.random.default_rng(depth)
    ids, text = rnd.integers(0, 4, 200), np.sort(rnd.integers(0, 9, 200))
    order, common = importance.suffix_array(ids, text, depth)
    after = [tuple(ids[i : i + depth][text[i : i + depth] == text[i]].tolist()) for i in range(200)]
    assert [after[i] for i in order] == sorted(after)
    for a, b, n in zip(order, order[1:], common[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(after[a], after[b])) if x != y), min(len(after[a]), len(after[b])))


# ---- audit


def _audited(rows, labels):
    marks = {}
    for i, q, t in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    told = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = brute.solid_words(t, lower=False)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        told[s or ""].append(({k for k, v in fails.items() if v}, *marks.get(i, (0, 0))))
    out, shapley = [], Counter()
    for part, docs in told.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(gone)
                out.append((part, order, k + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    rnd = random.Random(9)
    rows = list(EDGES)
    for i in range(60):
        words = [rnd.choice(["Aa", "b", "c#", "dddd", "eeee"]) + (str(rnd.randrange(300)) if i % 2 else "") for _ in range(rnd.choice([30, 199, 200, 260]))]
        rows.append((100 + i, " ".join(words), rnd.choice(["a", "b", None])))
    rows += [(300 + i, rows[30][1], "a") for i in range(5)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(90, 330, 2)] + [(100, 1, 1), (100, 0, 0), (None, 1, 1)]
    docs = _docs(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("part", "fails", "good")})
    out = filteraudit.audit(filteraudit.verdicts(docs, table))
    got = Counter(tuple(r) for r in out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == _audited(rows, labels)
    assert filteraudit.audit(filteraudit.verdicts(docs.where("false"), table)).count() == 0


def test_trie_shares_states(spark):
    """Of three filters the trie has 7 states with edges, whatever the number of orders, and 12 edges."""
    rows = spark.createDataFrame([("p", m, 0, 0) for m in range(8)] * 3, "part string, fails int, good byte, toxic byte")
    edges = {(r["state"], r["filter"]): (r["before"], r["removed"]) for r in filteraudit.trie_edges(rows, 3).collect()}
    assert len(edges) == 12 and len({s for s, _ in edges}) == 7
    assert edges[0, 0] == (24, 12) and edges[1, 1] == (12, 6) and edges[6, 0] == (6, 3)
