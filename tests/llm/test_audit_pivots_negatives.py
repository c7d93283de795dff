"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from terrane.llm import audit, negatives, pivots, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, mask int, part string, n int, digest string, quality int"
LABELS = "doc_id long, quality int, toxic int, part string"
VECTORS = "vec_id long, embedding array<float>, label int, uid long, n string, kept int, v string, salt int"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_pivot_neardup", "op13_hard_negatives"])
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def audit_rows(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcXYZé中") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts = [None, "", " \n\t\x0b", "one", "W" * 7000, "é" * 300 + " x" * 500, "a b " * 150, "$" + " w" * 220, "tail  ", "  head", "\x1c \x85\xa0  x"]
    texts += [" ".join(rng.choices(words, k=rng.choice([3, 150, 199, 200, 201, 600]))) + rng.choice(["", "", "|", "*"]) for _ in range(80)]
    texts += rng.choices(texts, k=60)
    rows = [(i if i % 9 else None if i % 2 else 18, t, rng.choice(["a", "hot", "hot", "", None])) + (5, "?", 1, "d", 1) for i, t in enumerate(texts)]
    rows += rows[12:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 150, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")]
    rng.shuffle(rows)
    return rows, labels


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t, _ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    marked = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        marked.append((source or "", "".join(k for k in "ABCDE" if fails[k]), i in good, i in toxic))
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                every = sum(f in m[1] for m in own)
                out[part, order, step] = [len(left), len(gone), every - len(gone), sum(m[1] == f for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("window", [audit.WINDOW, 64])
def test_audit_equals_plain_counts(spark, monkeypatch, window):
    rows, labels = audit_rows()
    monkeypatch.setattr(audit, "WINDOW", window)  # in this process
    for t in [t for _, t, *_ in rows]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        m, w = audit.measure(raw, np.array([0, len(raw)])), WORDS.findall(t or "")
        assert [int(m[c][0]) for c in ("words", "distinct", "capitals", "symbols", "points")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t or "")), len(re.findall(r"[#$%&*|]", t or "")), len(t or "")]
    if window == 64:
        return
    got = audit.audit_filters(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got) and found == plain_audit(rows, labels)


def test_audit_many_texts_in_one_buffer():
    rows, _ = audit_rows(8)
    texts = [(t or "").encode() for _, t, *_ in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    m = audit.measure(data, offsets)
    assert m["distinct"].tolist() == [len(set(WORDS.findall(t or ""))) for _, t, *_ in rows]
    assert m["words"].tolist() == [len(WORDS.findall(t or "")) for _, t, *_ in rows]


def test_audit_counts_words_with_one_hash_exactly(monkeypatch):
    monkeypatch.setattr(audit, "word_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    data = np.frombuffer(b"a b a cc b dd cc", np.uint8)
    assert audit.measure(data, np.array([0, 5, 5, len(data)]))["distinct"].tolist() == [2, 0, 3]


def test_audit_of_nothing(spark):
    assert audit.audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = audit.audit_filters(spark.createDataFrame([(None, None, None, 1, "", 1, "", 1)], DOCS), spark.createDataFrame([], LABELS))
    assert {(r.part, r.kept + r.removed + r.redundant) for r in one.collect()} <= {("", 0), ("", 1)} and one.count() == 600


def vector_rows(seed=5, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dim))
    x = [*base, *(base[i % 60] + 0.03 * rng.normal(size=dim) for i in range(120)), *(base[3] + 0.02 * rng.normal(size=(90, dim))), *(base[7] * 3 for _ in range(5)), *(base[9] + 0.15 * rng.normal(size=(60, dim)))]
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 3)) if i % 11 else None) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [None] + [1.0] * (dim - 1), 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 1)]
    rows += [(n + 5, [1.0, 2.0], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1), (None, rows[1][1], rows[1][2]), (None, None, None), rows[1], rows[1]]
    return [r + (9, "?", 1, "v", 2) for r in rows]


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)


def plain_links(rows, dim):
    n = len(rows)
    fit = [usable(v, dim) and any(v) and label is not None for _, v, label, *_ in rows]
    up, links = list(range(n)), [0] * n

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    u = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in range(n) if fit[i]}
    for i, j in itertools.combinations(sorted(u), 2):
        if rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98:
            links[i] += 1
            links[j] += 1
            up[top(i)] = top(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, links[i], least.get(top(i)) if links[i] else k) for i, (k, *_) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("points", "chunk"), [(4096, 4096), (4096, 16), (1, 7)])
def test_vectors_equal_brute_force(spark, monkeypatch, points, chunk):
    monkeypatch.setattr(pivots, "POINTS", points)
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    rows = vector_rows()
    got = pivots.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == plain_links(rows, 12)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_close_group_is_counted_without_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.eye(8)[0] + 0.005 * rng.normal(size=8)], 1) + (0, "", 0, "", 0) for i in range(600)]
    got = pivots.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}
    x = pivots.units(np.array([r[1] for r in rows]))
    refs = pivots.References(x, 16, float(np.arccos(0.98)))
    assert (refs.describe(x)[1] >= 0).all()  # all are in a core, so no list holds a pair


def test_recall_at_the_threshold_of_unstructured_vectors():
    rng = np.random.default_rng(9)
    x = pivots.units(rng.normal(size=(6000, 64)))
    away = rng.normal(size=x.shape)
    away = pivots.units(away - (away * x).sum(1, keepdims=True) * x)
    refs = pivots.References(x, 512, float(np.arccos(0.98)))
    near, far = (np.sort(refs.describe(v)[0], axis=1) for v in (x, pivots.units(0.98 * x + np.sqrt(1 - 0.98**2) * away)))
    found = (near[:, :, None] == far[:, None, :]).any(2).sum(1) >= pivots.SHARED
    assert found.mean() >= 0.99
    first = pivots.first_shared(near[found], far[found])
    kept = pivots.NEAREST - pivots.SHARED + 1
    assert ((near[found][:, :kept] == first[:, None]).any(1) & (far[found][:, :kept] == first[:, None]).any(1)).all()


def test_vectors_of_empty_and_unusable_tables(spark):
    assert pivots.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    got = pivots.near_duplicate_vectors(spark.createDataFrame([(4, None, 1, 0, "", 0, "", 0), (None, [0.0], 1, 0, "", 0, "", 0)], VECTORS)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(4, 0, 4, True), (None, 0, None, True)}


def plain_negatives(rows, dim, every=50):
    best = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and usable(v, dim):
            one = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(c))) for c in v])
            best[i] = min(one, best.get(i, one))
    out = []
    for a in sorted(i for i in best if i % every == 0):
        score = {i: sum(x * y for x, y in zip(v, best[a][1])) for i, (_, v) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == best[a][0]][:5]:
            fit = [i for i in order if best[i][0] != best[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "least", "scale"), [(65536, 1024, 1.0), (40, 20, 1.0), (50, 30, 1e4), (64, 32, 3e4)])
def test_negatives_equal_full_search(spark, monkeypatch, block, least, scale):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LEAST_BLOCK", least)
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    rows = [(i, None if v is None else [None if c is None else c * scale for c in v], *rest) for i, v, *rest in vector_rows()]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], *rest) for i, v, *rest in rows]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(negatives.whole_vectors(df, label), every=10)
    want = plain_negatives(rows, 12, every=10)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_negatives_ties_limits_and_errors(spark):
    falling = np.array([100, 96, 95, 95, 60, 50, 49])
    assert negatives.within(falling, 100, 3) == slice(2, 5) and negatives.within(falling, 100, 9) == slice(2, 6)
    assert negatives.within(falling, -10, 3).stop == negatives.within(falling, -10, 3).start
    assert negatives.within(np.array([3, 0, 0, -1]), 0, 5) == slice(1, 3)
    assert negatives.ordered(np.array([5, 7, 5, 7]), np.array([4, 9, 1, 3])).tolist() == [3, 1, 2, 0]
    empty = negatives.whole_vectors(spark.createDataFrame([], VECTORS), F.col("label"))
    assert negatives.mine(empty).count() == 0
    big = spark.createDataFrame([(0, [3e20], 1, 0, "", 0, "", 0)], VECTORS)
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(negatives.whole_vectors(big, F.col("label")))
