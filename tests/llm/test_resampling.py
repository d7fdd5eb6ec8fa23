"""Importance resampling, embedding near-dedup and the filter audit against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from gridloom.llm import common, filter_audit, importance, vector_dedup

DOCS = "doc_id long, text string, source string, score long, rank long, bucket int, mask int, low long, part string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5, "x") for i, t, s in rows], DOCS)


def benchmark(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), w + [a + " " + b for a, b in itertools.pairwise(w)]


def resampled(rows, target):
    at = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(map(at, grams(text)[1]))
    for text in target:
        t.update(map(at, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (all_s + 10000) / (float(s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text, _ in rows:
        n, g = grams(text)
        weight = sum(gain(at(x)) for x in g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, n])
    may = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeXYé9") for _ in range(3)) for _ in range(400)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60)), "s") for i in range(150)]
    rows += [(150, None, None), (151, "", "s"), (152, " .,; ", "s"), (None, text(30), "s"), (None, None, "s"), (153, text(60_000), "s")]
    rows += [(200, text(25), "s")] * 5 + [(201 + i, "same " * 25, "s") for i in range(40)]
    return rows, [text(40) for _ in range(10)] + [None, ""]


def test_resampling_is_that_of_plain_python(spark, monkeypatch):
    rows, target = corpus()
    monkeypatch.setattr(importance, "CHUNK_BYTES", 900)
    got = importance.op11(docs(spark, rows), benchmark(spark, target))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target)


@pytest.mark.parametrize(("rows", "target"), [([], ["a b"]), ([(1, "a " * 30, "s")], []), ([(1, None, "s")], [None])])
def test_resampling_of_empty_tables(spark, rows, target):
    got = importance.op11(docs(spark, rows), benchmark(spark, target)) if rows else importance.op11(docs(spark, [(1, "x", "s")]).where("doc_id < 0"), benchmark(spark, target))
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target)


def test_dictionary_holds_each_string_once(spark):
    texts = benchmark(spark, ["a b a b", "B c", "\x00a\x7f", None])
    n = {r.bucket: r.n for r in importance.bucket_counts(texts).collect()}
    want = Counter(zlib.crc32(g.encode()) % 10000 for t in ("a b a b", "B c", "a") for g in grams(t)[1])
    assert n == dict(want)


def test_groups_of_strings():
    hashes = np.arange(0, 1 << 32, 99_991)
    for groups in (1, 7, 10_000, 45_000):
        grp = importance.group_of(hashes, groups)
        # each bucket's strings stand in few groups, so few rows leave the dictionary
        assert len(set(zip(grp.tolist(), (hashes % 10_000).tolist(), strict=True))) <= 10_000 * -(-groups // 10_000)


def test_ranks_without_a_single_task_for_ties(spark):
    rows = spark.createDataFrame([(i % 3, i, "x") for i in range(500)], "k long, i long, place string")
    got = importance.ranked(rows.select("k", "i"), common.F.col("k").desc()).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert all(a.k >= b.k for a, b in itertools.pairwise(sorted(got, key=lambda r: r["rank"])))


VECTORS = "vec_id long, embedding array<double>, label int, node long, cell long, key string"


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    centre = rng.normal(size=(6, 16))
    near = np.concatenate([c + s * rng.normal(size=(90, 16)) for c, s in zip(centre, (0.01, 0.05, 0.08, 0.12, 0.15, 0.2), strict=True)])
    rows = [(i, list(map(float, v)), int(rng.integers(2))) for i, v in enumerate(np.concatenate((x, near * rng.uniform(0.1, 9, (len(near), 1)))))]
    rows += [(5000 + i, [1.0] * 16, 1) for i in range(60)] + [(6000, [1e200] * 16, 1), (6001, [-0.0] + [1e-3] * 15, 1), (6002, [0.0] + [1e-3] * 15, 1)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0] * 15]
    rows += [(7000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(8000, [1.0] * 16, None), (None, [1.0] * 16, 1), (5000, [1.0] * 16, 1), (5001, rows[3][1], 1)]
    return rows


def deduplicated(rows, least=0.98):
    fine = [
        i for i, (k, v, label) in enumerate(rows)
        if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, n = [], Counter()
    for label, size in {(rows[i][2], len(rows[i][1])) for i in fine}:
        at = [i for i in fine if rows[i][2] == label and len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a < b:
                links.append((at[a], at[b]))
                n.update((at[a], at[b]))
    comp = brute.components(range(len(rows)), links)
    low: dict = {}
    for i, c in comp.items():
        low[c] = min((x for x in (low.get(c), rows[i][0]) if x is not None), default=None)
    return sorted(((k, n[i], low[comp[i]], k == low[comp[i]]) for i, (k, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("cell", "block", "few"), [(4096, 2048, 500_000), (40, 2048, 500_000), (60, 16, 500_000), (60, 32, 0)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, cell, block, few):
    rows = vectors()
    for name, value in (("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(vector_dedup, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    got = vector_dedup.op12(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == deduplicated(rows)


def test_no_vectors(spark):
    assert vector_dedup.op12(spark.createDataFrame([], VECTORS)).collect() == []


def test_linked_vectors_share_a_cell():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(3000, 8)))
    y = unit(x + 0.05 * rng.normal(size=x.shape))
    linked = (x * y).sum(1) >= 0.98
    centroids = vector_dedup.fitted(x, 20, 0.4)
    for a, b in zip(vector_dedup.standing(x, centroids, 0.1), vector_dedup.standing(y, centroids, 0.1), strict=True):
        assert len(a) and len(b)
    shared = [bool(set(a) & set(b)) for a, b in zip(vector_dedup.standing(x, centroids, 0.1), vector_dedup.standing(y, centroids, 0.1), strict=True)]
    assert linked.sum() > 500 and np.array(shared)[linked].all()


def audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low: dict = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    parts: dict = {}
    for i, t, s in rows:
        t = t or ""
        w = brute.words(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > low[t],
        }
        parts.setdefault(s or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, held in parts.items():
        shapley, mine = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in held)
                row = ("".join(order), step + 1, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in held))
                mine.append((part, *row, sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in mine]
    return sorted(out)


def test_audit_is_that_of_removing_rows(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "word " * 60, "SHOUT " * 60, "a#b", "x" * 300_000 + " $", " ".join(map(str, range(70)))]
    texts += [" ".join(rng.choice(["one", "Two", "three|", "FOUR", str(k)]) for _ in range(rng.randrange(90))) for k in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(300)]
    rows += [(7, rows[7][1], "s")] * 3 + [(None, "a#b", "t"), (None, "only here", "u"), (None, None, None)] + [(400 + i, "hot copy", "s") for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 450, 2)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit(rows, labels)
    for few in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", few)
        monkeypatch.setattr(common, "HOT", 10)
        assert sorted(map(tuple, filter_audit.op13(docs(spark, rows), table).collect())) == want
    assert filter_audit.op13(docs(spark, rows).where("false"), table).collect() == []
    assert filter_audit.op13(docs(spark, rows), table.where("false")).where("good_lost + toxic_lost > 0").collect() == []


def test_orders_by_adjacent_swaps():
    order = list(range(5))
    seen = {tuple(order)}
    for i in filter_audit.swaps(5):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == 120 and len(list(filter_audit.swaps(5))) == 119
