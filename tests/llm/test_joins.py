import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from gridloom.llm import common, jaccard_join, line_dedup, nn_descent, packing, quality_model
from gridloom.llm.common import documents

DOCS = "doc_id long, text string, source string, sid long, block long, lead string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 2, "x") for i, t in rows], DOCS)


def near_copies():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    texts = [None, "", " \t", "one two", "ONE  two", "one two three", "x " * 400, "x " * 500]
    for n in (6, 30, 200, 900):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 3
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(70)) + " " + passage for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "few"), [(256, 500_000), (8, 500_000), (16, 0)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block, few):
    rows = near_copies()
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ASKING", 4 * block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", few)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(common, "HOT", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op7(docs(spark, rows)).collect()}
    assert got == brute.jaccard_components(dict(rows))


def test_no_documents(spark):
    assert jaccard_join.op7(docs(spark, [(1, "x")]).where("doc_id < 0")).collect() == []
    assert jaccard_join.deduplicated(docs(spark, [(1, "x")]).where("doc_id < 0")).collect() == []


def test_no_hot_key_in_a_join_that_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 7)], "k long, v long")
    small = spark.createDataFrame([(i, -i) for i in range(200)], "k long, w long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).collect()), key=repr)
        monkeypatch.setattr(common, "HOT", 5)
        assert sorted(map(tuple, common.met(big, small, "k", how).collect()), key=repr) == want


def test_a_leading_shingle_of_a_linked_pair_is_early_in_the_smaller():
    rng = np.random.default_rng(8)
    for _ in range(300):
        base = np.unique(rng.integers(0, 400, 60))
        a, b = (np.unique(np.concatenate((rng.choice(base, rng.integers(40, len(base)), replace=False), rng.integers(0, 400, rng.integers(0, 9))))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        if 100 * (n := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - n):
            first = np.intersect1d(a, b)[0]
            assert first in a[: jaccard_join.early(len(a))] and first in b[: len(b) - jaccard_join.needed(len(b)) + 1]


def test_one_of_each_group_stays(spark):
    rows = near_copies()
    want = {c for _, c in brute.jaccard_components(dict(rows)).values()}
    df = docs(spark, [*rows, rows[20], (None, "no id")])
    kept = jaccard_join.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_rows_with_clashing_ids_are_documents_of_their_own(spark):
    rng = random.Random(6)
    a, b, c = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, a + " end"), (8, ""), (8, None), (8, " ")]
    kept = [(r.doc_id, r.text) for r in jaccard_join.deduplicated(docs(spark, rows)).collect()]
    own = [(i, t) for i, t in enumerate([a, a, b, b, b, c, a + " end", "", None, " "])]
    want, seen = [], set()
    for i, (_, k) in sorted(brute.jaccard_components(dict(own)).items()):
        if k not in seen:
            seen.add(k)
            want.append(rows[i])
    assert sorted(kept, key=repr) == sorted(want, key=repr) and (5, b) in kept and (7, c) in kept


def test_the_tree_links_what_brute_force_links():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 5000, 80))
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(50, 80), replace=False), rng.integers(0, 5000, rng.integers(0, 12))))) for _ in range(60)]
    sets = [s for i, s in enumerate(sets) if not any(np.array_equal(s, t) for t in sets[:i])]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    want = brute.components(range(len(sets)), links)
    got = jaccard_join.joined(sets, list(range(len(sets))), list(range(len(sets))))
    assert {(i, j): got[i] == got[j] for i in want for j in want} == {(i, j): want[i] == want[j] for i in want for j in want}


@pytest.mark.parametrize("fine", [1, jaccard_join.FINE])
def test_parity_maps_never_overstate_the_difference(fine):
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 40, rng.integers(1, 300))) for _ in range(2))
        b = np.unique(np.concatenate((b, rng.choice(a, len(a) // 2))))
        maps = sorted((np.frombuffer(jaccard_join.parity(s, fine), np.uint8) for s in (a, b)), key=len)
        while len(maps[1]) > len(maps[0]):
            half = len(maps[1]) // 2
            maps[1] = maps[1][:half] ^ maps[1][half:]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r], "c", 7) for i, r in enumerate(x)]
    odd = [(500, None, "c", 7), (520, [0.0] * 8, "c", 7), (540, [float("nan")] * 8, "c", 7), (560, [None] + [1.0] * 7, "c", 7), (580, [float("inf")] * 8, "c", 7), (600, [1.0], "c", 7), (None, [1.0] * 8, "c", 7), (620, [], "c", 7)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, bucket string, node int")
    got: dict = {}
    for r in nn_descent.op9(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(400), -scores))[:20]
        hits += len({v for v, _ in found} & set(want.tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0])) and all(abs(s - scores[v]) < 1e-9 for v, s in found)
    assert hits >= 0.95 * 400
    few = nn_descent.op9(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert nn_descent.op9(df.where("vec_id = 0")).collect() == [] and nn_descent.op9(df.where("vec_id < 0")).collect() == []


def test_quality_scores_are_those_of_a_numpy_discriminant(spark):
    """Class covariances shrunken towards the pooled one, then towards its diagonal; log densities by solving, not by factors."""
    rng = random.Random(9)
    good, bad = ["the", "and", "of", "river", "stone", "letter", "morning", "house"], ["$$$", "CLICK", "###", "win", "win", "1000"]
    rows = []
    for i in range(160):
        words = good if i % 2 else bad
        text = " ".join(rng.choice(words if rng.random() < 0.85 else good + bad) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randrange(3, 120)))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, "   "), (203, "word " * 20_000), (7, rows[7][1]), (None, "no id")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 160, 1) if i % 3] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score, r.predicted, r.held_out) for r in quality_model.op5(table, labels).collect())
    x = sorted((r[0] if r[0] is not None else -1, list(r[1])) for r in table.select("doc_id", quality_model.statistics(common.F.col("text"))).collect())
    out = lambda i: i >= 0 and zlib.crc32(str(i).encode()) % 4 == 2
    label = {i: i % 2 for i in range(160) if i % 3}
    data = {k: np.array([v for i, v in x if i in label and label[i] == k and not out(i)]) for k in (0, 1)}
    n = {k: len(v) for k, v in data.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in data.items()}
    pooled = sum(n[k] * cov[k] for k in cov) / sum(n.values())
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))

    def density(v, k):
        s = (1 - quality_model.SHRINK_POOLED) * cov[k] + quality_model.SHRINK_POOLED * pooled
        s = (1 - quality_model.SHRINK_IDENTITY) * s + quality_model.SHRINK_IDENTITY * scale + 1e-6 * np.eye(len(s))
        d = np.array(v) - data[k].mean(0)
        return -0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1])

    prior = np.log(n[1] / n[0])
    for (i, score, predicted, held), (_, v) in zip(got, x, strict=True):
        want = 1 / (1 + np.exp(-np.clip((density(v, 1) - density(v, 0)) / quality_model.TEMPER + prior, -500, 500)))
        assert abs(score - want) < 1e-6 and predicted == (score >= 0.7) and held == out(i)
    assert len(got) == len(rows)


def test_recall_in_groups_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=32) + s * rng.normal(size=(500, 32)) for s in (0.001, 0.003, 0.01)] + [rng.normal(size=(300, 32))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nn_descent.op9(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(found) == 20
        hits += len(found & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 90 and hits >= 0.95 * 20 * 90


def test_rows_that_repeat_an_id_are_vectors_each(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(62, 6)).astype(np.float32).astype(np.float64)
    ids = [*range(60), 20, 20]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nn_descent.op9(df).collect())
    want = []
    for q in (0, 20, 40, 60, 61):
        s = x @ x[q]
        rest = [j for j in np.lexsort((ids, -s)) if j != q][:20]
        want += [(ids[q], k + 1, ids[j], round(float(s[j]), 9)) for k, j in enumerate(rest)]
    assert got == sorted(want)


TEXTS = [None, "", "a short text", "word " * 3000, "漢字 and 𝔘nicode — “quotes” <|endoftext|>", "x" * 5000, " \n\n  \t", *["some text of a few words number %d" % i * (i % 40 + 1) for i in range(150)]]


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary()[0])
    rows = packing.op10(docs(spark, list(enumerate(TEXTS)))).collect()
    total, by_doc, by_sequence = 0, {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= total / 2048 * 1.02 + 2
    assert packing.op10(docs(spark, [(0, "x")]).where("doc_id < 0")).collect() == []


def sequences_of(plan, counts, capacity):
    """Checks that a plan places each piece once, without gaps or overlaps; the number of sequences."""
    plan = sorted(plan)
    used: dict = {}
    for i, (length, rank, first, offset) in enumerate(plan):
        nxt = plan[i + 1] if i + 1 < len(plan) and plan[i + 1][0] == length else None
        assert rank == 0 if i == 0 or plan[i - 1][0] != length else rank > plan[i - 1][1]
        for k in range((nxt[1] if nxt else counts[length]) - rank):
            used.setdefault(first + k, []).append((offset, length))
    assert sum(len(u) for u in used.values()) == sum(counts.values())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("kind", ["mixed", "small", "halves"])
def test_supersteps_use_about_as_few_sequences_as_best_fit(spark, kind):
    rng = random.Random(9)
    counts = {
        "mixed": {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(20)},
        "small": {3: 5000},
        "halves": {33: 4, 32: 7, 31: 9, 64: 2},
    }[kind]
    plan = packing.best_fit(spark.createDataFrame(list(counts.items()), "length long, n long"), 64).collect()
    got = sequences_of([tuple(r) for r in plan], counts, 64)
    assert got <= 1.02 * brute.best_fit(counts, 64) + 1


def test_fast_and_slow_encoders_agree():
    fast, slow = packing._encoder(*packing.vocabulary()), packing._encoder.__wrapped__(packing.vocabulary()[0], None)
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), 0x20AC]):
        for form in ("a{}b 1{}2 {}{} {}\n{}x", "{}", " {}{}'s{}'ll  {}   {}", "\n\n{} {}\n"):
            text = form.replace("{}", c)
            assert packing.PLAIN.search(text) is None and fast(text).tolist() == slow(text).tolist(), hex(ord(c))
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x" * 3000 + " " * 3000 + "7" * 3000, "\n" * 500 + "\t" * 500 + "-" * 500]:
        assert fast(text).tolist() == slow(text).tolist()
    assert slow("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_fast_and_slow_encoders_agree_on_documents():
    import pyarrow.parquet as pq

    fast, slow = packing._encoder(*packing.vocabulary()), packing._encoder.__wrapped__(packing.vocabulary()[0], None)
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist():
        assert fast(t or "").tolist() == slow(t or "").tolist()


def test_pipeline_stages_are_those_of_brute_force(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "src1", 0), (900_003, "one two", "en", None, 7)]
    start = documents(spark, d)
    start = start.union(spark.createDataFrame(odd, start.schema)).union(start.where("doc_id = 7"))
    stages = dict(pipeline.STAGES)

    def after(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, start.schema), d)
        assert out.columns == start.columns, name
        return out.collect()

    rows = start.collect()
    good = {r.doc_id for r in quality_model.op5(start, documents(spark, d, "labels")).collect() if r.predicted}
    kept = after("quality classifier", rows)
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in rows if r.doc_id in good) and 0 < len(kept) < len(rows)
    cleaned = after("line dedup", rows)
    want = brute.without_boilerplate([(r.source, r.text) for r in rows], line_dedup.RATIO, line_dedup.MARGIN, line_dedup.SPARE)
    assert Counter((r.doc_id, r.source, r.text) for r in cleaned) == Counter((r.doc_id, r.source, t) for r, t in zip(rows, want, strict=True))
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cleaned)
    one = after("n-gram Jaccard join", rows)
    groups = brute.jaccard_components({i: r.text for i, r in enumerate(rows)})
    assert Counter(r.text for r in one) == Counter(rows[c].text for c in {c for _, c in groups.values()})
    mixed = after("mixing sources", rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    targets, taken = brute.mix_targets(dict(sizes)), Counter()
    for r in mixed:
        taken[r.source] += len(brute.words(r.text))
    longest = max(len(brute.words(r.text)) for r in rows)
    assert all(abs(taken[s] - t) <= longest for s, t in targets.items()) and max(Counter(map(tuple, mixed)).values()) <= 4
    counts = Counter(r.doc_id for r in rows)
    packed = stages["best-fit packing"](spark, spark.createDataFrame(rows, start.schema), d).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == counts
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False)) and places[-1][1] <= 2048
    empty = start.where("doc_id < 0")
    assert all(stage(spark, empty, d).collect() == [] for _, stage in pipeline.STAGES)
