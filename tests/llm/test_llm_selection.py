"""Filter audit, importance resampling and the embedding join against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import embedding_join, filter_audit, importance, queries

SMALL = "/root/testdata/sf0.001"
CLASHES = ["n", "part", "fails", "digest", "good", "first", "score", "bucket", "rank", "above", "at", "weight", "key", "vec", "copies", "block", "cell", "tied", "n_links"]


def clashing(frame):
    return frame.withColumns({c: F.lit("clash") for c in CLASHES if c not in frame.columns})


# 11 filter audit


def fails_of(texts):
    """For (doc_id, text) rows, the set of filters each row fails."""
    firsts = {}
    for i, text in texts:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    made = []
    for i, text in texts:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > firsts[text],
        }
        made.append({name for name, bad in failed.items() if bad})
    return made


def audit_by_brute_force(rows, labels):
    """Run every order of filters over all rows; labels: doc_id to a set of marks."""
    parts = defaultdict(list)
    for (i, _, source), failed in zip(rows, fails_of([(i, t) for i, t, _ in rows]), strict=True):
        parts[source or ""].append((failed, labels.get(i, set())))
    made, sums = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                made[part, order, step] = [
                    len(left), len(gone), sum(name in x[0] for x in docs) - len(gone), sum(x[0] == {name} for x in docs),
                    sum("good" in x[1] for x in gone), sum("toxic" in x[1] for x in gone),
                ]
                sums[part, name] += len(gone)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in made.items()}


def audited(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in frame.collect()}


def test_audit_of_all_documents_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {
        r["doc_id"]: {n for n, c in (("good", "quality"), ("toxic", "toxic")) if r[c] == 1}
        for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    }
    assert audited(queries.audit_filters(spark, SMALL)) == audit_by_brute_force(rows, labels)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, "s"), (2, "", None), (3, "", "s"), (4, long, ""), (4, long, "s"), (4, long, "s"), (5, long, "t"), (None, long, "t"), (None, None, None),
        (6, "A" * 300_000, "s"), (7, "x " * 300 + "#", "s"), (8, long + " ÄÖÜ", "s"), (9, " \n\t", "s"), (10, long, "t"),
    ]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    given = [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    labels = clashing(spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
    marks = {4: {"good", "toxic"}, 5: {"toxic"}, 6: {"good"}}
    assert audited(filter_audit.audit(docs, labels)) == audit_by_brute_force(rows, marks)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert {x[-3:] for x in audited(filter_audit.audit(docs, labels.where("false"))).values() if x[-3:-1] != (0, 0)} == set()


def test_least_squares_gives_mean_marginal_contributions():
    rng = random.Random(7)
    value = [0] + [rng.randint(-1000, 1000) for _ in range(31)]
    want = [Fraction(0)] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            want[i] += Fraction(value[before | 1 << i] - value[before], 120)
            before |= 1 << i
    assert filter_audit.shapley(value) == want


# 12 importance resampling


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(2)
    gain = rng.integers(-20_000, 20_000, 1003)
    counts = rng.integers(0, 5, (7, 1003))
    counts[0], counts[1, 5], counts[2, 1002] = 0, 3_000_000_000, 12_345
    assert (importance.GainPlanes(gain).sums(counts) == counts @ gain).all()
    for kept in (np.maximum(gain, 0), np.zeros_like(gain)):
        assert (importance.GainPlanes(kept).sums(counts) == counts @ kept).all()


def resampled_by_brute_force(docs, target, run=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        every = [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in every]

    rows = [(i, *found(t)) for i, t in docs]
    source, wanted = Counter(b for _, _, x in rows for b in x), Counter(b for t in target for b in found(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    scored = []
    for i, words, x in rows:
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((x for x in scored if x[4] >= min_words), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    rank = {id(x): k for k, x in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*x[:4], rank.get(id(x))) for x in scored), key=repr)


def test_resampling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()]
    assert sorted(map(tuple, queries.importance_resampling(spark, SMALL).collect()), key=repr) == resampled_by_brute_force(*given)
    options = {"run": 2, "buckets": 777, "min_words": 5, "percent": 35, "seed": 9}
    got = importance.resample(clashing(docs), clashing(target), **options).collect()
    assert sorted(map(tuple, got), key=repr) == resampled_by_brute_force(*given, **options)


def test_resampling_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, words), (3, words), (None, words), (4, "Ünï ¿ x\x00y" + words.upper()), (5, "a " * 200_000), (6, " \n")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    target = spark.createDataFrame([("w1 w2 w3 a",), (None,)], "text string")
    got = sorted(map(tuple, importance.resample(docs, target, percent=100).collect()), key=repr)
    want = resampled_by_brute_force(rows, ["w1 w2 w3 a", None], percent=100)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert sorted(x[4] for x in got if x[4]) == [1, 2, 3, 4, 5]
    assert importance.resample(docs.where("false"), target).count() == 0
    assert importance.resample(docs, target.where("false")).count() == len(rows)
    assert importance.resample(docs, target, percent=0).where("rank IS NOT NULL").count() == 0


# 13 embedding join


def joined_by_brute_force(vectors, cosine=Fraction("0.95")):
    """vec_id to n_links and component; vectors: (vec_id, list or None), ids unique."""
    def fine(v):
        return v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)

    width = max(len(v or []) for _, v in vectors)
    ids = [i for i, v in vectors if fine(v)]
    rows = np.array([[float(x) for x in v] + [0.0] * (width - len(v)) for _, v in vectors if fine(v)])
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    near = scaled @ scaled.T / np.outer(np.linalg.norm(scaled, axis=1), np.linalg.norm(scaled, axis=1))
    linked = near >= float(cosine)
    for a, b in np.argwhere(np.abs(near - float(cosine)) < 1e-12):
        x, y = ([Fraction(v) for v in rows[k].tolist()] for k in (a, b))
        dot = sum(p * q for p, q in zip(x, y, strict=True))
        linked[a, b] = dot > 0 and dot * dot >= cosine * cosine * sum(p * p for p in x) * sum(q * q for q in y)
    np.fill_diagonal(linked, False)
    root = {i: i for i, _ in vectors}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(linked):
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    counts = dict(zip(ids, linked.sum(axis=1).tolist(), strict=True))
    return {i: (counts.get(i, 0), find(i), find(i) == i) for i, _ in vectors}


def joined(frame, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_duplicates(frame, **options).collect()}


def planted(rng, n=400, width=24):
    """Loose points, groups of near copies of many spreads, a chain, exact and scaled copies, ties at the threshold."""
    made = list(rng.normal(size=(n, width)))
    for spread in (0.01, 0.1, 0.2, 0.25):
        base = rng.normal(size=width)
        base /= np.linalg.norm(base)
        made += [base + spread * x / np.linalg.norm(x) for x in rng.normal(size=(60, width))]
    x, y = np.linalg.qr(rng.normal(size=(width, 2)))[0].T
    made += [math.cos(0.2 * k) * x + math.sin(0.2 * k) * y for k in range(25)]
    made += [made[3]] * 40 + [made[3] * 2, made[3] * 7, -made[3]]
    tie = np.zeros((3, width))
    tie[0, 0], tie[1, :4], tie[2, 0] = 1.0, (19.0, 5.0, 3.0, math.sqrt(5.0)), 1e-300
    exact = np.zeros((2, width))
    # 19 * 19 + 39 = 400: a cosine of exactly 19 / 20 with the first axis.
    exact[0, 0], exact[1, :4] = 3.0, (19.0, 6.0, 1.0, 1.0)
    exact[1, 4] = 1.0
    return [list(map(float, v)) for v in [*made, *tie, *exact]]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1, "directions": 3, "sample": 50}])
def test_links_equal_brute_force(spark, options):
    vectors = list(enumerate(planted(np.random.default_rng(5))))
    random.Random(1).shuffle(vectors)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    assert joined(frame, **options) == joined_by_brute_force(vectors)


def test_exact_ties_link():
    one, two = np.array([[3.0, 0, 0, 0, 0]]), np.array([[19.0, 6.0, 1.0, 1.0, 1.0]])
    assert embedding_join.surely(one[0], two[0], Fraction("0.95")) and not embedding_join.surely(one[0], two[0] + [0, 0, 0, 0, 1e-9], Fraction("0.95"))


def test_registered_join_equals_brute_force(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.grid_order_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == joined_by_brute_force(vectors)


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [2.0, 0.0, -0.0]), (9, [1e-30, 0.0]), (10, [0.0, 1.0]),
    ]
    frame = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    assert joined(frame) == joined_by_brute_force(vectors)
    again = [(None, [1.0, 0.0]), (None, None), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0]), (5, [1.0, 0.0])]
    rows = embedding_join.near_duplicates(spark.createDataFrame(again, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(None, 0, None, False)] * 2 + [(5, 2, 5, True)] * 2 + [(6, 2, 5, False), (5, 0, 5, True)], key=repr)
    assert embedding_join.near_duplicates(frame.where("false")).count() == 0
    assert embedding_join.near_duplicates(frame.where("vec_id < 4")).count() == 3


def test_distant_intervals_are_skipped():
    rng = np.random.default_rng(3)
    centres = np.eye(8)[np.repeat(np.arange(8), 256)]
    units = embedding_join.units(centres + 0.05 * rng.normal(size=centres.shape))
    side = embedding_join.Side(units, units, np.ones(len(units)))
    work = embedding_join.BlockJoin(side, side, 0.95)
    work.join((0, len(side)), (0, len(side)))
    assert work.compared <= 8 * 3 and (work.links == ((units @ units.T) >= 0.95).sum(axis=1) - 1).all()
