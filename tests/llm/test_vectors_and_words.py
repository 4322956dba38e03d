import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import spelling, whitening


def brute_whitening(rows):
    """n, deviations, whitened values (up to sign) and explained parts, by an eigendecomposition of the whole covariance."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    z = (u - total // n) - (total % n) / n
    w, q = np.linalg.eigh(z.T @ z / n)
    w, q = w[::-1][:16], q[:, ::-1][:, :16]
    own = (x - total // n) - (total % n) / n
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]
    return n, deviation, own @ q / np.sqrt(w), w / np.trace(z.T @ z / n)


def test_whitening_is_that_of_the_whole_covariance(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 20)) @ np.diag(np.geomspace(3, 0.2, 20)) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    rows = [(i, [float(np.float32(c)) for c in base[i % 250]]) for i in range(300)] + [(i, [float(np.float32(c)) for c in base[0]]) for i in range(300, 400)]
    df = spark.createDataFrame([*rows, (7, None), (8, []), (9, [None] * 20), (10, [float("nan")] * 20), (11, [float("inf")] + [1.0] * 19), (12, [1e200] * 20), (13, [1.0] * 3)], "vec_id long, embedding array<float>")
    got = whitening.report(df.withColumn("component", F.lit("clash")).withColumn("_x", F.lit(1))).orderBy("vec_id", "component").toPandas()
    n, deviation, white, explained = brute_whitening(rows)
    assert len(got) == 16 * 400 and (got.n == n).all() and got.identity_error.max() < 1e-12
    assert got.deviation.tolist()[::16] == deviation
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-9
    assert (np.abs(mine - white).max(axis=0) < 1e-9).tolist() == (np.abs(mine + white).max(axis=0) > 1e-3).tolist()
    assert got.explained.tolist()[:16] == pytest.approx(list(explained))


def test_whitening_without_variance_and_of_few_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.report(spark.createDataFrame([], kind)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [3.0, 6.0, 5.0])]
    got = whitening.report(spark.createDataFrame(line, kind)).toPandas()
    assert len(got) == 10 and set(got.component) == {1} and got.explained.tolist() == pytest.approx([1.0] * 10) and got.identity_error.max() < 1e-12
    assert got.vec_id.isna().sum() == 1 and got.n.tolist() == [9] * 10
    huge = whitening.report(spark.createDataFrame([(i, [1e12 * i, float(i % 3)]) for i in range(5)], kind)).toPandas()
    assert huge.deviation.isna().sum() > 0 and huge.identity_error.max() < 1e-4


def test_whitened_column_joins_the_others(spark):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 7)], "own") for i in range(40)], "vec_id long, embedding array<double>, whitened string").withColumn("label", F.lit(1))
    out = whitening.whiten(df)
    assert set(out.columns) == {"vec_id", "embedding", "label", "whitened"} and out.count() == 40
    w = np.array([r.whitened for r in out.dropDuplicates(["embedding"]).collect()])
    assert np.abs(w.T @ w / len(w) - np.eye(2)).max() < 1e-12


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(found):
    form, near = {}, {}
    for w in found:
        near[w] = [v for v in found if v != w and one_apart(v, w)]
        best = min(near[w], key=lambda v: (-found[v], v), default=None)
        form[w] = best if best is not None and found[best] >= 10 * found[w] else None
    out = []
    for w in found:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, found[w], len(near[w]), found[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def spelt(spark):
    rng = random.Random(6)
    stems = ["straßenbahn", "ÉCOLIÈRES", "tttttttt", "spelling", "variants", "éàüöñßxy", "neighbour", "neighbor", "x" * 70]
    rows = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = stems[min(int(rng.expovariate(0.6)), len(stems) - 1)]
            for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("aeßÿzÀ") + w[k:], w[:k] + rng.choice("aeßÿzÀ") + w[k + 1 :]))
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, rng.choice((" ", ", ", "-1")).join(words)))
    rows += [(100, None), (101, ""), (None, "spelling spelling"), (102, "tttttttttt " * 400), (102, "tttttttttt " * 400), (103, "a" * 5000 + " " + "a" * 4999 + " " + "a" * 5000 + " " + "a" * 4999)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_words_and_groups_are_brute_force(spelt):
    rows, df = spelt
    found = brute_words(rows)
    assert {r.word: r.n for r in spelling.words(df).collect()} == found and len(found) > 200
    got = sorted(tuple(r) for r in spelling.report(df.withColumns({"word": F.lit(1), "n": F.lit("clash")})).collect())
    assert got == brute_groups(found) and any(g[2] not in (g[0], g[1]) for g in got) and max(g[4] for g in got) > 9


def test_slices_of_the_filters_give_the_same_groups(spelt, monkeypatch):
    rows, df = spelt
    monkeypatch.setattr(spelling, "PIECE", 4)
    monkeypatch.setattr(spelling, "SLICE_BYTES", 512)
    got = sorted(tuple(r) for r in spelling.report(df).collect())
    assert got == brute_groups(brute_words(rows))


def test_full_filters_only_cost_time(spelt, monkeypatch):
    rows, df = spelt
    monkeypatch.setattr(spelling, "BITS", 0.2)
    assert sorted(tuple(r) for r in spelling.report(df).collect()) == brute_groups(brute_words(rows))


def test_no_words(spark):
    kind = "doc_id long, text string"
    for rows in ([], [(1, None), (2, "")], [(1, "onlyonce and short")]):
        assert spelling.report(spark.createDataFrame(rows, kind)).count() == 0


def test_generated_edits_name_all_neighbours():
    letters = np.frombuffer("aabca".encode("latin-1"), np.uint8).reshape(1, 5)
    alphabet = np.frombuffer(b"abc", np.uint8)

    def code(w):
        return int(spelling._code(spelling._terms(np.frombuffer(w.encode("latin-1"), np.uint8).reshape(1, -1)).sum(axis=1), len(w))[0])

    made = {int(c) for _, _, _, _, codes in spelling.edits(letters, alphabet) for c in codes}
    want = {"aabca"[:i] + "aabca"[i + 1 :] for i in range(5)} | {"aabca"[:i] + c + "aabca"[i + 1 :] for i in range(5) for c in "abc" if c > "aabca"[i]}
    assert made == {code(w) for w in want}
