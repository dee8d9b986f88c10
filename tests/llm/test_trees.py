"""Centroids, quality classifier and manifest against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroids, manifest, quality
from lodestone.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def multiset(rows):
    return Counter(map(repr, rows))


# 11. centroids


def plain_clusters(rows, k, rounds):
    """rows: (id, vector); Lloyd's rounds in Python's integers. ((id, cluster, distance), centroids)."""
    points = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows]
    first = sorted(((sha(f"3:{i}") if i is not None else "~", v, n) for n, (i, v) in enumerate(rows)))[:k]
    centers = [points[n][1] for _, _, n in first]

    def assign():
        out = []
        for i, p in points:
            d, z = min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), z) for z, c in enumerate(centers))
            out.append((i, z, d))
        return out

    for _ in range(rounds):
        own = assign()
        for z in range(len(centers)):
            mine = [p for (_, p), (_, of, _) in zip(points, own, strict=True) if of == z]
            if mine:
                centers[z] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return assign(), centers


def wanted(rows, k, rounds):
    own, centers = plain_clusters(rows, k, rounds)
    long = lambda x: x if x < 1 << 63 else None
    per = Counter()
    for _, z, d in own:
        per[z] += d
    return multiset((i, z, long(d), long(per[z]), long(sum(per.values())), ",".join(map(str, centers[z]))) for i, z, d in own)


def seed():
    return F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256)


def clustered(spark, rows, k, rounds, width, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, tree int").repartition(parts)
    out = centroids.cluster(centroids.vectors(df, width), k, rounds, width, seed()).collect()
    return multiset(tuple(r) for r in out)


def test_op11_is_plain_clustering(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if len(r["embedding"]) == 64]
    got = QUERIES["op11_centroids"](spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = Counter()
    for text, n in wanted(rows, 8, 10).items():
        i, z, d, a, b, c = eval(text)
        want[repr((i, z, d, a, b, sha(c)))] += n
    assert multiset(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize(("width", "spread", "n"), [(2, 1.0, 3000), (5, 0.05, 500), (3, 3000.0, 400), (2, 1e200, 60)])
def test_clusters_prune_and_stay_exact(spark, width, spread, n):
    rng = np.random.default_rng(width)
    v = (rng.integers(-4, 5, (n, 1)) * spread + rng.normal(0, spread / 9, (n, width))).tolist()
    v[: n // 3] = [v[0]] * (n // 3)  # copies
    rows = [(int(i), x) for i, x in enumerate(v)]
    assert clustered(spark, [(*r, "x", 1) for r in rows], 6, 4, width) == wanted(rows, 6, 4)


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, -1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])]
    kept = [r for r in rows if r[0] in (1, None, 8)]
    for k in (1, 2, 3, 8):
        assert clustered(spark, [(*r, None, 1) for r in rows], k, 3, 2) == wanted(kept, k, 3)
    assert clustered(spark, [(2, None, None, 1)], 2, 3, 2) == Counter()


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-50, 50, (500, 3)) + c for c in ([0, 0, 0], [5000, 0, 0], [0, 5000, 0])]).astype(np.int32)
    tree, order = centroids.build(points)
    assert (points[order] == tree.points).all()
    done, rows, _ = centroids.descend(tree, np.array([[0, 0, 0], [5000, 0, 0], [0, 5000, 0]]))
    taken = sum(int(tree.last[j] - tree.first[j]) for j, _ in done)
    assert taken + len(rows) == 1500 and taken > 1350 and len(done) < 20  # the rest: leaves that lie across two groups


# 12. quality


def plain_features(t):
    b = t.encode()
    out = [("end",)]
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    out += [("w", x) for x in w] + [("p", x, y) for x, y in zip(w, w[1:], strict=False)]
    for k in quality.GRAMS:
        for x in w:
            m = b"\x02" + x + b"\x03"
            out += [(k, m[i : i + k]) for i in range(len(m) - k + 1)]
    return out


def test_features_are_those_of_the_texts():
    texts = ["the cat  sat\n", "", "the", "é 日本 the cat", " \t ", "a b a b a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = [Counter() for _ in texts]
    for place, text in quality.features(data, offsets):
        for p, t in zip(place.tolist(), text.tolist(), strict=True):
            got[t][p] += 1
    to = {}
    for t, places in zip(texts, got, strict=True):
        want = Counter(plain_features(t))
        assert sorted(want.values()) == sorted(places.values())
        alone = [Counter() for _ in range(1)]
        for place, _ in quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])):
            alone[0].update(place.tolist())
        assert alone[0] == places  # a text's features do not depend on its neighbours
        to |= {t: places}
    assert sum((to["the"] & to["the cat  sat\n"]).values()) == len(plain_features("the"))


def test_op12_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op12_quality"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    quality_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(quality_of[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in quality_of]
    assert np.mean([a == b for a, b in held]) > 0.95 and np.mean([b for a, b in held if a == 0]) < 0.3
    assert multiset(rows) == multiset(QUERIES["op12_quality"](spark, sf).collect())


def test_quality_of_odd_rows(spark, docs, rows, empty):
    bad = [(i, "!!! ### " * (i % 7 + 1)) for i in range(2000, 2040)]
    train = docs.select("doc_id", "text").unionByName(spark.createDataFrame(bad, "doc_id long, text string"))
    given = [(i, 0, 1) for i, _ in bad] + [(i, 1, 0) for i in range(120)] + [(3, 0, 1), (4, None, 1), (None, 1, 1), (99999, 1, 1), (5, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, text int")
    model = quality.learn(train, labels, "quality")
    assert model.classes == [0, 1] and model.adds.shape == (2, quality.BUCKETS)
    got = quality.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1000, 1001, 1002)}
    assert len(blank) == 1  # null, empty and white space are one text
    seen = {r["doc_id"]: r["score"] for r in quality.score(train, model).collect()}
    assert max(seen[i] for i, _ in bad) < 0.3 < min(seen[i] for i in range(6, 100))
    assert quality.score(empty, model).count() == 0
    none = quality.learn(empty, labels, "quality")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.learn(train, labels.filter("quality = 1"), "quality")
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 5)
    many = spark.createDataFrame([(i % 3, f"text {i} of a key that comes often") for i in range(300)], "doc_id long, text string")
    model = quality.learn(many, spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int"), "quality")
    assert round(float((model.shares * 5).sum())) == 5 and all(x * 5 == round(x * 5) for x in model.shares)


# 13. manifest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_manifest(rows, tampered):
    """rows: (doc_id, source, leaf, leaf to fold in); (doc_id, leaf, subroot, root, proof, folded)."""
    proof, folds = {}, {}

    def fold(nodes):  # nodes: (digest, rows below)
        while len(nodes) > 1:
            up = []
            for at in range(0, len(nodes), 16):
                run = nodes[at : at + 16]
                for i, (_, below) in enumerate(run):
                    others = [d for d, _ in run]
                    for n in below:
                        proof[n] += "".join(others[:i] + others[i + 1 :])
                        folds[n] = sha("".join([*others[:i], folds[n], *others[i + 1 :]]))
                up.append((sha("".join(d for d, _ in run)), [n for _, below in run for n in below]))
            nodes = up
        return nodes[0]

    order = sorted(range(len(rows)), key=lambda n: (rows[n][1] is not None, (rows[n][1] or "").encode(), rows[n][0] is not None, rows[n][0] or 0, rows[n][2]))
    trees, sub = [], {}
    for n in order:
        proof[n], folds[n] = "", rows[n][3]
        if not trees or rows[trees[-1][-1]][1] != rows[n][1]:
            trees.append([])
        trees[-1].append(n)
    tops = []
    for tree in trees:
        top = fold([(rows[n][2], [n]) for n in tree])
        sub |= dict.fromkeys(tree, top[0])
        tops.append(top)
    root = fold(tops)[0] if tops else None
    return multiset((rows[n][0], rows[n][2], sub[n], root, sha(proof[n]), folds[n]) for n in range(len(rows)))


def plain_leaves(rows):
    out = []
    for d, s, la, n, t in rows:
        leaf = sha("".join(map(field, (d, s, la, n, t))))
        low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if t is not None else None
        other = sha("".join(map(field, (d, s, la, n, low)))) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
        out.append((d, s, leaf, other))
    return out


def manifested(df):
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(remainder(5) == 0, manifest.leaf([low if c == "text" else F.col(c) for c in columns]))
    return manifest.manifest(df, columns, other=other)


@pytest.mark.parametrize("per", [50_000, 37, 5])
def test_op13_is_a_plain_manifest(spark, monkeypatch, per):
    monkeypatch.setattr(manifest, "ROWS", per)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    got = QUERIES["op13_manifest"](spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = got.collect()
    assert multiset(tuple(r)[:6] for r in out) == plain_manifest(plain_leaves(rows), True)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in out) and any(not r["verified"] for r in out)


@pytest.mark.parametrize(("sources", "per", "n"), [(1, 9, 300), (40, 11, 300), (300, 7, 300), (2, 100, 1), (3, 1, 17), (290, 1000, 600), (1, 16, 4113)])
def test_sources_of_every_size(spark, monkeypatch, sources, per, n):
    monkeypatch.setattr(manifest, "ROWS", per)
    rng = np.random.default_rng(n + sources)
    of = np.where(rng.random(n) < 0.3, 0, rng.integers(0, sources, n)).tolist()
    rows = [(i, None if s == 7 else f"s{s}é" if s % 2 else f"S{s}", "en", i % 5, f"Text {i}") for i, s in enumerate(of)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert multiset(tuple(r) for r in manifested(df).collect()) == plain_manifest(plain_leaves(rows), True)


def test_manifest_of_odd_rows(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS", 10)
    df = docs.withColumn("n_chars", F.length("text")).withColumn("leaf", F.lit("x")).withColumn("key", F.lit(1))
    same = df.filter("doc_id = 1003")
    for _ in range(6):
        same = same.union(same)
    df = df.union(same)  # equal rows in more than one partition
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]
    assert multiset(tuple(r) for r in manifested(df).collect()) == plain_manifest(plain_leaves(rows), True)
    assert manifested(df.limit(0)).count() == 0


def test_forests_are_a_monoid():
    leaves = {(t, 0, i): hashlib.sha256(f"{t} {i}".encode()).digest() for t, n in ((0, 300), (1, 1), (2, 20)) for i in range(n)}
    sizes = {0: 300, 1: 1, 2: 20}
    rng = np.random.default_rng(3)

    def parts(cuts):
        names = sorted(leaves)
        ends = [0, *sorted(rng.integers(0, len(names), cuts).tolist()), len(names)]
        return [manifest.Forest(3, dict(sizes), {n: leaves[n] for n in names[a:b]}).fold(keep=False) for a, b in zip(ends, ends[1:], strict=False)]

    roots = set()
    for cuts in (0, 1, 5, 30):
        held = parts(cuts)
        while len(held) > 1:  # any grouping, any order
            a, b = rng.choice(len(held), 2, replace=False).tolist()
            one = held[a].merge(held[b])
            held = [f for i, f in enumerate(held) if i not in (a, b)] + [one]
        assert list(held[0].nodes) == [(manifest.TOP, 0, 0)] or list(held[0].nodes) == [(manifest.TOP, 1, 0)]
        roots.add(next(iter(held[0].nodes.values())))
    assert len(roots) == 1
