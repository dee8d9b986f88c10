"""Each operator against a plain version of itself on a small table with every odd row."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, hmm, language, line_dedup, mixing, neighbours, pii, set_join, simple8b, suffix_dedup, tokens
from lodestone.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def multiset(rows):
    return Counter(map(repr, rows))


# 1. mixing


def test_targets_are_capped_and_reshared():
    got = mixing.targets([("a", 10), ("b", 1), ("c", 100)])
    assert got[1] == 3 and sum(got) == pytest.approx(111) and got[2] / got[0] == pytest.approx(3)
    assert mixing.targets([("a", 0), ("b", 5)]) == [0, 5]
    assert mixing.targets([]) == []


def test_mix(docs, rows, empty):
    out = mixing.mix(docs).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.targets([(s, size[s]) for s in names]), strict=True))
    assert multiset((d, len(WORD.findall(t or "")), size[s], round(want[s], 6)) for d, t, _, s in rows) == multiset((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in out)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in names:
        assert taken[size[s], round(want[s], 6)] == round(want[s])
    assert multiset(out) == multiset(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(empty).count() == 0


def test_schedule_is_even(spark):
    per, want = [("a", 6400), ("b", 12800)], [6400, 12800]
    slots = [r["k"] for r in mixing.schedule(spark, per, want).orderBy("slot").collect()]
    assert all(abs(slots[:n].count(0) - n / 3) <= 4 for n in range(1, len(slots) + 1))


def test_repeated_rows(docs):
    uses = Counter()
    for r in mixing.mix(docs).collect():
        if r["taken"]:
            uses[r["doc_id"], r["h"]] += math.ceil(r["taken"] / r["size"])
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    text = F.coalesce("text", F.lit(""))
    assert Counter((r[0], r[1]) for r in out.select("doc_id", F.xxhash64(F.lit(17), text, "doc_id")).collect()) == uses


# 2. personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, z) for a, _, z, k in sorted(out)]


ODD = [
    "a@b.c_x@d.e",
    "a@b.c..d@e.f g@h",
    "x@y.z@p.q r.s@t-u.v-w.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
    "4111 1111 1111 1111 4111-1111-1111-1111-1 4111  1111 1111 1111",
    "+1 (555) 123-4567. +49 30 1234567 +1--2 ++12345678901",
    "😀 4111111111111111 é a@b.cd",
    "9" * 40 + " 4111111111111111",
    "1 2 3 4 5 6 7 8 9 " * 500,
    "a" * 20000 + "@" + "b." * 300 + "c",
    "me@a" + ".b" * 600 + "..c d@e" + ".f" * 100_000 + ". g@h.i",
    "@@@ ... +++ --- 1.1.1",
]


def test_pii(spark, docs, rows, empty):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    every = [(d, t) for d, t, _, _ in rows] + [(5000 + k, t) for k, t in enumerate(ODD)]
    got = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE]) for r in pii.find_pii(df).collect()]
    assert multiset(got) == multiset((d, base_spans(t or "")) for d, t in every)
    assert pii.find_pii(empty).count() == 0


def test_pii_added_kinds_and_context(spark):
    texts = ["my iban is DE89 3704 0044 0532 0130 00 ok", "DE00370400440532013000", "ssn 123-45-6789", "order 123-45-6789", "call +14155550123"]
    out = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: [("iban", 1.0)], 1: [], 2: [("ssn", 0.6)], 3: [], 4: [("phone", 0.9)]}


def test_pii_plan_has_no_python(docs):
    plan = QUERIES["op2_pii"](docs.sparkSession, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3. set join


def shingle_set(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_groups(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * den >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (low.get(root(i)), d) if x is not None]
        low[root(i)] = min(known) if known else None
    return [(d, len(s), low[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_set_join(docs, rows, k, num, den):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.similar_groups(docs, k, num, den).collect()]
    assert multiset(got) == multiset(plain_groups([(d, t) for d, t, _, _ in rows], k, num, den))


def test_set_join_of_mutated_texts(spark, monkeypatch):
    """Groups of near copies around the threshold, small and large sets, lists cut into blocks."""
    monkeypatch.setattr(set_join, "LIST", 8)
    monkeypatch.setattr(set_join, "GROUP", 5)
    rng = np.random.default_rng(5)
    out = []
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 3000, (12, 25, 60, 150, 400, 900)[base])]
        for _ in range(25):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, max(2, len(w) // 40))):
                w[at] = f"x{rng.integers(0, 10**6)}"
            out.append((len(out), " ".join(w)))
    got = set_join.similar_groups(spark.createDataFrame(out, "doc_id long, text string").repartition(3), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_groups(out, 3, 90, 100))


def test_one_of_each(docs, rows, empty):
    kept = set_join.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = plain_groups([(d, t) for d, t, _, _ in rows], 5, 8, 10)
    want = {g for d, n, g in groups if n} | {d for d, n, _ in groups if not n}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert kept.count() == len({(g, None) for d, n, g in groups if n}) + sum(not n for _, n, _ in groups)
    assert set_join.similar_groups(empty).count() == 0 and set_join.one_of_each(empty).count() == 0


def test_small_sets_are_cheaper_as_subsets():
    rule = set_join.Rule(3, 9, 10)
    assert set_join.boundary({20: 1000}, 50.0, rule) > set_join.boundary({200: 1000}, 1.0, rule)


# 4. decontamination

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(rows, items):
    out = []
    for d, t in rows:
        w = ITEM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, text in items:
            x = ITEM.findall((text or "").translate(LOWER))
            n = min(10, len(x))
            own = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            places = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own] if own else []
            for i in places:
                hit.update(range(i, i + n))
            if places and item is not None:
                found.add(str(item))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 1500])
def test_contamination(spark, docs, rows, empty, block):
    w = ITEM.findall(rows[0][1] or "the of to and in a b c d e f g h")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, " ".join(w[5:20])), (901, " ".join(w[3:7]).upper()), (902, None), (903, "..."), (904, "one"), (None, " ".join(w[30:44])), (900, "one two"), (905, "long text of words long text of words long text")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, df, block).collect()]
    assert multiset(got) == multiset(plain_contamination([(d, t) for d, t, _, _ in rows], items))
    assert decontaminate.contamination(empty, df, block).count() == 0 and decontaminate.contamination(docs, df.limit(0)).filter("n_hit > 0").count() == 0


def test_clean(spark, docs, rows):
    df = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in df.collect()]
    want = [d for d, _, hit, _ in plain_contamination([(d, t) for d, t, _, _ in rows], items) if not hit]
    out = decontaminate.clean(docs, df)
    assert out.columns == docs.columns and multiset(r["doc_id"] for r in out.collect()) == multiset(want)


# 5. neighbours


@pytest.mark.parametrize("wave", [16, 2])
def test_nearest(spark, monkeypatch, wave):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "WAVE", wave)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[40] = x[41] = x[42]
    rows = [(int(i), x[i].tolist()) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] + [1.0] * 7), (204, [float("inf")] * 8), (205, [1.0, 2.0]), (None, [1.0] * 8), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    v = neighbours.vectors(df)
    assert v.count() == 151
    got = neighbours.nearest(v.filter("id % 5 = 0"), v, 4).collect()
    want = []
    for q in range(0, 150, 5):
        score = []
        for c in range(150):
            s = 0.0
            for a, b in zip(x[q].tolist(), x[c].tolist(), strict=True):
                s += a * b
            score.append((-s, c))
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(y for y in score if y[1] != q)[:4])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert neighbours.nearest(v.limit(0), v).count() == 0 and neighbours.nearest(v, v.limit(0)).count() == 0


def test_nearest_with_products_beyond_double_and_clashing_names(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1.0, 1.0]), (4, [-1e200, 0.0]), (5, [2.0, 0.5]), (6, [1e-320, 1e-320])]
    df = spark.createDataFrame([(*r, 7, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, id int, v string, score double")
    v = neighbours.vectors(df)
    got = [tuple(r) for r in neighbours.nearest(v, v, 3).orderBy("query_id", "rank").collect()]
    want = []
    for q, x in rows:
        score = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in rows if c != q)[:3]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(score)]
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(50, 16))
    (ca, sa, na, ea), (cb, sb, nb, eb) = neighbours.quantised(a), neighbours.quantised(b)
    near = (ca.astype(int) @ cb.astype(int).T) * sa[:, None] * sb
    assert (np.abs(a @ b.T - near) <= np.sqrt((a * a).sum(1))[:, None] * eb + ea[:, None] * nb + 1e-9).all()


# 6. language


def test_language(docs, rows, empty):
    samples = language.learn(docs.filter("doc_id % 3 <> 1"))
    out = language.predict(docs, samples)
    assert out.columns == [*docs.columns, "lang_pred", "lang_score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["lang_score"] <= 1 for r in got)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    told = [r for r in got if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.95 * len(told)
    assert language.predict(empty, samples).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"} and language.learn(empty) == {}


def test_automaton_knows_every_substring():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 60).astype(np.uint8)
    a = language.Automaton(text)
    known = {bytes(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(200):
        x = rng.integers(0, 5, rng.integers(1, 12)).astype(np.int16)
        count, at = 0, 0
        while at < len(x):  # longest known phrase, or one unknown symbol
            end = at + 1
            while end < len(x) and bytes(x[at : end + 1].astype(np.uint8)) in known:
                end += 1
            count, at = count + 1, end
        assert a.phrases(x, np.array([0, len(x)]))[0] == count


def plain_phrases(text, x):
    """Longest-match phrases of the symbols ``x`` in the symbols ``text``; an unknown symbol is one."""
    count, at = 0, 0
    while at < len(x):
        end = at + 1
        while end < len(x) and bytes(x[at : end + 1]) in text:
            end += 1
        count, at = count + 1, end
    return count


@pytest.mark.parametrize(("stretch", "together"), [(3, 2), (5, 1), (16, 4), (256, 2048)])
def test_parse_is_that_of_the_whole_text(monkeypatch, stretch, together):
    monkeypatch.setattr(language, "STRETCH", stretch)
    monkeypatch.setattr(language, "TOGETHER", together)
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 400).astype(np.uint8)
    a = language.Automaton(text)
    parts = [rng.integers(0, 4, n).astype(np.uint8) for n in (0, 1, 7, 300, 0, 33, 64, 0)] + [text[50:350], text[100:180]]
    got = a.phrases(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    assert got.tolist() == [plain_phrases(bytes(text), x) for x in parts]


def test_language_query_is_the_plain_cross_parse(spark):
    """op6 itself, row by row, against longest matches looked up in the labelled text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    learned = docs.filter(F.col("doc_id").isin([d for d, h in held.items() if not h]))
    samples = language.learn(learned)
    assert samples and sum(map(len, samples.values())) > 0
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(held)
    names, texts = sorted(samples), {k: bytes(v.astype(np.uint8)) for k, v in samples.items()}
    for r in rows:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        x = language.symbols(raw, np.array([0, len(raw)]))[0]
        if len(x) > 3000:  # the plain way takes long
            continue
        one = got[r["doc_id"]]
        assert one["held_out"] == held[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (one["lang_pred"], one["score"]) == ("und", 0)
            continue
        bits = [plain_phrases(texts[k], x.astype(np.uint8)) * np.log2(len(texts[k])) / len(x) for k in names]
        two = sorted(bits)[:2]
        assert one["lang_pred"] == names[int(np.argmin(bits))] and one["score"] == pytest.approx(1 - two[0] / two[1])


def test_language_sample_is_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 4)
    df = spark.createDataFrame([(k, "abc" * (k + 1), "xy"[k % 2]) for k in range(40)] + [(99, "z" * 9000, "x")], "doc_id long, text string, lang string")
    sizes = {k: len(v) for k, v in language.learn(df).items()}
    assert set(sizes) == {"x", "y"}  # two whole rows each, a separator between them
    assert all((n - 1) % 3 == 0 and n - 1 <= 2 * 120 for n in sizes.values())
    monkeypatch.setattr(language, "LABELS", 1)
    assert set(language.learn(df)) == {"x"}  # that with the most rows


def test_languages_of_long_texts_are_learned(spark):
    longest = language.SAMPLE_LONGEST
    rows = [(i, "one two three four five " * 10, "aa") for i in range(20)] + [(100 + i, "eins zwei drei " * 100 * (1 + (i > 0) * longest // 1000), "bb") for i in range(20)] + [(200 + i, "uno due tre " * longest, "cc") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.learn(df)
    assert set(sample) == {"aa", "bb", "cc"} and all(len(x) <= longest // 3 for x in sample.values())
    got = language.predict(df, sample).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_many_languages(spark):
    rows = [(i, f"words of language {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{'xyz'[i // 676]}q " * 3, f"l{i:04d}") for i in range(2000)]
    sample = language.learn(spark.createDataFrame([*rows, (5000, rows[1990][1], "l1990")], "doc_id long, text string, lang string"))
    assert len(sample) == language.LABELS and "l1990" in sample and "l0000" in sample and "l1023" not in sample


@pytest.mark.parametrize("unit", ["w ", "abc ab ", "w x w y ", "na " * 40 + "x "])
def test_periodic_texts_are_parsed_at_once(unit):
    import time

    learned = np.frombuffer(b"the whole way of two women who know what na na na they want w x w y abc ab", np.uint8)
    a = language.Automaton(language.symbols(learned, np.array([0, len(learned)]))[0])
    text = np.frombuffer((unit * (1_000_000 // len(unit)) + "the end").encode(), np.uint8)
    twice = np.concatenate([text, text[:5000]])
    s, offsets = language.symbols(twice, np.array([0, len(text), len(twice)]))
    began = time.perf_counter()
    got = a.phrases(s, offsets)
    assert time.perf_counter() - began < 5
    for (x, y), n in zip(zip(offsets, offsets[1:], strict=False), got.tolist(), strict=True):
        state = want = 0
        for c in a.code[s[x:y]].tolist():
            step = int(a.table[state + c])
            want, state = want + (step & 1), step >> 1
        assert n == want


# 7. repeated bytes


def plain_removed(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out.append((bytes(c for c, m in zip(b, mark, strict=True) if not m), len(b), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeated_bytes(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefé"), 6))
    shared = " ".join(word() for _ in range(90))
    made = [(2000 + k, " ".join(word() for _ in range(30)) + shared[k : k + 350 + 20 * k] + word()) for k in range(12)]
    made += [(3000, "x" * 900), (3001, "x" * 401), (3002, "x" * 399), (3003, "ab" * 500)]
    keep = [(d, t) for d, t, _, _ in rows if len(t or "") < 8000]
    df = spark.createDataFrame(keep + made, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], len(r["spans"]) // 2) for r in suffix_dedup.dedup_bytes(df).collect()]
    want = plain_removed([t for _, t in keep + made], 400)
    assert multiset(got) == multiset((d, *w) for (d, _), w in zip(keep + made, want, strict=True))
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_repeated_bytes_beside_hot_cores(spark, monkeypatch):
    """Exact copies whose cores share places in the filter of hot cores."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "HOT_BITS", 64)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdef "), n))
    shared = text(500)
    made = [(k, text(50) + shared + text(50)) for k in range(6)]  # hot: the cores' surroundings differ
    made += [(100 + k, t) for k in range(40) for t in [text(700)] * 2]  # one surrounding a core
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], bytes(r["kept"]), r["n_bytes"], len(r["spans"]) // 2) for r in suffix_dedup.dedup_bytes(df).collect()]
    want = plain_removed([t for _, t in made], 400)
    assert multiset(got) == multiset((d, *w) for (d, _), w in zip(made, want, strict=True))


def test_places_in_the_filter_are_even():
    """Cores are minima of many hashes; a filter of as many bits as cores holds about 63 % of its places, not a few."""
    h = np.random.default_rng(6).integers(0, 1 << 64, (4096, 200), np.uint64).min(1) | np.uint64(1)
    used = sum(bool(suffix_dedup._passes(np.array([1 << b if w == k else 0 for k in range(64)], np.uint64), h).any()) for w in range(64) for b in range(64))
    assert used > 2400


# 8. language model


def test_hmm(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(hmm, "GAIN", 1.0)  # two sweeps
    held = F.col("doc_id") % 5 == 1
    got = hmm.score(docs, held).collect()
    words = [(d, WORD.findall((t or "").translate(LOWER)) + [None]) for d, t, _, _ in rows]
    train = [w for d, w in words if d is None or d % 5 != 1]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    want = [(d, d is not None and d % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, w in words]
    assert multiset((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == multiset(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.score(empty, held).count() == 0
    assert all(r["n_known"] == 0 for r in hmm.score(docs.limit(3), F.lit(True)).collect())


@pytest.mark.parametrize("head", [0, 50, 700])
def test_hmm_with_a_small_head(docs, monkeypatch, head):
    monkeypatch.setattr(hmm, "GAIN", 1.0)  # two sweeps
    """Counts that are joined give what broadcast counts give, scores included."""
    key = lambda rows: sorted((str(r["doc_id"]), r["n_known"], r["base_score"], r["score"]) for r in rows)
    held = F.col("doc_id") % 5 == 1
    whole = key(hmm.score(docs, held).collect())
    monkeypatch.setattr(hmm, "HEAD", head)
    small = key(hmm.score(docs, held).collect())
    assert [x[:2] for x in small] == [x[:2] for x in whole]
    assert [x[2:] for x in small] == [pytest.approx(x[2:], rel=1e-6) for x in whole]


def test_head_holds_the_commonest_words(docs, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 300)
    monkeypatch.setattr(hmm, "MOST_FREQUENT", 20)
    counts = hmm.Counts(docs)
    every = sorted((r["c"] for r in counts.table.collect()), reverse=True)
    assert 20 <= len(counts.words) <= 320 and sorted(counts.top_counts, reverse=True) == every[:20]
    assert min(counts.counts) >= every[320] and counts.table.filter(~counts.head).count() == len(every) - len(counts.words)


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(hmm, "GAIN", 1.0)  # two sweeps
    """Every sweep of the training counts all texts, whatever numbers their rows get."""
    key = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in hmm.score(df, F.col("doc_id") % 5 == 1).collect())
    one, other = key(docs.coalesce(1)), key(docs.repartition(5, "doc_id"))
    assert [x[:2] for x in one] == [x[:2] for x in other]
    assert [x[2] for x in one] == pytest.approx([x[2] for x in other], rel=1e-5)


def plain_counts(model, seqs):
    """Expected counts of whole sequences, one after another, in double precision."""
    start, pairs, emitted, fit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.N_CLASSES)), 0.0
    for s in seqs:
        alpha = [model.start * model.emit[:, s[0]]]
        scale = [alpha[0].sum()]
        alpha[0] = alpha[0] / scale[0]
        for x in s[1:]:
            a = alpha[-1] @ model.step * model.emit[:, x]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        beta = np.ones(hmm.STATES)
        for t in range(len(s) - 1, -1, -1):
            emitted[:, s[t]] += alpha[t] * beta
            if t:
                ahead = model.emit[:, s[t]] * beta / scale[t]
                pairs += np.outer(alpha[t - 1], ahead) * model.step
                beta = model.step @ ahead
        start += alpha[0] * beta
        fit += np.log10(scale).sum()
    return np.concatenate([start, pairs.ravel(), emitted.ravel(), [fit]])


def test_counts_of_stretches_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 40)
    monkeypatch.setattr(hmm, "COLUMNS", 3)
    rng = np.random.default_rng(4)
    model = hmm.Model.first(rng.dirichlet(np.ones(hmm.N_CLASSES)))
    seqs = [rng.integers(0, hmm.N_CLASSES, n) for n in (1, 2, 39, 40, 41, 500, 90)]
    got = hmm._expected(model, pa.array([s.astype("<u2").tobytes() for s in seqs], pa.binary()))
    want = plain_counts(model, seqs)
    assert got[:-1].sum() == pytest.approx(len(seqs) + sum(len(s) - 1 for s in seqs) + sum(map(len, seqs)), rel=1e-5)
    assert np.abs(got - want)[:-1].max() < 1e-3 and got[-1] == pytest.approx(want[-1], rel=1e-4)


def test_hmm_query_is_the_plain_model(spark):
    """op8 itself: the same training in double precision over whole texts, then the recursion, word by word."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(hmm.SLICES)).alias("slice")).collect()
    counts, words = Counter(), {}
    for r in docs:
        w, _ = hmm._tokens(pa.array([r["text"] or ""]))
        words[r["doc_id"]] = w.tolist()
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update(words[r["doc_id"]])
    top = sorted(counts, key=lambda x: (-counts[x], x - (x >> 63 << 64)))[: hmm.MOST_FREQUENT]
    number = {x: k for k, x in enumerate(sorted(top))}
    class_of = lambda x: number.get(x, hmm.MOST_FREQUENT + x % hmm.CLASSES)
    total = np.full(hmm.N_CLASSES, 0.5)
    total[hmm.MOST_FREQUENT :] = 0.5
    for x, c in counts.items():
        total[class_of(x)] += c if x in number else c + 0.5
    for x in top:
        total[number[x]] = counts[x] + 0.5
    weights = total / total.sum()
    model, latest, before, sweeps = hmm.Model.first(weights), {}, -np.inf, 0
    for step in range(hmm.SWEEPS * hmm.SLICES):
        own = [[class_of(x) for x in words[r["doc_id"]]] for r in docs if r["slice"] == step % hmm.SLICES and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
        latest[step % hmm.SLICES] = plain_counts(model, own)
        model = model.better(sum(latest.values()), weights)
        if step % hmm.SLICES == hmm.SLICES - 1:
            sweeps, fit = sweeps + 1, sum(x[-1] for x in latest.values())
            if fit - before < hmm.GAIN * sum(counts.values()):
                break
            before = fit
    assert 5 <= sweeps < hmm.SWEEPS
    got = {r["doc_id"]: r for r in QUERIES["op8_hmm"](spark, path).collect()}
    assert set(got) == set(words)
    for d, w in words.items():
        want = model.log10([np.array([class_of(x) for x in w])])[0] + sum(math.log10((counts[x] + 0.5) / total[class_of(x)]) for x in w if x not in number)
        assert got[d]["score"] == pytest.approx(want, rel=2e-3)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1) and got[d]["n_tokens"] == len(w) and got[d]["n_known"] == sum(counts[x] > 0 for x in w)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    k, m = hmm.STATES, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k))
    seqs = [rng.integers(0, m, n) for n in (1, 4, 9, 300)]
    for s, got in zip(seqs, model.log10(seqs), strict=True):
        a, total = model.start * model.emit[:, s[0]], 0.0
        for x in s[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ model.step * model.emit[:, x]
        assert got == pytest.approx(total + math.log10(a.sum()))


def test_training_helps(docs):
    got = hmm.score(docs.filter("doc_id < 1000"), F.col("doc_id") % 5 == 1).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# 9. token ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 70000) | st.just(0), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(values, repeat):
    ids = np.array(values * repeat, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert np.array_equal(simple8b.decode(words, offsets, len(ids)), ids) and offsets[-1] == len(words)


def test_simple8b_file():
    ids = np.arange(10000, dtype=np.uint32) % 50257
    doc_ids, counts, back = simple8b.load(simple8b.dump([7, None], np.array([1, 9999]), ids))
    assert doc_ids == [7, None] and counts.tolist() == [1, 9999] and np.array_equal(back, ids)
    with pytest.raises(ValueError):
        simple8b.load(b"x" * 40)


TRICKY = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "it's don't 's", "a \n b", "t\tx y", "<|endoftext|> a", "a<|endoftext|>", "a b", "a　b", "a b", "é,x ,é", "ab1c,d", "\na", "a\n", "1\n2", "a'll 'x", "—x “q”, y", "\x1fa b", "wordɐx y"]


def test_encoder_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    encoder, texts = tokens.Encoder(tokenizer_path()), TRICKY + [t for _, t, _, _ in rows if t]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é',.1\n\t ☞A<|", max_size=30))
def test_encoder_on_any_text(text):
    if "one" not in _ENCODER:
        _ENCODER["one"] = tokens.Encoder(tokenizer_path())
    e = _ENCODER["one"]
    assert e.encode(pa.array([text]))[0].tolist() == e.whole([text])[0].tolist()


_ENCODER: dict = {}


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = tokens.read(tokens.write(docs, tokenizer_path())).orderBy("start").collect()
    ids = {(d, t): plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _, _ in rows}
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d)) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert multiset((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == multiset((d, len(ids[d, t]), crc(ids[d, t])) for d, t, _, _ in rows)
    assert tokens.read(tokens.write(empty, tokenizer_path())).count() == 0


# 10. lines


def plain_lines(rows, least=10):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    first = {k: min(d, key=lambda x: (x is None, x)) for k, d in held.items() if len(k) >= least and len(d) > 1}
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if first.get(key(x), d) == d]
        out.append((d, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def test_line_dedup(docs, rows, empty):
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    assert multiset(got) == multiset(plain_lines([(d, t) for d, t, _, _ in rows]))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_index_is_reversible(docs):
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    a, b = own.filter("doc_id % 2 = 0"), own.filter("doc_id % 2 = 1")
    grown = line_dedup.LineIndex.build(a).insert(b)
    whole = line_dedup.LineIndex.build(own)
    back = grown.delete(b)
    alone = line_dedup.LineIndex.build(a)
    rows = lambda df: multiset(df.collect())
    assert rows(grown.dedup(own)) == rows(whole.dedup(own)) and rows(back.dedup(a)) == rows(alone.dedup(a))
    assert rows(back.refs) == rows(alone.refs) and rows(back.twice) == rows(alone.twice)


@pytest.mark.parametrize("keys", [500_000, 7])
def test_filters_by_shard_give_the_same(docs, monkeypatch, keys):
    want = multiset(line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup.LineIndex, "SHARD_KEYS", keys)
    index, rows = line_dedup.LineIndex.build(docs), line_dedup.lines(docs)
    broadcast = multiset(index.shared(rows).collect())
    monkeypatch.setattr(line_dedup.LineIndex, "BROADCAST_BYTES", -1)
    assert multiset(index.shared(rows).collect()) == broadcast and len(broadcast) < rows.count()
    assert multiset(line_dedup.dedup_lines(docs).collect()) == want


def test_line_key_of_odd_lines(spark):
    odd = ["", " \t\x0b\f\r x Y \r", "ÀÉ İ AZaz", "\u00a0 K\u212a A \u3000", "\x1c A\x1f"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").orderBy("k").select(line_dedup.line_key(F.col("t"))).collect()]
    assert got == [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER) for x in odd]


def test_cuckoo():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    f = line_dedup.Cuckoo(20000)
    f.insert(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2)
    assert f.contains(other).mean() < 0.01
    f = line_dedup.Cuckoo.loads(f.dumps())
    f.delete(keys[:10000])
    assert f.contains(keys[10000:]).all() and f.contains(keys[:10000]).mean() < 0.01
    tight = line_dedup.Cuckoo(10)
    tight.insert(keys[:5000])  # far beyond its room: the rest is kept exactly
    assert tight.contains(keys[:5000]).all()


# the queries themselves, over a whole table, against the plain versions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op1_is_the_plain_mix(spark, table):
    out = QUERIES["op1_mixing"](spark, SF).collect()
    size = Counter()
    for _, t, s in table:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.targets([(s, size[s]) for s in names]), strict=True))
    assert multiset((d, len(WORD.findall(t or "")), size[s], round(want[s], 6)) for d, t, s in table) == multiset((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in out)
    source, taken = {d: s for d, _, s in table}, Counter()
    for r in out:
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(taken[s] == round(want[s]) for s in names)
    assert multiset(out) == multiset(QUERIES["op1_mixing"](spark, SF).collect())


def plain_taken(rows, block):
    """rows: (doc_id, h, source, size); words of each row that the schedule takes, from the description of the method."""
    size = Counter()
    for _, _, s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = [round(t) for t in mixing.targets([(s, size[s]) for s in names])]
    ends = np.cumsum(want) / sum(want)
    place = []  # of each source its words in shuffled order: (row, word)
    for s in names:
        own = sorted((h, d, n, i) for i, (d, h, t, n) in enumerate(rows) if t == s and n)
        n_buckets = max(1, len(rows) // mixing.BUCKET)
        own.sort(key=lambda x: (x[0] % n_buckets, x[0], x[1], x[2]))
        place.append([i for _, _, n, i in own for _ in range(n)])
    taken, given, rank = Counter(), [0] * len(names), [0] * len(names)

    def slot(k):
        words, n = place[k], -(-len(place[k]) // block)
        b = rank[k] % n
        rank[k] += 1
        part = words[b * block : (b + 1) * block]
        for i in part[: want[k] - given[k]]:
            taken[i] += 1
        given[k] += min(len(part), want[k] - given[k])

    for i in range(sum(-(-w // block) for w in want)):
        point = (i * mixing._GOLDEN % mixing._ONE) / mixing._ONE
        k = min(len(names) - 1, int(np.searchsorted(ends, point, side="right")))
        if given[k] < want[k]:
            slot(k)
    for k in range(len(names)):  # what the schedule leaves short comes at the end
        while given[k] < want[k]:
            slot(k)
    return [taken[i] for i in range(len(rows))]


@pytest.mark.parametrize("sources", [1024, 2])
def test_taken_words_are_those_of_the_plain_schedule(spark, docs, monkeypatch, sources):
    monkeypatch.setattr(mixing, "SOURCES", sources)
    out = mixing.mix(docs).collect()
    text = F.coalesce("text", F.lit(""))
    rows = [(r["doc_id"], r["h"], r["source"], len(WORD.findall(r["t"]))) for r in docs.select("doc_id", F.xxhash64(F.lit(17), text, "doc_id").alias("h"), "source", text.alias("t")).collect()]
    want = Counter()
    for (d, h, _, n), t in zip(rows, plain_taken(rows, mixing.BLOCK_WORDS), strict=True):
        want[d, h, n] += t  # equal rows are not told apart
    got = Counter()
    for r in out:
        got[r["doc_id"], r["h"], r["size"]] += r["taken"]
    assert got == want


def test_thousands_of_sources(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('word ', CAST(1 + id % 9 AS INT)) AS text", "concat('s', id % 5000) AS source")
    out = mixing.mix(df.withColumn("lang", F.lit("x"))).join(df.select("doc_id", "source"), "doc_id")
    per = out.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert len(per) == 5000 and all(r["n"] == round(r["t"]) for r in per)


def test_op2_is_the_plain_search(spark, table):
    want = []
    for d, t, _ in table:
        spans = base_spans(t or "")
        counts = Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        want.append((d, *(counts[k] for k in BASE), hashlib.sha256(text.encode()).hexdigest()))
    out = QUERIES["op2_pii"](spark, SF).collect()
    assert multiset(want) == multiset((r["doc_id"], *(r[f"n_{k}"] for k in BASE), r["base_sha256"]) for r in out)
    for r in out:  # added spans come besides the base ones
        kept = [x for x in r["spans"].split(",") if x.split(":")[0] in BASE]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


def test_op3_is_the_plain_join(spark, table):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op3_set_join"](spark, SF).collect()]
    assert multiset(got) == multiset(plain_groups([(d, t) for d, t, _ in table], 3, 90, 100))


def test_op7_is_the_plain_removal(spark, table):
    data = [(t or "").encode() for _, t, _ in table]
    seen = Counter(hash(b[i : i + 400]) for b in data for i in range(len(b) - 399))
    want = []
    for (d, _, _), b in zip(table, data, strict=True):
        mark = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                mark[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        want.append((d, len(b), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    out = QUERIES["op7_suffix_dedup"](spark, SF).collect()
    assert multiset(want) == multiset((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)
    assert sum(w[2] for w in want) > 0


def test_op9_is_the_tokenizer(spark, table):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t, _ in sorted(table):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op9_tokens"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_repeated_benchmark_items(docs, spark):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    many = b.unionByName(b).unionByName(b)
    assert multiset(decontaminate.contamination(docs, b).collect()) == multiset(decontaminate.contamination(docs, many, 4000).collect())


# the queries and the pipeline


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    df = docs
    bench = "/root/testdata/sf0.001"
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, df, bench)
        assert out.columns == df.columns
        df = out.cache()
    first = c.STAGES[0][1](spark, docs, bench)
    assert multiset(r["doc_id"] for r in first.collect()) == multiset(d for d, t, _, _ in rows if any(x.isalpha() for x in t or ""))
    last = c.STAGES[-1][1](spark, df, bench)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and multiset(r["doc_id"] for r in last.collect()) == multiset(r["doc_id"] for r in df.collect())


def test_pipeline_of_no_documents(spark, empty):
    import corpus_pipeline as c

    for _, stage in c.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_pipeline_is_its_plain_stages(spark, table):
    """run() over a whole table against brute force: what is kept, how often, and the ids of the texts in order."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    kept = [(d, t) for d, t, _ in table if any(x.isalpha() for x in t or "")]
    groups = plain_groups(kept, 5, 8, 10)
    want = {g for _, n, g in groups if n} | {d for d, n, _ in groups if not n}
    kept = [(d, t) for d, t in kept if d in want]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in plain_contamination(kept, items) if x[2]}
    kept = {d: t for d, t in kept if d not in hit}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin(list(kept)))
    own = [(r["doc_id"], r["h"], r["source"], len(WORD.findall(r["text"]))) for r in docs.select("doc_id", F.xxhash64(F.lit(17), "text", "doc_id").alias("h"), "source", "text").collect()]
    uses = {d: -(-t // n) for (d, _, _, n), t in zip(own, plain_taken(own, mixing.BLOCK_WORDS), strict=True) if t}
    plain, start, rows = Tokenizer.from_file(tokenizer_path()), 0, []
    for d in sorted(kept):
        ids = np.array([*plain.encode(kept[d], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(uses.get(d, 0)):
            rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(map(tuple, c.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == rows and len(rows) > 20


@pytest.mark.parametrize("name", ["op4_decontaminate", "op5_neighbours", "op10_line_dedup"])
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    from lodestone.llm.queries import ORACLE_SQL

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    flat = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert multiset(flat(r[n] for n in names) for r in got.collect()) == multiset(flat(r) for r in want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_hash_of_kept_bytes(spark):
    r = QUERIES["op7_suffix_dedup"](spark, "/root/testdata/sf0.001").filter("n_removed = n_bytes and n_bytes > 0").first()
    assert r is None or r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
