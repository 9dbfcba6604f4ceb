"""Each operator against brute force, its SQL, or labels it has not seen."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.llm import common, decontaminate, language, licences, lines, links, minhash, mixing, passages, quality, queries, repeats, rules, suffixes, whole_order
from lexiflow.llm.arrow import Rolling
from tests.compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)


def noisy(n=60, seed=3, words="ab ba aab abb bab the of and".split()):
    """Texts with shared passages, copies, near copies and periods."""
    rng = random.Random(seed)
    parts = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = "\n".join(rng.choice(parts) if rng.random() < 0.6 else " ".join(rng.choices(words, k=30)) for _ in range(rng.randint(0, 5)))
        out.append(t if rng.random() < 0.8 or not out else rng.choice(out))
    return [*out, "a " * 300, "ab" * 400, "é" * 120, None, ""]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_all_documents_come_back(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_decontamination_without_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    same(decontaminate.op2_decontaminate(spark, sf), decontaminate.OP2_SQL, sf)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_order(s):
    assert suffixes.suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def removed_bytes(texts):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[k] = len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(suffixes, "SORT_BYTES", 500)
    texts = noisy(seed=seed)
    got = suffixes.dedup_bytes(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n"], sum(x.b - x.a for x in r["ranges"]), len(r["ranges"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got} == removed_bytes(texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passage_dedup(spark, seed):
    texts = noisy(seed=seed)
    seen, expected = set(), {}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        expected[k] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
    got = passages.dedup_passages(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n"], sum(x.b - x.a for x in r["ranges"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got} == expected


A, B = (" ".join(f"{c}{i * 7919 % 1009}" for i in range(40)) for c in "ab")


@pytest.mark.parametrize("operator", [suffixes.dedup_bytes, passages.dedup_passages])
def test_rows_that_share_a_doc_id(spark, operator):
    """Every row is a document of its own, and one copy of every passage is left."""
    rows = [(1, A), (None, A), (None, B), (7, A), (7, B), (7, f"{B} more"), (9, A), (9, A), (None, "short"), (None, "short"), (None, None), (None, None)]
    got = operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    kept = sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in got)
    rest = "more" if operator is passages.dedup_passages else " more"
    assert [k for k in kept if k[1] and k[1] != "short"] in (sorted([("1", A), ("7", B), ("7", rest)]), [("1", A), ("7", f"{B} more")])
    assert sum(k[1] == "short" for k in kept) == 2 and len([k for k in kept if not k[1]]) >= 7
    many = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(A).alias("text"))
    lengths = operator(many).groupBy(F.length("kept").alias("k")).count().collect()
    assert {r["k"]: r["count"] for r in lengths} == {0: 24_999, len(A): 1}


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """If all windows had one hash, the texts would still decide."""
    monkeypatch.setattr(passages, "Rolling", lambda s: type("R", (), {"ranges": lambda self, a, b: np.zeros(len(a), np.uint64)})())
    units = [b" ".join(b"%d" % (i + k) for i in range(25)) for k in (0, 0, 3, 100)]
    got = repeats.Strings(np.arange(4), *[np.zeros(4, int)] * 5, units)
    marks = passages.sorted_windows(got, passages.WORDS)
    assert sorted(zip(*(m.tolist() for m in marks), strict=True)) == [(1, 0, 0, 0, 25), (2, 0, 0, 0, 22)]


def test_packing_is_lossless():
    texts = [t.encode() for t in noisy() if t]
    for unit in (passages.WORDS, suffixes.BYTES):
        made = repeats.cut([np.arange(len(texts))] * 3, [unit.canonical(t) for t in texts], unit)
        back, marks = repeats.unpacked(repeats.packed(made, [np.array([k]) for k in range(5)]), unit)
        assert back.text == made.text and all(getattr(back, c).tolist() == getattr(made, c).tolist() for c in (*repeats.KEY, "start"))
        assert [m.tolist() for m in marks] == [[k] for k in range(5)]
        starts = collections.Counter()
        for d, s, t in zip(made.doc, made.start, made.text, strict=True):
            n = len(t.split()) if unit.words else len(t)
            starts.update((d, s + i) for i in range(n - unit.window + 1))
        assert set(starts.values()) <= {1}
        assert len(starts) == sum(max(0, (len(t.split()) if unit.words else len(t)) - unit.window + 1) for t in texts)


def jaccard_components(texts, similarity, size):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= similarity * len(a | sets[j]):
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    return {k: (len(s), top[k], top[k] == k) for k, s in enumerate(sets)}


def near_copies(n=120, seed=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"X{rng.randint(0, 99)}"
        out.append(" ".join(w))
    return [*out, None, "", "one", "ONE", "one two"]


@pytest.mark.parametrize(("size", "block"), [(2, 1024), (5, 1024), (2, 7)])
def test_minhash(spark, size, block, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", block)
    texts = near_copies()
    got = minhash.near_duplicates(documents(spark, texts), 80, size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == jaccard_components(texts, 80, size)


def thue_morse(n=1024):
    """Two texts without a common word of which polynomial hashes modulo 2**64 are equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return ("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))


def test_words_with_equal_polynomial_hashes(spark):
    a, b = thue_morse()
    texts = [f"{a} w1 w2 w3", f"{b} w1 w2 w3", f"{a} w1", f"{b} w1", *[" ".join(f"x{i}" for i in range(9))] * 2]
    got = minhash.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


@given(st.lists(st.lists(st.sampled_from("ab cA Ab B x\n".split(" ")), max_size=9), min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_exact_sets(lists, size):
    texts = [" ".join(w).encode() for w in lists]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    for made in (minhash.exact_sets(texts, size), [x for x, _ in minhash.shingle_sets(texts, size)]):
        assert [len(x) for x in made] == [len(x) for x in sets]
        assert all(len(np.intersect1d(made[i], made[j])) == len(sets[i] & sets[j]) for i in range(len(texts)) for j in range(i))


def test_recall_near_the_threshold():
    """Of pairs of sets at 0.80 to 0.82, so many share a band and pass the estimate."""
    rng, found, n = np.random.default_rng(8), 0, 3000
    for _ in range(n):
        pool = rng.integers(0, 1 << 63, 110).astype(np.uint64)
        a, b = minhash.minima(pool[:100]), minhash.minima(pool[10:110])  # 90 of 110
        sig = [np.frombuffer(minhash.packed(x), np.uint8) for x in (a, b)]
        found += bool((minhash.band_keys(a) == minhash.band_keys(b)).any() and minhash.estimates(*sig) >= minhash.least_estimate(80))
    assert found >= n - 1


def test_signature_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
        k = int(rng.integers(100, 1000))
        a, b = pool[:1000], np.concatenate((pool[k:1000], pool[1000 : 1000 + k // 2]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(minhash.packed(minhash.minima(np.unique(s))), np.uint8) for s in (a, b))
        errors.append(float(minhash.estimates(x, y)) - true)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(k, k + 1) for k in range(400, 460)]
    top = list(range(500))
    for a, b in edges:
        low, high = sorted((top[a], top[b]))
        top = [low if x == high else x for x in top]
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top[k] for e in edges for k in e if e[0] != e[1] or any(k in x and x[0] != x[1] for x in edges)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("ab", max_size=9), st.text("ab", max_size=9), st.integers(0, 3))
@settings(max_examples=400, deadline=None)
def test_within(a, b, edits):
    assert lines.within(a, b, edits) == (distance(a, b) <= edits)


@given(st.text("ab", max_size=9), st.lists(st.text("ab", max_size=9), max_size=9), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_within_all(a, others, edits):
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, *others)]
    assert lines.within_all(points[0], points[1:], edits).tolist() == [distance(a, b) <= edits for b in others]


RULES = [lines.EDITS, ((3, 2),), ((4, 1), (8, 2), (12, 3))]


@given(st.text("abcé", min_size=3, max_size=20), st.lists(st.tuples(st.integers(0, 19), st.sampled_from(["x", "", "yy", "ab"])), max_size=3), st.sampled_from(RULES))
@settings(max_examples=400, deadline=None)
def test_edited_lines_meet(line, changes, rule):
    """Linked lines share a file, have sketches that are alike, and count in just one of the files they share."""
    other = line
    for at, new in changes:
        other = other[:at] + new + other[at + 1 :]
    edits = lines.allowed(min(len(line), len(other)), rule)
    if other == line or not edits or distance(line, other) > edits:
        return
    points, start, length, _, _ = lines.spans([line, other])
    which, key, own, nth = lines.filed(Rolling(points.astype(np.uint64) + np.uint64(1)), start, length, rule)
    assert lines.alike(lines.sketches(points, start, start + length)[:1], lines.sketches(points, start, start + length)[1], edits).all()
    counted = 0
    for k in set(key.tolist()):
        here = key == np.uint64(k)
        mine = [bool((own & here & (which == n)).any()) for n in (0, 1)]
        if not any(mine) or not all((here & (which == n)).any() for n in (0, 1)):
            continue
        a, b = (line, other) if mine[0] else (other, line)
        whose, segment = lines.first_meeting(a, b, a is line, edits)
        counted += segment == nth[here][0] and (whose or all(mine))
    assert counted == 1


@pytest.mark.parametrize(("a", "b"), [(f"+{'-' * 24}+", f"|{'-' * 24}|"), (f"Part 1 {'.' * 22} 17", f"Part 2 {'.' * 22} 18"), thue_morse()])
def test_lines_with_an_even_middle_meet(spark, a, b):
    near = distance(a, b) <= 2
    got = lines.line_report(documents(spark, [a, b, a])).collect()
    assert [r["n_links"] for r in sorted(got)] == [int(near)] * 3
    assert sorted((r["doc_id"], r["n_removed"], r["n_exact"]) for r in got) == [(0, 0, 0), (1, int(near), 0), (2, 1, 1)]
    assert {r["text"] for r in lines.dedup_lines(documents(spark, [a, b])).collect()} == ({a} if near else {a, b})


def test_short_lines(spark):
    """Exact repeats of any length; blank lines stay."""
    texts = ["All rights reserved.\n\n§\n \nok", "All rights reserved.\n\n§\n \nOK", "All rights reserved!\n\r\nok"]
    got = {r["doc_id"]: (r["n_removed"], r["n_exact"], r["n_links"]) for r in lines.line_report(documents(spark, texts)).collect()}
    assert got == {0: (0, 0, 1), 1: (2, 2, 1), 2: (2, 1, 1)}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert kept == {0: texts[0], 1: "\n \nOK", 2: "\r"}


@pytest.mark.parametrize(("rule", "block"), [(((3, 2),), 2048), (((3, 2),), 16), (((3, 1), (6, 2)), 7)])
def test_links_of_short_lines(spark, rule, block, monkeypatch):
    monkeypatch.setattr(lines, "GROUP", block)
    rng = random.Random(9)
    kinds = sorted({"".join(rng.choices("abc-", k=rng.randint(2, 9))) for _ in range(160)})
    near = {frozenset((a, b)) for i, a in enumerate(kinds) for b in kinds[:i] if (e := lines.allowed(min(len(a), len(b)), rule)) and distance(a, b) <= e}
    got = {r["doc_id"]: r["n_links"] for r in lines.line_report(documents(spark, kinds), rule).collect()}
    assert got == {k: sum(x in pair for pair in near) for k, x in enumerate(kinds)}


def test_many_near_lines(spark):
    """Links of a large class are counted without being written out."""
    kinds = [f"page {i:05d} of the minutes of the meeting" for i in range(1200)]
    got = lines.line_report(documents(spark, kinds)).agg(F.sum("n_links"), F.sum("n_removed")).first()
    near = sum(lines.within(kinds[i], x, 2) for i in range(0, 1200, 50) for x in kinds) - 24
    assert got[1] == 1199 and lines.line_report(documents(spark, kinds)).where("doc_id % 50 = 0").agg(F.sum("n_links")).first()[0] == near


def edited_lines(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(10, 60))) for _ in range(14)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("xyé")], [s[k], "x"]])
        return "".join(s)

    return ["\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 6))) for _ in range(50)] + [None, "short", "a\nshort"]


def line_classes(texts):
    rows = [(k, n, x) for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    kinds = sorted({x for *_, x in rows})
    top, degree = {x: x for x in kinds}, collections.Counter()
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            edits = lines.allowed(min(len(a), len(b)), lines.EDITS)
            if edits and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                degree[a] += 1
                degree[b] += 1
                old, new = top[a], top[b]
                top = {k: new if v == old else v for k, v in top.items()}
    lead: dict = {}
    for k, n, x in rows:
        lead.setdefault(top[x], (k, n))
    return rows, lambda x: lead[top[x]], degree


def test_line_dedup(spark):
    texts = edited_lines()
    rows, lead, degree = line_classes(texts)
    first: dict = {}
    for k, n, x in rows:
        first.setdefault(x, (k, n))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_exact"], r["n_links"], r["classes_sha256"]) for r in lines.line_report(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        own = [(n, x) for d, n, x in rows if d == k]
        named = ",".join(f"{n}:{lead(x)[0]}:{lead(x)[1]}" for n, x in own)
        removed, exact = sum(lead(x) != (k, n) for n, x in own), sum(first[x] != (k, n) for n, x in own)
        assert got[k] == (len((t or "").split("\n")), removed, exact, sum(degree[x] for x in {x for _, x in own}), hashlib.sha256(named.encode()).hexdigest())
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        left = [x for n, x in enumerate((t or "").split("\n")) if not x.strip() or lead(x) == (k, n)]
        assert kept.get(k) == ("\n".join(left) if left and t is not None else t if t is None else None)


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_knapsack(counts, budget):
    reach = {0}
    for k, n in counts.items():
        reach = {r + k * i for r in reach for i in range(n + 1) if r + k * i <= budget}
    taken = mixing.knapsack(counts, budget)
    assert all(0 <= n <= counts[k] for k, n in taken.items())
    assert sum(k * n for k, n in taken.items()) == max(reach)


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, None: 100, "c": 1000})
    assert got["a"] == 30 and got["b"] == 300 and abs(sum(got.values()) - 1210) < 1e-6
    assert got["c"] == pytest.approx(got[None] / 5 if got[None] < 300 else 1210 - 30 - 300 - 300)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("seed", range(4))
def test_planned_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, rng.randint(1, 50), rng.randint(1, 20_000)]) for i in range(rng.randint(1, 30))} | {None: 70}
    got = mixing.planned(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)).collect()
    expected = mixing.targets(sizes)
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(t) for s, t in expected.items()}
    assert all(r["times"] == (min(3, int(r["target"] // r["source_size"])) if r["source_size"] else 0) for r in got)


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7919 % 503,) for i in range(503)], "k long").repartition(5)
    assert sorted((r["n"], r["k"]) for r in common.numbered(rows, F.col("k").desc()).collect()) == [(i + 1, 502 - i) for i in range(503)]
    assert common.numbered(rows.limit(0), F.col("k")).count() == 0


def test_mix(spark, sf):
    rows = mixing.op5_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"] or "")) and (r["taken"] == 0 or r["taken"] % r["size"] == 0) and r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
        target[d["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 200 for s, t in target.items())
    assert sorted(rows) == sorted(mixing.op5_mixing(spark, sf).collect())


def brute_scan(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + p.count(" ") + 1] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licence_places(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["Under the MIT license under the mit-license, CC BY-NC! cc by nc", "apache license version 2apache license version 2"]
    got = licences.scan(documents(spark, texts)).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {k: brute_scan(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Copyright (c) 2020 Some One. All rights reserved.", "all-rights-reserved"),
        ("All rights reserved", "all-rights-reserved"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("licensed under the gnu lesser general public license version 3", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files", "mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this one two three four five and associated documentation files", ""),
        ("Licensed under CC BY-NC 4.0 International", "cc-by-nc"),
    ],
)
def test_templates(text, labels):
    assert licences.scan_text(text.encode(), licences.PHRASES, licences.compiled(licences.templates_of()))[5] == labels


def ends_of(tokens, words, at):
    """Where a template can end that starts at a word: by trying everything."""
    if not tokens:
        return {at}
    head, rest = tokens[0], tokens[1:]
    if isinstance(head, list):
        return {e for x in ends_of(head, words, at) | {at} for e in ends_of(rest, words, x)}
    if isinstance(head, int):
        return {e for k in range(head + 1) if at + k <= len(words) for e in ends_of(rest, words, at + k)}
    return ends_of(rest, words, at + 1) if at < len(words) and words[at] == head else set()


def parsed(template):
    stack = [[]]
    for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            done = stack.pop()
            stack[-1].append(done)
        elif part[:2] == "{{":
            stack[-1].append(int(part[2:-2]))
        else:
            stack[-1] += plain(part)
    return stack[0]


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_templates_against_all_ways_to_match():
    rng = random.Random(6)
    templates = [("a [[b c]] {{2}} d", "one"), ("[[a {{1}}]] b b", "two"), ("c [[d [[a]]]] c", "three"), ("b {{3}} b [[c]]", "four")]
    automata = licences.compiled(templates)
    for _ in range(400):
        t = " ".join(rng.choices("abcdE", k=rng.randint(0, 14)))
        words, covered, labels = plain(t), set(), set()
        for template, label in templates:
            for i in range(len(words)):
                if found := [e for e in ends_of(parsed(template), words, i) if e > i]:
                    labels.add(label)
                    covered.update(range(i, max(found)))
        got = licences.scan_text(t.encode(), {}, automata)
        assert got[5] == ",".join(sorted(labels)) and got[6] == pytest.approx(len(covered) / len(words) if words else 0)


def test_whole_licences():
    """Each template matches itself with its optional wording, and without it; one changed word is enough to refuse."""
    automata = licences.compiled(licences.templates_of())
    for template, label in licences.templates_of():
        filled = re.sub(r"\{\{\d+\}\}", "someone", template).replace("[[", "").replace("]]", "")
        assert label in licences.scan_text(filled.encode(), {}, automata)[5].split(",")
        words = [x for x in parsed(template) if isinstance(x, str)]
        assert label in licences.scan_text(" ".join(words).encode(), {}, automata)[5].split(",")
        one = licences.compiled([(template, label)])
        changed = " ".join(f"{w}x" if k == len(words) // 2 else w for k, w in enumerate(words))
        assert licences.scan_text(changed.encode(), {}, one)[5] == ""


def test_a_long_text_of_phrases_takes_no_long_time():
    text = b"Under the MIT license; permission is hereby granted, free of charge, to any person obtaining a copy. " * 20_000
    began = time.time()
    assert licences.scan_text(text, licences.PHRASES, licences.compiled(licences.templates_of()))[1] == 20_000
    assert time.time() - began < 20


def test_languages_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def four_bytes(t):
    letters = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in (t or "").encode())
    padded = b"   " + letters + b"   "
    return [int.from_bytes(padded[i : i + 4], "little") for i in range(len(padded) - 3)]


def slots_of(gram):
    return [(gram ^ gram >> 15) * m % (1 << 32) >> 32 - language.SLOT_BITS for m in language.MULTIPLIERS]


def test_language_scores(spark):
    """Slots, masks and corrected shares recomputed gram by gram."""
    rng = random.Random(2)
    letters = {"x": "aeiou  lmn", "y": "eirst  dgh", "z": "aou  kpqz"}
    rows = [(i, "".join(rng.choices(letters[k], k=rng.randint(5, 90))), k) for i, k in enumerate(rng.choices("xyz", k=150))]
    rows += [(150, "", "x"), (151, "12 34", "y"), (152, None, "z"), (153, "ABC é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, masks = language.learn(docs, keep=60)
    counts = {k: collections.Counter() for k in "xyz"}
    for i, t, k in rows:
        if t is not None and k and zlib.crc32(str(i).encode()) % 5:
            counts[k].update(four_bytes(t))
    filters = {k: {s for g in sorted(c, key=lambda g: (-c[g], g))[:60] for s in slots_of(g)} for k, c in counts.items()}
    false = {k: (len(f) / (1 << language.SLOT_BITS)) ** 3 for k, f in filters.items()}
    got = {r["doc_id"]: r for r in language.identify(docs, (langs, masks)).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        grams = [g for g in four_bytes(t) if g != 0x20202020]
        share = {k: max(0.0, (sum(filters[k].issuperset(slots_of(g)) for g in grams) / max(1, len(grams)) - false[k]) / (1 - false[k])) for k in langs}
        assert got[i]["lang_pred"] == min(k for k in langs if share[k] == max(share.values()))
        assert got[i]["score"] == pytest.approx(max(share.values()) / (sum(share.values()) or 1))


def test_quality_not_seen(spark):
    """Trained on half of the labels, tested on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = known.where("doc_id % 2 = 0")
    got = quality.classify(docs, known.where("doc_id % 2 = 1")).join(held, "doc_id")
    kept = {(r["good"]): r["k"] for r in got.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[True] >= 0.98 and kept[False] <= 0.15


def test_sites_and_scores(spark):
    """Strengths, sites and scores from the evidence alone, recomputed in plain Python."""
    rng = random.Random(12)
    known = [(i, f"h{i % 7}" if i % 11 else None, f"p{i % 3}", min(1.0, max(0.0, rng.gauss(0.15 + 0.1 * (i % 7), 0.1)))) for i in range(400)] + [(400, "rare", "p0", 0.9)]
    got = {r["doc_id"]: r for r in quality.posterior(spark.createDataFrame(known, "doc_id long, host string, path string, p_bad double")).collect()}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for _, h, p, x in known:
        hosts[h].append(x)
        paths[h, p].append(x)
    mean = sum(x[3] for x in known) / len(known)

    def fitted(groups, above, n_above, sizes_above, variance):
        between = sum(len(v) * (sum(v) / len(v) - above(k)) ** 2 for k, v in groups.items())
        free = len(groups) - n_above
        error = (2 * variance**2 * free + variance * sum(1 / len(v) for v in groups.values())) ** 0.5
        room = variance * (len(known) - sum(len(v) ** 2 / sizes_above(k) for k, v in groups.items()) - free)
        excess = between - variance * free
        return min(1e4, max(1.0, 1 / min(1.0, excess / room) - 1)) if room > 0 and excess > 3 * error else 1e4

    host_k = fitted(hosts, lambda _: mean, 1, lambda _: len(known), sum((x[3] - mean) ** 2 for x in known) / len(known))
    inner = sum((x - sum(v) / len(v)) ** 2 for v in hosts.values() for x in v) / (len(known) - len(hosts))
    path_k = fitted(paths, lambda k: sum(hosts[k[0]]) / len(hosts[k[0]]), len(hosts), lambda k: len(hosts[k[0]]), inner)
    assert 1 < host_k < 100 and path_k == 1e4
    for i, h, p, x in known:
        prior = (sum(hosts[h]) - x + mean * host_k) / (len(hosts[h]) - 1 + host_k)
        site = (sum(paths[h, p]) - x + prior * path_k) / (len(paths[h, p]) - 1 + path_k)
        odds = [min(1 - 1e-9, max(1e-9, q)) / (1 - min(1 - 1e-9, max(1e-9, q))) for q in (x, site, mean)]
        assert got[i]["site"] == pytest.approx(site) and got[i]["score"] == pytest.approx(1 / (1 + odds[0] * odds[1] / odds[2]))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_equal_hosts_are_not_told_apart(spark, size):
    """A third of all documents fail, whatever their host: no host of 2,000 is rejected for its luck."""
    rng = random.Random(size)
    rows = [(f"h{i}", rng.random() < 1 / 3) for i in range(2000) for _ in range(size)]
    assert rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).where("host_rejected").count() == 0


def test_different_hosts_are_told_apart(spark):
    rng = random.Random(3)
    rows = [(f"h{i}", rng.random() < (0.95 if i % 5 == 0 else 0.1)) for i in range(200) for _ in range(30)] + [("one", True), ("none", False)]
    rejected = {r["host"] for r in rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).where("host_rejected").collect()}
    assert rejected == {f"h{i}" for i in range(0, 200, 5)}


def test_sparse_sites_lean_on_the_whole(spark):
    """A site's expectation moves with its documents only as far as they are many."""
    bad, good = "trash scum loser here now", "plain good words stand here"
    rows = [(i, bad if i % 10 == 0 else good, "big", "x") for i in range(300)] + [(1000, bad, "small", "x"), (1001, good, "small", "x")] + [(2000 + i, bad, "worst", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("text") == bad).cast("int").alias("toxic"))
    site = {r["doc_id"]: r["site"] for r in quality.classify(docs, known).collect()}
    assert site[2000] > 0.8 > site[1001] > site[1] and abs(site[1] - 0.1) < 0.05


@pytest.mark.parametrize(("letters", "n"), [("ab", 60), ("a", 30), ("abcdefgh", 70)])
def test_order_of_a_whole_corpus(spark, letters, n):
    """The distributed sort, recursion and merge included, orders suffixes as plain sorting does."""
    s = [ord(c) for c in random.Random(n).choices(letters, k=n)]
    symbols = spark.createDataFrame(list(enumerate(s)), "pos long, s long").repartition(3)
    got = {r["pos"]: r["rank"] for r in whole_order.suffix_ranks(symbols, one_task=12).collect()}
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(n), key=lambda i: s[i:])


def test_symbols_of_documents(spark):
    docs = spark.createDataFrame([(2, "é"), (1, "ab"), (3, None)], "doc_id long, text string")
    got = [r["s"] for r in sorted(whole_order.corpus_symbols(docs).collect())]
    assert got == [99, 100, 1, 0xC3 + 2, 0xA9 + 2, 1, 1]
