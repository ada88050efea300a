"""Vector codes, licence scans and periodic runs against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from lumenforge.llm import license_scan, periodic_runs, queries, vector_codes
from lumenforge.llm.license_texts import PHRASES, TEMPLATES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
ODD = [None, "", " ", "\n\t ", "a", "MIT License", "mit license", "a b " * 400, "x " * 30, "É é " * 20, "MIT license, MIT LICENSE; the Apache-License 2.0 general\npublic_license", "z" * 5000, "word\x1fword \x85 ", "\x00 a"]
SCHEMA = "doc_id long, text string, lang string, _0 string, text_ string, runs int, n_words int"


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def runs_of(x, shortest=12):
    """All maximal repetitions of a list, period by period."""
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, 2 * q) and not any(x[i : i + size - r] == x[i + r : i + size] for r in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """The row of one document as the contract of the query says."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    out = {i for s, size, q in runs for i in range(s + q, s + size)}
    s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc_id, len(runs), s, size, q, q and 1000 * size // q, sha(text), sha(" ".join(w for i, w in enumerate(words) if i not in out))


def test_periodic_runs_of_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, x, "en", "clash", "c", 1, 2) for i, x in enumerate(ODD)]
    for i in range(len(rows), 200):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 80))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), "en", None, None, None, None))
    rows += rows[-3:]
    sf = table(spark, tmp_path, "documents", rows, SCHEMA)
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()), key=lambda r: r[0])
    assert got == sorted((periodic(r[0], r[1]) for r in rows), key=lambda r: r[0])
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    null = spark.createDataFrame([(None, "a b " * 10)], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.periodic_runs(null).select("_0", "runs").first().runs] == [(0, 20, 2)]


@needs_data
def test_periodic_runs_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0]: r[1] for r in docs if len(r[1] or "") < 6000}
    got = {r[0]: tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, x in short.items():
        assert got[i] == periodic(i, x)


@pytest.mark.parametrize("shortest", [2, 4, 12])
def test_runs_in_many_texts_at_once(shortest):
    rng = random.Random(shortest)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            x = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 50))]
            if x and rng.random() < 0.5:
                a, p = rng.randrange(len(x)), rng.randint(1, 9)
                x = [w if i < a else x[min(len(x) - 1, a + (i - a) % p)] for i, w in enumerate(x)]
            texts.append(x)
        found = periodic_runs.find_runs([np.array(x, np.int64) for x in texts], shortest)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [runs_of(x, shortest) for x in texts]


def test_texts_are_passed_over_only_without_repeats():
    rng = random.Random(9)
    texts = [[rng.randint(1, 4) for _ in range(rng.randint(0, 40))] for _ in range(200)]
    flags = periodic_runs._repeats([np.array(x, np.int64) for x in texts])
    for x, flag in zip(texts, flags, strict=True):
        grams = [tuple(x[i : i + 6]) for i in range(len(x) - 5)]
        assert flag == (len(grams) != len(set(grams)))


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def base(doc_id, text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    found = sorted((i, label) for label, phrase in PHRASES for i in places(words, phrase.split()))
    at = [i for i, _ in found]
    return doc_id, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_scan_of_odd_texts(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = "mit license apache general public licensed under the version 2 0 gnu x y".split()
    rows = [(i, x, "en", "clash", "c", 1, 2) for i, x in enumerate([*ODD, *(t for _, t in TEMPLATES)])]
    for i in range(len(rows), 300):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), None, None, None, None, None))
    rows += rows[-3:] + [(None, "mit license", None, None, None, None, None)]
    sf = table(spark, tmp_path, "documents", rows, SCHEMA)
    got = queries.op12_license_scan(spark, sf).collect()
    by_id = lambda r: (r[0] is None, r[0])
    assert sorted((tuple(r[c] for c in BASE) for r in got), key=by_id) == sorted((base(r[0], r[1]) for r in rows), key=by_id)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels.split(",") for r in got}
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in labels[len(ODD) + k]
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0


@needs_data
def test_license_scan_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in BASE) for r in queries.op12_license_scan(spark, DATA).collect())
    assert got == sorted(base(*r) for r in docs)


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        letters = "abc"[: rng.randint(1, 3)]
        templates = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))) for k in range(rng.randint(1, 4))]
        a = license_scan.Automaton.build(templates, [("p", "a b"), ("q", "b a b")])
        texts = [t.split() for _, t in templates]
        all_texts = [*texts, ["a", "b"], ["b", "a", "b"]]
        words = [rng.choice("abcz") for _ in range(60)]
        ids = [a.numbers.get(w.encode(), 0) for w in words]
        for i, state, length in a.statistics(ids, 0):
            longest = max((k for k in range(i + 2) if any(places(t, words[i + 1 - k : i + 1]) for t in all_texts)), default=0)
            assert length == longest
            if length:
                factor = words[i + 1 - length : i + 1]
                assert a.ends[state] == {k: [p + length - 1 for p in places(t, factor)] for k, t in enumerate(texts) if places(t, factor)}
                assert sorted(x for x, size in a.phrases[state] if size <= length) == sorted(x for x, p in (("p", "a b"), ("q", "b a b")) if factor[-len(p.split()) :] == p.split())


def test_spans_survive_gaps_and_long_texts():
    label, text = next(t for t in TEMPLATES if len(t[1]) > 600)
    a = license_scan.Automaton.build(TEMPLATES, PHRASES)
    words = license_scan.words_of(text)
    broken = words[:40] + [b"Copyright", b"2020", b"someone"] + words[40:90] + [b"unlike"] + words[91:]
    for padding in (0, 20_000):
        _, spans = license_scan.scan_words(a, [b"the"] * padding + broken + [b"of"] * padding)
        assert [(s[0], s[1]) for s in spans] == [(label, padding)] and spans[0][5] > 0.95
    _, spans = license_scan.scan_words(a, license_scan.words_of("Released under the MIT License. " * 3000))
    assert len(spans) == 3000
    assert license_scan.scan_words(a, license_scan.words_of("the license of this work is subject to the terms under which the software was released")) == ([], [])


def codes_by_distance(vectors, rounds=6):
    """(codes, errors, codebooks) of integer vectors by plain distances."""
    books = [[list(v[p]) for v in vectors[:16]] for p in range(8)]
    for step in range(rounds + 1):
        code, error = [], []
        for v in vectors:
            d = [[sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in books[p]] for p in range(8)]
            code.append([x.index(min(x)) for x in d])
            error.append(sum(map(min, d)))
        if step == rounds:
            return ["".join(f"{e:02x}" for e in c) for c in code], error, books
        for p in range(8):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(vectors, code) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]


def test_vector_codes_of_odd_tables(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.0, 0.5, rng.gauss(0, 1), rng.gauss(0, 1e-4)]) for _ in range(16)], rng.choice([1, 1, 1, 2, None]), "clash", "c") for i in range(300)]
    rows += [(7, None, 1, "", ""), (1, [float("nan")] * 16, 1, "", ""), (2, [float("inf")] + [0.0] * 15, 1, "", ""), (3, [None] + [0.0] * 15, 1, "", ""), (900, [1.0, 2.0], 3, "", ""), (901, [], 3, "", ""), (None, [0.25] * 16, 3, "", "")]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, v string").repartition(5)
    good = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0]))
    whole = [[int(np.floor(4096 * x)) for x in [*r[1], *[0.0] * (16 - len(r[1]))]] for r in good]
    code, error, books = codes_by_distance([[x[p * 2 : p * 2 + 2] for p in range(8)] for x in whole])
    total = {}
    for r, e in zip(good, error):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    key = lambda r: tuple((x is None, x) for x in r)
    expected = sorted(((r[0], c, e, total[r[2]], digest) for r, c, e in zip(good, code, error)), key=key)
    assert sorted((tuple(r) for r in vector_codes.encode(df).collect()), key=key) == expected
    assert vector_codes.encode(df.where("vec_id is null")).count() == 1
    assert vector_codes.encode(df.where("false")).count() == 0
    assert vector_codes.encode(df.where("embedding is null")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 5, 8, 16])
def test_bounds_lose_no_nearest_entry(d):
    rng = np.random.default_rng(d)
    for spread in (1, 3, 1000, 1 << 24):
        entries = rng.integers(-spread, spread + 1, (16, d))
        x = np.vstack([rng.integers(-spread, spread + 1, (500, d)), entries, np.repeat(entries[:1], 3, 0)])
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        at, distance = vector_codes.Bounds(entries).nearest(x)
        assert (at == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_filter():
    """Most entries are ruled out before distances are taken."""
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-800, 800, (16, 8)), rng.integers(-800, 800, (2000, 8))
    bounds = vector_codes.Bounds(entries)
    mean, rest = bounds._reduced(x, 2)
    of = bounds.of_entries[-1]
    low = ((mean[:, None] - of[0][None]) ** 2).sum(axis=2) + (rest[:, None] - of[1][None]) ** 2
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (low <= exact + 1e-6 * exact.max()).all() and (low <= exact.min(axis=1)[:, None]).mean() < 0.5


def test_new_words_of_a_page_are_hashed_together(monkeypatch):
    """One call for all new words of a page, with the vectors that each word has alone, whatever was met before and after a start anew."""
    import xxhash

    from lumenforge.llm import html_text

    calls, real = [], html_text._hashed
    monkeypatch.setattr(html_text, "_hashed", lambda words, dim: calls.append(words) or real(words, dim))
    v = html_text.Vectors(8, limit=1500)
    for page in range(4):
        lists = [[f"w{page}-{i}" for i in range(1100)], [], ["w0-1", "\ud800", "é"]]
        want = np.zeros((3, 8))
        for row, words in enumerate(lists):
            for word in words:
                for k in range(4):
                    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), k)
                    want[row, h % 8] += 0.5 if h >> 63 else -0.5
        assert np.array_equal(v.sums(lists), want.astype(np.float32))
    assert len(calls) == 4
