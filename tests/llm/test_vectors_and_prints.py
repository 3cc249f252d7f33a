"""SimHash links, whitening and product codes against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tonearm.llm import codes, simhash, whitening

SHAPE = "vec_id long, embedding array<double>, label int, ids string, v int, x string, place int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", 1, "b", 2) for i, v, l in rows], SHAPE)


# ---------------------------------------------------------------- SimHash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints):
    """{id row: least id}, by flooding over all pairs."""
    root = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 2 and root[j] > root[i]:
                    root[j], moved = root[i], True
    return root


def texts():
    r = random.Random(3)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randint(0, 30)) for _ in range(n)) for n in (400, 300, 500, 40)]
    out = [None, "", " \t\n", "One", "one two", "ONE  two", "É Two three", "é two three", "𝄞 two\x0bthree\x0cfour\rfive", "x" * 5000, "a b c " * 2000]
    for b in base:
        w = b.split()
        for n in (0, 0, 1, 1, 2, 3, 6):
            v = w[:]
            for i in r.sample(range(len(v)), n):
                v[i] = "other" + str(r.randint(0, 9))
            out.append("  ".join(v))
    return out


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) % 2**64 == brute_print(t)
    long = " ".join(f"w{i % 97}" for i in range(150_000))
    assert simhash.fingerprint(long) % 2**64 == brute_print(long)


@pytest.mark.parametrize("crowd", [64, 1])
def test_near_copies(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = [(i * 3 + 5, t, "k") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + [rows[12], (None, "One", "k"), (None, "never seen before", "k")], "doc_id long, text string, fingerprint string")
    found = simhash.near_copies(docs).collect()
    got = {r["id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in found if r["id"] is not None}
    prints = [brute_print(t) for _, t, _ in rows]
    assert got == {i: (p, rows[k][0]) for (i, _, _), p, k in zip(rows, prints, brute_components(prints), strict=True)}
    nameless = {r["component_id"] for r in found if r["id"] is None}
    assert nameless == {None, next(i for i, t, _ in rows if t == "One")}
    assert len(found) == docs.count()
    if crowd == 1:
        return
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()} | {None}
    assert simhash.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 8])
def test_links_in_crowds(spark, monkeypatch, crowd):
    """Numbers with few bits, many of which share a half, one bit apart or two."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(1)
    signed = lambda x: x - 2**64 if x >> 63 else x
    some = {sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(250)} | {r.getrandbits(64) for _ in range(60)} | {2**63, 2**63 | 1, 2**64 - 1}
    some = sorted(some)
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in some], "fingerprint long")).collect()
    assert all(bin((e["a"] ^ e["b"]) % 2**64).count("1") <= 2 for e in found)
    root = {x: x for x in map(signed, some)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in found:
        a, b = sorted((top(e["a"]), top(e["b"])), key=lambda x: x % 2**64)
        root[b] = a
    want = brute_components(some)
    assert [some.index(top(signed(x)) % 2**64) for x in some] == want
    if crowd == 8:
        assert len(found) < 64 * len(some)


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """64 rows a fingerprint look as small as one to Spark, however many fingerprints there are."""
    r, plans = random.Random(5), []
    saved = simhash.saved

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(simhash, "saved", told)
    path = saved(spark.createDataFrame([(r.getrandbits(63),) for _ in range(300)], "fingerprint long"))
    simhash.links(path)
    assert any("SortMergeJoin [key" in p for p in plans) and not any("BroadcastHashJoin [key" in p for p in plans)
    around = [p for p in plans if "LeftSemi" in p]
    assert around and not any(re.search(r"BroadcastHashJoin [^\n]*LeftSemi", p) for p in around)


# ---------------------------------------------------------------- whitening


def sound(rows):
    return [(i, v, l) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)]


def vector_rows(n=300, d=16, seed=2):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, d)) * np.linspace(0.02, 0.4, d) + r.normal(size=d)
    rows = [(int(i), v.tolist(), int(i) % 4 if i % 7 else None) for i, v in zip(r.permutation(n), m, strict=True)]
    return rows + [rows[0], (1000, None, 1), (1001, [], 1), (1002, [None] + [0.0] * (d - 1), 1), (1003, [float("nan")] * d, 1), (1004, [float("inf")] * d, 1), (None, rows[3][1], 1)]


@pytest.mark.parametrize("k", [8, 3])
def test_whitening(spark, k):
    rows = vector_rows()
    kept = sound(rows)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in kept])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    exact = ((n * x - s) ** 2).sum(axis=1)
    got = whitening.whiten(vectors(spark, rows), k).toPandas()
    assert len(got) == n * k and set(got["n"]) == {n}
    assert sorted(got["deviation"]) == sorted(np.repeat(exact, k).tolist())
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c in range(k):
        part = got[got["component"] == c + 1]
        z = y @ q[:, c] / np.sqrt(e[c])
        assert np.allclose(part["explained"], e[c] / e.sum(), rtol=1e-9)
        assert np.allclose(sorted(part["whitened"].abs()), sorted(np.abs(z)), atol=1e-8)
        one = part[part["id"] == rows[1][0]]["whitened"].to_numpy()
        assert np.allclose(abs(one), abs(z[1]), atol=1e-8)


def test_whitening_of_little_spread(spark):
    got = whitening.whiten(vectors(spark, [(i, [i / 64, 2 * i / 64, 5.0, -i / 64], 0) for i in range(10)])).toPandas()
    assert set(got["component"]) == {1} and np.allclose(got["explained"], 1) and got["identity_error"].max() < 1e-9
    corners = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)], 0) for i in range(8)]  # three equal deviations
    got = whitening.whiten(vectors(spark, corners)).toPandas()
    assert set(got["component"]) == {1, 2, 3} and np.allclose(got["explained"], 1 / 3) and got["identity_error"].max() < 1e-9
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    mixed = whitening.whiten(vectors(spark, corners + [(9, [1.0], 0), (10, [1e300] * 3, 0)])).toPandas()
    assert set(mixed["id"]) == set(range(8))


def test_deviations_are_exact():
    x = np.array([[2**52, 3], [-(2**52), 5]])
    c = whitening.Centre(2, [0, 8])
    assert c.deviations(x) == [None, None]
    c = whitening.Centre(3, [300_001, 7])
    assert c.deviations(np.array([[100_007, 2], [99_000, 4]])) == [(3 * 100_007 - 300_001) ** 2 + 1, (3 * 99_000 - 300_001) ** 2 + 25]


def test_steps_end_early_only_when_nothing_hides():
    r = np.random.default_rng(0)
    basis = np.linalg.qr(r.normal(size=(40, 40)))[0]
    for deviations in (np.r_[100 * 0.5 ** np.arange(40)], np.r_[[7.0] * 5, np.full(35, 1e-3)], np.linspace(1, 2, 40), np.r_[[5.0] * 10, np.zeros(30)]):
        x = (np.linalg.qr(r.normal(size=(200, 40)))[0] * deviations) @ basis
        calls = []

        def product(w, u, x=x, calls=calls):
            calls.append(1)
            p = x @ w
            return x.T @ p, (x @ u.T).T @ p, p @ p, (x * x).sum()

        comps, s, trace = whitening.bidiagonalise(product, 40, 8)
        want = np.sort(deviations)[::-1][:8]
        assert np.allclose(s, want[want > 1e-9], rtol=1e-9) and np.allclose(comps @ comps.T, np.eye(len(s)), atol=1e-12)
        z = x @ comps.T / s
        assert np.allclose(z.T @ z, np.eye(len(s)), atol=1e-9)
        if deviations[0] == 100:
            assert len(calls) < 35


# ---------------------------------------------------------------- product codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i is None, i or 0), [int(np.floor(4096 * x)) if abs(x) < 1e12 else int(x) * 4096 for x in v], l) for i, v, l in sound(rows))
    cut = [[list(p) for p in np.array_split(np.array(v, object), parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda s, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(s, book[e], strict=True)), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [near(c[p], book) for c in cut]
            for e in range(len(book)):
                mine = [c[p] for c, o in zip(cut, of, strict=True) if o == e]
                if mine:
                    book[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for ((_, i), _, l), c in zip(kept, cut, strict=True):
        of = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, l, "".join(f"{o:02x}" for o in of), sum(sum((a - b) ** 2 for a, b in zip(c[p], books[p][of[p]], strict=True)) for p in range(parts))))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def told(found):
    return sorted(((r["id"] or 0, r["label"], r["code"], r["error"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("rows", [
    vector_rows(), vector_rows(40, 10, 5), vector_rows(9, 8, 6), [(i, [0.5] * 8, 1) for i in range(30)],
    [(i, [float(i * 10**9), -1e9 * i, 0.25, 1e-9, -1e-9, 3.0, 2.0, 1.0], i % 2) for i in range(40)],
], ids=["usual", "ten wide", "few", "equal", "wide numbers"])
def test_codes(spark, rows):
    found, books = codes.compress(vectors(spark, rows))
    want, digest = brute_codes(rows)
    assert codes._told(books) == digest
    assert told(found) == sorted(((i, l, c, e if e < 2**63 else None) for i, l, c, e in want), key=str)


def test_codes_of_nothing(spark):
    found, books = codes.compress(vectors(spark, []))
    assert found.count() == 0 and codes._told(books) == hashlib.sha256(b"").hexdigest()
    huge = [(i, [1e300 * (i + 1)] * 8, 1) for i in range(20)]
    found, books = codes.compress(vectors(spark, huge))
    assert {len(r["code"]) for r in found.collect()} == {16} and len(books[0]) == 16


def test_code_blocks_add_up(spark, monkeypatch):
    from tonearm.llm import vectors as blocks

    rows = vector_rows(200, 16, 8)
    whole = told(codes.compress(vectors(spark, rows))[0])
    monkeypatch.setattr(blocks, "NUMBERS", 16 * 7)
    assert told(codes.compress(vectors(spark, rows).repartition(5))[0]) == whole


def test_label_errors(spark, tmp_path):
    vectors(spark, vector_rows(60, 16, 9)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op13_vector_codes(spark, str(tmp_path)).toPandas()
    want, _ = brute_codes(vector_rows(60, 16, 9))
    total = {}
    for _, l, _, e in want:
        total[l] = total.get(l, 0) + e
    assert sorted(got["label_error"]) == sorted(total[l] for _, l, _, _ in want)
    assert set(got.columns) == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}


def test_fingerprint_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.op11_simhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in rows}
