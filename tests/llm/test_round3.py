"""Whitening, hard negatives and the URL filter against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from varspan.llm import hard_negatives, toxicity, url_filter, whitening
from varspan.llm.queries import op11_whitening

VEC = "vec_id long, embedding array<double>, label int, v string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VEC)


def some(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) + rng.standard_normal(dim) * 50
    return [(i, x[i].tolist(), int(i % 3)) for i in range(n)]


BAD = [(9001, None, 1), (9002, [float("nan")] * 6, 1), (9003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (9004, [float("inf")] * 6, 0), (9005, [], 0), (9006, [1.0], 0)]


def test_op11(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rows = some(300, 6) + [(7, [0.0] * 6, 1), (None, [1.0] * 6, None)] + some(5, 6)
    got = whitening.whitened_components(vectors(spark, rows + BAD).repartition(5), 4).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(6)] for i in range(6)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    far = sorted((-1 if i is None else i, sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)), k) for (i, _, _), r in zip(rows, x, strict=True) for k in range(1, 5))
    assert sorted((-1 if r.vec_id is None else r.vec_id, int(r.deviation), r.component) for r in got) == far
    assert all(abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < 1e-9 for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    true = (np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)] for r in x]) @ axes[:, :4]) / np.sqrt(e[:4])
    for k in range(4):
        mine = np.sort([r.whitened for r in got if r.component == k + 1])
        assert min(np.abs(mine - np.sort(sign * true[:, k])).max() for sign in (1, -1)) < 1e-8


def test_op11_edges(spark):
    frame = lambda rows: vectors(spark, rows)
    assert whitening.whitened_components(frame(BAD[:5]), 4).count() == 0
    assert whitening.whitened_components(frame(BAD).limit(0), 4).columns == whitening.whitened_components(frame(some(20, 6)), 4).columns
    assert whitening.whitened_components(frame([(1, [1.0, 2.0], 0)] * 3), 4).count() == 0
    # fewer rows than dimensions, and a constant one: axes without variance have no row
    assert {r.component for r in whitening.whitened_components(frame(some(3, 6)), 6).collect()} == {1, 2}
    flat = [(i, [*v[:3], 5.0], y) for i, v, y in some(40, 4)]
    assert {r.component for r in whitening.whitened_components(frame(flat), 6).collect()} == {1, 2, 3}


def test_op11_wide_values(spark):
    """Sums beyond 64 bits stay exact; a deviation that no long holds is null in the query alone."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(2) * 2.0**50).tolist(), 0) for i in range(50)] + [(60, [1e300, 0.0], 0)]
    x = [[max(-whitening.LIMIT, min(whitening.LIMIT, int(np.floor(64 * c)))) + 1_000_000 for c in v] for _, v, _ in rows[:50]]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    model = whitening.fit(vectors(spark, rows[:50]))
    true = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(2)] for i in range(2)]
    assert model.sums == s and all(abs(model.covariance[i, j] / float(true[i][j]) - 1) < 1e-15 for i in range(2) for j in range(2))
    got = {r.vec_id: r.deviation for r in whitening.whitened_components(vectors(spark, rows[:50]), 1).collect()}
    assert all(int(got[i]) == sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x))
    assert whitening.whitened_components(vectors(spark, rows), 1).count() == 51


def test_op11_query(spark, tmp_path):
    vectors(spark, some(60, 6)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and got.where("deviation is null").count() == 0 and got.count() == 60 * 6


@pytest.mark.parametrize("dim,size", [(1, 3), (8, 200), (64, 160), (5, 2**27), (64, 2**27)])
def test_packed_products(dim, size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-size, size, (7, dim)), rng.integers(-size, size, (29, dim))
    packed = hard_negatives.Packed(b, hard_negatives._reach(a, b))
    assert (packed.scores(a) == a @ b.T).all()
    assert packed.fields == 64 // packed.bits and (size > 1000 or packed.fields > 1)
    one = hard_negatives.Packed(b[:1], hard_negatives._reach(a, b))
    assert (one.scores(a) == a @ b[:1].T).all()


def brute_negatives(rows, every=100):
    e = []
    for i, v, y in rows:
        if i is not None and y is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all():
            e.append((i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * c)) for c in v]))
    out = []
    for i, y, v in e:
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in e if j != i)
        for p, j, _ in [t for t in s if t[2] == y][:5]:
            fits = [(n, k) for n, k, z in s if z != y and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [8192, 40])
def test_op12(spark, monkeypatch, chunk):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "ASKED", chunk)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 6))
    rows = [(i, (centres[i % 4] + 0.3 * rng.standard_normal(6)).round(1).tolist(), int(rng.integers(0, 3)) if i % 2 else 1) for i in range(600)]
    rows[200:230] = [(i, rows[100][1], y) for i, _, y in rows[200:230]]
    rows += [(800, [0.0] * 6, 1), (-100, rows[3][1], 2), (None, rows[3][1], 2), (900, rows[4][1], None)]
    got = hard_negatives.hard_negatives(vectors(spark, rows + BAD))
    kinds = ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert [t for _, t in got.dtypes] == kinds
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_op12_edges(spark):
    assert hard_negatives.hard_negatives(vectors(spark, BAD[:5])).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, BAD).limit(0)).count() == 0
    # a repeated vec_id: of its anchors one asks, and as a negative it is a row each
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.9, 0.0], 2), (5, [0.9, 0.0], 2), (9, [5.0, 0.0], 2)]
    got = sorted(tuple(r)[:4] for r in hard_negatives.hard_negatives(vectors(spark, rows)).collect())
    assert got == [(100, 3, 1, 5), (100, 3, 2, 5)]
    assert hard_negatives.hard_negatives(vectors(spark, [(0, [1e300, 1.0], 1), (1, [1e300, 1.0], 2), (2, [1e300, 1.0], 3), (3, [-1e300, 1.0], 3)])).count() == 1


def test_url_parts(spark):
    cases = {
        "http://A.Org/x/Y?z#w": ("a.org", "/x/Y"), "x://h": ("h", ""), "x://h?q=/a": ("h", ""), "x://h#/a": ("h", ""), "a?b=://h/p": ("h", "/p"), "nothing": ("", ""),
        "": ("", ""), None: ("", ""), "://": ("", ""), "http://ÄB.org/\n/é": ("Äb.org", "/\n/é"), "x://h//a": ("h", "//a"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def test_rules(spark):
    want = {
        ("example.org", "/es/1"): ("block", "example.org/es/"), ("m.example.org", "/es/"): ("block", "example.org/es/"), ("myexample.org", "/es/"): ("allow", "org/"), ("example.org", "/en/12"): ("block", "example.org/en/1"),
        ("example.org", "/en/2"): ("allow", "org/"), ("org", "/"): ("allow", "org/"), ("org", ""): None, ("xorg", "/"): None, ("a.com", "/fr/"): ("allow", "com/fr/"), ("a.com", "/fr"): None, ("com", "/de/x"): ("block", "com/de/"),
    }
    df = spark.createDataFrame(list(want), "host string, path string")
    got = df.select("host", "path", url_filter.rule_for(F.col("host"), F.col("path")).alias("r")).collect()
    assert {(r.host, r.path): None if r.r is None else (r.r.verdict, r.r.rule) for r in got} == want


def brute_ranks(links, seeds, rounds=url_filter.ROUNDS):
    hosts = sorted({h for e in links for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    out = []
    for side in (0, 1):
        m = np.zeros((len(hosts),) * 2)
        for a, b in links:
            a, b = (a, b) if side == 0 else (b, a)
            m[at[b], at[a]] = 1
        m = url_filter.DAMPING * m / np.maximum(1, m.sum(axis=0))
        s = np.array([seeds.get(h, (0, 0))[side] for h in hosts], float)
        t = s.copy()
        for _ in range(rounds):
            t = s + m @ t
        out.append(t)
    return {h: (out[0][k], out[1][k]) for h, k in at.items()}


def test_op13(spark):
    page = "page_id long, url string, html string, host string, rule string, t string"
    a = lambda *hosts: "<p>" + " ".join(f'<A class="x" href="https://{h}/p?q">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/en/2", a("Friend.net", "hub.net", "good.org") + '<a href="/rel">'), (2, "http://friend.net/x", a("hub.net")), (3, "http://hub.net/", a("bad.com", "worse.com")),
        (4, "http://bad.com/de/1", a("worse.com")), (5, "http://bad.com/de/5", "<a href='//worse.com/x'><a href=http://bad.com:80/>"), (6, "http://worse.com/de/", a("bad.com")), (7, "http://worse.com/de/x", ""),
        (8, "http://farm.net/a", a("worse.com", "bad.com")), (9, "http://farm.net/b", None), (10, None, a("bad.com")), (11, "no host", a("worse.com")), (12, "http://alone.net", "<b href='http://bad.com'>"), (12, "http://alone.net", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], page)
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows)
    links = {("good.org", "friend.net"), ("good.org", "hub.net"), ("friend.net", "hub.net"), ("hub.net", "bad.com"), ("hub.net", "worse.com"), ("bad.com", "worse.com"), ("bad.com", "bad.com:80"), ("worse.com", "bad.com"), ("farm.net", "worse.com"), ("farm.net", "bad.com")}
    assert {(r.a, r.b) for r in url_filter.host_links(df).collect()} == links
    ranks = brute_ranks(links, {"good.org": (1, 0), "bad.com": (0, 1), "worse.com": (0, 1)})
    for r in got:
        trust, distrust = ranks.get(r.host, (0, 0))
        assert abs(r.trust - trust) < 1e-7 and abs(r.distrust - distrust) < 1e-7
        if r.rule is None:
            assert r.verdict == ("block" if distrust - trust > 0.5 else "allow")
    by = {r.page_id: r.verdict for r in got}
    assert by[1] == "allow" and by[4] == "block" and by[8] == by[9] == "block" and by[3] == by[10] == by[11] == by[12] == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_op13_sql(spark, tmp_path):
    """The query's SQL on a table with links, which the given pages lack."""
    import duckdb

    rng = np.random.default_rng(4)
    names = [f"h{k}.{'org' if k % 3 == 0 else 'com' if k % 3 == 1 else 'net'}" for k in range(30)]
    rows = []
    for k in range(400):
        h = names[int(rng.integers(30) ** 2 / 30)]
        out = "".join(f"<a href='http://{names[int(rng.integers(30))]}/'>" for _ in range(int(rng.integers(4))))
        rows.append((k, f"http://{h}/{('fr', 'de', 'de', 'en')[int(rng.integers(4))]}/{k}", out))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = sorted(c.execute(url_filter.URL_SQL).fetchall())
    got = url_filter.judge_urls(spark.read.parquet(str(tmp_path / "pages"))).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {v for *_, rule, v in want if rule is None} == {"allow", "block"}


def test_op8_aligned_side_by_side():
    from varspan.llm import near_dup

    rng = np.random.default_rng(6)
    a, b, most = [], [], []
    for _ in range(400):
        x = rng.integers(0, int(rng.choice([3, 40, 60000])), int(rng.integers(1, 60))).astype(np.uint16)
        y = x.tolist()
        for _ in range(int(rng.integers(0, 14))):
            k = int(rng.integers(0, len(y) + 1))
            how = rng.integers(3)
            y = y[:k] + ([int(rng.integers(0, 9))] if how else []) + y[k + (how < 2) :]
        y = np.array(y or [1], dtype=np.uint16)
        limit = int(0.2 * max(len(x), len(y)) + 1e-9) + int(rng.integers(0, 3))
        if abs(len(x) - len(y)) <= limit:
            a, b, most = [*a, x], [*b, y], [*most, limit]
    got = near_dup._banded(a, b, np.array(most))
    want = [near_dup.edit_distance(x.astype(np.uint32), y.astype(np.uint32), k) for x, y, k in zip(a, b, most, strict=True)]
    assert got.tolist() == [d if d <= k else -1 for d, k in zip(want, most, strict=True)] and 50 < sum(d >= 0 for d in got) < len(got) - 50


def test_op8_pairs_of_large_groups(spark, monkeypatch):
    """Near copies of one text, and texts that share a long passage: few pairs are aligned, and near copies are one class."""
    import random

    from varspan.llm import near_dup

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    some = lambda k: rng.choices(words, [1 / (i + 1) ** 0.8 for i in range(3000)], k=k)
    base, passage, n, texts = some(180), some(120), 400, []
    for _ in range(n):
        text = list(base)
        for k in rng.sample(range(180), rng.randint(8, 24)):
            text[k] = some(1)[0]
        texts.append(text)
    for _ in range(n):
        own = some(60)
        texts.append(own[:30] + passage + own[30:])
    seen, real = [], near_dup._verified

    def counted(pairs, words, similarity):
        seen.append(pairs.count())
        return real(pairs, words, similarity)

    monkeypatch.setattr(near_dup, "_verified", counted)
    out = near_dup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sum(seen) < 8 * n and {r.class_id for r in out if r.doc_id < n} == {0} and len({r.class_id for r in out}) == n + 1


def test_op4_fit_rises_to_a_top():
    rng = np.random.default_rng(3)
    docs = [[sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(0, 4))] for _ in range(80)]
    n = np.array([len(d) + i % 3 for i, d in enumerate(docs)], float)
    y = np.array([float(any(0 in s or (1 in s and 2 in s) for s in d)) for d in docs])
    y[::17] = 1 - y[::17]
    rise = toxicity._Rise(y, n, docs, 6, 0.01)

    def plain(theta):
        """The same by the definition: a document is clean if each of its sentences is."""
        out = 0.0
        for of, words, whole in zip(y, docs, n, strict=True):
            logits = [theta[-1] + sum(theta[w] for w in s) for s in words] + [theta[-1]] * int(whole - len(words))
            clean = math.prod(1 - 1 / (1 + math.exp(-z)) for z in logits)
            out += math.log(max(1 - clean if of else clean, 1e-9))
        return out - 0.01 * len(y) * 0.1 / 2 * sum(t * t for t in theta[:-1])

    for _ in range(5):
        theta = rng.normal(size=7)
        assert rise.value(theta) == pytest.approx(plain(theta), rel=1e-6)
        slope = [(rise.value(theta + e) - rise.value(theta - e)) / 2e-5 for e in np.eye(7) * 1e-5]
        some = rise.gradient(theta)
        assert some == pytest.approx(slope, rel=1e-4, abs=1e-4)
    model = toxicity._train(y, n, docs, list("abcdef"), 2000, 0.01)
    top = np.array([*model.weights.values(), model.bias])
    assert np.abs(rise.gradient(top)).max() < 0.05 and all(rise.value(top) > rise.value(top + e) for e in rng.normal(size=(50, 7)) * 0.3)
