"""op8: a block of near copies gives the links that join its classes, not all pairs, and joins all that links of its texts could join."""

import random

import numpy as np
import pyarrow as pa
import pytest

from varspan.llm import near_dup


def copies(rng, words, n, edits):
    base = rng.choices(words, k=n)
    while True:
        text = list(base)
        for k in rng.sample(range(n), rng.randint(*edits)):
            text[k] = rng.choice(words)
        yield text


def table_of(texts, classes, role):
    ws = [near_dup.codes(" ".join(t))[1] for t in texts]
    return ws, pa.table({
        "g": pa.array([7] * len(ws), pa.int64()), "role": pa.array(role, pa.int32()), "c": pa.array(classes, pa.int64()), "tid": pa.array(range(len(ws)), pa.int64()), "n": pa.array([len(w) for w in ws], pa.int32()),
        "hist": pa.array([near_dup.histogram(w) for w in ws], pa.binary()),
    })


def parts(pairs, n, classes):
    joined = near_dup._Joined()
    joined.join(classes, list(range(n)))
    joined.join([a for a, _ in pairs], [b for _, b in pairs])
    return [joined.least(i) for i in range(n)]


def linked(ws, a, b):
    most = int(0.2 * max(len(ws[a]), len(ws[b])) + 1e-9)
    return near_dup.edit_distance(ws[a], ws[b], most) <= most


@pytest.mark.parametrize("role", ["own", "sides"])
@pytest.mark.parametrize("at_once", [near_dup.AT_ONCE, 50])
def test_block_joins_what_its_links_join(monkeypatch, role, at_once):
    monkeypatch.setattr(near_dup, "AT_ONCE", at_once)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    texts = [next(x) for x in (copies(rng, words, 120, (0, 20)), copies(rng, words, 60, (0, 9)), copies(rng, words, 500, (40, 80)), copies(rng, words, 20, (0, 3))) for _ in range(40)]
    shuffled = list(texts[0])
    texts += [rng.sample(shuffled, len(shuffled)) for _ in range(10)] + [rng.choices(words, k=100) for _ in range(20)]
    rng.shuffle(texts)
    n = len(texts)
    roles = [2] * n if role == "own" else [int(i % 3 > 0) for i in range(n)]
    # some are of one class already, on one side only, as members of a bucket's largest class are
    classes = [i - i % 9 if roles[i] == 2 and i % 9 < 2 else i for i in range(n)]
    ws, t = table_of(texts, classes, roles)
    # a block knows 16 bits of each word
    ws = [w.astype(np.uint16) for w in ws]
    got = [(*x,) for y in near_dup._pairs_of(t, 0.8, 4, near_dup._Joined()) for x in zip(*(z.tolist() for z in y), strict=True)]
    sure = [(a, b) for a, b, _, s in got if s]
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if (roles[a] == 2 or roles[a] != roles[b]) and classes[a] != classes[b] and linked(ws, a, b)]
    assert all(linked(ws, a, b) for a, b in sure) and len(sure) == len(got)
    assert len(want) > 4 * n > n > len(sure) and parts(sure, n, classes) == parts(want, n, classes)
    # without few, all links
    every = {(a, b) for y in near_dup._pairs_of(t, 0.8, None, near_dup._Joined()) for a, b in zip(y[0].tolist(), y[1].tolist(), strict=True)}
    assert every == set(want)


def test_longer_texts_leave_their_block():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    make = copies(rng, words, near_dup.ALIGNED + 40, (10, 50))
    texts = [next(make) for _ in range(12)] + [next(make)[: near_dup.ALIGNED] for _ in range(4)]
    ws, t = table_of(texts, [*range(16)], [2] * 16)
    for few in (4, None):
        got = [(*x,) for y in near_dup._pairs_of(t, 0.8, few, near_dup._Joined()) for x in zip(*(z.tolist() for z in y), strict=True)]
        doubt = {(a, b) for a, b, _, s in got if not s}
        assert few is None or all(max(len(ws[a]), len(ws[b])) > near_dup.ALIGNED for a, b in doubt)
        ends = {x for p in doubt for x in p}
        assert ends >= set(range(12)) and (few or len(doubt) >= 66) and all(max(len(ws[a]), len(ws[b])) <= near_dup.ALIGNED for a, b, _, s in got if s)


def test_words_that_agree_in_16_bits_only():
    """A joining pair of a block may not link by whole words; the pass over all pairs, which then follows, holds every link."""
    real = near_dup.codes

    def codes(text):
        # the last letter is not among the 16 bits
        key, w = real(text)
        low = real(" ".join(x[:-1] for x in (text or "").split()))[1] & np.uint32(0xFFFF)
        return key, low | (w & np.uint32(0xFFFF0000))

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    base = rng.choices(words, k=100)
    texts = [" ".join(w + ("y" if k in at else "x") for k, w in enumerate(base)) for at in (set(), {*range(0, 100, 4)}, {*range(0, 60, 4)}, {*range(1, 100, 4)}, {*range(1, 60, 4)})]
    ws = [codes(t)[1] for t in texts]
    t = table_of([x.split() for x in texts], [*range(5)], [2] * 5)[1].set_column(5, "hist", pa.array([near_dup.histogram(w) for w in ws], pa.binary()))
    given = {(a, b) for y in near_dup._pairs_of(t, 0.8, 4, near_dup._Joined()) for a, b in zip(y[0].tolist(), y[1].tolist(), strict=True)}
    every = {(a, b) for y in near_dup._pairs_of(t, 0.8, None, near_dup._Joined()) for a, b in zip(y[0].tolist(), y[1].tolist(), strict=True)}
    assert len(given) == 4 and len(every) == 10 and any(not linked(ws, a, b) for a, b in given) and any(linked(ws, a, b) for a, b in every - given)


def test_a_group_of_near_copies_gives_few_rows(spark, monkeypatch):
    """Before, 400 near copies of one text and 400 texts with a passage gave about 3000 rows of candidates in the first of two passes."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    make = copies(rng, words, 150, (10, 24))
    texts = [next(make) for _ in range(400)]
    passage = rng.choices(words, k=100)
    texts += [rng.choices(words, k=25) + passage + rng.choices(words, k=25) for _ in range(400)]
    rows, real = [], near_dup._met

    def counted(*args):
        out = near_dup.save(real(*args), "counted")
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_met", counted)
    out = near_dup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    ws = [near_dup.codes(" ".join(t))[1] for t in texts[:400]]
    want = parts([(a, b) for a in range(400) for b in range(a + 1, 400) if linked(ws, a, b)], 400, list(range(400)))
    assert [r.class_id for r in sorted(out, key=lambda r: r.doc_id)] == want + list(range(400, 800))
    assert len(rows) == 1 and rows[0] < 800
