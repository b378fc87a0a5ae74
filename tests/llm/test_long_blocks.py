"""op8: texts of more than 512 words are aligned in their block too, and two of them meet in one bucket only."""

import random

import numpy as np
import pyarrow as pa

from varspan.llm import near_dup


def texts_with_a_passage(seed, n, own):
    """Texts that share 600 words: those with few words of their own link, others don't, though counts of words allow it."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    passage = rng.choices(words, k=600)
    return [rng.choices(words, k=rng.randint(*own)) + passage for _ in range(n)]


def linked(x, y):
    most = int(0.2 * max(len(x), len(y)) + 1e-9)
    return near_dup.edit_distance(x, y, most) <= most


def test_long_texts_of_a_block_are_aligned_there():
    """Before, each pair whose counts allow a link left its block, from every bucket that it shares."""
    ws = [near_dup.codes(" ".join(t))[1] for t in texts_with_a_passage(5, 40, (120, 180))]
    t = pa.table({
        "g": pa.array([7] * 40, pa.int64()), "role": pa.array([2] * 40, pa.int32()), "c": pa.array(range(40), pa.int64()), "tid": pa.array(range(40), pa.int64()),
        "n": pa.array([len(w) for w in ws], pa.int32()), "hist": pa.array([near_dup.histogram(w) for w in ws], pa.binary()),
    })
    # a block knows 16 bits of each word
    known = [w.astype(np.uint16) for w in ws]
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if linked(known[a], known[b])}
    got = [(a, b, s) for y in near_dup._pairs_of(t, 0.8, 4, near_dup._Joined()) for a, b, _, s in zip(*(z.tolist() for z in y), strict=True)]
    assert all(s for _, _, s in got) and {(a, b) for a, b, _ in got} <= want and len(got) < 40 < len(want) < 39 * 20
    assert parts(got, 40) == parts([(*p, True) for p in want], 40)
    every = {(a, b) for y in near_dup._pairs_of(t, 0.8, None, near_dup._Joined()) for a, b in zip(y[0].tolist(), y[1].tolist(), strict=True)}
    assert every == want

    # a group for each bucket: all of them together hold each link once
    sk = near_dup.sketches_all(ws, near_dup.K, near_dup.MINIMA, near_dup.SKETCHES, 0.8)
    rows = sorted((int(b), i) for i, s in enumerate(sk) for b in s.view(np.int64))
    share = {(a, b) for a in range(40) for b in range(a + 1, 40) if set(sk[a].tolist()) & set(sk[b].tolist())}
    at = pa.array([i for _, i in rows])
    of = pa.chunked_array([pa.array([b for b, _ in rows], pa.int64())])
    groups = t.take(at).set_column(0, "g", of).append_column("bucket", of).append_column("sk", pa.array([sk[i].view(np.int64) for _, i in rows], pa.list_(pa.int64())))
    met = [(a, b) for y in near_dup._pairs_of(groups, 0.8, None, near_dup._Joined()) for a, b in zip(y[0].tolist(), y[1].tolist(), strict=True)]
    assert len(met) == len(set(met)) and set(met) == want & share


def parts(pairs, n):
    joined = near_dup._Joined()
    joined.join([a for a, _, _ in pairs], [b for _, b, _ in pairs])
    return [joined.least(i) for i in range(n)]


def test_rows_that_blocks_of_long_texts_make(spark, monkeypatch):
    texts = texts_with_a_passage(6, 90, (120, 180))
    made, real = spark.sparkContext.accumulator(0), near_dup._pairs_of

    def counted(*args):
        for got in real(*args):
            made.add(len(got[0]))
            yield got

    monkeypatch.setattr(near_dup, "_pairs_of", counted)
    out = near_dup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    ws = [near_dup.codes(" ".join(t))[1] for t in texts]
    sk = [set(x.tolist()) for x in near_dup.sketches_all(ws, near_dup.K, near_dup.MINIMA, near_dup.SKETCHES, 0.8)]
    want = parts([(a, b, True) for a in range(90) for b in range(a + 1, 90) if sk[a] & sk[b] and linked(ws[a], ws[b])], 90)
    assert [r.class_id for r in sorted(out, key=lambda r: r.doc_id)] == want
    assert made.value < 90, made.value
