"""Seeds and segments are found where a pair is read; pairs of one id, and very long ones, meet in a grouping."""

import random
from collections import Counter

from varspan.jobs import queries
from varspan.operators import kmers

TURN = str.maketrans("ACGT", "TGCA")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(pairs, k=17):
    """Seeds of pairs (id, query, ref) with A, C, G, T and other letters; those of one id are counted together."""
    out = []
    for i in {p[0] for p in pairs}:
        own = [p for p in pairs if p[0] == i]
        cut = lambda bs: [(b[j : j + k], j) for b in bs for j in range(len(b) - k + 1)]
        ref = _once(cut([r for _, _, r in own]))
        turned = ["".join(c if c in "ACGT" else "N" for c in q)[::-1].translate(TURN) for _, q, _ in own]
        for strand, qs in (("+", [q for _, q, _ in own]), ("-", turned)):
            out += [(i, strand, j, ref[x]) for x, j in _once(cut(qs)).items() if x in ref]
    return sorted(out)


def _once(found):
    n = Counter(x for x, _ in found)
    return {x: j for x, j in found if n[x] == 1}


def runs(found, k=17, least=30):
    left, out = set(found), []
    for i, s, q, r in sorted(found):
        if (i, s, q - 1, r - 1) not in left:
            n = 1
            while (i, s, q + n, r + n) in left:
                n += 1
            if n + k - 1 >= least:
                out.append((i, s, q, r, n + k - 1))
    return sorted(out)


def some_pairs():
    rng = random.Random(9)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for i in range(30):
        ref = word("ACGTN" if i % 3 else "ACGTacgtNé\U0001f9ec", rng.choice((0, 16, 17, 60, 900)))
        q = ref[len(ref) // 4 : len(ref) // 2] + word("ACGT", rng.choice((0, 5, 40)))
        pairs.append((i, q if i % 2 else q[::-1].translate(TURN), ref))
    # ids 3 and 4 twice, one of them with the same rows
    return pairs + [(3, pairs[4][1], pairs[4][2]), (4, pairs[4][1], pairs[4][2]), (7, "", "ACGT" * 20)]


def test_no_kmer_is_exchanged(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abcdefgh XYZ,.1") for _ in range(700))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    code = str.maketrans(queries.LETTERS, queries.BASES)
    refs = [(i, "".join(c for c in text if c.isalpha()).translate(code)) for i, text in docs]
    thirds = [(i, ref[len(ref) // 3 :][: len(ref) // 3], ref) for i, ref in refs]
    want = by_hand([(i, q if i % 2 == 0 else q[::-1].translate(TURN), ref) for i, q, ref in thirds])
    got = queries.q_kmer_seeds(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == want and want
    got = queries.q_kmer_segments(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == runs(want) and runs(want)


def test_pairs_of_one_id_and_any_letters(spark):
    pairs = some_pairs()
    df = spark.createDataFrame([*pairs, (None, "ACGT" * 9, "ACGT" * 9), (40, None, "ACGTTGCA" * 9), (41, "ACGTTGCA" * 9, None)], "id long, query string, ref string")
    want = by_hand(pairs)
    assert rows(kmers.seeds(df)) == want and len(want) > 500
    assert rows(kmers.pair_segments(df)) == runs(want) == rows(kmers.segments(kmers.seeds(df)))


def test_long_pairs_meet_in_a_grouping(spark, monkeypatch):
    pairs = [p for p in some_pairs() if p[0] not in (3, 4)]
    want = by_hand(pairs)
    df = spark.createDataFrame(pairs, "id long, query string, ref string")
    for most, block in ((500, 1 << 19), (1 << 20, 100)):
        monkeypatch.setattr(kmers, "LONG", most)
        monkeypatch.setattr(kmers, "BLOCK", block)
        assert rows(kmers.seeds(df)) == want and rows(kmers.pair_segments(df)) == runs(want)


def test_other_lengths_of_kmers(spark):
    pairs = some_pairs()
    df = spark.createDataFrame(pairs, "id long, query string, ref string")
    for k in (1, 6, 32, 45):
        assert rows(kmers.seeds(df, k)) == by_hand(pairs, k)
