"""q_kmer_seeds has a row for each seed, not sums of them."""

import random
import re
from collections import Counter

from varspan.jobs import queries


def brute(docs, k=17):
    turn, code = str.maketrans("ACGT", "TGCA"), dict(zip(queries.LETTERS, queries.BASES, strict=True))
    for i, text in docs:
        ref = "".join(code[c] for c in re.sub("[^A-Za-z]", "", text))
        third = len(ref) // 3
        query = ref[third : 2 * third]
        query = query if i % 2 == 0 else query[::-1].translate(turn)
        cut = lambda b: [b[j : j + k] for j in range(len(b) - k + 1)]
        there = cut(ref)
        once = {x for x, n in Counter(there).items() if n == 1}
        for strand, q in (("+", query), ("-", query[::-1].translate(turn))):
            here = cut(q)
            yield from ((i, strand, j, there.index(x)) for x, n in Counter(here).items() if n == 1 and x in once for j in (here.index(x),))


def test_kmer_seeds_are_rows(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abcdefgh XYZ,.1") for _ in range(rng.choice((10, 70, 400, 2500))))) for i in range(24)]
    docs.append((24, "abcd" * 80 + docs[3][1]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.q_kmer_seeds(spark, str(tmp_path)).select("id", "strand", "query_pos", "ref_pos").collect())
    assert got == sorted(brute(docs)) and len(got) > 2000
    # the SQL keeps every seed, too
    assert queries.ORACLE["q_kmer_seeds"].endswith("SELECT * FROM kp")
