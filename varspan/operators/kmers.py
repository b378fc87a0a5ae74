"""Where a sequence came from: k-mers that are unique on both sides, and the diagonals they line up on.

A pair's seeds come from its own row alone, so they are found where the row is read: no k-mer is
exchanged. Pairs that share an id, whose k-mers are counted together, and very long ones are cut
into k-mers that meet in a grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from varspan.functions.calls import reverse_complement
from varspan.sources.tables import kept

#: Start positions of k-mers that are cut from one piece, so that a long sequence isn't walked from its beginning for each.
PIECE = 512
#: Bases of the pairs that one pass of arrays holds, and of the longest sequence that is no case for the grouping.
BLOCK, LONG = 1 << 19, 1 << 20


def positions(sequences: DataFrame, bases: Column, k: int) -> DataFrame:
    """id, pos (from 0), kmer of every k-mer; sequences that are null or shorter than k have none."""
    x = sequences.select("id", bases.alias("_b")).where(F.length("_b") >= k)
    x = x.select("id", "_b", F.explode(F.sequence(F.lit(0), F.length("_b") - k, F.lit(PIECE))).alias("_at"))
    x = x.select("id", "_at", F.substring("_b", F.col("_at") + 1, F.lit(PIECE + k - 1)).alias("_b"))
    cut = F.transform(F.sequence(F.lit(0), F.length("_b") - k), lambda i: F.substring("_b", i + 1, F.lit(k)))
    return x.select("id", "_at", F.posexplode(cut).alias("_i", "kmer")).select("id", (F.col("_at") + F.col("_i")).cast("long").alias("pos"), "kmer")


def _joined(a: np.ndarray, a_bits: int, a_width: int, b: np.ndarray, b_bits: int) -> tuple[np.ndarray, int]:
    """Numbers of stretches, each followed by the stretch of ``b`` that begins ``a_width`` further on; ranks take their place where a word can't hold both."""
    if a_bits + b_bits > 62:
        a, a_bits = _ranked(a)
        b, b_bits = _ranked(b)
    m = min(len(a), len(b) - a_width)
    return (a[:m] << b_bits) | b[a_width : a_width + m], a_bits + b_bits


def _ranked(a: np.ndarray) -> tuple[np.ndarray, int]:
    values, at = np.unique(a, return_inverse=True)
    return at.astype(np.int64), max(1, int(len(values) - 1).bit_length())


def _numbered(codes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """A number for the k letters from each place on, the same for the same letters and no other, and how many bits it has."""
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.cumsum(seen) - 1
    power, bits, width = letters[codes].astype(np.int64), max(1, int(letters[-1]).bit_length()), 1
    out, out_bits, done = None, 0, 0
    while True:
        if k & width:
            out, out_bits = (power, bits) if out is None else _joined(out, out_bits, done, power, bits)
            done += width
        if done == k:
            return out, out_bits
        power, bits = _joined(power, bits, width, power, bits)
        width *= 2


def _once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur once, in order, and where."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1], [True]))
    alone = new[1:] & new[:-1]
    return s[alone], order[alone]


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _turned(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The reverse complement of each sequence, as functions.calls.reverse_complement has it: letters but A, C, G, T are N."""
    pair = np.full(max(int(codes.max()), ord("T")) + 1, ord("N"), np.uint32)
    pair[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]
    ends = np.cumsum(lengths)
    return pair[codes][np.repeat(2 * ends - lengths - 1, lengths) - np.arange(len(codes))]


def _seeds_of(refs: list[str], queries: list[str], k: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """strand, and of its seeds the pair's place, query_pos and ref_pos; all sequences have k bases or more."""
    n = len(refs)
    own = [np.array([len(s) for s in side], np.int64) for side in (refs, queries)]
    query = _letters(queries)
    kmer, bits = _numbered(np.concatenate([_letters(refs), query, _turned(query, own[1])]), k)
    if bits + n.bit_length() > 62:
        kmer, bits = _ranked(kmer)
    found, start = [], 0
    for lengths in (own[0], own[1], own[1]):
        count = lengths - k + 1
        pair = np.repeat(np.arange(n), count)
        pos = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        keys, at = _once((pair << bits) | kmer[start + (np.cumsum(lengths) - lengths)[pair] + pos])
        found.append((keys, pos[at]))
        start += int(lengths.sum())
    ref, ref_pos = found[0]
    for strand, (keys, pos) in zip("+-", found[1:], strict=True):
        at = np.searchsorted(ref, keys)
        hit = (ref[np.minimum(at, len(ref) - 1)] == keys) if len(ref) else np.zeros(len(keys), bool)
        yield strand, keys[hit] >> bits, pos[hit], ref_pos[at[hit]]


def _runs_of(pair: np.ndarray, query: np.ndarray, ref: np.ndarray, k: int, least: int) -> tuple[np.ndarray, ...]:
    """Pair's place, query_start, ref_start and length of runs of seeds side by side on one diagonal."""
    order = np.lexsort((query, ref - query, pair))
    pair, query, ref = pair[order], query[order], ref[order]
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (query[1:] != query[:-1] + 1) | (ref[1:] != ref[:-1] + 1)))[: len(pair)]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(pair))) + k - 1
    first, length = first[length >= least], length[length >= least]
    return pair[first], query[first], ref[first], length


def _in_rows(pairs: DataFrame, k: int, least: int | None) -> DataFrame:
    """Seeds of pairs, or with ``least`` their segments, each pair in the task that reads it."""
    kind = pairs.schema["id"].dataType
    cells = ["query_pos", "ref_pos"] if least is None else ["query_start", "ref_start", "length"]
    schema = pa.schema([("id", to_arrow_type(kind)), ("strand", pa.string()), *[(c, pa.int64()) for c in cells]])

    def blocks(batch):
        """Places in the batch, references and queries of about BLOCK bases each time; pairs with a side that is null or shorter than k have no k-mers."""
        at, refs, queries, size = [], [], [], 0
        for i, (r, q) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if min(len(r or ""), len(q or "")) < k:
                continue
            if at and size + len(r) + 2 * len(q) > BLOCK:
                yield np.array(at), refs, queries
                at, refs, queries, size = [], [], [], 0
            at.append(i)
            refs.append(r)
            queries.append(q)
            size += len(r) + 2 * len(q)
        if at:
            yield np.array(at), refs, queries

    def run(batches):
        for batch in batches:
            for at, refs, queries in blocks(batch):
                for strand, pair, *places in _seeds_of(refs, queries, k):
                    if least is not None:
                        pair, *places = _runs_of(pair, *places, k, least)
                    ids = batch.column(0).take(pa.array(at[pair])).cast(schema.field("id").type)
                    yield pa.RecordBatch.from_arrays([ids, pa.repeat(strand, len(pair)), *[pa.array(x, pa.int64()) for x in places]], schema=schema)

    return pairs.select("id", "ref", "query").mapInArrow(run, f"id {kind.simpleString()}, strand string, " + ", ".join(f"{c} long" for c in cells))


def _grouped(pairs: DataFrame, k: int) -> DataFrame:
    """Seeds of pairs whose k-mers meet in a grouping by (id, k-mer): k-mers that repeat are counted, never paired up."""
    sides = [("r", F.col("ref")), ("+", F.col("query")), ("-", reverse_complement(F.col("query")))]
    every = [positions(pairs, b, k).select("id", "kmer", "pos", F.lit(s).alias("side")) for s, b in sides]
    on = lambda s: F.col("side") == s
    at = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("id", "kmer").agg(*[c for s, _ in sides for c in (F.count_if(on(s)).alias(f"n{s}"), F.max(F.when(on(s), F.col("pos"))).alias(f"at{s}"))])
    found = F.array(*[F.when(F.col(f"`n{s}`") == 1, F.struct(F.lit(s).alias("strand"), F.col(f"`at{s}`").alias("query_pos"))) for s in "+-"])
    return at.where("nr = 1").select("id", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"), F.col("atr").alias("ref_pos")).select("id", "e.strand", "e.query_pos", "ref_pos")


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs whose row is enough, and those that share an id or are over LONG (None, if there are none). Pairs with a null id are in neither."""
    pairs = pairs.where(F.col("id").isNotNull())
    longest = F.max(F.greatest(F.length("ref"), F.length("query")))
    apart = kept(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), longest.alias("longest")).where((F.col("n") > 1) | (F.col("longest") > LONG)).select("id"))
    if apart.isEmpty():
        return pairs, None
    return pairs.join(apart, "id", "left_anti"), pairs.join(apart, "id", "left_semi")


def seeds(pairs: DataFrame, k: int = 17) -> DataFrame:
    """id, strand, query_pos, ref_pos of k-mers that occur once in ``query`` and once in ``ref`` of a pair (id, query, ref).

    On the reverse strand positions are those of the query's reverse complement. Pairs of one id count
    as one; those with a null id, or a null side, have no seeds.
    """
    alone, rest = _dealt(pairs)
    found = _in_rows(alone, k, None)
    return found if rest is None else found.unionByName(_grouped(rest, k))


def pair_segments(pairs: DataFrame, k: int = 17, least: int = 30) -> DataFrame:
    """``segments`` of the seeds of ``pairs``; only those of pairs that share an id, or are very long, are exchanged."""
    alone, rest = _dealt(pairs)
    found = _in_rows(alone, k, least)
    return found if rest is None else found.unionByName(segments(_grouped(rest, k), k, least))


def segments(found: DataFrame, k: int = 17, least: int = 30) -> DataFrame:
    """id, strand, query_start, ref_start, length of runs of seeds side by side on one diagonal, of ``least`` bases or more."""
    w = Window.partitionBy("id", "strand", "_d").orderBy("query_pos")
    x = found.withColumn("_d", F.col("ref_pos") - F.col("query_pos")).withColumn("_run", F.col("query_pos") - F.row_number().over(w))
    runs = x.groupBy("id", "strand", "_d", "_run").agg(F.min("query_pos").alias("query_start"), F.min("ref_pos").alias("ref_start"), (F.count(F.lit(1)) + k - 1).alias("length"))
    return runs.where(F.col("length") >= least).select("id", "strand", "query_start", "ref_start", "length")
