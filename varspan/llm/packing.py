"""Cost-balanced packing: descending pieces go to the cheapest sequence with room, by linear plus quadratic cost."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches

#: Tokens of a sequence, the id that ends a document, tokens or documents that are packed together, and the cost of l tokens: l + l*l/ATTENTION.
LENGTH, END, ROOM, DOCS, ATTENTION = 1024, 0, 2_000_000, 4096, 2048.0
#: Fixed value: the string that the vocabulary's file names as special, and its id.
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict = {}


def encoder(path: str, pattern: str):
    """The byte-level BPE of a ranks file; its ids equal those of the same vocabulary in the other library's format."""
    import tiktoken

    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def token_ids(text: str | None, path: str, pattern: str, exact: str | None) -> np.ndarray:
    """A text's ids and END. The pattern's engine gives up on a run of about a million blanks; such a text goes to the slower library, whose file is ``exact``."""
    try:
        own = np.frombuffer(encoder(path, pattern).encode_to_numpy(text or "", allowed_special="all"), dtype=np.uint32)
    except ValueError:
        if exact is None:
            raise
        if exact not in _encoders:
            from tokenizers import Tokenizer

            _encoders[exact] = Tokenizer.from_file(exact)
        own = np.array(_encoders[exact].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.append(own, np.uint32(END)).astype("<u4")


def balance(lengths: np.ndarray, size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces of at most ``size``, each token in one.

    Whole runs of ``size`` are sequences of their own. The rests, as few sequences as can hold
    them, are dealt in descending order: to the cheapest sequence in which a rest fits, or, if it
    fits in none, cut to fill the cheapest that has any room. So less than one sequence is padding.
    """
    out, sequence = [], 0
    for d in np.flatnonzero(lengths >= size):
        for b in range(int(lengths[d]) // size):
            out.append((int(d), b * size, size, sequence, 0))
            sequence += 1
    rest = lengths % size
    bins = -(-int(rest.sum()) // size)
    cost, used = np.zeros(bins), np.zeros(bins, dtype=np.int64)
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(lengths[d] - rest[d])
        while left:
            fits = used + left <= size
            if not fits.any():
                fits = used < size
            s = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, size - int(used[s]))
            out.append((int(d), start, n, sequence + s, int(used[s])))
            used[s] += n
            cost[s] += n + n * n / ATTENTION
            start, left = start + n, left - n
    return out


def pack(documents: DataFrame, path: str, pattern: str, exact: str | None = None, size: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded of every piece.

    A document's ids are its text's and then END, so a null or empty text has one token. Tasks
    tokenise and pack their own rows, about ROOM tokens at a time: nothing is shuffled, and what
    is held is bounded by ROOM and the longest document. A sequence's id has its partition and
    number in it; its tokens are padded to ``size`` unless they are a power of two already. Rows
    that repeat a doc_id are documents of their own; a null doc_id stays null. Other columns are not
    looked at, and an empty table gives no rows. ``path`` is the ranks file of the vocabulary and
    ``exact`` its JSON file, for texts that the first can't cut.
    """
    bound_batches(documents.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]

    def run(batches):
        first = TaskContext.get().partitionId() << 36
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, tokens, held, first
            lengths = np.array([len(t) for t in tokens])
            pieces = balance(lengths, size)
            d, start, n, seq, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(tokens[a][b : b + c].tobytes()) for a, b, c in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)]
            total = np.bincount(seq, weights=n).astype(np.int64)
            padded = np.where(total & (total - 1) == 0, total, size)
            columns = [pa.array([ids[x] for x in d], pa.int64()), start, n, np.array(crc, dtype=np.int64), lengths[d], seq + first, offset, padded[seq]]
            first += int(seq.max()) + 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = token_ids(text, path, pattern, exact)
                ids.append(doc_id)
                tokens.append(own)
                held += len(own)
                if held >= ROOM or len(ids) >= DOCS:
                    yield flush()
        if ids:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))
