"""Secret scans: all rules in one automaton and one byte pass."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.automaton import Dfa, compile_rules
from varspan.llm.common import bound_batches

#: Rules as (kind, pattern, letters in either case, characters that the part after the last quote or sign needs).
#: The kinds with a least length have it in the pattern, where a shorter match can hold no longer one.
RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", True, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", False, 0),
    ("hex", r"[0-9a-f]{24,}", False, 0),
)
#: More kinds, behind the base ones: heads of private keys, and tokens of chat services.
MORE_RULES = RULES + (
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", False, 0),
)
BASE = tuple(r[0] for r in RULES)
#: What stands before an assigned value: for its length.
_LEAD = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Bytes of a lane of the scan.
LANE = 2048


class Scanner:
    """Spans of each rule in UTF-8 texts, leftmost and not overlapping within a rule.

    The bytes of a batch are cut into lanes that step through the transition arrays side by side,
    each from the start state. A lane whose true first state, the last one of the lane before it,
    is another is run again from there until both runs meet, which takes a few bytes. A match ends
    where a rule's accepting run ends; the rule's automaton of reversed bytes then finds the
    leftmost start behind the rule's last match.
    """

    def __init__(self, rules=MORE_RULES):
        self.rules = rules
        self.all = compile_rules([(p, i) for _, p, i, _ in rules], anywhere=True)
        self.back = [compile_rules([(p, i)], anywhere=False, backwards=True) for _, p, i, _ in rules]
        self.lead = compile_rules([(_LEAD, True)], anywhere=False)
        self.rows = self.all.step.reshape(-1, self.all.classes).tolist()

    def _states(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The state after each byte; ``starts`` are the offsets at which texts begin."""
        dfa = self.all
        lanes = -(-len(data) // LANE)
        kinds = np.zeros(lanes * LANE, dtype=np.int32)
        kinds[: len(data)] = dfa.class_of[data]
        fresh = np.zeros(lanes * LANE, dtype=bool)
        fresh[starts[starts < len(data)]] = True
        by_step, restart = np.ascontiguousarray(kinds.reshape(lanes, LANE).T), np.ascontiguousarray(fresh.reshape(lanes, LANE).T)
        some = restart.any(axis=1)
        out = np.empty((LANE, lanes), dtype=np.int32)
        state = np.zeros(lanes, dtype=np.int32)
        for i in range(LANE):
            if some[i]:
                state[restart[i]] = 0
            state = dfa.step[state * dfa.classes + by_step[i]]
            out[i] = state
        flat = np.ascontiguousarray(out.T).ravel()
        for lane in range(1, lanes):
            at = lane * LANE
            s = int(flat[at - 1])
            while s and at < len(data) and not fresh[at]:
                s = self.rows[s][kinds[at]]
                if s == flat[at]:
                    break
                flat[at] = s
                at += 1
        return flat[: len(data)]

    def _start(self, k: int, data: bytes, least: int, end: int) -> int:
        """Leftmost start, ``least`` or later, of a match of rule k that ends at ``end``; -1: none."""
        dfa, s, found = self.back[k], 0, -1
        for at in range(end - 1, least - 1, -1):
            s = int(dfa.step[s * dfa.classes + dfa.class_of[data[at]]])
            if s == dfa.dead:
                break
            if dfa.accepts[s]:
                found = at
        return found

    def _value(self, data: bytes, start: int, end: int) -> int:
        """Length of the value of an assignment: the lead takes as much as it can."""
        dfa, s, found = self.lead, 0, start
        for at in range(start, end):
            s = int(dfa.step[s * dfa.classes + dfa.class_of[data[at]]])
            if s == dfa.dead:
                break
            if dfa.accepts[s]:
                found = at + 1
        return end - found

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in bytes, by start and rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data):
            return found
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        bits = self.all.accepts[self._states(data, starts)]
        after = np.zeros_like(bits)
        after[:-1] = bits[1:]
        after[ends[ends > 0] - 1] = 0
        over = bits & ~after
        # the end of each rule's last match in a text, so that its next one starts behind it
        last: dict[tuple[int, int], int] = {}
        at = np.flatnonzero(over)
        for at, doc in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
            text, end = texts[doc], at - int(starts[doc]) + 1
            for k in range(len(self.rules)):
                if over[at] >> k & 1:
                    if (s := self._start(k, text, last.get((doc, k), 0), end)) >= 0:
                        found[doc].append((s, k, end))
                        last[doc, k] = end
        for doc, own in enumerate(found):
            found[doc] = sorted(x for x in own if not self.rules[x[1]][3] or self._value(texts[doc], x[0], x[2]) >= self.rules[x[1]][3])
        return found


def _points(text: bytes, spans):
    """Byte offsets to code points: one count of the bytes that begin one."""
    if not spans:
        return []
    upto = np.append(0, np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80))
    return [(int(upto[s]), k, int(upto[e])) for s, k, e in spans]


def scan(documents: DataFrame, rules=MORE_RULES) -> DataFrame:
    """doc_id, n_<kind> of each rule, spans [kind, start, end], redacted.

    Offsets are code points of the whole text, ends exclusive. ``redacted`` is the text with the
    secrets replaced by [kind]; a null text has no spans and stays null. Case and letters are
    ASCII; a row repeated is scanned again. An empty text has no spans, a null doc_id stays null,
    other columns are not looked at, and an empty table gives no rows.
    """
    bound_batches(documents.sparkSession)
    kinds = [r[0] for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds], ("spans", pa.list_(span)), ("redacted", pa.string())])

    scanner = Scanner(rules)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            coded = [(t or "").encode() for t in texts]
            counts, rows, clean = [[] for _ in kinds], [], []
            for text, data, own in zip(texts, coded, scanner.spans(coded), strict=True):
                own = _points(data, own)
                rows.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in own])
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in own))
                clean.append(_redact(text, own, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(rows, schema.field("spans").type), pa.array(clean, pa.string())], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"n_{k} long" for k in kinds)
    return docs.mapInArrow(run, f"doc_id long, {fields}, spans array<struct<kind:string,start:long,end:long>>, redacted string")


def _redact(text: str | None, own, kinds) -> str | None:
    if not own:
        return text
    out, at = [], 0
    for s, k, e in own:
        if s >= at:
            out += [text[at:s], f"[{kinds[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, rules=MORE_RULES) -> DataFrame:
    """The documents with secrets replaced in ``text`` and ``n_chars`` set anew; all other columns stay, whatever their names.

    A null text stays null, with a null n_chars; rows that repeat are scanned each; an empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    kinds = [r[0] for r in rules]

    scanner = Scanner(rules)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            coded = [(t or "").encode() for t in texts]
            clean = [_redact(t, _points(d, own), kinds) for t, d, own in zip(texts, coded, scanner.spans(coded), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def digest(doc_spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in doc_spans).encode()).hexdigest()


__all__ = ["Dfa", "Scanner", "digest", "redact", "scan"]
