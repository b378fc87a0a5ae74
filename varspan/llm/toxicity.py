"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches, held_out, save

#: Labelled documents, and characters of their texts, that the model is fitted on, about; words and stems that it may weigh.
FIT_DOCS, FIT_CHARS, VOCABULARY = 20_000, 100_000_000, 4096
#: A stem is a word's first letters; so many make one, with a mark behind it, as words of one family share them.
STEM, MARK = 4, "*"
#: A word or stem is weighed if its share of toxic documents is so many standard deviations from that of all, and it is in so many documents and shares of them.
SIGMAS, LEAST, LEAST_SHARE = 5.0, 4, 0.0005
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(sentence: str) -> set[str]:
    """The distinct words of a sentence, lower-cased, and the stems of the longer ones."""
    words = set(WORD.findall(sentence.lower()))
    return words | {w[:STEM] + MARK for w in words if len(w) > STEM}


@dataclass(frozen=True)
class NoisyOr:
    """A sentence with features S has logit bias + sum of weights of those in S that have one."""

    bias: float
    weights: dict[str, float]

    @cached_property
    def tables(self) -> tuple[dict[str, float], dict[str, float]]:
        """The weights of words, and those of stems by their letters."""
        stems = {w: x for w, x in self.weights.items() if w.endswith(MARK)}
        return {w: x for w, x in self.weights.items() if w not in stems}, {w[:STEM]: x for w, x in stems.items()}

    def sentences(self, text: str | None):
        """(start, end, logit) of each sentence."""
        (of_word, of_stem), out = self.tables, []
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m[0].lower()))
            stems = of_stem.keys() & {w[:STEM] for w in words if len(w) > STEM}
            z = self.bias + sum(of_word[w] for w in sorted(of_word.keys() & words)) + sum(of_stem[w] for w in sorted(stems))
            out.append((m.start(), m.end(), z))
        return out


def _softplus(z):
    return np.logaddexp(0.0, z)


def _words(text: str | None) -> list[set[str]]:
    return [features(s) for s in SENTENCE.findall(text or "")]


def fit(documents: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, vocabulary: int = VOCABULARY, rounds: int = 400, decay: float = 3e-4) -> NoisyOr:
    """Fit on about ``fit_docs`` labelled documents of about ``fit_chars`` characters that are not held out, dealt by hash.

    Counts of words and stems by label pick the vocabulary on the executors: those whose share of
    toxic documents is SIGMAS standard deviations from that of all, ``vocabulary`` of them at most,
    the furthest first, ties by spelling. What the driver trains on is the sample's sentences in that
    vocabulary, bounded by the sample. Without both labels the bias alone is fitted. Labels that
    repeat a doc_id count once, the largest; null labels and ids don't count.
    """
    y = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n = y.count()
    if n > fit_docs:
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(fit_docs / n * (1 << 30)))
    # about fit_docs rows of two numbers: a bounded side
    docs = save(documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("y", "text"), "fit")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > fit_chars:
        docs = docs.where(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 30)) < int(fit_chars / chars * (1 << 30)))
    total = {r["y"]: r["n"] for r in docs.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return NoisyOr(-20.0 if not pos else 5.0, {})

    def words(batches):
        for pdf in batches:
            rows = [(y, w) for y, t in zip(pdf["y"], pdf["text"], strict=True) for w in features(t or "")] if len(pdf) else []
            yield pd.DataFrame(rows, columns=["y", "word"])

    seen = docs.mapInPandas(words, "y int, word string").groupBy("word").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    rate = pos / (pos + neg)
    z = (F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    least = max(LEAST, int(LEAST_SHARE * (pos + neg)))
    top = seen.where(F.col("n") >= least).withColumn("z", z).where(F.abs("z") >= SIGMAS).orderBy(F.desc(F.abs("z")), "word").limit(vocabulary).collect()
    index = {r["word"]: i for i, r in enumerate(top)}

    def encode(batches):
        for pdf in batches:
            rows = []
            for y, t in zip(pdf["y"], pdf["text"], strict=True):
                ids = [sorted(index[w] for w in index.keys() & s) for s in _words(t)]
                rows.append((y, len(ids), [x for x in ids if x]))
            yield pd.DataFrame(rows, columns=["y", "n", "ids"])

    coded = docs.mapInPandas(encode, "y int, n int, ids array<array<int>>").toPandas()
    # order of rows must not matter for reruns
    coded = coded.assign(k=coded["ids"].map(str)).sort_values(["y", "n", "k"])
    return _train(coded["y"].to_numpy(float), coded["n"].to_numpy(float), coded["ids"].tolist(), [r["word"] for r in top], rounds, decay)


class _Rise:
    """What the fit raises: log-likelihood of document labels less the weights' squares; the bias, last in ``theta``, isn't held back."""

    def __init__(self, y, n, docs, names: int, decay: float):
        self.y, self.docs, self.names, self.held = y, len(docs), names, decay * len(y) * 0.1
        self.of_doc = np.array([d for d, s in enumerate(docs) for _ in s], dtype=np.int64)
        flat = [list(x) for s in docs for x in s]
        self.inst = np.array([i for i, x in enumerate(flat) for _ in x], dtype=np.int64)
        self.word = np.array([w for x in flat for w in x], dtype=np.int64)
        self.plain = n - np.bincount(self.of_doc, minlength=len(docs))

    def _none(self, theta):
        """Logits of sentences with words, and -log of each document's chance that none of its sentences is toxic."""
        z = theta[-1] + np.bincount(self.inst, weights=theta[self.word], minlength=len(self.of_doc))
        none = np.bincount(self.of_doc, weights=_softplus(z), minlength=self.docs) + self.plain * _softplus(theta[-1])
        return z, np.maximum(none, 1e-9)

    def value(self, theta) -> float:
        none = self._none(theta)[1]
        return float(np.where(self.y > 0, np.log(-np.expm1(-none)), -none).sum() - self.held / 2 * (theta[:-1] ** 2).sum())

    def gradient(self, theta):
        z, none = self._none(theta)
        push = np.where(self.y > 0, np.exp(-none) / -np.expm1(-none), -1.0)
        g = push[self.of_doc] / (1 + np.exp(-z))
        bias = g.sum() + (push * self.plain).sum() / (1 + math.exp(-theta[-1]))
        return np.append(np.bincount(self.word, weights=g[self.inst], minlength=self.names) - self.held * theta[:-1], bias)


def _train(y, n, docs, names, rounds, decay) -> NoisyOr:
    """Adam on the likelihood of noisy-or: P(doc) = 1 - prod(1 - p(sentence)); sentences without a word share the bias."""
    rise = _Rise(y, n, docs, len(names), decay)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = rise.gradient(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return NoisyOr(float(theta[-1]), {w: float(x) for w, x in zip(names, theta, strict=False)})


def score(documents: DataFrame, model: NoisyOr, bar: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences, offending: [start, end, score] of each sentence that scores ``bar`` or more alone.

    Offsets are code points of the whole text. A null or empty text has no sentence, so nothing
    that could offend: its score is 0. Rows that repeat are scored each, a null doc_id stays null,
    other columns are not looked at, and an empty table gives no rows.
    """
    bound_batches(documents.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = model.sentences(text)
                none, worst = 0.0, []
                for a, b, z in found:
                    none += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                    p = 1 / (1 + math.exp(-max(-700.0, z)))
                    if p >= bar:
                        worst.append((a, b, p))
                out.append((doc_id, -math.expm1(-none), len(found), worst))
            pdf = pd.DataFrame(out, columns=["doc_id", "score", "n_sentences", "offending"])
            yield pdf.astype({"doc_id": "Int64"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>")
