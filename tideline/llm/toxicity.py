"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so a misspelling that was never seen
shares most of its parts with known words. A window of a few words is the mean of its words and
goes through a linear softmax over two classes; a document is as toxic as its most toxic window,
so one insult counts the same in a short and in a very long text. Embeddings and softmax are
trained together; each document's gradient goes through the window that decides it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import TwoGenerations, extend_rows, held_out
from tideline.storage import materialize, scratch

WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 3, 6


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Subwords:
    """Embeddings of hashed n-grams (``buckets`` x ``dims``) and the softmax on top."""

    def __init__(self, buckets: int = 1 << 16, dims: int = 12, window: int = 4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.buckets, self.dims, self.window, self.seed = buckets, dims, window, seed
        self.vectors = np.zeros((buckets, dims), np.float32)  # an n-gram that no gradient reaches says nothing
        self.weights = (rng.standard_normal((dims, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def parts(self, word: str) -> list[int]:
        """Buckets of the word's n-grams, with marks at both ends; of the whole word if it has none."""
        w, mask, crc = f"<{word}>", self.buckets - 1, zlib.crc32
        size = len(w)
        if w.isascii():  # characters are bytes
            w = w.encode()
            grams = [crc(w[i : i + n]) & mask for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)]
            return grams or [crc(w) & mask]
        grams = [crc(w[i : i + n].encode("utf-8", "replace")) & mask for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)]
        return grams or [crc(w.encode("utf-8", "replace")) & mask]

    def margins(self) -> Callable[[str], float]:
        """A function that gives a word's share of the softmax margin (class 1 less class 0). The
        softmax is linear, so every n-gram's vector is taken through it once, beforehand."""
        share, parts = (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(float).tolist(), self.parts

        def margin(word: str) -> float:
            found = [share[i] for i in parts(word)]
            return sum(found) / len(found)

        return margin

    def probability(self, margins: list[float]) -> float:
        """Of class 1, from the margins of a document's words: its most toxic window decides."""
        bias = float(self.bias[1] - self.bias[0])
        if not margins:
            best = bias
        elif len(margins) <= self.window:
            best = sum(margins) / len(margins) + bias
        else:
            total = np.cumsum(np.concatenate([[0.0], margins]))
            best = float((total[self.window :] - total[: -self.window]).max()) / self.window + bias
        return float(1 / (1 + np.exp(-np.clip(best, -30, 30))))

    def fit(self, rows: list[tuple[str, int]], updates: int = 560, batch: int = 64, rate: float = 0.5, balance: float = 0.7) -> Subwords:
        """Adagrad over documents; rows are (text, 0 or 1). Classes are weighted
        by their inverse frequency to the power ``balance``. Small sets are gone through more often, so
        that there are about ``updates`` steps, at least 6 and at most 30 times."""
        epochs = min(30, max(6, -(-updates * batch // max(1, len(rows)))))
        number: dict[str, int] = {}
        texts = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t, _ in rows]
        labels = np.array([y for _, y in rows], np.int64)
        if not len(rows) or labels.min() == labels.max():
            return self
        parts = [np.array(self.parts(w), np.int64) for w in number]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        share = labels.mean()
        weight = (np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** balance).astype(np.float32)
        rng = np.random.default_rng(self.seed)
        seen_v, seen_w, seen_b = np.full(self.buckets, 1e-6, np.float32), np.full_like(self.weights, 1e-6), np.full(2, 1e-6, np.float32)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                docs = [d for d in order[at : at + batch] if len(texts[d])]
                if not docs:
                    continue
                used, place = np.unique(np.concatenate([texts[d] for d in docs]), return_inverse=True)
                ids, starts = self._gather(first, flat, used)
                counts = np.diff(np.append(starts, len(ids))).astype(np.float32)
                means = np.add.reduceat(self.vectors[ids], starts, axis=0) / counts[:, None]
                margin = means @ (self.weights[:, 1] - self.weights[:, 0])
                chosen, owner, pos = [], [], 0
                for k, d in enumerate(docs):
                    here = place[pos : pos + len(texts[d])]
                    pos += len(here)
                    if len(here) > self.window:
                        total = np.cumsum(np.concatenate([[0.0], margin[here]]))
                        i = int(np.argmax(total[self.window :] - total[: -self.window]))
                        here = here[i : i + self.window]
                    chosen.append(here)
                    owner.append(np.full(len(here), k))
                chosen, owner = np.concatenate(chosen), np.concatenate(owner)
                sizes = np.bincount(owner, minlength=len(docs)).astype(np.float32)
                bags = np.zeros((len(docs), self.dims), np.float32)
                np.add.at(bags, owner, means[chosen])
                bags /= sizes[:, None]
                logits = bags @ self.weights + self.bias
                logits -= logits.max(1, keepdims=True)
                soft = np.exp(logits)
                soft /= soft.sum(1, keepdims=True)
                soft[np.arange(len(docs)), labels[docs]] -= 1
                soft *= weight[docs][:, None] / len(docs)
                grad_w, grad_b, grad_bag = bags.T @ soft, soft.sum(0), soft @ self.weights.T / sizes[:, None]
                words, back = np.unique(chosen, return_inverse=True)
                grad_word = np.zeros((len(words), self.dims), np.float32)
                np.add.at(grad_word, back, grad_bag[owner])
                ids, starts = self._gather(first, flat, used[words])
                lengths = np.diff(np.append(starts, len(ids)))
                rows_, into = np.unique(ids, return_inverse=True)
                grad_v = np.zeros((len(rows_), self.dims), np.float32)
                np.add.at(grad_v, into, np.repeat(grad_word / lengths[:, None].astype(np.float32), lengths, axis=0))
                seen_v[rows_] += (grad_v**2).mean(1)
                self.vectors[rows_] -= step * grad_v / np.sqrt(seen_v[rows_])[:, None]
                seen_w += grad_w**2
                self.weights -= step * grad_w / np.sqrt(seen_w)
                seen_b += grad_b**2
                self.bias -= step * grad_b / np.sqrt(seen_b)
        return self

    @staticmethod
    def _gather(first: np.ndarray, flat: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of these words, one after another, and where each word's begin."""
        lengths = first[words + 1] - first[words]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return flat[np.repeat(first[words] - starts, lengths) + np.arange(lengths.sum())], starts


def labelled_rows(docs: DataFrame, labels: DataFrame, most_per_class: int = 3000, most_bytes: int = 64 << 20, seed: int = 5) -> list[tuple[str, int]]:
    """A bounded sample to learn from: at most ``most_per_class`` documents and ``most_bytes`` / 2 bytes of
    text of each label, those with the smallest hash of their id; texts that are too long for
    what is left of the bytes are passed over. None of them is held out or has a null label or text. An id
    with both labels counts as toxic; of several texts of an id the first in order stands for it."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    ids = known.where("toxic = 0").orderBy("h", "doc_id").limit(most_per_class).unionByName(known.where("toxic = 1").orderBy("h", "doc_id").limit(most_per_class))
    with scratch(spark):
        ids = materialize(ids, "toxicity-ids")
        own = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        own = materialize(own.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")), "toxicity-texts")
        left, chosen = {0: most_bytes // 2, 1: most_bytes // 2}, []
        for r in own.select("toxic", "h", "doc_id", F.octet_length("text").alias("size")).orderBy("h", "doc_id").toLocalIterator():
            if r.size <= left[r.toxic]:
                left[r.toxic] -= r.size
                chosen.append((r.doc_id,))
        if not chosen:
            return []
        picked = spark.createDataFrame(chosen, own.select("doc_id").schema)
        return sorted((r.text, r.toxic) for r in own.join(F.broadcast(picked), "doc_id", "left_semi").select("text", "toxic").collect())


def learn_toxicity(docs: DataFrame, labels: DataFrame, most_per_class: int = 3000, most_bytes: int = 64 << 20) -> Subwords:
    """A model from the bounded sample of ``labelled_rows``; without both labels it is untrained
    and gives every text about one half or less."""
    return Subwords().fit(labelled_rows(docs, labels, most_per_class, most_bytes))


def score_toxicity(docs: DataFrame, model: Subwords, keep: list[str] | None = None) -> DataFrame:
    """Score the whole ``text`` of every row: ``keep`` (default ``doc_id``), ``score`` (0 to 1) and
    ``predicted`` (1 if the score is at least 0.5). Null and empty texts get the bias's score.
    Repeated rows stay repeated; columns not in ``keep`` are ignored. The model (buckets x dims
    floats, 3 MB) is broadcast; no shuffle; memory is a batch and a bounded cache of words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        cache = TwoGenerations(m.margins(), half=500_000)
        return lambda texts: [(s, int(s >= 0.5)) for s in (m.probability([cache[w] for w in words_of(text)]) for text in texts)]

    return extend_rows(docs, ["doc_id"] if keep is None else keep, make, [("score", "double"), ("predicted", "int")])
