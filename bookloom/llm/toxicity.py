"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are runs of letters; a chain is a sentence, cut after `CHAIN` words at the latest. States are
clean and toxic. Features of a word are hashed: the word, its first three to five bytes, the
words before and after it.

Documents are labelled as a whole, so words get their labels by contrast: in toxic documents a word
counts as toxic if it stands between many different words there (copies of a text add nothing) and
`odds` times as often as in clean ones. The field is trained on those labels by gradient steps with
forward-backward, in one task of the cluster; it then generalises by prefixes and neighbours. It reads
up to `toxic` and `clean` different labelled texts, those with the smallest hashes, of at most `longest`
bytes.

A document's score is a logistic function, fitted on the same texts, of the sum of its words'
marginals and of that sum per hundred words; null, empty and wordless texts score as texts without
toxic words, and everything scores near 0 if no toxic row teaches. Repeated rows are scored
one by one, rows without an id are never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import remainder, sample, text_hash, trained
from bookloom.llm.wordhash import BYTE, P, Words, cut, encoded, mix, portions, spans_hash

SIZE = 1 << 18
CHAIN = 48
FLOOR = 0.1
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True


def features(w: Words) -> np.ndarray:
    """Places of each word's features, one row per kind."""
    raw, n = BYTE[w.data], len(w.starts)
    hashes = w.hashes
    kinds = [hashes, *(spans_hash(raw, w.starts, np.minimum(w.ends, w.starts + k), P) for k in (3, 4, 5))]
    edge = np.zeros(n, bool)
    edge[w.first[:-1][w.first[:-1] < n]] = True
    before = np.r_[np.uint64(0), hashes[:-1]] if n else hashes
    before = np.where(edge, np.uint64(0), before)
    after = np.where(np.r_[edge[1:], True], np.uint64(0), np.r_[hashes[1:], np.uint64(0)]) if n else hashes
    kinds += [before, after]
    return np.array([((h + np.uint64(77 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46))
                     .astype(np.int32) for k, h in enumerate(kinds)]).reshape(len(kinds), n)


def chains(w: Words) -> np.ndarray:
    """First words of chains, with the number of words at the end."""
    n = len(w.starts)
    begins = np.zeros(n + 1, bool)
    begins[w.first] = True
    stops = np.cumsum(STOP[w.data])
    if n:
        begins[1:n] |= stops[w.starts[1:]] > stops[w.ends[:-1] - 1]
    starts = np.flatnonzero(begins[:n])
    place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    return np.r_[np.flatnonzero(place % CHAIN == 0), n]


@dataclass
class Field:
    """weights of features; move: log potentials from state i to state j (clean 0, toxic 1)."""

    weights: np.ndarray
    bias: float
    move: np.ndarray
    text: np.ndarray  # of the logistic score of a text's totals

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each word, and P(i, j) of it and the next word (only within chains).

        Both passes keep ratios of toxic to clean and walk all chains at once, longest first."""
        length = np.diff(edges)
        order = np.argsort(-length, kind="stable")
        start, length = edges[:-1][order], length[order]
        e = np.exp(np.clip(unary, -30, 30))
        (oo, ot), (to, tt) = np.exp(self.move)
        forward, backward = np.empty(len(unary)), np.ones(len(unary))
        most = int(length[0]) if len(length) else 0
        count = np.searchsorted(-length, -np.arange(most), "left")
        for t in range(most):
            at = start[:count[t]] + t
            if t:
                r = forward[at - 1]
                forward[at] = e[at] * (ot + r * tt) / (oo + r * to)
            else:
                forward[at] = e[at]
        for t in range(most - 2, -1, -1):
            at = start[:count[t + 1]] + t
            x = e[at + 1] * backward[at + 1]
            backward[at] = (to + tt * x) / (oo + ot * x)
        odds = forward * backward
        pairs = np.zeros((len(unary), 4))
        inner = np.ones(len(unary), bool)
        inner[edges[1:] - 1] = False
        at = np.flatnonzero(inner)
        r, x = forward[at], e[at + 1] * backward[at + 1]
        joint = np.stack([np.full(len(at), oo), ot * x, r * to, r * tt * x], axis=1)
        pairs[at] = joint / joint.sum(axis=1, keepdims=True)
        return odds / (1 + odds), pairs

    def unary(self, found: np.ndarray) -> np.ndarray:
        total = np.full(found.shape[1], self.bias)
        for row in found:
            total += self.weights[row]
        return total


def stands_out(key: np.ndarray, around: np.ndarray, doc: np.ndarray, texts: int, odds: float,
               share: float) -> np.ndarray:
    """Whether each key is typical of words in toxic texts; doc: whether a word's text is toxic."""
    keys, at, total = np.unique(key, return_inverse=True, return_counts=True)
    counts = []
    for side in (False, True):
        own = doc == side
        which, beside = at[own], around[own]
        _, first = np.unique(mix(which.astype(np.uint64) + np.uint64(P) * beside), return_index=True)
        counts.append(np.bincount(which[first], minlength=len(keys)))
    clean, toxic = counts
    ratio = (toxic + 0.5) / (toxic.sum() + 1) / ((clean + 0.5) / (clean.sum() + 1))
    least = max(3, share * texts)
    return ((ratio >= odds) & (toxic >= least) & (toxic >= 0.3 * total))[at]


def toxic_words(w: Words, label: np.ndarray, odds: float = 20.0, share: float = 0.01) -> np.ndarray:
    """Labels of words; label: of each text. Words count as such and by their first bytes."""
    n = len(w.starts)
    doc = np.repeat(label, np.diff(w.first)).astype(bool)
    if not doc.any():
        return doc
    around = np.zeros(n, np.uint64)
    around[1:] = w.hashes[:-1] * np.uint64(3)
    around[:-1] += w.hashes[1:]
    raw, found = BYTE[w.data], np.zeros(n, bool)
    for key in (w.hashes, *(spans_hash(raw, w.starts, np.minimum(w.ends, w.starts + k), P)
                            for k in (4, 5))):
        found |= stands_out(key, around, doc, int(label.sum()), odds, share)
    return found & doc


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    beta = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, a.T @ (p - y) + 0.1 * beta)
    return beta


def totals(w: Words, p: np.ndarray) -> np.ndarray:
    """Per text: log of the expected number of toxic words, and of that per hundred words."""
    run = np.r_[0.0, np.cumsum(np.where(p >= FLOOR, p, 0.0))]
    number = np.maximum(run[w.first[1:]] - run[w.first[:-1]], 0.0)
    return np.stack([np.log1p(number),
                     np.log1p(100 * number / np.maximum(1, np.diff(w.first)))], axis=1)


def fit(texts: list[bytes], label: np.ndarray, rounds: int = 6, spare: int = 40_000) -> Field:
    """Trains on all chains with a toxic word and `spare` others."""
    model = Field(np.zeros(SIZE), -4.0, np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0]))
    once = dict(zip(texts, label))  # copies teach nothing new
    texts, label = list(once), np.array(list(once.values()), bool)
    w = cut([t.lower() for t in texts], NOT_LETTER)
    y = toxic_words(w, label)
    if not y.any():
        model.bias = -30.0
        return model
    edges, rng = chains(w), np.random.default_rng(0)
    held = np.add.reduceat(y, edges[:-1]) > 0
    pick = np.flatnonzero(held)
    rest = np.flatnonzero(~held)
    pick = np.r_[pick, rng.permutation(rest)[:spare]]
    found, g2, m2 = features(w), np.full(SIZE, 1e-6), np.full((2, 2), 1e-6)
    b2 = 1e-6
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(pick), max(1, len(pick) // 1000)):
            length = edges[part + 1] - edges[part]
            at = np.repeat(edges[part] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            own = np.r_[0, np.cumsum(length)]
            f, truth = found[:, at], y[at].astype(float)
            p, pairs = model.marginals(model.unary(f), own)
            gap = p - truth
            inner = np.ones(len(at), bool)
            inner[own[1:] - 1] = False
            i = np.flatnonzero(inner)
            seen = np.bincount((2 * y[at][i] + y[at][i + 1]).astype(int), minlength=4)
            grad = np.bincount(f.ravel(), np.tile(gap, len(f)), SIZE) + 1e-3 * model.weights
            used = grad != 0
            g2[used] += grad[used] ** 2
            model.weights[used] -= 0.5 * grad[used] / np.sqrt(g2[used])
            gm = pairs.sum(axis=0).reshape(2, 2) - seen.reshape(2, 2) + 0.1 * model.move
            m2 += gm ** 2
            model.move -= 0.1 * gm / np.sqrt(m2)
            b2 += gap.sum() ** 2
            model.bias -= 0.1 * gap.sum() / np.sqrt(b2)
    p, _ = model.marginals(model.unary(found), edges)
    model.text = logistic(totals(w, p), label.astype(float))
    return model


def train(docs: DataFrame, marks: DataFrame, toxic: int = 2_000, clean: int = 3_000,
          longest: int = 20_000) -> Field:
    """docs: doc_id, text; marks: doc_id, toxic. The fit runs in one task, on the bounded sample."""
    rows = docs.where("text is not null").where(F.octet_length("text") <= longest)
    hashes = rows.select("doc_id", text_hash().alias("h")).join(marks, "doc_id").select(
        (F.col("toxic") == 1).alias("label"), "h")
    taken = sample(hashes, rows, F.when(F.col("label"), toxic).otherwise(clean))
    return trained(taken, lambda found: fit([t.encode() for _, t in found],
                                            np.array([bad for bad, _ in found], bool)))


def score(docs: DataFrame, model: Field, tagged: float = 0.5) -> DataFrame:
    """doc_id, score, spans (start, end in characters, probability) of words tagged toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                raw = encoded(part.column(1))
                w = cut([t.lower() for t in raw], NOT_LETTER)
                p, _ = shared.value.marginals(shared.value.unary(features(w)), chains(w))
                base = np.cumsum([0, *(len(t) + 1 for t in raw)]) + 1
                beta, x = shared.value.text, totals(w, p)
                scores = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
                spans = []
                # characters before each byte: all but the bytes that go on with one
                chars = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
                for i in range(len(raw)):
                    at = np.arange(w.first[i], w.first[i + 1])
                    at = at[p[at] >= tagged]
                    begin = chars[base[i]]
                    spans.append([{"start": a, "end": z, "probability": q} for a, z, q in zip(
                        (chars[w.starts[at]] - begin).tolist(), (chars[w.ends[at]] - begin).tolist(),
                        p[at].tolist())])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                           ("probability", pa.float64())]))
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64()),
                                       pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        judge, "doc_id long, score double, "
               "spans array<struct<start:int,end:int,probability:double>>")


def toxicity_of(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans; learned from labelled rows not held out."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    marks = labels.select("doc_id", "toxic").where("toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    return score(docs, train(docs.select("doc_id", "text").where(~held), marks)).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
