"""Repeated passages by anchors and window hashes.

Seeds: of every `seed`-word run in each window of `window` words, the one with the smallest hash
is the window's anchor (winnowing, leftmost on ties). Equal windows have equal anchors at the same
place, so a passage that repeats shares anchors. Anchors are a semi-join filter: one that occurs
once rules out all its windows.

Window hashes replace the pairwise extension of seeds, since pairs within a passage group would be
unbounded: all windows of an anchor that occurs again are compared by 128-bit hashes of their words,
and the union of matching windows is the maximal repeat. Windows, not pairs of documents,
are compared: a passage in a third of all documents costs a row per occurrence, summed before the
shuffle. The occurrence with the smallest (doc_id, start) stays; words covered by any later one
are removed. What is first is judged on the input, not on what is left.

Null text has no words; documents shorter than a window lose nothing. Ids are taken to be unique:
rows with the same id and text are one document, and each gets its result. Rows with a null id
are neither compared nor cut. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.wordhash import Q1, Q2, Words, cut, encoded, portions


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of values[i:i + width] for each i."""
    m = len(values) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[:len(best) - step], best[step:]
        later = b < a
        at = np.where(later, at[step:], at[:len(at) - step])
        best = np.where(later, b, a)
        reach += step
    return at[:m]


def window_anchors(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within texts, the place of each one's anchor, hashes of all runs."""
    runs = w.runs(seed)
    at = sliding_min(runs, window - seed + 1)
    starts = np.flatnonzero(w.inside(window))
    return starts, at[starts], runs


def document_of(w: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, places, "right") - 1


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, anchor (hash): a row for each place that is some window's anchor.

    Rows without an id, and copies, have none."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(2).is_null()))
            for part in portions(b, 1):
                w = cut(encoded(part.column(1)))
                _, at, runs = window_anchors(w, window, seed)
                at = at[np.diff(at, prepend=-1) != 0]
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(ids[document_of(w, at)]),
                                       pa.array(runs[at].view(np.int64))], ["doc_id", "anchor"])

    return docs.select("doc_id", "text", "copy").mapInArrow(find, "doc_id long, anchor long")


def candidates(texts: list[bytes], met: list, window: int, seed: int) -> tuple[Words, np.ndarray]:
    """Words, and starts of the windows whose anchor was met elsewhere. met: anchors by text."""
    w = cut(texts)
    starts, at, runs = window_anchors(w, window, seed)
    doc, keep = document_of(w, starts), np.zeros(len(starts), bool)
    hashes = runs[at].view(np.int64)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, known in enumerate(met):
        if known is not None and edges[i] < edges[i + 1]:
            part = slice(edges[i], edges[i + 1])
            keep[part] = np.isin(hashes[part], known)
    return w, starts[keep]


def lists(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None else x.values.to_numpy() for x in
            (s if s.is_valid else None for s in column)]


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words that stay, joined by blanks), spans (start and
    end, in words, of each maximal repeat that is removed)."""
    rows = docs.select("doc_id", "text")
    # a text that equals an earlier one repeats it from start to end; it needs no seeds
    prints = rows.where("doc_id is not null").select("doc_id", F.md5("text").alias("print"))
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = (prints.join(first.where("n > 1"), "print").where("doc_id > first")
              .select("doc_id", F.lit(True).alias("copy")).distinct())
    # every later step shares this one exchange of the texts
    base = rows.join(copies, "doc_id", "left")
    seeds = anchors(base, window, seed)
    twice = seeds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # distinct anchors of one document: no more than it has words
    met = (seeds.join(twice, "anchor", "left_semi").groupBy("doc_id")
           .agg(F.collect_set("anchor").alias("met")))
    texts = base.join(met, "doc_id", "left").select("doc_id", "text", "met", "copy")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b.filter(b.column(2).is_valid()), 1):
                w, starts = candidates(encoded(part.column(1)), lists(part.column(2)), window, seed)
                one, two = w.runs(window, Q1)[starts], w.runs(window, Q2, 0x5BF03635)[starts]
                doc = document_of(w, starts)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(ids[doc].astype(np.int64)),
                     pa.array((starts - w.first[doc]).astype(np.int32))],
                    ["one", "two", "doc_id", "at"])

    matches = texts.mapInArrow(
        extend, "one long, two long, doc_id long, at int")
    firsts = (matches.groupBy("one", "two").agg(F.min(F.struct("doc_id", "at")).alias("f"))
              .groupBy("f.doc_id").agg(F.collect_list("f.at").alias("firsts")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                raw, met_in = encoded(part.column(1)), lists(part.column(2))
                w, starts = candidates(raw, met_in, window, seed)
                first, copy, out = lists(part.column(4)), part.column(3).to_pylist(), []
                doc = document_of(w, starts)
                edges = np.searchsorted(doc, np.arange(len(raw) + 1))
                for i, text in enumerate(raw):
                    n = int(w.first[i + 1] - w.first[i])
                    own = starts[edges[i]:edges[i + 1]] - w.first[i]
                    late = own if first[i] is None else own[~np.isin(own, first[i])]
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, late, 1)
                    np.add.at(step, late + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                    if copy[i] and n >= window:
                        gone[:] = True
                    words = text.split()
                    if gone.any():
                        words = [x for x, g in zip(words, gone.tolist()) if not g]
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans = [{"start": s, "end": e}
                             for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
                    out.append((n, n - len(words), b" ".join(words).decode(), spans))
                types = (pa.int64(), pa.int64(), pa.string(),
                         pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.record_batch(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return texts.join(firsts, "doc_id", "left").select(
        "doc_id", "text", "met", "copy", "firsts").mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_text string, "
                "spans array<struct<start:int,end:int>>")
