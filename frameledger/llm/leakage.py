"""Passages of evaluation items in training documents, by winnowing.

Texts are sequences of words (maximal runs of letters and digits, lower case). Every run of GRAM
words has a hash; of each WINDOW neighbouring hashes the least is kept as a fingerprint. A run of
GRAM + WINDOW - 1 common words therefore always leaves a common fingerprint. Fingerprints travel
with the words around them, so a hit is extended, and checked word by word, where the two meet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW = 8, 5
#: Bits of the filter that keeps documents' fingerprints that some item may have: 2 MB, whatever the items' number.
FILTER_BITS = 1 << 24
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * _BASE
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hashes:
    """Hash of a word, the same in every process; those of frequent words are kept."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, ws: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            out.append(h)
        return np.array(out, np.uint64)


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` words from the words' hashes."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out = out * _BASE + h[j : j + n]
    return _mixed(out)


def winnow(g: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places in g of the fingerprints: the last of the least hashes in each window of one text.

    g holds the hashes of several texts one after the other, starts the place of each text's first.
    """
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = g[:n].copy(), np.arange(n)
    for j in range(1, window):
        x = g[j : j + n]
        lower = x <= least
        least = np.where(lower, x, least)
        place = np.where(lower, np.arange(j, j + n), place)
    text = np.zeros(len(g) + 1, np.int64)
    np.add.at(text, starts, 1)
    text = np.cumsum(text[:-1])
    return np.unique(place[text[:n] == text[window - 1 :]])


def _fingerprints(ids: str, bits: Callable[[], np.ndarray | None]) -> Callable:
    side = WINDOW - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = Hashes(), bits()
        for b in batches:
            id_, texts = b.column(ids).to_pylist(), [words(x) for x in b.column("text").to_pylist()]
            parts = [gram_hashes(hashes.of(t)) for t in texts]
            size = np.array([len(p) for p in parts], np.int64)
            if not size.sum():
                continue
            g, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum(size)[:-1]))
            at = winnow(g, starts[size > 0])
            h = g[at].view(np.int64)
            if kept is not None:
                bit = g[at] & np.uint64(FILTER_BITS - 1)
                use = (kept[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, h = at[use], h[use]
            of = np.searchsorted(starts, at, "right") - 1
            while (empty := size[of] == 0).any():
                of = of - empty
            place = at - starts[of]
            out: list[list] = [[], [], []]
            for t, p, x in zip(of.tolist(), place.tolist(), h.tolist(), strict=True):
                ws = texts[t]
                left, right = ws[max(0, p - side) : p], ws[p : p + GRAM + side]
                out[0].append(id_[t])
                out[1].append(x)
                out[2].append([""] * (side - len(left)) + left + right + [""] * (GRAM + side - len(right)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string()))], names=["id", "print", "around"])

    return run


def fingerprints(texts: DataFrame, ids: str, kept: DataFrame | None = None) -> DataFrame:
    """id, print, around (the GRAM words with WINDOW - 1 on each side, '' beyond the text) of every fingerprint; only those whose bit is set in `kept`, if given."""
    t = texts.select(F.col(ids).cast("bigint").alias(ids), "text").filter(F.col("text").isNotNull() & F.col(ids).isNotNull())
    bits: Callable[[], np.ndarray | None] = lambda: None
    if kept is not None:
        array = np.zeros(FILTER_BITS, bool)
        array[[r[0] for r in kept.toLocalIterator()]] = True
        sent = texts.sparkSession.sparkContext.broadcast(np.packbits(array, bitorder="little").tobytes())
        bits = lambda: np.frombuffer(sent.value, np.uint8)
    return t.mapInArrow(_fingerprints(ids, bits), "id bigint, print bigint, around array<string>")


def _extended(a: Column, b: Column, run: int) -> Column:
    """Whether a hit's words and those around it have `run` equal words in a row, the hit's among them."""
    equal = F.zip_with(a, b, lambda x, y: (x == y) & (x != ""))
    starts = F.sequence(F.lit(1), F.lit(2 * WINDOW - 1 + GRAM - run))
    return F.exists(starts, lambda i: F.forall(F.slice(equal, i, run), lambda x: x))


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = GRAM + WINDOW - 1) -> DataFrame:
    """doc_id, item_id: documents that share `run` or more consecutive words with an item, at most GRAM + WINDOW - 1 = 12.

    Null ids and texts have no passages; repeated rows count once. The items' fingerprints fold into a
    filter of fixed size that documents' ones pass before they leave their task (it lets some others
    through, none of the items' own is lost); the join on the fingerprint is an ordinary one.
    """
    if run > GRAM + WINDOW - 1 or run < GRAM:
        raise ValueError(f"run must lie between {GRAM} and {GRAM + WINDOW - 1}")
    i = fingerprints(items, "item_id").distinct()
    bits = i.select(F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1).cast("bigint")).cast("int").alias("bit")).distinct()
    d = fingerprints(documents, "doc_id", bits)
    hits = d.alias("d").join(i.alias("i"), "print").filter(_extended(F.col("d.around"), F.col("i.around"), run))
    return hits.select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id")).distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, docs: for every item in how many documents it leaked, 0 included."""
    n = leaked_passages(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).cast("bigint").alias("docs"))
