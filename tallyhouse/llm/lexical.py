"""Ranked lexical search: the best documents for every item of a small set of texts.

Two passes over the documents. The first counts: documents, terms, and for each term of the items the documents that
hold it. The second takes the documents a block at a time. A block has a bitmap of its documents for each term. For an
item, these bitmaps group the documents by the mask of the item's terms that they hold, and each distinct mask has a
greatest score that any of its documents can reach. Masks are evaluated by falling greatest score, exactly, until the
next one is below the item's worst kept result; no document is left out that could still be among the best.

Nothing is shuffled but the counts of the items' terms and the best documents of each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

#: Bytes of item texts that one round takes to the tasks; more of them make more rounds, each over all documents.
ROUND_BYTES = 4 << 20
#: A block of documents ends with so many of them, or so many of their terms.
BLOCK, BLOCK_TERMS = 4096, 2_000_000
#: Documents evaluated before the worst kept result is looked at again.
AT_ONCE = 128
#: Parts of an item's candidates that are ranked apart before the last ranking.
SALTS = 64

#: Bytes that part terms become blanks, capital ASCII letters small ones; bytes of other characters belong to terms.
_PARTING = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in _PARTING else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; null has none."""
    return text.translate(FOLD).split() if text else []


@dataclass
class Round:
    """Items of one round: their ids, their terms as numbers from 1 on, and what the corpus says about the terms."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    documents: int = 0
    length: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows) -> "Round":
        vocabulary: dict[bytes, int] = {}
        items = [np.array(sorted(vocabulary.setdefault(t, len(vocabulary) + 1) for t in set(terms(r["text"]))), np.int64) for r in rows]
        return cls([r["item_id"] for r in rows], vocabulary, items)

    def weigh(self, counts: dict[int, int]) -> None:
        """counts: by term the documents that hold it; under 0 the documents with terms, under -1 all their terms."""
        self.documents, self.length = counts.get(0, 0), counts.get(-1, 0)
        n = 2 * self.documents + 2
        of = lambda t: math.floor(1000 * math.log(n / (2 * counts[t] + 1))) if t in counts else 0
        self.weights = np.array([0, *map(of, range(1, len(self.vocabulary) + 1))], np.int64)


class Block:
    """Some documents with their lengths, and one posting for each of their terms that items have, in order of term."""

    def __init__(self, ids: list, lengths: list[int], counts: list[int], hits: list[int], round_: Round):
        # Documents without an id come after all others where scores are equal.
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.size = len(ids)
        document = np.repeat(np.arange(self.size), counts)
        key, tf = np.unique(np.array(hits, np.int64) * self.size + document, return_counts=True)
        term, self.document = key // self.size, key % self.size
        m = 10 + (90 * np.array(lengths, np.int64) * round_.documents) // max(1, round_.length)
        self.score = round_.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.document]))
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.most = np.maximum.reduceat(self.score, self.first) if len(term) else np.zeros(0, np.int64)
        bits = np.zeros((len(self.terms), self.size), np.uint8)
        bits[np.repeat(np.arange(len(self.terms)), self.last - self.first), self.document] = 1
        self.bitmaps = np.packbits(bits, axis=1)

    def search(self, item: np.ndarray, best: "Best") -> None:
        """Offers the documents of an item that may be among its best."""
        at = np.searchsorted(self.terms, item)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == item)] if len(self.terms) else at[:0]
        at = at[self.most[at] > 0]
        if not len(at) or not best.may_take(int(self.most[at].sum())):
            return
        bitmaps, most = self.bitmaps[at], self.most[at]
        holding = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps), count=self.size))
        held = np.unpackbits(bitmaps, axis=1, count=self.size)[:, holding]
        mask = groups_of(held)
        _, example = np.unique(mask, return_index=True)
        reach = most @ held[:, example].astype(np.int64)
        by_mask = np.argsort(mask, kind="stable")
        ends = np.cumsum(np.bincount(mask))
        some: list[np.ndarray] = []
        waiting = 0
        for g in np.argsort(-reach, kind="stable"):
            if not best.may_take(int(reach[g])):
                break
            some.append(by_mask[ends[g - 1] if g else 0 : ends[g]])
            waiting += len(some[-1])
            if waiting >= AT_ONCE:
                self._offer(at, holding[np.concatenate(some)], best)
                some, waiting = [], 0
        if some:
            self._offer(at, holding[np.concatenate(some)], best)

    def _offer(self, at: np.ndarray, documents: np.ndarray, best: "Best") -> None:
        """Exact scores of the documents, of one mask or of several."""
        scores = np.zeros(len(documents), np.int64)
        for t in at:
            lo, hi = self.first[t], self.last[t]
            place = np.minimum(lo + np.searchsorted(self.document[lo:hi], documents), hi - 1)
            scores += np.where(self.document[place] == documents, self.score[place], 0)
        best.offer(scores, self.ids[documents])


def groups_of(held: np.ndarray) -> np.ndarray:
    """A number for each column of a matrix of 0 and 1, equal where the columns are; numbers are without gaps from 0."""
    group = np.zeros(held.shape[1], np.int64)
    for lo in range(0, len(held), 31):
        word = (1 << np.arange(min(31, len(held) - lo), dtype=np.int64)) @ held[lo : lo + 31].astype(np.int64)
        group = np.unique(group << 31 | word, return_inverse=True)[1]
    return group


class Best:
    """The k best documents met for an item: greatest score first, then the smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_take(self, score: int) -> bool:
        """Whether a document of at most this score may be among the best; at an equal score its id decides."""
        return score > 0 and (len(self.scores) < self.k or score >= self.scores[-1])

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores[scores > 0]), np.append(self.ids, ids[scores > 0])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _counts(docs: DataFrame, round_: Round) -> dict[int, int]:
    vocabulary = round_.vocabulary

    def run(batches):
        import pyarrow as pa

        df = np.zeros(len(vocabulary) + 1, np.int64)
        length, get = 0, vocabulary.get
        for b in batches:
            for text in b.column(0).to_pylist():
                found = terms(text)
                if found:
                    length += len(found)
                    df[0] += 1
                    held = set(filter(None, map(get, found)))
                    df[np.fromiter(held, np.int64, len(held))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], length), pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}  # at most one for each term of the round's items, and two


def blocks(batches: Iterator, round_: Round) -> Iterator[Block]:
    """Documents that have terms of the items, in blocks."""
    get = round_.vocabulary.get
    ids, lengths, counts, hits = [], [], [], []
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = terms(text)
            before = len(hits)
            hits.extend(filter(None, map(get, found)))
            if len(hits) == before:
                continue
            ids.append(doc_id)
            lengths.append(len(found))
            counts.append(len(hits) - before)
            if len(ids) >= BLOCK or len(hits) >= BLOCK_TERMS:
                yield Block(ids, lengths, counts, hits, round_)
                ids, lengths, counts, hits = [], [], [], []
    if ids:
        yield Block(ids, lengths, counts, hits, round_)


def _best(docs: DataFrame, round_: Round, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best of each task."""

    def run(batches):
        import pyarrow as pa

        best = [Best(k) for _ in round_.items]
        for block in blocks(batches, round_):
            for item, b in zip(round_.items, best):
                block.search(item, b)
        part = TaskContext.get().partitionId() % SALTS
        for no, b in enumerate(best):
            if len(b.ids):
                n = len(b.ids)
                ids = pa.array(b.ids, mask=b.ids == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array([no] * n, pa.int32()), pa.array([round_.ids[no]] * n, pa.int64()), pa.array([part] * n, pa.int32()), ids, pa.array(b.scores)], ["item", "item_id", "part", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, item_id long, part int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item, those above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Null and empty texts have none: as
    documents they count nowhere, as items they have no rows. Repeated items count once; items of one id and different
    texts are ranked apart. Repeated documents all take a rank. Equal scores go by ascending doc_id, nulls last. Items
    without an id, and other columns, do no harm. Items come to the tasks in rounds of about ROUND_BYTES of text.
    """
    spark = docs.sparkSession
    docs = _documents(docs, id_col, text_col)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = math.ceil(size / ROUND_BYTES)
    found = []
    for r in range(rounds):
        round_ = Round.of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r).collect())  # about ROUND_BYTES
        round_.weigh(_counts(docs, round_))
        first = Window.partitionBy("item", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        some = _best(docs, round_, k).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
