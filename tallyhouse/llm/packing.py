"""Hierarchical packing of documents into sequences of several lengths.

The tiers are powers of two up to the longest window. A document longer than the window fills whole windows first; what
is left goes to the smallest tier that holds it. Each tier, longest first, packs its own remainders best fit; the gaps of
its windows are then filled from shorter tiers, whole pieces first, then pieces cut to the gap. What is open when the
tiers are done is cut into powers of two, which need no padding. Steps take sequences of one length in turn, so step
groups carry equal numbers of tokens.

Packing runs on the rows of a partition, a batch at a time: nothing crosses the network, and the work of a task is its
own texts.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyhouse.llm.bpe import Memo, printable_bytes
from tallyhouse.llm.common import hold, ids_and_texts, rest_collector, tokenizer_path

WINDOW = 2048
TIERS = (2048, 1024, 512, 256, 128, 64)
#: Documents packed together; sequences of a step group.
TOGETHER, STEP = 2000, 64
#: Of texts free of them, str.split() parts the words just as the tokenizer's white space does.
CONTROLS = regex.compile("[\x1c-\x1f]")
PLAIN = regex.compile("[\x21-ɏ]+")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never span white space: each distinct word is encoded once.

    Words beyond the Latin letters, where the tokenizer's normal forms matter, go to the tokenizers library; others are
    split here and merged by rank, with the byte 0xFF, which UTF-8 never has, as the mark of a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        rest_collector()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        stands_for = printable_bytes()
        back = {c: b for b, c in enumerate(stands_for)}
        as_bytes = lambda t: bytes(back[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix)
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        ids = [vocab[c] for c in stands_for] + [vocab[c + suffix] for c in stands_for]
        for k, pair in enumerate(model["merges"]):
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            ranks[as_bytes(token)] = 512 + k
            ids.append(vocab[token])
        self.id_bytes = [i.to_bytes(4, "little") for i in ids]
        self.merge = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts = Memo(self._part)
        self.words = Memo(self._word)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.merge(part.encode() + b"\xff")))

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._part(word.lower())
            if word[:-1].isalpha():
                return self.parts[word[:-1].lower()] + self.parts[word[-1]]
        if "<|" in word or not PLAIN.fullmatch(word):
            return self._library(word)
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))

    def encode(self, text: str | None) -> np.ndarray:
        if text and CONTROLS.search(text):
            return np.frombuffer(self._library(text), "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or "").split())), "<u4")


_word_encoder = lru_cache(maxsize=1)(WordEncoder)


def word_encoder(path: str) -> WordEncoder:
    hold(_word_encoder)
    return _word_encoder(path)


def pack_lengths(sizes: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of the given sizes; no token needs padding."""
    full: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), by length
    for d, n in enumerate(sizes):
        at = 0
        while n - at >= window:
            full.append([(d, at, window)])
            at += window
        if n > at:
            waiting[min(t for t in tiers if t >= n - at)].append((n - at, d, at))
    for pieces in waiting.values():
        pieces.sort()
    open_windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    for k, tier in enumerate(tiers):
        gaps: list[tuple[int, int]] = []  # (gap, window's place), by gap: best fit takes the smallest that holds a piece
        held: list[list[tuple[int, int, int]]] = []
        for size, d, at in reversed(waiting[tier]):
            i = bisect_left(gaps, (size, -1))
            if i < len(gaps):
                gap, w = gaps.pop(i)
            else:
                gap, w = tier, len(held)
                held.append([])
            held[w].append((d, at, size))
            if gap > size:
                insort(gaps, (gap - size, w))
        waiting[tier] = []
        left = {w: gap for gap, w in gaps}
        for w, pieces in enumerate(held):
            gap = left.get(w, 0)
            for shorter in tiers[k + 1 :]:
                queue = waiting[shorter]
                while gap and queue:
                    i = bisect_left(queue, (gap + 1, -1))
                    if not i:
                        break
                    size, d, at = queue.pop(i - 1)
                    pieces.append((d, at, size))
                    gap -= size
            for shorter in reversed(tiers[k + 1 :]) if gap else ():
                if queue := waiting[shorter]:
                    size, d, at = queue.pop()  # longer than the gap: its front fills it
                    pieces.append((d, at, gap))
                    size, at, gap = size - gap, at + gap, 0
                    insort(waiting[min(t for t in tiers if t >= size)], (size, d, at))
                    break
            if gap:
                open_windows.append((tier - gap, pieces))
            else:
                full.append(pieces)
    for size, pieces in open_windows:  # cut along the binary digits of what they hold
        digits = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
        room, out = digits.pop(0), []
        for d, at, n in pieces:
            while n:
                take = min(n, room)
                out.append((d, at, take))
                at, n, room = at + take, n - take, room - take
                if not room:
                    full.append(out)
                    room, out = digits.pop(0) if digits else 0, []
    return full


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of a document, whole texts only; columns as in SCHEMA.

    A document is its text's ids and then end_id. Null and empty texts are just end_id; rows with equal or null ids are
    documents of their own. sequence_tokens is the sequence's length, window or a power of two, and step_group a number
    shared by up to STEP sequences of that length. Pieces of a sequence lie end to end from offset 0. An empty table
    gives no rows.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        import pyarrow as pa

        encoder, base, n_seq = word_encoder(path), TaskContext.get().partitionId() << 32, 0
        steps: dict[int, list[int]] = {}
        n_step = 0
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                doc_ids = part.column(0).to_pylist()
                ids = [np.append(encoder.encode(x), np.uint32(end_id)).astype("<u4", copy=False) for x in part.column(1).to_pylist()]
                rows: list[tuple] = []
                for pieces in pack_lengths([len(x) for x in ids], window, tiers):
                    total = sum(n for _, _, n in pieces)
                    step = steps.get(total)
                    if step is None or step[1] == STEP:
                        step = steps[total] = [n_step, 0]
                        n_step += 1
                    step[1] += 1
                    offset = 0
                    for d, at, n in pieces:
                        rows.append((doc_ids[d], at, n, zlib.crc32(ids[d][at : at + n].tobytes()), len(ids[d]), base + n_seq, offset, total, base + step[0]))
                        offset += n
                    n_seq += 1
                cols = list(zip(*rows)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return ids_and_texts(docs).mapInArrow(run, SCHEMA)
