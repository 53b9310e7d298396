"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge list decides how far right of a token the text can still change that token. That distance is computed once from
the list, by following chains of merges of falling rank. A window that reaches so far past a token settles it, so tokens
leave as soon as they are stable and the working memory never grows with a text. Decoding is a byte-to-text automaton
that holds at most an unfinished UTF-8 sequence.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex
import tiktoken
from pyspark.sql import DataFrame

from tallyhouse.llm.common import WHITE, hold, ids_and_texts, rest_collector, tokenizer_path

NEVER = 1 << 60
#: Entries of each bounded memo of a worker.
MEMO = 300_000
#: Characters of text taken up at a time.
BLOCK = 1 << 16

SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: A space with white space on its left, and white space or the end on its right: only there does it matter that a run is cut.
KNOTTED = re.compile(rf"(?<=[{WHITE}]) (?=[{WHITE}]|\Z)")
#: A space between two other characters: no pre-token spans its left edge.
SEAM = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """A BPE merge list with the lookahead that suffices for it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        stands_for = printable_bytes()
        back = {c: b for b, c in enumerate(stands_for)}
        self.first = [vocab[c] for c in stands_for]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.product: list[int] = []
        #: By token: bytes right of it that settle whether it comes about, and whether it is then taken up by a right neighbour.
        formed, taken = [0] * n, [0] * n
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = k
            self.product.append(t)
            formed[t] = max(formed[t], formed[b], taken[b])
            taken[a] = max(taken[a], len(self.bytes_of[b]) + formed[t])
        self.lookahead = max(max(formed), max(taken))
        self.window = max(256, 4 * self.lookahead)
        # Where ids rise with rank, a compiled routine can merge a window; else merge_by_rank() does.
        self.merge = self.merge_by_rank
        if self.product == sorted(set(self.product)) and (not self.product or max(self.first) < self.product[0]):
            ranks = {x: i for i, x in enumerate(self.bytes_of) if x and i not in self.special.values()}
            self.merge = tiktoken.Encoding("window", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def merge_by_rank(self, data: bytes) -> list[int]:
        """Tokens of the bytes on their own: always the lowest rank first, leftmost first."""
        first, rank, product = self.first, self.rank, self.product
        out = [first[b] for b in data]
        if len(out) < 2:
            return out
        get = rank.get
        order = [get(p, NEVER) for p in zip(out, out[1:])]
        while order:
            best = min(order)
            if best == NEVER:
                break
            i = order.index(best)
            out[i : i + 2] = [product[best]]
            del order[i]
            if i:
                order[i - 1] = get((out[i - 1], out[i]), NEVER)
            if i < len(order):
                order[i] = get((out[i], out[i + 1]), NEVER)
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one pre-token, each sent once its right neighbourhood can't change it any more."""
        at, end = 0, len(data)
        while at < end:
            upto = min(end, at + self.window)
            settled = end if upto == end else upto - self.lookahead
            for t in self.merge(data[at:upto]):
                if upto < end and at + len(self.bytes_of[t]) > settled:
                    break
                at += len(self.bytes_of[t])
                yield t


class Memo(dict):
    """Remembers make(key) for the MEMO keys last met, or up to twice as many: a full memo becomes the old one."""

    def __init__(self, make, longest: int = 64):
        super().__init__()
        self.make, self.longest, self.old = make, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Transducer:
    """Text to ids, block by block."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.pretokens = Memo(self._pretoken)
        self.chunks = Memo(self._chunk)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

    def _pretoken(self, pretoken: str) -> tuple[int, ...]:
        data = pretoken.encode("utf-8", "surrogatepass")
        return tuple(self.merges.merge(data) if len(data) <= self.merges.window else self.merges.stream(data))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Of a space and what follows it up to the next one: letters, perhaps with a mark at the end, are split without a pattern."""
        if chunk[0] == " ":
            if chunk[1:].isalpha():
                return self._pretoken(chunk)
            if chunk[-1] in ".,!?" and chunk[1:-1].isalpha():
                return self.pretokens[chunk[:-1]] + self.pretokens[chunk[-1]]
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, SPLIT.findall(chunk))))

    def _plain(self, text: str) -> Iterable[int]:
        if KNOTTED.search(text):
            return chain.from_iterable(map(self.pretokens.__getitem__, SPLIT.findall(text)))
        head, *rest = text.split(" ")
        words = [" " + w for w in rest]
        if head:
            words.insert(0, head)
        return chain.from_iterable(map(self.chunks.__getitem__, words))

    def blocks(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            seam = SEAM.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            upto = seam.start() if seam else len(text)
            yield text[at:upto]
            at = upto

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The ids, a block of text at a time."""
        for block in self.blocks(text or ""):
            for k, part in enumerate(self.cut.split(block) if self.cut else [block]):
                if k % 2:
                    yield [self.merges.special[part]]
                elif part:
                    yield list(self._plain(part))


class Decoder:
    """Ids to text; what is held between calls is an unfinished UTF-8 sequence."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


@lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    rest_collector()
    return Transducer(MergeList(path))


def transducer(path: str) -> Transducer:
    hold(_transducer)
    return _transducer(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. A null text counts as empty and gives no ids; repeated rows stay."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        t = transducer(path)
        for b in batches:
            ids = [list(chain.from_iterable(t.encode(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null or no ids give the empty text."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        bytes_of = transducer(path).merges.bytes_of
        for b in batches:
            texts = [Decoder(bytes_of).feed(x or [], True) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of encode() and of decode() on its ids: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    The ids go through both automata a block of text at a time and are never held whole. A null text counts as empty.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        t = transducer(path)
        digits = [str(i) for i in range(len(t.merges.bytes_of))].__getitem__
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t.merges.bytes_of)
                for some in t.encode(text):
                    of_ids.update((("," if n else "") + ",".join(map(digits, some))).encode())
                    of_text.update(decoder.feed(some).encode())
                    n += len(some)
                of_text.update(decoder.feed([], True).encode())
                counts.append(n)
                ids_sha.append(of_ids.hexdigest())
                text_sha.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; a null text has 0."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        t = transducer(path)
        for b in batches:
            counts = [sum(map(len, t.encode(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long")
