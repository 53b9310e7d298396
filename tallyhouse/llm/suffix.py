"""Removal of long byte strings that occur more than once, by suffix arrays.

Every string of `length` bytes holds an anchor: of its 192-byte grams, the one of least hash. Equal strings have equal
anchors at equal places, so a string can only repeat within the group of its anchor's gram. Anchors whose gram occurs
once drop out at once. An anchor answers for the strings for which it is the least one; together they cover a region of
the text. Regions that are equal as a whole repeat as a whole, and need counting only. What is left is decided by suffix
arrays over the distinct regions of a gram, the gram itself being one symbol. Bytes that a region shares with no other one
of its gram, in their order from the gram, are in no string that repeats and are cut off before; what all strings of a gram
then hold goes into that symbol too.

Longer strings repeat only where shorter ones do, so they are looked for within the runs of those.

Suffixes are sorted by linear grouping: groups of suffixes with one Lyndon prefix are refined in descending order through
pointers to the previous smaller suffix, then the order within the groups is emitted in ascending order along the same
pointers, without recursive renaming.

Grams with very many distinct regions are split by the bytes beside the gram; strings that end too near the gram for
that, and all strings of a part that is still too large, are counted by their digests. So no group grows without bound.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Store, hold, ids_and_texts, row_key
from tallyhouse.llm.minhash import _mix

LENGTH, GRAM = 400, 192
#: Words of a repeated passage, at least.
WORDS = 50
#: Starts of strings looked at in one step; distinct regions sorted together at most; bytes on either side that split larger groups.
STEP, TOGETHER, BESIDE = 60_000, 4000, 3
#: Bytes that groups have which are sorted together; a larger group is sorted alone.
SORTED = 300_000
#: Rows that a Python task hands on together.
SLICE = 20_000


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order; the text's last symbol must be its least and occur once."""
    return list(_suffixes(text))


def _suffixes(text: Sequence[int]) -> array:
    """suffix_array() with all numbers in arrays of 32 bits, so that a symbol takes some 40 bytes in all."""
    n = len(text)
    group = array("i", bytes(4 * n))
    members: list[array] = []
    below: list[int] = []
    above: list[int] = []
    first = {c: g for g, c in enumerate(sorted(set(text)))}
    for g in range(len(first)):
        members.append(array("i"))
        below.append(g - 1)
        above.append(g + 1 if g + 1 < len(first) else -1)
    for i, c in enumerate(text):
        g = group[i] = first[c]
        members[g].append(i)
    done = [False] * len(first)
    previous = array("i", [-1]) * n
    g = len(first) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        own.sort()
        members[g] = array("i", own)
        done[g] = True
        pointed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            # Who is followed by more copies of this group's prefix is larger: the most go out of their group first, to right above it.
            by_times: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                moved: dict[int, int] = {}
                for p in by_times[k]:
                    h = group[p]
                    new = moved.get(h)
                    if new is None:
                        new = moved[h] = len(members)
                        members.append(array("i"))
                        done.append(False)
                        up = above[h]
                        below.append(h)
                        above.append(up)
                        above[h] = new
                        if up >= 0:
                            below[up] = new
                    members[new].append(p)
                    group[p] = new
        g = below[g]
    start = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        start[g] = at
        if members[g] and done[g]:
            at += len(members[g])
        g = above[g]
    order = array("i", [-1]) * n
    placed = bytearray(n)
    order[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = previous[j]
    return order


def _common(a: bytes, b: bytes) -> int:
    """How many bytes a and b share from their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _shared(sides: list[bytes]) -> list[int]:
    """How many bytes each of them shares from its start with any other one: the one before or after it in order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        out[i], out[j] = max(out[i], n), n
    return out


def shared_parts(regions: list[tuple[int, bytes, bytes]], width: int) -> list[tuple[int, int, tuple[int, bytes, bytes, int]]]:
    """The regions (gram's number, bytes left of the gram, bytes right of it) that can share a string of width symbols with
    another of their gram, as repeated_starts() takes them: place in the list, how much more the new gram has on the left, region.

    They are cut to the bytes that others have beside the gram too, and the gram takes in what then all strings hold. The strings that
    repeat stay whole.
    """
    groups: dict[int, list[int]] = {}
    for k, r in enumerate(regions):
        groups.setdefault(r[0], []).append(k)
    out, numbers = [], {}
    for g, own in groups.items():
        lefts = _shared([regions[k][1][::-1] for k in own])
        rights = _shared([regions[k][2] for k in own])
        own = [(k, x, y) for k, x, y in zip(own, lefts, rights) if x + y >= width - 1]
        if not own:
            continue
        more_left = max(0, width - 1 - max(y for _, _, y in own))
        more_right = max(0, width - 1 - max(x for _, x, _ in own))
        for k, x, y in own:
            _, left, right = regions[k]
            n = len(left)
            gram = numbers.setdefault((g, left[n - more_left :], right[:more_right]), len(numbers))
            out.append((k, more_left, (gram, left[n - x : n - more_left], right[more_right:y], width - more_left - more_right)))
    return out


def repeated_starts(regions: list[tuple[int, bytes, bytes, int]]) -> list[list[int]]:
    """For regions (gram's number, bytes left of the gram, bytes right of it, width, the same for all of a gram): by region, how
    far left of the gram the strings of width symbols start that occur in another region too. A region's left and right hold just its own strings."""
    parts, begins, at = array("i"), [], 0
    for g, left, right, _ in regions:
        part = [b + 2 for b in left] + [258 + g] + [b + 2 for b in right] + [1]
        parts.extend(part)
        begins.append(at)
        at += len(part)
    parts.append(0)
    chars = "".join(map(chr, parts))
    owner = array("i", np.repeat(np.arange(len(regions), dtype=np.int32), np.diff([*begins, at])).tobytes())
    lefts = [len(r[1]) for r in regions]
    ends = [b + len(left) + 1 + len(right) for b, (_, left, right, _) in zip(begins, regions)]
    good: list[set[int]] = [set() for _ in regions]
    last = None
    for i in _suffixes(parts):
        if i >= at:
            continue
        r = owner[i]
        width = regions[r][3]
        if i - begins[r] > lefts[r] or i + width > ends[r]:
            continue
        now = chars[i : i + width]
        if last is not None and last[0] == now:
            good[r].add(lefts[r] - (i - begins[r]))
            q, j = last[1], last[2]
            good[q].add(lefts[q] - (j - begins[q]))
        last = (now, r, i)
    return [sorted(x) for x in good]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = STEP + 2 * LENGTH + 2
    powers = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return _mix(np.arange(1, 257, dtype=np.uint64)), powers[0], powers[1]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and first and last start of the strings that it answers for."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    byte, up, down = _tables()
    window = length - gram + 1
    raw = np.frombuffer(data, np.uint8)
    places, hashes = [], []
    for base in range(0, n - length + 1, STEP):
        starts = min(STEP, n - length + 1 - base)
        d = byte[raw[base : base + starts + length - 1]]
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(d * down[: len(d)], out=sums[1:])
        grams = starts + window - 1
        h = _mix((sums[gram : gram + grams] - sums[:grams]) * up[:grams])
        key = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(grams, dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            rest = window - span
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least & np.uint64(0xFFFF)).astype(np.int64)
        places.append(at + base)
        hashes.append(h[at])
    place, h = np.concatenate(places), np.concatenate(hashes)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    hi = np.append(lo[1:] - 1, len(place) - 1)
    return h[lo], place[lo], lo, hi


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row_key, spans array<struct<start, end>>) of the rows with bytes to remove; spans are in order and do not meet.

    A byte is to be removed if a string of `length` bytes covers it that also starts anywhere else, be it in a row of the
    same id or of none.
    """
    texts = docs.select(row_key().alias("doc_id"), F.lit(0).alias("base"), F.col("text").cast("string").cast("binary").alias("text"))
    return _find(texts, length, gram, Store(docs.sparkSession, "suffix"))


def find_within(docs: DataFrame, shorter: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What find() finds, if shorter is what it found in the same rows for a smaller length.

    All of a repeated string's own strings repeat, so it lies in one of the spans of shorter, and so does each other place of it.
    """
    store = Store(docs.sparkSession, "suffix")

    def cut(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            rows = [
                (doc, x["start"], text[x["start"] : x["end"]])
                for doc, text, spans in zip(*(c.to_pylist() for c in b.columns))
                for x in spans
                if x["end"] - x["start"] >= length
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "base", "text"])

    runs = shorter.where(F.exists("spans", lambda x: x["end"] - x["start"] >= length))
    texts = docs.select(row_key().alias("row_key"), F.col("text").cast("string").cast("binary").alias("text"))
    return _find(store.put(texts.join(runs, "row_key").select("row_key", "text", "spans").mapInArrow(cut, "doc_id long, base int, text binary")), length, gram, store)


def _find(docs: DataFrame, length: int, gram: int, store: Store) -> DataFrame:
    """find() for (doc_id, base, text): text is what the row named doc_id has from byte base on."""
    width = length - gram + 1  # the sides of joins by gram are stored, so that Spark can split a hot one

    def grams(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            found = [anchors(t or b"", length, gram)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["gram"])

    def regions(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, base, data in zip(*(c.to_pylist() for c in b.columns)):
                h, a, lo, hi = anchors(data or b"", length, gram)
                digest = xxhash.xxh3_64_intdigest
                region = np.array([digest(data[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist())], np.uint64)
                for c, x in zip(cols, (h.view(np.int64), region.view(np.int64), np.full(len(h), doc), np.full(len(h), base), a + base, lo + base, hi + base)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 4)], ["gram", "region", "doc_id", "base", "at", "lo", "hi"]
            )

    repeated = store.put(docs.select("text").mapInArrow(grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    seen = store.put(docs.mapInArrow(regions, "gram long, region long, doc_id long, base int, at int, lo int, hi int").join(repeated.hint("merge"), "gram", "left_semi"))
    distinct = store.put(seen.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "base", "at", "lo", "hi")).alias("one")))
    # Regions that occur once, and share their gram with another region, have to be looked into; the others are decided.
    mixed = store.put(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("regions"), F.min("times").alias("least")).where("regions > 1 and least = 1").select("gram", "regions"))
    asked = distinct.join(mixed, "gram").select("gram", "region", "times", "regions", "one.*")
    lists = asked.groupBy("doc_id", "base").agg(F.collect_list(F.struct("gram", "region", "times", "regions", "at", "lo", "hi")).alias("asked"))

    def cut(batches):
        import pyarrow as pa

        hold()

        def batch(rows):
            types = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["gram", "region", "times", "regions", "doc_id", "at", "left", "right"])

        rows = []
        for b in batches:
            for doc, base, text, wanted in zip(*b.columns):
                base, data = base.as_py(), text.as_py()
                for r in wanted.as_py():
                    a, lo, hi = r["at"] - base, r["lo"] - base, r["hi"] - base
                    rows.append((r["gram"], r["region"], r["times"], r["regions"], doc.as_py(), r["at"], data[lo:a], data[a + gram : hi + length]))
                    if len(rows) == SLICE:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    pieces = docs.join(lists, ["doc_id", "base"]).select("doc_id", "base", "text", "asked").mapInArrow(cut, "gram long, region long, times long, regions long, doc_id long, at int, left binary, right binary")
    large = F.col("regions") > TOGETHER
    beside = F.when(large, F.concat(F.substring("left", F.greatest(F.length("left") - (BESIDE - 1), F.lit(1)), F.lit(BESIDE)), F.lit(b"|"), F.substring("right", 1, BESIDE))).otherwise(F.lit(b""))
    pieces = store.put(pieces.withColumn("large", large).withColumn("part", beside))
    # Rows of one key each send the regions that they share; each region counts once.
    pieces = pieces.where("times = 1").unionByName(pieces.where("times > 1").dropDuplicates(["gram", "region"]))
    crowded = store.put(pieces.where("large").groupBy("gram", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("gram", "part", F.lit(True).alias("crowded")))
    pieces = pieces.join(crowded, ["gram", "part"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))

    def sort(batches):
        """Rows come ordered by gram and part; whole groups are sorted together, several at a time."""
        import pyarrow as pa

        hold()

        def decide(rows):
            numbers: dict = {}
            kept = shared_parts([(numbers.setdefault((r["gram"], r["part"]), len(numbers)), r["left"], r["right"]) for r in rows], width)
            out = []
            for (k, more, _), offsets in zip(kept, repeated_starts([region for _, _, region in kept])):
                r, offsets = rows[k], [o + more for o in offsets]
                if r["times"] > 1:
                    continue
                if r["large"]:
                    offsets = [o for o in offsets if BESIDE <= o <= width - 1 - BESIDE]
                if offsets:  # all strings of a piece hold its gram, so what they cover is one span
                    out.append((r["doc_id"], r["at"] - max(offsets), r["at"] - min(offsets) + length))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["doc_id", "start", "end"])

        def key(r):
            return r["gram"], r["part"]

        held, own, now, n_held, n_own = [], [], None, 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for r in b.slice(lo, 500).to_pylist():
                    if key(r) != now:
                        if held and n_held + n_own > SORTED:
                            yield decide(held)
                            held, n_held = [], 0
                        held, n_held, own, n_own, now = held + own, n_held + n_own, [], 0, key(r)
                    own.append(r)
                    n_own += len(r["left"]) + len(r["right"])
        if held and n_held + n_own > SORTED:
            yield decide(held)
            held = []
        if held or own:
            yield decide(held + own)

    columns = ["gram", "part", "large", "times", "doc_id", "at", "left", "right"]
    by_sorting = pieces.where("not crowded").select(*columns).repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(sort, "doc_id long, start long, end long")

    def windows(batches):
        """Strings that the parts can't decide: in crowded parts all of them, else those that end near the gram."""
        import pyarrow as pa

        hold()

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["digest", "gram", "doc_id", "at", "start", "times"])

        rows = []
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                left, right = r["left"], r["right"]
                for o in range(max(0, width - 1 - len(right)), len(left) + 1):
                    if r["crowded"] or not BESIDE <= o <= width - 1 - BESIDE:
                        side = left[len(left) - o :] + right[: width - 1 - o]
                        rows.append((xxhash.xxh3_64_intdigest(side, o) - (1 << 63), r["gram"], r["doc_id"], r["at"], r["at"] - o, r["times"]))
                if len(rows) >= SLICE:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    strings = pieces.where("large").select("gram", "crowded", "times", "doc_id", "at", "left", "right").mapInArrow(windows, "digest long, gram long, doc_id long, at long, start long, times long")
    counted = store.put(strings.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "digest"))
    by_counting = strings.where("times = 1").join(counted, ["gram", "digest"], "left_semi").groupBy("doc_id", "at").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("at")
    whole = seen.join(distinct.where("times > 1").select("gram", "region"), ["gram", "region"], "left_semi")
    whole = whole.select("doc_id", F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("end"))
    spans = whole.unionByName(by_sorting).unionByName(by_counting).groupBy(F.col("doc_id").alias("row_key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def join(batches):
        import pyarrow as pa

        for b in batches:
            spans, far = b.column(1), 1 << 40  # rows lie this far apart, so that one pass merges the spans of all
            row = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy())) * far
            starts, ends = (spans.flatten().field(k).to_numpy() + row for k in range(2))
            order = np.argsort(starts, kind="stable")
            starts, reached = starts[order], np.maximum.accumulate(ends[order])
            first = np.flatnonzero(np.append(True, starts[1:] > reached[:-1])) if len(starts) else starts
            last = np.append(first[1:], len(starts)) - 1 if len(starts) else starts
            offsets = np.searchsorted(starts[first] // far, np.arange(b.num_rows + 1))
            runs = pa.StructArray.from_arrays([pa.array(starts[first] % far), pa.array(reached[last] % far)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], ["row_key", "spans"])

    found = store.put(spans.mapInArrow(join, "row_key long, spans array<struct<start: long, end: long>>"))
    store.drop_all_but(found)
    return found


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _left(text: str | None, spans, words: int = 0) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    """The text's bytes, those that stay, and the merged spans of at least so many words."""
    data = _bytes(text)
    cuts = merged((x["start"], x["end"]) for x in (() if spans is None else spans))
    if words:
        cuts = [(s, e) for s, e in cuts if len(data[s:e].split()) >= words]
    at, parts = 0, []
    for s, e in cuts:
        parts.append(data[at:s])
        at = e
    return data, b"".join([*parts, data[at:]]), cuts


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_passages, passage_words) of every row: what find() leaves of its
    UTF-8 bytes; null counts as empty.

    text: the bytes that stay, without UTF-8 sequences that a cut leaves in part. n_passages, passage_words: the runs of at least so
    many words among the bytes that repeated strings of half the length cover, and their words; they stay, if no string of the whole length covers them.
    """

    def run(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            texts, spans, passages = (b.column(k).to_pylist() for k in (1, 2, 3))
            rows = [_left(t, s) for t, s in zip(texts, spans)]
            long = [[n for x in p or () if (n := len(d[x["start"] : x["end"]].split())) >= words] for (d, _, _), p in zip(rows, passages)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(d) for d, _, _ in rows], pa.int64()),
                    pa.array([len(d) - len(k) for d, k, _ in rows], pa.int64()),
                    pa.array([len(c) for _, _, c in rows], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in rows], pa.string()),
                    pa.array([k.decode("utf-8", "ignore") for _, k, _ in rows], pa.string()),
                    pa.array([len(x) for x in long], pa.int64()),
                    pa.array([sum(x) for x in long], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_passages", "passage_words"],
            )

    docs = ids_and_texts(docs)
    shorter = find(docs, length // 2, gram // 2)
    found = shorter.withColumnRenamed("spans", "passages").join(find_within(docs, shorter, length, gram), "row_key", "left")
    joined = docs.withColumn("row_key", row_key()).join(found, "row_key", "left").select("doc_id", "text", "spans", "passages")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_passages long, passage_words long")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """docs without the bytes that find() names, and n_chars set anew; all rows stay, perhaps with an empty text.

    words: runs of bytes with fewer words stay, those cut at the ends included in the count. A UTF-8 sequence that a cut
    leaves in part goes with it.
    """

    @F.pandas_udf("string")
    def rest(texts, spans):
        import pandas as pd

        return pd.Series([_left(t, s, words)[1].decode("utf-8", "ignore") for t, s in zip(texts, spans)], dtype=object)

    out = docs.withColumn("_row_key", row_key()).join(find(docs, length, gram).select(F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans")), "_row_key", "left")
    out = out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rest("text", "_spans")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
