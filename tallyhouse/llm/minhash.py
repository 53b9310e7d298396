"""Near-duplicate documents by circulant MinHash.

One permutation spreads the shingles over a ring; a second one, shifted by one place for each further coordinate, gives
the whole signature. Bands of coordinates propose candidates, and every link is confirmed on the full shingle sets.

Equal sets are folded first, and of bands with the same members one is kept. Two bits of each coordinate go along with a
member, so that pairs far below the threshold are ruled out where buckets meet; the chance to lose a pair at the
threshold by it is about one in fifty million, below that of the bands. Within a bucket, members are first compared with
one pivot only, so a bucket of n copies costs n comparisons; links join members to groups. What is still apart is
compared with further pivots until every pair of a bucket that lies in two groups has been compared. No partner or
candidate is ever left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import ROW, Store, hold, ids_and_texts, numbered
from tallyhouse.llm.components import components

#: Bands and their rows: a pair of similarity 0.8 is missed by all bands once in 2 million pairs.
BANDS, ROWS = 48, 6
#: Places of the ring.
RING = 1 << 20
#: Standard deviations below its mean at which a pair's agreement in two bits of each coordinate rules it out.
SIGMAS = 5.5
#: Pivots of a bucket in the first round of outsiders, on average at most; later rounds have four times as many as the round before.
PIVOTS = 64
#: Pivots of a block, and partners that are compared with a block in one place, on average at most.
PIVOTS_OF, PARTNERS_OF = 64, 256
#: Ids that may be broadcast: under 4 MB.
FEW = 200_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of width words; with fewer words, of the whole sequence; without words, none.

    A-Z are lower-cased; words are runs of anything but space and the controls 9 to 13.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    acc = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(acc)])
    return np.unique(acc)


@lru_cache(maxsize=2)
def _ring(coordinates: int) -> np.ndarray:
    """The second permutation with its start repeated, as rows that begin at each place."""
    order = np.random.default_rng(20240229).permutation(RING).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k: the least place, under the second permutation shifted by k, of the shingles' places under the first."""
    ring = _ring(coordinates)
    places = (_mix(hashes + np.uint64(0x1234567)) >> np.uint64(44)).astype(np.int64)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(places), 512):
        np.minimum(out, ring[places[lo : lo + 512]].min(axis=0), out=out)
    return out


#: 64-bit words that hold one bit of every coordinate.
PLANE = -(-BANDS * ROWS // 64)


def two_bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate in PLANE 64-bit words, then the next bit in as many."""
    planes = np.zeros((2, 64 * PLANE), bool)
    for k in (0, 1):
        planes[k, : len(signature)] = signature >> np.uint32(k) & np.uint32(1)
    return np.packbits(planes).view(np.int64)


def most_apart(percent: int) -> int:
    """Coordinates whose two bits may differ in a pair of that similarity: others agree by chance once in four."""
    n, differ = BANDS * ROWS, 0.75 * (1 - percent / 100)
    return int(n * differ + SIGMAS * (n * differ * (1 - differ)) ** 0.5)


class _Index:
    """Sets of hashes by hash, to count what another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner, every = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]

    def similar(self, s: np.ndarray, percent: int) -> list[int]:
        """Numbers of the sets with 100 * intersection >= percent * union."""
        lo = np.searchsorted(self.hashes, s)
        n = np.searchsorted(self.hashes, s, "right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both)).tolist()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, bits): set_id is a 128-bit digest of the shingle set, null if empty; a number for each band."""

    def run(batches):
        import pyarrow as pa

        hold()
        salt = np.arange(BANDS, dtype=np.uint64)
        for b in batches:
            n, sets, bands, bits = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                if not len(s):
                    for x in (sets, bands, bits):
                        x.append(None)
                    continue
                sets.append(xxhash.xxh128_digest(s.tobytes()))
                whole = signature(s)
                bits.append(two_bits(whole).tolist())
                rows = whole.reshape(BANDS, ROWS).astype(np.uint64)
                key = salt
                for k in range(ROWS):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                bands.append(key.view(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.binary()), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_id", "bands", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands binary, bits array<long>")


def _near(percent: int, n, bits, pn, pbits):
    """Whether two sets may be similar: by their sizes n and pn, then by two bits of each coordinate."""
    apart = sum((F.bit_count(bits[k].bitwiseXOR(pbits[k]).bitwiseOR(bits[k + PLANE].bitwiseXOR(pbits[k + PLANE]))) for k in range(PLANE)), F.lit(0))
    return (100 * F.least(n, pn) >= percent * F.greatest(n, pn)) & (apart <= most_apart(percent))


def _met(store: Store, here: DataFrame, pivots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, candidates), as (doc_id, block) each: the pivots' blocks, and those in which a member meets a pivot of one of
    its buckets, of another group, that may be similar.

    Pivots of one anchor have mostly the same partners, so up to about PIVOTS_OF of them are a block. A bucket's pivots
    are met as lists of about PIVOTS_OF, so what is sent on is one row for each member and block, never all pairs.
    """
    homes = pivots.groupBy("rep").agg(F.min("anchor").alias("home"))
    chunks = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / PIVOTS_OF).alias("chunks"))
    blocks = store.put(homes.join(chunks, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "chunks")).alias("block")))
    pivot = F.struct(F.col("n").alias("n"), F.col("bits").alias("bits"), F.col("group").alias("group"), F.col("block").alias("block"))
    lists = pivots.join(blocks, "rep").groupBy("bucket", F.pmod(F.xxhash64("rep"), "lists").alias("list")).agg(F.collect_list(pivot).alias("pivots"))
    near = F.filter("pivots", lambda x: (x["group"] != F.col("group")) & _near(percent, F.col("n"), F.col("bits"), x["n"], x["bits"]))
    met = here.join(store.put(lists.select("bucket", "pivots")), "bucket").select("rep", F.array_distinct(F.transform(near, lambda x: x["block"])).alias("blocks"))
    every = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    return blocks.withColumnRenamed("rep", "doc_id"), store.put(every.select(F.col("rep").alias("doc_id"), F.explode("blocks").alias("block")))


def _grouped(members: DataFrame, label: DataFrame, state: DataFrame) -> DataFrame:
    """members of the buckets in which more than one group is left, with their group and their bucket's anchor (a group) and done.

    A group with more than twice as many members as the anchor's becomes the anchor.
    """
    anchors = state.join(label.select(F.col("id").alias("anchor"), F.col("component_id").alias("now")), "anchor", "left").select("bucket", F.coalesce("now", "anchor").alias("anchor"), "done")
    here = members.join(label.select(F.col("id").alias("rep"), F.col("component_id").alias("now")), "rep", "left").withColumn("group", F.coalesce("now", "rep")).drop("now").join(anchors, "bucket")
    sizes = here.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("group") == F.col("anchor"), 1)).alias("is_anchor"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("c", "group")).alias("top"), F.max(F.when(F.col("is_anchor") == 1, F.col("c"))).alias("c"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    moved = F.when(F.col("top.c") > 2 * F.col("c"), F.col("top.group"))
    here = here.join(top.select("bucket", moved.alias("moved")), "bucket")
    return here.withColumn("done", F.when(F.col("moved").isNull(), F.col("done")).otherwise(0.0)).withColumn("anchor", F.coalesce("moved", "anchor")).drop("moved")


def _similar(blocks: DataFrame, candidates: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) on full sets, 100 * intersection >= percent * union, that join whatever links of candidates and pivots join.

    A candidate's text goes to each of its blocks once, and the block's texts to each PARTNERS_OF of its candidates. The
    list of ids is broadcast where it is counted to be short.
    """
    parts = candidates.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_OF).alias("parts"))
    partners = candidates.join(parts, "block").select("doc_id", "block", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), F.lit(1).alias("side"))
    pivots = blocks.join(parts, "block").select("doc_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    sides = partners.unionByName(pivots)
    if sides.count() <= FEW:
        sides = F.broadcast(sides)
    sent = texts.join(sides, "doc_id").select("block", "part", "side", "doc_id", "text").repartition("block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches):
        import pyarrow as pa

        hold()
        now, ids, sets, index, parent = None, [], [], None, {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for batch in batches:
            good = []
            for row in range(batch.num_rows):
                block, part, side, doc = (batch.column(k)[row].as_py() for k in range(4))
                if (block, part) != now:
                    now, ids, sets, index, parent = (block, part), [], [], None, {}
                s = shingles(batch.column(4)[row].as_py(), width)
                if side == 0:
                    ids.append(doc)
                    sets.append(s)
                    continue
                if index is None:
                    index = _Index(sets)
                for k in index.similar(s, percent):
                    a, b = sorted((root(ids[k]), root(doc)))
                    if a != b:
                        parent[b] = a
                        good.append((ids[k], doc))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    component_id: the least doc_id that links reach, itself included; kept: it is that least one. Without words or text a
    document has no shingles and links with nothing. Rows of one doc_id must have one text; a row without doc_id links
    with nothing, has no component_id and is kept.
    """
    docs = ids_and_texts(docs)
    store = Store(docs.sparkSession, "minhash")
    seen = store.put(sketch(docs, width))
    reps = store.put(
        seen.where("set_id is not null and doc_id is not null").groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.col("bands").substr(k * 8 + 1, F.lit(8))))
    spread = reps.select("rep", F.explode(buckets).alias("bucket"))
    # Near copies share most of their bands: of buckets with the same members (by two digests of 64 bits) one stands for all.
    same = ["size", "first", F.col("x"), F.col("y")]
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    many = store.put(sizes.where("size > 1").groupBy(*same).agg(F.min("bucket").alias("bucket")).select("bucket", "size", "first"))
    placed = store.put(spread.join(many.hint("merge"), "bucket"))
    members = store.put(placed.join(reps.select("rep", "n", "bits"), "rep"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = store.put(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    # First round: each bucket's least member is its pivot, and every member a group of its own.
    alone = members.withColumn("group", F.col("rep")).withColumn("anchor", F.col("first")).withColumn("lists", F.lit(1).cast("long"))
    label = store.put(components(_similar(*_met(store, alone, alone.where("rep = first"), percent), texts, width, percent)))
    # Then all members outside the group of a bucket's anchor become pivots in turn: of two members that end in two groups,
    # one at least is outside it all along. A much larger group takes the anchor over, and turns start anew.
    place = F.pmod(F.xxhash64("bucket", "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    outside = (F.col("group") != F.col("anchor")) & (place >= F.col("done"))
    state, take, columns = members.where("rep = first").select("bucket", F.col("first").alias("anchor"), F.lit(0.0).alias("done")), PIVOTS, members.columns
    while True:
        here = store.put(_grouped(members, label, state))
        waiting = here.where(outside).groupBy("bucket").agg(F.count(F.lit(1)).alias("waiting"))
        share = F.least(F.lit(1.0), take / F.col("waiting"))
        asked = here.join(waiting, "bucket").withColumn("upto", F.when(share >= 1, 1.0).otherwise(F.col("done") + (1 - F.col("done")) * share))
        asked = store.put(asked.withColumn("lists", F.ceil(F.least(F.lit(take), F.col("waiting")) / PIVOTS_OF)).drop("waiting"))
        blocks, candidates = _met(store, asked, asked.where(outside & (place < F.col("upto"))), percent)
        if not candidates.isEmpty():
            # A group's links to its least member stand for all those that made it.
            stars = label.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
            label = store.put(components(stars.unionByName(_similar(blocks, candidates, texts, width, percent))))
        # Buckets whose members all had their turn are done.
        members = asked.where("upto < 1").select(*columns)
        state = store.put(asked.where("upto < 1").select("bucket", "anchor", F.col("upto").alias("done")).distinct())
        take *= 4
        if state.isEmpty():
            break
    out = seen.select("doc_id", "n_shingles", "set_id").join(reps.select("set_id", "rep"), "set_id", "left").join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    out = store.put(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    store.drop_all_but(out)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id, and of its rows the least by hash.

    Every row counts as a document of its own, so rows may share an id or have none. Of rows with one id and one text
    without words one stays, too.
    """
    rows = numbered(docs)
    found = groups(rows.select(F.col(ROW).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias(ROW), "n_shingles", "component_id")
    id_, empty = F.col("doc_id").cast("long"), F.col("n_shingles") == 0
    # Whole digests of texts without words, as they only meet by them.
    same = F.when(empty & id_.isNull(), F.col(ROW).cast("string")).when(empty, F.concat_ws(":", id_.cast("string"), F.coalesce("text_digest", F.lit("null")))).otherwise("")
    order = F.struct(id_.isNull().alias("x"), id_.alias("i"), F.col("text_digest").alias("d"), F.col("rest").alias("h"), F.col(ROW).alias(ROW))
    keys = rows.select(ROW, "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_digest"), F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]).alias("rest")).join(found, ROW)
    kept = keys.groupBy(F.when(~empty, F.col("component_id")).alias("c"), same.alias("s")).agg(F.min(order).alias("k")).select(f"k.{ROW}")
    gone = keys.select(ROW).join(kept, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
