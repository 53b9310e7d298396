"""What is remembered by key between batches: barriers of clients, gates, and facts that wait for their dimension.

Rows reach the state by client and part: a client's data are dealt over parts, so no task needs all of one client, and
its few control rows go to every part. All parts of a client thus decide alike, in the same batch. State is in RocksDB,
part of the query's checkpoint: no batch reads again what earlier ones read, and a client's state goes when it is done.
Data come, wait and leave in blocks of rows (streaming.blocks); only control rows are handled one by one.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from math import fsum

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhouse.streaming.blocks import blocks_of, packed, table_of, unpacked

#: Of queries that keep state by key: where it lies, no batches without rows, which state that can be forgotten would else
#: ask for without end, and fewer rows between Spark and its workers at once, since a row may be a block of rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
#: Parts of one client's rows.
PARTS = 64
#: Tasks of a batch where the session has as many, on few cores too: more of them may come later.
LEAST = 32
#: Milliseconds after which state that nothing touched is forgotten: clients that never end leave nothing for good.
FORGET = 30 * 24 * 3600 * 1000
#: Messages of a client's part and batch that are kept as rows; more of them are kept in blocks.
FEW = 100
#: Blocks that are added to a list at once.
APPEND = 100
#: Before every seq.
NEVER = -(2**63)


def tasks(spark: SparkSession) -> int:
    """Tasks of a batch: the session's, but no more than LEAST and two for each core.

    Each opens a store and a worker in every batch, whether rows come or not. A query keeps the number it began with.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST, 2 * spark.sparkContext.defaultParallelism))


@contextlib.contextmanager
def settings(spark: SparkSession):
    """Queries started inside have SETTINGS and tasks(); the session's own are as before afterwards."""
    inside = {**SETTINGS, "spark.sql.shuffle.partitions": str(tasks(spark))}
    before = {name: spark.conf.get(name, None) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def dealt(df: DataFrame, is_data: Column | str, by: list[str | Column], parts: int) -> DataFrame:
    """df with the column part: data by a hash of `by`, other rows once for every part."""
    is_data = F.expr(is_data) if isinstance(is_data, str) else is_data
    own = F.array(F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    return df.withColumn("part", F.explode(F.when(is_data, own).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))))


def add_blocks(state, blocks: list[bytes]) -> None:
    for k in range(0, len(blocks), APPEND):
        state.appendList([(b,) for b in blocks[k : k + APPEND]])


class Barrier(StatefulProcessor):
    """Sums of a client's part, once enough markers came.

    messages and blocks: what came since the last reset and was not yet sent, rows of a batch that brought FEW, and else
    blocks of them. marks: of each marker, where it was said. reset: the greatest seq of a reset. sent: the reset after
    which the client was last sent, and the marker that completed it.
    """

    OUT = "client_id string, part int, since long, until long, amount double, n_rows long"
    MESSAGE = "message_uuid string, amount double, seq long"

    def __init__(self, needed: int, forget: int = FORGET):
        self.needed, self.forget = needed, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", self.MESSAGE, self.forget)
        self.blocks = handle.getListState("blocks", "block binary", self.forget)
        self.marks = handle.getMapState("marks", "message_uuid string", "seqs array<long>", self.forget)
        self.reset = handle.getValueState("reset", "since long", self.forget)
        self.sent = handle.getValueState("sent", "since long, until long", self.forget)

    @staticmethod
    def after(table, seq: int):
        import pyarrow.compute as pc

        return table.filter(pc.greater(table.column("seq"), seq))

    def kept(self):
        """All messages that wait, as a table."""
        import pyarrow as pa

        schema = pa.schema([("message_uuid", pa.string()), ("amount", pa.float64()), ("seq", pa.int64())])
        rows = [list(c) for c in zip(*map(tuple, self.messages.get()))] if self.messages.exists() else [[], [], []]
        tables = [table_of(b).select(schema.names).cast(schema) for (b,) in self.blocks.get()] if self.blocks.exists() else []
        return pa.concat_tables([pa.table(rows, schema=schema), *tables])

    def keep(self, table) -> None:
        if 0 < table.num_rows <= FEW:
            self.messages.appendList([tuple(r.values()) for r in table.select(["message_uuid", "amount", "seq"]).to_pylist()])
        elif table.num_rows:
            add_blocks(self.blocks, list(blocks_of(table.combine_chunks())))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import pyarrow as pa
        import pyarrow.compute as pc

        client_id, part = key
        since = self.reset.get()[0] if self.reset.exists() else NEVER
        sent = tuple(self.sent.get()) if self.sent.exists() else None
        data, marks, resets = [], {}, []
        for r in rows:
            if r.kind == "data":
                data.append(table_of(r.block))
            elif r.kind == "EOF":
                marks.setdefault(r.message_uuid or "", []).append(r.seq)
            else:
                resets.append(r.seq)
        if max(resets, default=NEVER) > since:
            since = max(resets)
            self.reset.update((since,))
            left = self.after(self.kept(), since)
            self.messages.clear()
            self.blocks.clear()
            self.keep(left)
        # Of an epoch that was sent, what comes up to its last marker is late or repeated.
        after = max(since, sent[1]) if sent and sent[0] == since else since
        if data:
            self.keep(self.after(pa.concat_tables(data), after))
        marks = {name: late for name, seqs in marks.items() if (late := [s for s in seqs if s > after])}
        for name, seqs in marks.items():
            known = self.marks.getValue((name,))[0] if self.marks.containsKey((name,)) else []
            self.marks.updateValue((name,), (sorted({*known, *seqs}),))
        if not (marks or resets) or sent and sent[0] == since:
            return
        valid = [[s for s in seqs if s > since] for _, (seqs,) in self.marks.iterator()]
        first = sorted(min(seqs) for seqs in valid if seqs)
        if len(first) < self.needed:
            return
        until = first[self.needed - 1]
        table = self.kept()
        due = table.filter(pc.less_equal(table.column("seq"), until))
        self.messages.clear()
        self.blocks.clear()
        self.keep(self.after(table, until))
        # Of messages with an id the first counts; nothing tells that one without is a repeat.
        nameless = pc.equal(due.column("message_uuid"), "")
        ordered = due.filter(pc.invert(nameless)).sort_by([(c, "ascending") for c in ("message_uuid", "seq", "amount")])
        ids = ordered.column("message_uuid").combine_chunks()
        new = pa.concat_arrays([pa.array([True][: len(ids)], pa.bool_()), pc.not_equal(ids[1:], ids[:-1])])
        amounts = due.filter(nameless).column("amount").to_pylist() + ordered.filter(new).column("amount").to_pylist()
        self.marks.clear()
        self.sent.update((since, until))
        if amounts or part == 0:
            yield Row(client_id=client_id, part=part, since=since, until=until, amount=fsum(amounts), n_rows=len(amounts))

    def close(self) -> None:
        pass


def barrier(df: DataFrame, needed: int, parts: int = PARTS, forget: int = FORGET) -> DataFrame:
    """Rows of Barrier.OUT of a stream of (client_id, kind, message_uuid, amount, seq); see jobs.run_barrier."""
    rows = df.select("client_id", "kind", F.coalesce("message_uuid", F.lit("")).alias("message_uuid"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.col("seq").cast("long").alias("seq"))
    rows = rows.where("kind in ('data', 'EOF', 'CLIENT_RESET') and seq is not null")
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    data = dealt(rows.where("kind = 'data'").drop("kind"), "true", ["message_uuid", F.when(F.col("message_uuid") == "", F.col("seq"))], parts)
    data = packed(data, ["client_id", "part"]).select("client_id", "part", F.lit("data").alias("kind"), none("string", "message_uuid"), none("long", "seq"), "block")
    control = dealt(rows.where("kind <> 'data'"), "false", ["message_uuid"], parts).select("client_id", "part", "kind", "message_uuid", "seq", none("binary", "block"))
    return data.unionByName(control).groupBy("client_id", "part").transformWithState(Barrier(needed, forget), Barrier.OUT, "Append", "ProcessingTime")


class Gate(StatefulProcessor):
    """Blocks of a client's part, held until every needed input has ended. waiting: blocks held. ended: inputs that have."""

    def __init__(self, needed: set[str], forget: int = FORGET):
        self.needed, self.forget = needed, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "block binary", self.forget)
        self.ended = handle.getMapState("ended", "input string", "n int", self.forget)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came, ended = [], set()
        for r in rows:
            if r.input is None:
                came.append(r.block)
            elif r.input in self.needed:
                ended.add(r.input)
        for name in ended:
            self.ended.updateValue((name,), (1,))
        if len(ended) < len(self.needed):
            ended |= {name for (name,) in self.ended.keys()}
        if len(ended) < len(self.needed):
            add_blocks(self.waiting, came)
            return
        if self.waiting.exists():
            for (block,) in self.waiting.get():
                yield Row(block=bytes(block))
            self.waiting.clear()
        for block in came:
            yield Row(block=block)

    def close(self) -> None:
        pass


def gated(df: DataFrame, ends: DataFrame, needed: list[str], parts: int = PARTS, forget: int = FORGET) -> DataFrame:
    """Rows of the stream df, given on when all needed inputs of their client have ended, at once from then on.

    df has client_id; ends is a stream of (client_id, input), in any number and order. A null client is one of its own.
    """
    df = df.select("client_id", *[c for c in df.columns if c != "client_id"])
    rows = dealt(packed(df, ["client_id"]).withColumn("input", F.lit(None).cast("string")), "true", ["block"], parts)
    ends = dealt(ends.where("input is not null").select("client_id", F.lit(None).cast("binary").alias("block"), "input"), "false", ["input"], parts)
    held = rows.unionByName(ends).groupBy("client_id", "part").transformWithState(Gate(set(needed), forget), "block binary", "Append", "ProcessingTime")
    return unpacked(held, df.schema)


class Named(StatefulProcessor):
    """Blocks of facts of a client's part with names of their keys, held until the dimension's end was said.

    names: by key the name written last. waiting: facts held. ended: whether the dimension has ended.
    """

    def __init__(self, default: str, forget: int = FORGET):
        self.default, self.forget = default, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "key string", "seq long, name string", self.forget)
        self.waiting = handle.getListState("waiting", "block binary", self.forget)
        self.ended = handle.getValueState("ended", "n int", self.forget)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts, names, end = [], {}, False
        for r in rows:
            if r.kind == "fact":
                facts.append(r.block)
            elif r.kind == "end":
                end = True
            elif r.key not in names or (r.seq, r.name) > names[r.key]:
                names[r.key] = (r.seq, r.name)
        for k, named in names.items():
            if not self.names.containsKey((k,)) or tuple(self.names.getValue((k,))) < named:
                self.names.updateValue((k,), named)
        if end:
            self.ended.update((1,))
        elif not self.ended.exists():
            add_blocks(self.waiting, facts)
            return
        found = {None: self.default}
        if self.waiting.exists():
            for (block,) in self.waiting.get():
                yield Row(block=self.with_names(bytes(block), found))
            self.waiting.clear()
        for block in facts:
            yield Row(block=self.with_names(block, found))

    def with_names(self, block: bytes, found: dict) -> bytes:
        """The block with _name for _key. found: names that were looked up."""
        import pyarrow as pa

        table = table_of(block)
        keys = table.column("_key").combine_chunks().dictionary_encode()
        for k in keys.dictionary.to_pylist():
            if k not in found:
                found[k] = self.names.getValue((k,))[1] if self.names.containsKey((k,)) else self.default
        names = pa.array([found[k] for k in keys.dictionary.to_pylist()], pa.string()).take(keys.indices).fill_null(self.default)
        sink = pa.BufferOutputStream()
        table = table.append_column("_name", names)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def close(self) -> None:
        pass


def named(facts: DataFrame, dimension: DataFrame, ends: DataFrame, key: str, name: str, default: str, copies: int = 8, parts: int = PARTS, forget: int = FORGET) -> DataFrame:
    """The stream facts with the column `name` of their key, given on once their client's dimension has ended.

    dimension: a stream of (client_id, key, name, seq); of one key, the row of greatest seq counts, also when it comes
    after the end, for facts that come later. ends: a stream of (client_id). Facts before, between and after the
    dimension's files all get their names, and `default` where there is none. A key's facts are dealt over `copies`
    parts, which all hear of its name, so that one key may hold most facts.
    """
    columns = [c for c in facts.columns if c != "client_id"]
    base = "client_id", "part", "kind", "key", "seq", "name", "block"
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    of_key = lambda salt: F.pmod(F.xxhash64("key") + salt, F.lit(parts)).cast("int")
    f = facts.select("client_id", *columns, F.col(key).cast("string").alias("_key"))
    f = f.withColumn("part", F.pmod(F.xxhash64("_key") + F.pmod(F.xxhash64(F.to_json(F.struct(*columns))), F.lit(copies)), F.lit(parts)).cast("int"))
    d = dimension.select("client_id", F.lit("name").alias("kind"), F.col("key").cast("string").alias("key"), F.coalesce(F.col("seq").cast("long"), F.lit(NEVER)).alias("seq"), F.col("name").cast("string").alias("name"), none("binary", "block"))
    d = d.where("trim(key) <> '' and trim(name) <> ''").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: of_key(c))))
    e = ends.select("client_id", F.lit("end").alias("kind"), none("string", "key"), none("long", "seq"), none("string", "name"), none("binary", "block"))
    e = e.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    f = packed(f, ["client_id", "part"]).select("client_id", "part", F.lit("fact").alias("kind"), none("string", "key"), none("long", "seq"), none("string", "name"), "block")
    rows = f.select(*base).unionByName(d.select(*base)).unionByName(e.select(*base))
    got = rows.groupBy("client_id", "part").transformWithState(Named(default, forget), "block binary", "Append", "ProcessingTime")
    out = T.StructType([*facts.select("client_id", *columns).schema.fields, T.StructField("_name", T.StringType())])
    return unpacked(got, out).withColumnRenamed("_name", name)
