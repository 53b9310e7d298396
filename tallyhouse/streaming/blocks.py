"""Rows in blocks: many rows of one key as the bytes of an Arrow table, so that rows which only travel or wait are never
handled one by one in Python. Types stay as they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, types as T

#: Rows, and bytes, of which blocks are made at a time; of more keys, blocks are smaller.
AT_ONCE, BYTES_AT_ONCE = 50_000, 16 << 20
#: Bytes of a block, about; a larger row is a block of its own.
SIZE = 64 << 10


def blocks_of(table) -> Iterator[bytes]:
    """A table's rows, in order."""
    import pyarrow as pa

    rows = max(1, -(-table.num_rows * SIZE // max(table.nbytes, SIZE)))
    for k in range(0, table.num_rows, rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.slice(k, rows).combine_chunks())
        yield sink.getvalue().to_pybytes()


def table_of(block: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(block)).read_all()


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and block: the columns of df for some of a key's rows. Works without a shuffle, on streams too."""

    def pack(batches):
        import pyarrow as pa

        def out(waiting):
            table = pa.Table.from_batches(waiting)
            places = table.select(keys).append_column("_n", pa.array(range(table.num_rows), pa.int64())).group_by(keys).aggregate([("_n", "list")])
            table, at = table.take(places.column("_n_list").combine_chunks().flatten()), 0
            for k, n in enumerate(len(p) for p in places.column("_n_list")):
                blocks = list(blocks_of(table.slice(at, n)))
                same = [pa.repeat(places.column(c)[k], len(blocks)) for c in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(blocks, pa.binary())], [*keys, "block"])
                at += n

        waiting, rows, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                waiting, rows, size = [*waiting, b], rows + b.num_rows, size + b.nbytes
            if rows >= AT_ONCE or size >= BYTES_AT_ONCE:
                yield from out(waiting)
                waiting, rows, size = [], 0, 0
        if waiting:
            yield from out(waiting)

    return df.mapInArrow(pack, T.StructType([*df.select(*keys).schema.fields, T.StructField("block", T.BinaryType())]))


def unpacked(df: DataFrame, schema: T.StructType, column: str = "block") -> DataFrame:
    """The columns of schema of all rows of the blocks."""
    names = schema.fieldNames()

    def unpack(batches):
        for b in batches:
            for block in b.column(0):
                yield from table_of(block.as_py()).select(names).to_batches()

    return df.select(column).mapInArrow(unpack, schema)
