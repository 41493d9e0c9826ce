"""Sparse rows and models over terms, one bounded part of a model at a time.

A record keeps its terms in its own row, as ``array<struct<term, tf>>`` or with a
weight in place of the count. Vocabularies and class weights are written tables.
A small one is shipped to the tasks and looked up inside the rows. A large one
never reaches the driver or a task as a whole: records are packed, each pack asks
for its distinct terms, and the table's rows for them come back to the pack by their
places. No row is made for a record and a term, or for a record, a term and a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalumen.session import cut_lineage

# Terms of a vocabulary, and pairs of a class and a term, that are shipped to the tasks; larger tables are exchanged.
PART_TERMS = 300_000
PART_PAIRS = 300_000
# Bytes of text in a table that is shipped.
PART_BYTES = 16_000_000
# Classes that an exchange brings back at once.
CLASSES = 1_000
# Entries that are looked up together, and values of one intermediate array.
ENTRIES = 150_000
VALUES = 1_000_000
# Entries that are counted together or packed for an exchange, rows of a table in one bucket of it, and packs for each bucket.
PACKED = 800_000
BUCKET_ROWS = 500_000
BUCKET_PACKS = 10
# Terms of a bucket that are merged or answered at once.
MERGED = 2_000_000

BLOCKS = "bucket int, block binary"
COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
WEIGHTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that ``column`` holds up to ``ENTRIES`` entries, or one row: a bounded piece, however long batches and rows are."""
    most = most or ENTRIES
    held: list[pa.RecordBatch] = []
    entries = 0
    for batch in batches:
        # An empty row counts as well, so that rows without entries are bounded too.
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 1
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[start] + most - entries, side="right")) - 1
            if stop <= start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                entries += int(upto[stop] - upto[start])
                start = stop
            if start < batch.num_rows or entries >= most:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, entries = [], 0
                # The pool would keep what the last piece needed, in every worker.
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def entries_of(column: pa.Array, value: str | None) -> tuple[np.ndarray, pa.Array, np.ndarray | None]:
    """Row, term and value of every entry of a batch of sparse rows; a null row has none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return (np.repeat(np.arange(len(column)), lengths), flat.field("term"),
            None if value is None else flat.field(value).to_numpy(zero_copy_only=False).astype(np.float64))


def coded(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each term among the distinct ones, -1 for a null, and these."""
    held = terms if isinstance(terms, pa.DictionaryArray) else terms.cast(pa.string()).dictionary_encode()
    return pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False), held.dictionary


def places(terms: pa.Array, names: pa.Array) -> np.ndarray:
    """The place of each term in ``names``, which are distinct, -1 for others; terms that are coded are looked up once each, or not at all where both have one code."""
    if isinstance(terms, pa.DictionaryArray):
        code, distinct = coded(terms)
        if isinstance(names, pa.DictionaryArray) and names.dictionary.equals(distinct):
            at = np.full(len(distinct) + 1, -1, np.int64)
            at[names.indices.to_numpy()] = np.arange(len(names))
        else:
            at = np.append(places(distinct, names), -1)
        return at[code]
    names = names.dictionary_decode() if isinstance(names, pa.DictionaryArray) else names
    return pc.index_in(terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)


def sparse_column(rows: np.ndarray, terms: pa.Array | None, weights: np.ndarray, n: int) -> pa.Array:
    """Entries in row order as one sparse row each, also without their terms."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    columns = {"term": terms.cast(pa.string()), "weight": pa.array(weights)} if terms is not None else {"weight": pa.array(weights)}
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([*columns.values()], names=[*columns]))


def listed(like: pa.Array, values: pa.Array) -> pa.Array:
    """Other ``values`` in the lists of ``like``; null lists stay null."""
    ends = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=like.is_null())


def spelled(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches as Spark takes them, where ``column`` is still there and coded."""
    for batch in batches:
        kind = batch.column(column).type.value_type if column in batch.schema.names else None
        held = kind is not None and pa.types.is_struct(kind) and "term" in [f.name for f in kind] and pa.types.is_dictionary(kind.field("term").type)
        yield recoded(batch, column, code=False) if held else batch


def _sorted(terms: pa.Array) -> pa.DictionaryArray:
    """Coded terms with the distinct ones in order, which compress well."""
    held = terms.cast(pa.string()).dictionary_encode()
    order = pc.array_sort_indices(held.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return pa.DictionaryArray.from_arrays(pa.array(place).take(held.indices), held.dictionary.take(pa.array(order)))


def recoded(batch: pa.RecordBatch, column: str, code: bool = True) -> pa.RecordBatch:
    """A batch whose terms or tokens are held once each beside their places, or spelled out again."""
    values = batch.column(column).flatten()
    spell = _sorted if code else (lambda a: a.cast(pa.string()))
    if pa.types.is_struct(values.type):
        names = [f.name for f in values.type]
        values = pa.StructArray.from_arrays([spell(values.field(n)) if n == "term" else values.field(n) for n in names], names=names)
    else:
        values = spell(values)
    return replaced(batch, {column: listed(batch.column(column), values)}).select(batch.schema.names)


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in new and n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], [*names, *new])


def _blob(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _buckets(terms: pa.Array, n: int) -> np.ndarray:
    """An even bucket for each term, by its length and four windows of eight bytes, which cover up to 32 bytes."""
    if isinstance(terms, pa.DictionaryArray):
        return _buckets(terms.dictionary, n)[terms.indices.to_numpy()]
    terms = terms.cast(pa.large_binary())
    if not len(terms):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    start, size = ends[:-1] - ends[0], np.diff(ends)
    beyond = np.maximum(size - 8, 0)
    # A window of a shorter term is cut to its bytes; only longer terms have windows in between.
    short = np.uint64(8) * (np.uint64(8) - np.clip(size, 1, 8).astype(np.uint64))
    value = (size.astype(np.uint64) + (eight[start] << short) * (size > 0)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    for least, third in ((9, 3), (17, 1), (17, 2)):
        some = np.flatnonzero(size >= least)
        mixed = (value[some] ^ eight[(start + beyond * third // 3)[some]]) * np.uint64(0x9E3779B97F4A7C15)
        value[some] = mixed ^ (mixed >> np.uint64(32))
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return ((value >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _dealt(terms: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of terms by their bucket, in their order."""
    bucket = _buckets(terms, n)
    # Small whole numbers are sorted by radix.
    order = np.argsort(bucket.astype(np.uint16) if n <= 65_536 else bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(bucket)]):
        yield int(bucket[start]), order[start:stop]


def _blocks(rows: pa.Table, n: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a table with terms as a blob for each bucket; terms in order compress well."""
    rows = rows.combine_chunks()
    dealt = [*_dealt(rows.column("term").combine_chunks() if rows.num_rows else pa.array([], pa.string()), n)]
    if dealt:
        rows = rows.take(pa.array(np.concatenate([at for _, at in dealt]))).combine_chunks()
    start = 0
    for bucket, at in dealt:
        yield bucket, _blob(_own_codes(rows.slice(start, len(at))))
        start += len(at)


def _own_codes(block: pa.Table) -> pa.Table:
    """A block whose coded columns hold its own texts alone."""
    for nth, field in enumerate(block.schema):
        if pa.types.is_dictionary(field.type):
            held = block.column(nth).combine_chunks()
            own, code = np.unique(held.indices.to_numpy(), return_inverse=True)
            block = block.set_column(nth, field.name, pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), held.dictionary.take(pa.array(own))))
    return block


def _runs(blobs: Iterable[pa.Scalar]) -> Iterator[list[pa.Table]]:
    """Blobs as tables, some at a time: up to ``MERGED`` rows, or one blob."""
    held, n = [], 0
    for blob in blobs:
        held.append(_table(blob.as_py()))
        n += held[-1].num_rows
        if n >= MERGED:
            yield held
            held, n = [], 0
    if held:
        yield held


class Packs:
    """Rows in written packs of up to ``most`` entries: ``(pack, records)``, where each term or token is held once a pack.

    ``made`` makes the sparse rows of a pack's records in the worker that needs them.
    """

    def __init__(self, rows: DataFrame, column: str = "terms", most: int | None = None, made: Callable | None = None):
        self.schema, self.made = rows.schema, made or (lambda batch: batch)
        self.frame = cut_lineage(_packed(rows, column, most or PACKED), "packs")
        self.held = self.frame.count()

    def where(self, column: str, value: str) -> Packs:
        """The records with ``value`` in ``column``, chosen when a pack is opened."""
        own, made = Packs.__new__(Packs), self.made
        own.schema, own.frame, own.held = self.schema, self.frame, self.held
        own.made = lambda batch: made(batch.filter(pc.fill_null(pc.equal(batch.column(column), value), False)))
        return own


def _packed(rows: DataFrame, column: str, most: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for nth, batch in enumerate(gathered(batches, column, most)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{nth}"]), pa.array([_blob(recoded(batch, column))], pa.binary())], ["pack", "records"])

    return rows.mapInArrow(pack, "pack string, records binary")


def _opened(records: pa.Scalar, made: Callable) -> pa.RecordBatch:
    return made(_table(records.as_py()).to_batches()[0])


def opened(batches: Iterator[pa.RecordBatch], made: Callable) -> Iterator[pa.RecordBatch]:
    """The sparse rows of each pack."""
    return (_opened(records, made) for batch in batches for records in batch.column("records"))


def buckets(rows: DataFrame | Packs) -> int:
    """Buckets: their number follows the packs, so that a bucket stays small, and not the settings, since each pack writes a block for each."""
    frame = rows.frame if isinstance(rows, Packs) else rows
    least = max(64, 2 * frame.sparkSession.sparkContext.defaultParallelism)
    if isinstance(rows, Packs):
        return max(least, -(-rows.held // BUCKET_PACKS))
    return max(least, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt_rows(rows: pa.Table | pa.RecordBatch, n: int) -> pa.RecordBatch:
    """``(bucket, block)`` of rows with terms."""
    dealt = [*_blocks(pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows, n)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([b for _, b in dealt], pa.binary())], ["bucket", "block"])


def dealt(table: DataFrame, n: int) -> DataFrame:
    """A table with terms as ``BLOCKS``; where it names classes as well, both come many times and are coded."""
    texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = texts if len(texts) > 1 else []
            columns = {c: batch.column(c).cast(pa.string()).dictionary_encode() if c in code else batch.column(c) for c in batch.schema.names}
            yield dealt_rows(pa.table(columns), n)

    return table.mapInArrow(deal, BLOCKS)


def summed(blocks: DataFrame, keys: list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of ``BLOCKS`` with the same keys, one of which is the term, as one row with the sums of all other columns."""

    def add(group: pa.Table) -> pa.Table:
        whole: list[pa.Table] = []
        for some in _runs(x for chunk in group.column("block").chunks for x in chunk):
            rows = pa.concat_tables([*whole, *some], promote_options="default").unify_dictionaries()
            values = [c for c in rows.column_names if c not in keys]
            names, rows = rows.column_names, rows.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in values])
            whole = [rows.rename_columns([c.removesuffix("_sum") if c not in keys else c for c in rows.column_names]).select(names)]
        return pa.table({c: v.cast(pa.string()) if pa.types.is_dictionary(v.type) else v for c, v in zip(whole[0].column_names, whole[0].columns)})

    return blocks.groupBy("bucket").applyInArrow(add, schema)


def term_totals(rows: DataFrame | Packs, by: str | None = None) -> DataFrame:
    """``(term, df, total_tf)`` over sparse rows: blocks of distinct terms are counted where they lie, and merged by bucket.

    ``by`` names a column of the records: then a row for each of its values, ``(term, by, df, total_tf)``.
    """
    n = buckets(rows)
    made = rows.made if isinstance(rows, Packs) else None

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, "terms", PACKED) if made is None else opened(batches, made)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sparse(batches):
            row, term, tf = entries_of(batch.column("terms"), "tf")
            at, names = coded(term)
            kind = batch.column(by).dictionary_encode("encode") if by else None
            kinds = len(kind.dictionary) if by else 1
            # Only what occurs: records that were left out have left their terms behind.
            pair, at = np.unique(at * max(1, kinds) + (kind.indices.to_numpy()[row] if by else 0), return_inverse=True)
            columns = {"term": names.take(pa.array(pair // max(1, kinds)))} | ({by: kind.dictionary.take(pa.array(pair % max(1, kinds)))} if by else {})
            block = pa.table(columns | {"df": np.bincount(at, minlength=len(pair)), "total_tf": np.bincount(at, weights=tf, minlength=len(pair)).astype(np.int64)})
            del pair, at, row, term, tf
            yield dealt_rows(block, n)

    frame = rows.select("terms", *([by] if by else [])) if made is None else rows.frame
    keys = ["term", by] if by else ["term"]
    return summed(frame.mapInArrow(count, BLOCKS), keys, f"term string, {f'{by} {rows.schema[by].dataType.simpleString()}, ' if by else ''}df long, total_tf long")


def answered(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """A bucket's rows for the terms that each pack asks for, by their places among these."""
    buckets, packs, found = [], [], []
    if blocks.num_rows and asked.num_rows:
        own = pa.concat_tables([_table(b.as_py()) for b in blocks.column("block")]).combine_chunks()
        code, names = coded(own.column("term").combine_chunks())
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(names) + 1))
        own = {c: own.column(c).take(pa.array(order)).combine_chunks() for c in own.column_names if c != "term"}
        # Names of classes come again for each term.
        own = {c: v.dictionary_encode() if pa.types.is_string(v.type) else v for c, v in own.items()}
        bucket, pack, upto = asked.column("bucket")[0].as_py(), asked.column("pack").to_pylist(), 0
        for some in _runs(asked.column("asked")):
            # One look-up for the terms of many packs: each builds a table of the whole bucket.
            all_at = places(pa.concat_tables(some).column("term").combine_chunks(), names)
            ends = np.cumsum([0, *(t.num_rows for t in some)])
            for nth in range(len(some)):
                at = all_at[ends[nth]:ends[nth + 1]]
                known = np.flatnonzero(at >= 0)
                at = at[known]
                many = starts[at + 1] - starts[at]
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[at], many)
                if len(place):
                    buckets.append(bucket)
                    packs.append(pack[upto + nth])
                    at = pa.array(np.repeat(known, many).astype(np.int32))
                    found.append(_blob(pa.table({**{c: v.take(pa.array(place)) for c, v in own.items()}, "__at": at}).combine_chunks()))
            upto += len(some)
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "pack": pa.array(packs, pa.string()), "found": pa.array(found, pa.binary())})


def looked_up(rows: DataFrame | Packs, table: DataFrame, make: Callable[[pa.Table], Callable], schema: T.StructType | str, column: str = "terms",
              most: int | None = None) -> DataFrame:
    """``rows`` through ``make(part)``, a function on batches, where ``part`` holds the rows of ``table`` for all terms of these batches.

    Up to ``most`` rows of the table with ``PART_BYTES`` of text are shipped. Beyond that, packs of records and
    buckets of terms are exchanged: neither the driver nor a task holds more than
    a pack with its part, or a bucket. ``table`` is written and may hold a term several times.
    """
    made = rows.made if isinstance(rows, Packs) else lambda batch: batch
    length = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if isinstance(f.dataType, T.StringType)), F.lit(0).cast("long"))
    held, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    if held <= (most or PART_TERMS) and size <= PART_BYTES:
        run = make(table.toArrow())
        if not isinstance(rows, Packs):
            return rows.mapInArrow(run, schema)
        return rows.frame.mapInArrow(lambda batches: spelled(run(opened(batches, made)), column), schema)
    n = max(buckets(rows), -(-held // BUCKET_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, records in zip(batch.column("pack").to_pylist(), batch.column("records")):
                _, names = coded(entries_of(_opened(records, made).column(column), None)[1])
                blocks = dealt_rows(pa.table({"term": names}), n)
                yield pa.RecordBatch.from_arrays(
                    [blocks.column("bucket"), pa.array([name] * blocks.num_rows, pa.string()), blocks.column("block")], ["bucket", "pack", "asked"])

    bare = table.limit(0).toArrow().append_column("__at", pa.array([], pa.int32())).drop_columns("term")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for records, found in zip(batch.column("records"), batch.column("found")):
                own = _opened(records, made)
                _, names = coded(entries_of(own.column(column), None)[1])
                # The part's terms have the code of the pack's.
                at, place, parts = dict(_dealt(names, n)) if found.is_valid else {}, [np.zeros(0, np.int64)], [bare]
                for one in found.values or ():
                    part = _table(one["found"].as_py())
                    place.append(at[one["bucket"].as_py()][part.column("__at").to_numpy()])
                    parts.append(part.select(bare.column_names).cast(bare.schema))
                terms = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(place).astype(np.int32)), names)
                part = pa.concat_tables(parts).combine_chunks().append_column("term", terms).drop_columns("__at")
                yield from spelled(make(part)(iter([own])), column)

    # Both uses of the packs read one exchange, or the written packs.
    packs = rows.frame if isinstance(rows, Packs) else _packed(rows, column, PACKED).repartition("pack")
    asked = packs.mapInArrow(ask, "bucket int, pack string, asked binary")
    answers = dealt(table, n).groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answered, "bucket int, pack string, found binary")
    found = answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
    # A broadcast of the answers would go through the driver.
    return packs.join(found.hint("merge"), "pack", "left").select("records", "found").mapInArrow(apply, schema)


def weigh(rows: DataFrame | Packs, terms: DataFrame, weight: str, sublinear: bool = False, unit: bool = True, value: str = "tf",
          per_part: int | None = None, names: bool = True) -> DataFrame:
    """``rows`` with ``terms`` as ``array<struct<term, weight>>``: known terms only, ``tf`` times the term's ``weight``.

    ``sublinear`` takes 1 + ln(tf) in place of tf; ``unit`` brings each row to
    length one. ``terms`` is written and holds a term once; more than ``per_part`` are
    exchanged, see ``looked_up``. Entries keep their order. Without ``names`` the structs have
    the weights alone, for callers that read no term: nine tenths of what a worker sends are terms.
    """
    kept = [f for f in rows.schema if f.name != "terms"]
    schema = T.StructType([*kept, T.StructField("terms", WEIGHTED if names else T.ArrayType(T.StructType([WEIGHTED.elementType["weight"]])))])
    return looked_up(rows, terms.select("term", weight), lambda part: _weighing(part, weight, value, sublinear, unit, names), schema, "terms", per_part)


def _weighing(part: pa.Table, weight: str, value: str, sublinear: bool, unit: bool, spelled: bool = True):
    names = part.column("term").combine_chunks()
    weights = part.column(weight).to_numpy().astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "terms", PACKED):
            row, term, counted = entries_of(batch.column("terms"), value)
            at = places(term, names)
            known = np.flatnonzero(at >= 0)
            found = (1 + np.log(counted[known]) if sublinear else counted[known]) * weights[at[known]]
            row, term = row[known], term.take(pa.array(known)) if spelled else None
            if unit:
                length = np.sqrt(np.bincount(row, weights=found * found, minlength=batch.num_rows))
                found = found / np.maximum(length[row], np.finfo(float).tiny)
            yield replaced(batch, {"terms": sparse_column(row, term, found, batch.num_rows)})

    return run


class PairParts:
    """Weights ``(class, term, weight)`` in passes of whole classes, in class order, up to ``CLASSES`` each; one pass if they are few.

    ``classes`` has one row for each class, also for those without a pair; both are written.
    """

    def __init__(self, classes: DataFrame, pairs: DataFrame, per_part: int | None = None):
        self.classes, self.pairs, self.most = classes, pairs.select("class", "term", "weight"), per_part or PART_PAIRS
        names = classes.select("class").orderBy("class")
        self.ranges: list[tuple] = []
        each = min(CLASSES, max(1, self.most // 10))
        # Streams class by class; only the ends of the ranges stay.
        for nth, r in enumerate(names.toLocalIterator()):
            self.ranges[nth // each:] = [(self.ranges[-1][0] if nth % each else r["class"], r["class"])]
        if not self.ranges:
            raise ValueError("no class has a training record")
        self.kind = classes.schema["class"].dataType

    def __len__(self) -> int:
        return len(self.ranges)

    def __iter__(self) -> Iterator[tuple[pa.Table, DataFrame]]:
        """The classes of each pass and their pairs."""
        for low, high in self.ranges:
            own = F.col("class").between(F.lit(low), F.lit(high))
            whole = len(self.ranges) == 1
            yield (self.classes if whole else self.classes.filter(own)).toArrow().sort_by("class"), self.pairs if whole else self.pairs.filter(own)

    def through(self, rows: DataFrame | Packs, own: tuple[pa.Table, DataFrame], make: Callable[[Part], Callable], schema: T.StructType | str) -> DataFrame:
        """``rows`` through ``make(part)`` for the classes of one pass."""
        classes, pairs = own
        return looked_up(rows, pairs, lambda found: make(Part(classes, found)), schema, "terms", self.most)


class Part:
    """One part: its classes in order and, for each term, the classes it has a weight for."""

    def __init__(self, classes: pa.Table, pairs: pa.Table):
        self.names = classes.column("class").combine_chunks()
        self.constants = {c: classes.column(c).to_numpy() for c in classes.column_names if c != "class"}
        term, self.terms = coded(pairs.column("term").combine_chunks())
        order = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.of = pc.index_in(pairs.column("class").combine_chunks(), value_set=self.names).to_numpy()[order]
        self.weights = pairs.column("weight").to_numpy().astype(np.float64)[order]

    def chunks(self, row: np.ndarray, term: pa.Array, n: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Runs of rows, their entries and the places of their terms (-1: unknown), small enough for dense products."""
        own = isinstance(term, pa.DictionaryArray) and term.dictionary.equals(self.terms)
        at = coded(term)[0] if own else places(term, self.terms)
        many = np.where(at >= 0, self.starts[np.maximum(at, 0) + 1] - self.starts[np.maximum(at, 0)], 0) if len(self.terms) else np.zeros(len(at), np.int64)
        upto = np.searchsorted(row, np.arange(n + 1))
        cost = np.concatenate([[0], np.cumsum(many)])[upto] + np.arange(n + 1) * len(self.names)
        start = 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(cost, cost[start] + VALUES, side="right")) - 1)
            yield slice(start, stop), slice(int(upto[start]), int(upto[stop])), at[upto[start]:upto[stop]]
            start = stop

    def products(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Sums of value times weight, a row for each record and a column for each class."""
        known = np.flatnonzero(at >= 0)
        row, at, value = row[known], at[known], value[known]
        many = self.starts[at + 1] - self.starts[at]
        each = np.repeat(np.arange(len(at)), many)
        place = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.starts[at][each]
        flat = row[each] * len(self.names) + self.of[place]
        return np.bincount(flat, weights=value[each] * self.weights[place], minlength=n * len(self.names)).reshape(n, len(self.names))


def class_scores(batch: pa.RecordBatch, part: Part, value: str, constant: Callable[[slice], np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of rows of a batch with their scores for the classes of a part."""
    row, term, values = entries_of(batch.column("terms"), value)
    for rows, entries, at in part.chunks(row, term, batch.num_rows):
        n = rows.stop - rows.start
        yield rows, constant(rows) + part.products(row[entries] - rows.start, at, values[entries], n)
