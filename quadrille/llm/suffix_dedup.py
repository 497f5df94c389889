"""Removal of every byte that a long repeated string covers, by a run-length index.

A string of `length` bytes that starts in two places has, in both, the same
smallest `GRAM`-gram hash among those inside it (winnowing), so both places
select the same anchor. Anchors that are alone in the corpus are dropped at once.
The context of an anchor is what the strings that select it reach. Occurrences
of equal contexts are repeats as a whole. Where an anchor has several contexts,
they go to a run-length index (see run_index): a run-compressed Burrows-Wheeler
transform with sampled run ends, through which matching statistics are streamed;
suffixes that match `length` bytes are strings that start in several places, if
those places differ.

An anchor with more than `GROUP` contexts (a short passage with very many
surroundings) is split: every string around it reaches half of the missing bytes
further to the left or to the right, so its contexts are dealt by the longer grams
on both sides, equal ones are settled, and what is still too large is split again,
at last by whole strings. So no index grows with the corpus, and nothing is left
out.

What the texts of one part share is settled inside it: of an anchor and of a
context one entry is sent for each part.

Defined results: texts are UTF-8 bytes and a null text has none; a match never
crosses the end of a text; rows are texts of their own even where doc_id repeats
or is null, and rows that repeat a text repeat each other; other columns are
ignored; an empty table gives an empty result. Contexts are equal if two
independent 64-bit hashes are; strings in an index are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.llm.kernel import _BYTES, U64, buffers, mix64, prefix_sums, ragged, slices, span_hash
from quadrille.llm.packed import COARSE, SCHEMA, batch_of, by_bucket, by_part, coarse_of, dealt, entries, groups, measure, rows_of, table_of, tasks_for, with_part
from quadrille.llm.run_index import classes
from quadrille.llm.workspace import Workspace, free_name, with_row_key

LENGTH = 200
GRAM = 150
#: Contexts of one anchor that an index takes; beyond, they are split by longer grams.
GROUP = 1024
#: Bytes of contexts that anchors share an index up to (small texts sort in cache and in few rounds), and that one task's bin is meant to hold.
SHARED_BYTES = 60_000
BIN_BYTES = 1 << 20
#: Anchors that a task gathers before it sends them, and that one bucket is meant to hold.
STRETCH = 400_000
BUCKET_ANCHORS = 1_000_000
_NARROW = np.dtype([("lo", "<u4"), ("hi", "u1")])
_WIDE = np.dtype([("bucket", "<u4"), ("lo", "<u4"), ("hi", "u1")])
_CODE = np.dtype("<u8")
_LOW = U64((1 << 40) - 1)


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int, context: bool = False) -> tuple[np.ndarray, ...]:
    """Row, place in the data and fingerprint of each anchor; with context also where the first string that selects it starts and the last one ends."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if len(data) < length or not (size >= length).any():
        return none, none, none.view(U64), *[none] * (2 * context)
    width = length - gram + 1  # grams of a string
    sums = prefix_sums(data)
    _, down = _BYTES.get(len(sums))
    n = len(data) - gram + 1
    hashes = mix64((sums[gram:] - sums[:n]) * down[:n])
    top = (hashes >> U64(33)).astype(np.uint32) + np.uint32(1)
    least = sliding(top, width, np.minimum)  # of the string that starts there
    starts = len(data) - length + 1
    long = np.flatnonzero(size >= length)
    mark = np.zeros(starts + 1, np.int32)
    mark[off[long]] += 1
    np.add.at(mark, off[long + 1] - length + 1, -1)
    ok = np.cumsum(mark[:-1]) > 0
    best = np.zeros(n + width - 1, np.uint32)
    best[width - 1 : width - 1 + starts] = least = np.where(ok, least[:starts], 0)
    # a gram is an anchor if it is the smallest of any string that holds it
    chosen = np.flatnonzero(sliding(best, width, np.maximum)[:n] == top)
    row = np.searchsorted(off, chosen, "right") - 1
    inside = (size[row] >= length) & (chosen + gram <= off[row + 1])  # else the gram reaches into the next text
    row, chosen = row[inside], chosen[inside]
    if not context:
        return row, chosen, hashes[chosen]
    # the strings that select an anchor are those around it of which it is the smallest gram: part of a run of equal minima
    run = groups(least)
    value, at = least[run], np.searchsorted(run, np.minimum(chosen, starts - 1), "right") - 1
    live = np.flatnonzero(value[at] != top[chosen])
    while len(live):
        at[live] -= 1
        live = live[value[at[live]] != top[chosen[live]]]
    begin = np.maximum(run[at], chosen - (width - 1))
    last = np.minimum(np.append(run[1:], starts)[at] - 1, chosen)
    return row, chosen, hashes[chosen], begin, last + length


def _code(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 40 bits of an anchor; two anchors with one code count as one, which costs work only."""
    return ((h >> U64(24)) % U64(buckets)) << U64(40) | (h & _LOW)


def _select(length: int, gram: int, buckets: int, coarse: int):
    """The anchors of each part by bucket; kind: whether the part has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, codes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            part, code = np.concatenate(parts), np.concatenate(codes)
            parts.clear(), codes.clear()
            by = np.lexsort((part, code))
            part, code = part[by], code[by]
            at = groups(code, part)
            several = np.diff(np.append(at, len(code))) > 1
            part, code = part[at], code[at]
            rec = np.zeros(len(at), _WIDE if buckets > coarse else _NARROW)
            rec["lo"], rec["hi"] = code & U64(0xFFFFFFFF), code >> U64(32) & U64(0xFF)
            bucket = (code >> U64(40)).astype(np.int64)
            if buckets > coarse:
                rec["bucket"] = bucket
            bucket = coarse_of(bucket, buckets, coarse)
            return batch_of([r for kind in (0, 1) for r in rows_of(bucket[several == kind], part[several == kind], rec[several == kind], kind)])

        for batch in slices(batches, "text"):
            row, _, h = anchors(*buffers(batch.column(1)), length, gram)
            parts.append(batch.column(0).to_numpy()[row])
            codes.append(_code(h, buckets))
            held += len(h)
            if held > STRETCH:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def _shared(parts: int, buckets: int, coarse: int):
    """The anchors of a bucket that come twice, by part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = _WIDE if buckets > coarse else _NARROW
        (p0, r0), (p1, r1) = entries(table, 0, kind), entries(table, 1, kind)
        part, rec, several = np.concatenate([p0, p1]), np.concatenate([r0, r1]), np.arange(len(p0) + len(p1)) >= len(p0)
        code = rec["lo"].astype(U64) | rec["hi"].astype(U64) << U64(32)
        by = np.argsort(code, kind="stable")
        at = groups(code[by])
        if not len(at):
            return table_of([])
        size = np.diff(np.append(at, len(by)))
        mine = by[np.repeat((size > 1) | np.logical_or.reduceat(several[by], at), size)]
        return table_of(rows_of(coarse_of(part[mine], parts, coarse), part[mine], U64(key[0].as_py()) << U64(40) | code[mine]))

    return run


_SPANS = "part long, row long, a long, b long"
_CONTEXTS = "part long, key long, c long, c2 long, row long, at long, size int, gram int, several boolean"
_CONTEXT = pa.schema([("part", pa.int64()), *[(x, pa.int64()) for x in ("key", "c", "c2", "row", "at")], ("size", pa.int32()), ("gram", pa.int32()), ("several", pa.bool_())])


def _contexts(length: int, gram: int, buckets: int):
    """Of a part: the contexts of anchors that come twice; of equal ones the first place, and rows of their own (key null) for the spans of all."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        codes = np.sort(entries(answers, 0, _CODE)[1])
        found = []
        for batch in slices(texts.select(["row", "text"]).to_batches(), "text") if len(codes) else ():
            data, off = buffers(batch.column(1))
            row, place, h, begin, end = anchors(data, off, length, gram, context=True)
            mine = _code(h, buckets)
            use = codes[np.minimum(np.searchsorted(codes, mine), len(codes) - 1)] == mine
            row, place, h, begin, end = (x[use] for x in (row, place, h, begin, end))
            c, c2 = (mix64(span_hash(data, begin, end, seed) + (place - begin).astype(U64)) for seed in (0, 1))
            found.append((h.view(np.int64), c.view(np.int64), c2.view(np.int64), batch.column(0).to_numpy()[row], begin - off[row], end - begin, place - begin))
        if not found:
            return _CONTEXT.empty_table()
        h, c, c2, row, at, size, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((at, row, c2, c, h))
        h, c, c2, row, at, size, offset = (x[by] for x in (h, c, c2, row, at, size, offset))
        lead = groups(h, c, c2)
        count = np.diff(np.append(lead, len(h)))
        many = np.flatnonzero(np.repeat(count > 1, count))
        part = key[0].as_py()

        def table_of_rows(use: np.ndarray, several: np.ndarray, known: bool) -> pa.Table:
            columns = [np.full(len(use), part), h[use], c[use], c2[use], row[use], at[use], size[use].astype(np.int32), offset[use].astype(np.int32), several]
            arrays = [pa.array(x) for x in columns]
            if known:
                arrays[1] = pa.nulls(len(use), pa.int64())
            return pa.table(arrays, schema=_CONTEXT)

        return pa.concat_tables([table_of_rows(lead, count > 1, False), table_of_rows(many, np.ones(len(many), bool), True)])

    return run


_ITEMS = "part long, key long, row long, at long, gram int, size int, known boolean, data binary"


def _extract(key: tuple[pa.Scalar, ...], texts: pa.Table, wanted: pa.Table) -> pa.Table:
    """The bytes of the contexts that are wanted from a part."""
    schema = pa.schema([*[(x, pa.int64()) for x in ("part", "key", "row", "at")], ("gram", pa.int32()), ("size", pa.int32()), ("known", pa.bool_()), ("data", pa.binary())])
    row = wanted["row"].to_numpy()
    by = np.argsort(row, kind="stable")
    row = row[by]
    out = []
    for batch in slices(texts.select(["row", "text"]).to_batches(), "text") if len(row) else ():
        data, off = buffers(batch.column(1))
        ids = batch.column(0).to_numpy()
        lo = np.searchsorted(row, ids, "left")
        count = np.searchsorted(row, ids, "right") - lo
        mine, text = by[ragged(lo, count)], np.repeat(np.arange(len(ids)), count)
        if not len(mine):
            continue
        rows = wanted.take(pa.array(mine))
        size = rows["size"].to_numpy().astype(np.int64)
        raw = data[ragged(off[text] + rows["at"].to_numpy(), size)]
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        held = pa.BinaryArray.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        out.append(pa.table([*[rows[n].combine_chunks() for n in schema.names[:-1]], held], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


_PIECES = "part long, key long, c long, c2 long, row long, at long, gram int, size int, known boolean, data binary"


def _longer(glen: int, length: int) -> int:
    return glen + -(-(length - glen) // 2)


def _split(length: int, glen: int):
    """Each context under the two grams that reach half of the missing bytes further."""
    schema = pa.schema([*[(x, pa.int64()) for x in ("part", "key", "c", "c2", "row", "at")], ("gram", pa.int32()), ("size", pa.int32()), ("known", pa.bool_()), ("data", pa.binary())])

    new = _longer(glen, length)
    grow = new - glen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            data, off = buffers(batch.column(batch.schema.get_field_index("data")))
            part, row, at, gram = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("part", "row", "at", "gram"))
            for side in (0, 1):
                first = off[:-1] + gram - (grow if side else 0)
                use = np.flatnonzero((first >= off[:-1]) & (first + new <= off[1:]))
                begin = np.maximum(off[use], first[use] - (length - new))
                end = np.minimum(off[use + 1], first[use] + length)
                whole = end - begin >= length
                use, begin, end = use[whole], begin[whole], end[whole]
                g = first[use]
                key = mix64(span_hash(data, g, g + new, 2) + U64(side))
                c, c2 = (mix64(span_hash(data, begin, end, seed) + (g - begin).astype(U64)) for seed in (0, 1))
                size = end - begin
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                held = pa.BinaryArray.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(ends), pa.py_buffer(data[ragged(begin, size)])])
                columns = [part[use], key.view(np.int64), c.view(np.int64), c2.view(np.int64), row[use], at[use] + begin - off[use], (g - begin).astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns], batch.column(batch.schema.get_field_index("known")).take(pa.array(use)), held], schema=schema)

    return run


def repeated(key: np.ndarray, row: np.ndarray, at: np.ndarray, known: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every string of `length` bytes in contexts that aren't known yet that starts in a second place among those of its key; joined where they overlap."""
    place = np.cumsum(size) - size
    by = np.lexsort((at, row, key))
    key, row, at, known, size, place = (x[by] for x in (key, row, at, known, size, place))
    head = groups(key)
    ends = np.append(head[1:], len(key))
    total = np.append(0, np.cumsum(size))
    rows, firsts, turn = [], [], 0
    while turn < len(head):
        # whole groups up to SHARED_BYTES, or one larger group
        to = max(turn + 1, int(np.searchsorted(total[ends], total[head[turn]] + SHARED_BYTES, "right")))
        mine = slice(head[turn], ends[to - 1])
        text = data[ragged(place[mine], size[mine])]
        begin = total[mine] - total[head[turn]]
        where, number = classes(text, np.repeat(begin + size[mine], size[mine]), length)
        owner = np.searchsorted(begin, where, "right") - 1
        r, pos = row[mine][owner], at[mine][owner] + where - begin[owner]
        order = np.lexsort((pos, r, number))
        number, r, pos, told = number[order], r[order], pos[order], known[mine][owner][order]
        new = groups(number)
        if len(new):
            count = np.diff(np.append(new, len(number)))
            last = np.append(new[1:], len(number)) - 1
            differ = np.repeat((r[new] != r[last]) | (pos[new] != pos[last]), count)
            rows.append(r[differ & ~told])
            firsts.append(pos[differ & ~told])
        turn = to
    row, first = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, firsts))
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    by = np.lexsort((first, row))
    row, first = row[by], first[by]
    lead = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[1:] > first[:-1] + length))[: len(row)])
    last = np.append(lead[1:], len(row)) - 1
    return row[lead], first[lead], first[last] + length


def _search(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
        columns = [table[n].to_numpy() for n in ("key", "row", "at", "known")]
        row, a, b = repeated(*columns, table["size"].to_numpy().astype(np.int64), data, length)
        names, first = np.unique(columns[1], return_index=True)
        part = table["part"].to_numpy()[first[np.searchsorted(names, row)]]
        return pa.table({"part": pa.array(part), "row": pa.array(row), "a": pa.array(a), "b": pa.array(b)})

    return run


def _remove(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), *[(x, pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")], ("kept", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        spans = [answers[n].to_numpy() for n in ("row", "a", "b")]
        by = np.argsort(spans[0], kind="stable")
        held, a, b = (x[by] for x in spans)
        out = []
        for batch in slices(texts.select(["row", "doc_id", "text"]).to_batches(), "text"):
            data, off = buffers(batch.column(2))
            ids, n = batch.column(0).to_numpy(), batch.num_rows
            lo = np.searchsorted(held, ids, "left")
            count = np.searchsorted(held, ids, "right") - lo
            at, row = ragged(lo, count), np.repeat(np.arange(n), count)
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, off[row] + a[at], 1)
            np.subtract.at(mark, off[row] + b[at], 1)
            gone = np.cumsum(mark[:-1]) > 0
            row_of = np.repeat(np.arange(n), np.diff(off))
            first = gone & np.append(True, ~gone[:-1] | (row_of[1:] != row_of[:-1]))[: len(gone)]
            removed, runs = np.bincount(row_of[gone], minlength=n), np.bincount(row_of[first], minlength=n)
            to = np.concatenate([[0], np.cumsum(np.diff(off) - removed)])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
            out.append(pa.table([batch.column(1).cast(id_type), pa.array(np.diff(off)), pa.array(removed), pa.array(runs), kept], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _settled(work: Workspace, rows: DataFrame, told: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Of contexts (key, c, c2, row, at, ...): one of each, known if it is a repeat as a whole, and the spans that follow; told: a column that says whose spans are there."""
    by = ["key", "c", "c2"]
    equal = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(told).alias("any"), F.min(F.struct("row", "at")).alias("first"))
    joined = work.table(rows.join(equal.hint("merge"), by), name)
    spans = joined.where((F.col("n") > 1) & ~F.col(told)).select("part", "row", F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b"))
    one = joined.where((F.col("row") == F.col("first.row")) & (F.col("at") == F.col("first.at"))).withColumn("known", F.col("any") | (F.col("n") > 1))
    return one.drop("n", "any", "first", "c", "c2"), spans


def _cogroup(texts: DataFrame, answers: DataFrame, size: int):
    n = tasks_for(texts, size)
    return texts.repartition(n, "part").groupBy("part").cogroup(answers.repartition(n, "part").groupBy("part"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, bucket_anchors: int = BUCKET_ANCHORS, coarse: int = COARSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    if not 0 < gram < length:
        raise ValueError("an anchor must be shorter than a string")
    work, kind = Workspace(docs.sparkSession, "suffix-dedup"), docs.schema[id_col].dataType
    name = free_name(docs, "row_key")
    rows = with_row_key(docs, work, name).select(F.col(name).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size, count = measure(rows)
    placed = with_part(rows, "row", size, count).select("part", "row", "doc_id", "text")
    texts = placed.select("part", "row", "text")
    parts, buckets = max(1, math.ceil(size / (1 << 20))), max(1, math.ceil(2 * size / (length - gram) / bucket_anchors))
    # anchors that come twice, and their contexts
    chosen = placed.select("part", "text").mapInArrow(_select(length, gram, buckets, coarse), SCHEMA)
    chosen = dealt(chosen, buckets, lambda part, rec: rec["bucket"].astype(np.int64), _WIDE, size, (0, 1), coarse)
    twice = by_bucket(chosen, size).applyInArrow(_shared(parts, buckets, coarse), SCHEMA)
    twice = work.table(dealt(twice, parts, lambda part, code: part, _CODE, size, coarse=coarse), "twice")
    found = work.table(by_part(texts, twice, size, _contexts(length, gram, buckets), _CONTEXTS), "contexts")
    work.drop("twice")
    one, equal = _settled(work, found.where("key is not null"), "several", "settled")
    spans = [found.where("key is null").select("part", "row", F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b")), equal]
    # the bytes of the contexts of anchors that have several
    many = one.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = one.join(many.hint("merge"), "key").select("part", "key", "row", "at", "gram", "size", "known")
    items, glen, turn = work.table(_cogroup(texts, wanted, size).applyInArrow(_extract, _ITEMS), "items-0"), gram, 0
    while True:
        number = items.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counted = items.join(number.hint("merge"), "key")
        ready = counted.where(F.col("n") <= group)
        bins = max(1, math.ceil((ready.agg(F.sum("size")).first()[0] or 0) / BIN_BYTES))
        binned = ready.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).repartition(tasks_for(docs, bins * BIN_BYTES), "bin")
        spans.append(work.table(binned.groupBy("bin").applyInArrow(_search(length), _SPANS), f"spans-{turn}"))
        large = counted.where(F.col("n") > group).drop("n")
        if large.isEmpty():
            break
        pieces = work.table(large.select(*[x.split()[0] for x in _ITEMS.split(", ")]).mapInArrow(_split(length, glen), _PIECES), f"pieces-{turn}")
        turn, glen = turn + 1, _longer(glen, length)
        # neighbouring anchors of one text can lead to one and the same piece
        one, equal = _settled(work, pieces.dropDuplicates(["key", "c", "c2", "row", "at"]), "known", f"settled-{turn}")
        spans.append(equal)
        items = one.select("part", "key", "row", "at", "gram", "size", "known", "data")
    answers = spans[0]
    for more in spans[1:]:
        answers = answers.unionByName(more)
    out = _cogroup(placed, answers, size)
    return out.applyInArrow(_remove(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
