"""Jaccard self-join of word shingle sets with token-combination prefixes.

Rows with equal sets form one node. Shingles are ordered by the number of sets
that hold them (exact up to what one stretch counts, and the same for all): those
of one set alone come first, then the rare, then the frequent. A set of n
shingles that has a partner of similarity t shares with it all but n - ceil(t n)
of them, so it is enough to index a prefix of the order: a rare shingle counts as
one, and of the frequent shingles of one class (a hash class whose number depends
on the set's size) all but the first count. Rare prefix shingles that another set
has are indexed alone, frequent ones in pairs within their class; two similar sets
then share at least one rare shingle or one pair, and a shingle of a passage that
very many documents hold never makes a list of its own.

Nodes that lists connect are compared in chunks. Where that is one chunk, all its
pairs are verified at once. Where it is more, nodes of one list are put together
as far as chunks reach, and what turns out to be linked is represented by one
leader; leaders that still share a list are compared in the same way for some
rounds, so a large group of near copies takes a number of comparisons
in proportion to its members. Lists that then still have members of several
components are compared chunk by chunk. A comparison counts the common shingles
of all its pairs with matrix products, returns a spanning forest of the links and
checks each of those again with second hashes of the shingles.

Sets are held as 64-bit hashes of shingles; equal sets are recognised by two sums
over independent hashes.

Defined results: a null or wordless text has no shingles and is linked with
nothing; rows are told apart even where doc_id repeats or is null, and a component
is named by the smallest doc_id that is not null; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.components import components
from quadrille.llm.kernel import LOWER, NOT_SPACE, U64, buffers, mix64, ragged, rolling, slices, span_hash, spans
from quadrille.llm.packed import COARSE, SCHEMA, batch_of, by_bucket, by_part, coarse_of, dealt, entries, groups, measure, rows_of, table_of, tasks_for, with_part
from quadrille.llm.workspace import Workspace, free_name, with_row_key

SHINGLE = 5
PERCENT = 75
#: Nodes of one chunk; a comparison holds two.
CHUNK = 256
#: Shingles that one bucket is meant to hold.
BUCKET_ENTRIES = 1_000_000
#: A shingle is frequent if so many sets hold it.
FREQUENT = 64
#: Rounds of comparisons of leaders; what they leave open is compared chunk by chunk.
ROUNDS = 4
#: Shingles of one matrix product.
COLUMNS = 8192
#: Shingles that a task gathers before it sends them.
STRETCH = 1_000_000
_LOW = U64((1 << 40) - 1)
_CODE = np.dtype([("lo", "<u4"), ("hi", "u1"), ("n", "u1")])
_LEVEL = np.dtype([("code", "<u8"), ("level", "u1")])
_ANSWER, _COPY = 0, 1


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = SHINGLE, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Row and hash of every distinct shingle, sorted by row and hash, and further hashes for more seeds."""
    low = LOWER[data]
    starts, ends, rows = spans(low, off, NOT_SPACE)
    n = len(off) - 1
    count = np.bincount(rows, minlength=n)
    r, hashes = [], [[] for _ in seeds]
    for i, seed in enumerate(seeds):
        words = span_hash(low, starts, ends, seed)
        for k in range(1, width + 1):  # all words of a shorter text are one shingle
            short = np.flatnonzero(count == k) if k < width else None
            if k < width and not len(short):
                continue
            found, whole = rolling(words, rows, k)
            at = np.flatnonzero(whole) if k == width else np.searchsorted(rows, short)
            hashes[i].append(found[at])
            if not i:
                r.append(rows[at])
    r, hashes = np.concatenate(r), [np.concatenate(x) for x in hashes]
    order = np.lexsort((hashes[0], r))
    r, hashes = r[order], [x[order] for x in hashes]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (hashes[0][1:] != hashes[0][:-1])
    return r[new], *[x[new] for x in hashes]


def set_sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each set."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(mix64(h + U64(1)), out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def node_of(k1: np.ndarray, k2: np.ndarray, salt: int) -> np.ndarray:
    return mix64(k1 ^ mix64(k2 + U64(salt))).view(np.int64)


def code_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 40 bits of a shingle; two shingles with one code count as one, which costs work only."""
    return ((h >> U64(40)) % U64(buckets)) << U64(40) | (h & _LOW)


def _describe(width: int, buckets: int, coarse: int, salt: int, id_type: pa.DataType):
    """Of each row its set (kind 1), and of each stretch the codes of the distinct sets of a part, by bucket (kind 0)."""
    fields = [("bucket", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("doc_id", id_type), *[(x, pa.int64()) for x in ("row", "part", "n", "k1", "k2", "node")]]
    schema = pa.schema(fields)

    def whole(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nodes, owners, codes, held, seen = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            part, node, owner, code = (np.concatenate(x) for x in (parts, nodes, owners, codes))
            for x in (parts, nodes, owners, codes):
                x.clear()
            # of equal sets of a part one speaks
            by = np.lexsort((node, part))
            lead = np.zeros(len(part), bool)
            lead[by[groups(part[by], node[by])]] = True
            if not lead.all():
                keep = lead[owner]
                owner, code = owner[keep], code[keep]
            names, which = np.unique(part, return_inverse=True)
            out = []
            for p, name in enumerate(names):
                mine = np.sort(code[which[owner] == p] if len(names) > 1 else code)
                at = groups(mine)
                rec = np.zeros(len(at), _CODE)
                one = mine[at]
                rec["lo"], rec["hi"] = one & U64(0xFFFFFFFF), (one >> U64(32)) & U64(0xFF)
                rec["n"] = np.minimum(np.diff(np.append(at, len(mine))), 255)
                bucket = coarse_of((one >> U64(40)).astype(np.int64), buckets, coarse)
                if buckets > coarse:  # the bucket itself is not in the record
                    wide = np.zeros(len(at), _WIDE)
                    wide["bucket"], wide["code"] = one >> U64(40), rec
                    rec = wide
                out += rows_of(bucket, np.full(len(at), name), rec)
            return whole(len(out), dict(zip(("bucket", "kind", "docs", "counts", "keys"), batch_of(out).columns, strict=True)))

        for batch in slices(batches, "text"):
            r, h, g = shingle_sets(*buffers(batch.column(3)), width, (0, 1))
            n = batch.num_rows
            bounds = np.searchsorted(r, np.arange(n + 1))
            k1, k2 = set_sums(h, bounds), set_sums(g, bounds)
            node = node_of(k1, k2, salt)
            yield whole(n, {"kind": pa.array(np.ones(n, np.int32)), "doc_id": batch.column(0), "row": batch.column(1), "part": batch.column(2), "n": pa.array(np.diff(bounds)), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "node": pa.array(node)})
            parts.append(batch.column(2).to_numpy())
            nodes.append(node)
            owners.append(r + seen)
            codes.append(code_of(h, buckets))
            seen += n
            held += len(r)
            if held > STRETCH:
                yield flush()
                held = seen = 0
        if parts:
            yield flush()

    return run


_WIDE = np.dtype([("bucket", "<u4"), ("code", _CODE)])


def _levels(buckets: int, parts: int, coarse: int):
    """Of a bucket the codes that several sets have, with the level of their number, by part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        wide = buckets > coarse
        part, rec = entries(table, 0, _WIDE if wide else _CODE)
        rec = rec["code"] if wide else rec
        code = rec["lo"].astype(U64) | rec["hi"].astype(U64) << U64(32)
        by = np.argsort(code, kind="stable")
        at = groups(code[by])
        if not len(at):
            return table_of([])
        total = np.add.reduceat(rec["n"][by].astype(np.int64), at)
        total = np.repeat(total, np.diff(np.append(at, len(by))))
        keep = total > 1
        mine = by[keep]
        out = np.zeros(len(mine), _LEVEL)
        out["code"] = U64(key[0].as_py()) << U64(40) | code[mine]
        out["level"] = 1 + np.floor(np.log2(total[keep])).astype(np.uint8)
        return table_of(rows_of(coarse_of(part[mine], parts, coarse), part[mine], out, _ANSWER))

    return run


def _copies(parts: int, coarse: int):
    """The rows (part, row) whose set another row stands for, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            rec = np.zeros(batch.num_rows, _LEVEL)
            rec["code"] = batch.column(1).to_numpy().view(U64)
            yield batch_of(rows_of(coarse_of(part, parts, coarse), part, rec, _COPY))

    return run


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def signatures(r: np.ndarray, h: np.ndarray, level: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of each index entry of the sets (r, h); level: 0 for a shingle of one set, else 1 + log2 of their number."""
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    by = np.lexsort((h, level, r))
    r, h, level = r[by], h[by], level[by]
    begin = np.searchsorted(r, np.arange(int(r[-1]) + 2))
    n = np.diff(begin)
    least = -(-percent * n // 100)  # the smallest size of a partner, and of the overlap with one
    need = n - least + 1
    place = np.arange(len(r)) - begin[r]
    rare = level <= math.log2(frequent)
    alone = rare & (level > 0) & (place < need[r])
    rows, sigs = [r[alone]], [mix64(h[alone] ^ U64(0xA5A5A5A5A5A5A5A5))]
    rares = np.bincount(r, weights=rare, minlength=len(n)).astype(np.int64)
    own, other = _size_class(n), _size_class(least)
    for classes, wanted in ((own, np.ones(len(n), bool)), (other, own != other)):
        use = ~rare & (wanted & (rares < need))[r]
        if not use.any():
            continue
        fr, fh = r[use], h[use]
        cls = (mix64(fh) % np.left_shift(1, np.maximum(classes - 2, 0))[fr].astype(U64)).astype(np.int64)
        # a token counts towards the prefix unless it is the first of its class
        grouped = np.lexsort((np.arange(len(fr)), cls, fr))
        gain = np.ones(len(fr), np.int64)
        gain[grouped[groups(fr[grouped], cls[grouped])]] = 0
        total = np.cumsum(gain)
        at = np.searchsorted(fr, np.arange(len(n)))
        base = np.concatenate([[0], total])[at]
        so_far = total - base[fr] + rares[fr]
        inside = so_far - gain < need[fr]  # up to the token that completes the prefix
        fr, fh, cls = fr[inside], fh[inside], cls[inside]
        grouped = np.lexsort((np.arange(len(fr)), cls, fr))
        fr, fh, cls = fr[grouped], fh[grouped], cls[grouped]
        lead = groups(fr, cls)
        end = np.repeat(np.append(lead[1:], len(fr)), np.diff(np.append(lead, len(fr))))
        later = end - np.arange(len(fr)) - 1
        a = np.repeat(np.arange(len(fr)), later)
        b = ragged(np.arange(len(fr)) + 1, later)
        rows.append(fr[a])
        sigs.append(mix64(mix64(fh[a]) * U64(3) + mix64(fh[b] + U64(7)) + classes[fr[a]].astype(U64)))
    row, sig = np.concatenate(rows), np.concatenate(sigs)
    by = np.lexsort((sig, row))
    row, sig = row[by], sig[by]
    one = groups(row, sig)
    return row[one], sig[one]


def _index(width: int, percent: int, frequent: int, buckets: int, salt: int):
    """Index entries (sig, node) of the sets of a part, and the texts (node, text) of those that have any."""
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("text", pa.string())])

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, told = entries(answers, _ANSWER, _LEVEL)
        _, copies = entries(answers, _COPY, _LEVEL)
        by = np.argsort(told["code"])
        code, level = told["code"][by], told["level"][by]
        copies = np.sort(copies["code"].view(np.int64))
        out = []
        for batch in slices(texts.select(["row", "text"]).to_batches(), "text") if len(code) else ():
            ids = batch.column(0).to_numpy()
            if len(copies):
                batch = batch.filter(pa.array(copies[np.minimum(np.searchsorted(copies, ids), len(copies) - 1)] != ids))
            r, h, g = shingle_sets(*buffers(batch.column(1)), width, (0, 1))
            mine = code_of(h, buckets)
            at = np.minimum(np.searchsorted(code, mine), len(code) - 1)
            row, sig = signatures(r, h, np.where(code[at] == mine, level[at], 0), percent, frequent)
            bounds = np.searchsorted(r, np.arange(batch.num_rows + 1))
            node = node_of(set_sums(h, bounds), set_sums(g, bounds), salt)
            has = np.unique(row)
            out.append(pa.table([pa.array(sig.view(np.int64)), pa.array(node[row]), pa.nulls(len(row), pa.string())], schema=schema))
            out.append(pa.table([pa.nulls(len(has), pa.int64()), pa.array(node[has]), batch.column(1).take(pa.array(has))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


_Set = tuple[int, np.ndarray, np.ndarray]


def links_between(left: list[_Set], right: list[_Set] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """What links among `left`, or between left and right, connect: each node with the smallest of its component; a set: node, sorted hashes, second hashes."""
    docs = left + (right or [])
    size = np.array([len(s) for _, s, _ in docs], np.int64)
    token = np.concatenate([s for _, s, _ in docs])
    owner = np.repeat(np.arange(len(docs)), size)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    at = groups(token)
    times = np.diff(np.append(at, len(token)))
    col = np.repeat(np.cumsum(times > 1) - 1, times)
    shared = np.repeat(times > 1, times)
    col, owner = col[shared], owner[shared]
    n_left = len(left) if right is not None else len(docs)
    common = np.zeros((n_left, len(docs)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, (at, at + COLUMNS))
        block = np.zeros((len(docs), min(COLUMNS, int(col[-1]) + 1 - at)), np.float32)
        block[owner[lo:hi], col[lo:hi] - at] = 1
        common += block[:n_left] @ block.T
    union = size[:n_left, None] + size[None, :] - common
    hit = (100 * common >= percent * union) & (common > 0)
    if right is not None:
        hit[:, :n_left] = False
    a, b = np.nonzero(hit)
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def alike(x: int, y: int) -> bool:
        """The comparison by both hashes."""
        _, i, j = np.intersect1d(docs[x][1], docs[y][1], assume_unique=True, return_indices=True)
        both = int((docs[x][2][i] == docs[y][2][j]).sum())
        return 100 * both >= percent * (int(size[x]) + int(size[y]) - both)

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q and alike(x, y):
            parent[p] = q
    least: dict[int, int] = {}
    for i, (node, _, _) in enumerate(docs):
        root = find(i)
        least[root] = min(node, least.get(root, node))
    return [(node, least[find(i)]) for i, (node, _, _) in enumerate(docs) if node != least[find(i)]]


def _verify(width: int, percent: int):
    """Compares the sides of each comparison (c1, c2, right, node, text); rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, found = None, ([], []), []

        def close() -> None:
            if now is not None:
                found.extend(links_between(sides[0], None if now[0] == now[1] else sides[1], percent))
            sides[0].clear(), sides[1].clear()

        def batch_of_links() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["node", "least"])
            found.clear()
            return out

        for batch in slices(batches, "text"):
            r, h, g = shingle_sets(*buffers(batch.column(4)), width, (0, 1))
            cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
            for i, (c1, c2, right, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if now != (c1, c2):
                    close()
                    now = (c1, c2)
                sides[right].append((node, h[cut[i] : cut[i + 1]].copy(), g[cut[i] : cut[i + 1]].copy()))
            if len(found) > 10_000:
                yield batch_of_links()
        close()
        yield batch_of_links()

    return run


def _merge(df: DataFrame) -> DataFrame:
    """Tables that grow with the input are never broadcast."""
    return df.hint("merge")


class _Join:
    """The comparisons of one run: lists (sig, node) and the texts (node, text) of their members; `label`: (node, leader) of the nodes that have one."""

    def __init__(self, work: Workspace, lists: DataFrame, texts: DataFrame, width: int, percent: int, chunk: int):
        self.work, self.lists, self.texts, self.width, self.percent, self.chunk = work, lists, texts, width, percent, chunk
        self.turn = 0

    def table(self, df: DataFrame, what: str) -> DataFrame:
        return self.work.table(df, f"{what}-{self.turn}")

    def several(self, lists: DataFrame) -> DataFrame:
        """The lists with at least two members, of those with equal members one, with their sizes and smallest members."""
        one, two = F.shiftrightunsigned(F.xxhash64("node"), 24), F.bit_xor(F.xxhash64("node", F.lit(1)))
        stats = lists.groupBy("sig").agg(F.count("*").alias("df"), F.min("node").alias("least"), F.sum(one).alias("one"), two.alias("two")).where("df > 1")
        kept = stats.groupBy("df", "least", "one", "two").agg(F.min("sig").alias("sig")).select("sig", "df", "least")
        return self.table(lists.join(_merge(kept), "sig"), "lists")

    def deal(self, lists: DataFrame) -> DataFrame:
        """(node, chunk, size): what lists connect is one chunk, or where that is much, members of one list stay together."""
        joined = components(self.work, lists.select(F.col("node").alias("a"), F.col("least").alias("b")), "met")
        main = lists.groupBy("node").agg(F.max(F.struct("df", "sig")).alias("m"))
        joined = joined.select("node", F.col("component").alias("met"))
        whole = main.join(_merge(joined), "node", "left").select("node", "m", F.coalesce("met", "node").alias("met"))
        sizes = whole.groupBy("met").agg(F.count("*").alias("size"))
        # large lists are cut by member, lists and pieces are dealt over the chunks
        place = F.xxhash64("met", F.pmod(self.piece(), F.ceil(F.col("size") / self.chunk)))
        return self.table(whole.join(_merge(sizes), "met").select("node", place.alias("chunk"), "size"), "chunks")

    def piece(self):
        return F.xxhash64("m.sig", F.pmod(F.xxhash64("node"), F.ceil(F.col("m.df") / self.chunk)))

    def compare(self, sides: DataFrame) -> DataFrame:
        """What the comparisons (c1, c2, side, node) connect: (node, least)."""
        rows = sides.join(_merge(self.texts), "node").select("c1", "c2", "side", "node", "text")
        ordered = rows.repartition(tasks_for(rows, 0), "c1", "c2").sortWithinPartitions("c1", "c2")
        return self.table(ordered.mapInArrow(_verify(self.width, self.percent), "node long, least long"), "links")

    def inside(self, chunks: DataFrame) -> DataFrame:
        """All pairs of each chunk (node, chunk)."""
        more = chunks.groupBy("chunk").agg(F.count("*").alias("members")).where("members > 1")
        return self.compare(chunks.join(_merge(more), "chunk").select(F.col("chunk").alias("c1"), F.col("chunk").alias("c2"), F.lit(0).alias("side"), "node"))

    def led(self, label: DataFrame, moved: DataFrame) -> DataFrame:
        """The label after leaders have got leaders (node, least) of their own."""
        new = moved.select(F.col("node").alias("leader"), F.col("least").alias("new"))
        old = label.join(_merge(new), "leader", "left").select("node", F.coalesce("new", "leader").alias("leader"))
        return self.table(old.unionByName(moved.select("node", F.col("least").alias("leader"))), "label")

    def run(self) -> DataFrame:
        """The label when every pair that shares a list is linked, compared or known to be connected."""
        lists = self.several(self.lists)
        first = self.deal(lists)
        # a node is in one chunk, so what its comparison connects is a star
        label = self.inside(first).select("node", F.col("least").alias("leader"))
        # what fitted into one chunk is settled
        large = self.table(first.where(F.col("size") > self.chunk).select("node", "chunk"), "large")
        if large.isEmpty():
            return label
        lists = lists.join(_merge(large), "node").select("sig", "node", "chunk")
        named = lists.join(_merge(label), "node", "left").select("sig", "node", "chunk", F.coalesce("leader", "node").alias("leader"))
        named = self.table(named, "named")
        led = named.select("sig", F.col("leader").alias("node")).distinct()
        for self.turn in range(1, ROUNDS + 1):
            members = self.several(led)
            if members.isEmpty():
                return label
            main = members.groupBy("node").agg(F.max(F.struct("df", "sig")).alias("m"))
            moved = self.inside(main.select("node", self.piece().alias("chunk")))
            if moved.isEmpty():
                break
            label = self.led(label, moved)
            if moved.count() < 0.1 * main.count():  # most leaders are what they will be
                break
            led = members.join(_merge(moved.withColumnRenamed("least", "to")), "node", "left").select("sig", F.coalesce("to", "node").alias("node")).distinct()
        now = label.select(F.col("node").alias("leader"), F.col("leader").alias("now"))
        lists = named.join(_merge(now), "leader", "left").select("sig", "node", "chunk", F.coalesce("now", "leader").alias("leader"))
        several = lists.groupBy("sig").agg(F.min("leader").alias("x"), F.max("leader").alias("y")).where("x < y").select("sig")
        lists = self.table(lists.join(_merge(several), "sig"), "open")
        # members of several components are left in these lists
        self.turn += 1
        met = lists.select("sig", "chunk", "leader").distinct()
        one, two = (met.select("sig", F.col("chunk").alias(c), F.col("leader").alias(x)) for c, x in (("c1", "l1"), ("c2", "l2")))
        pairs = one.join(_merge(two), "sig").where("c1 < c2 and l1 != l2").select("c1", "c2").distinct()
        sides = pairs.select("c1", "c2", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("chunk", F.when(F.col("side") == 0, F.col("c1")).otherwise(F.col("c2")))
        found = self.compare(sides.join(_merge(lists.select("node", "chunk").distinct()), "chunk").select("c1", "c2", "side", "node"))
        # a link of two nodes is one of their leaders
        leader = _merge(label)
        ends = found.join(leader, "node", "left").select(F.coalesce("leader", "node").alias("a"), F.col("least").alias("node"))
        ends = ends.join(leader, "node", "left").select("a", F.coalesce("leader", "node").alias("b"))
        joined = components(self.work, ends, "led")
        return self.led(label, joined.select("node", F.col("component").alias("least")))


def connected(docs: DataFrame, work: Workspace, width: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, bucket_entries: int = BUCKET_ENTRIES, frequent: int = FREQUENT, coarse: int = COARSE, row_col: str = "row", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n, component (equal for rows that links connect; null for those without shingles); row_col: a distinct long."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{row_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))
    size, count = measure(rows)
    placed = with_part(rows, "row", size, count).select("doc_id", "row", "part", "text")
    buckets, parts, salt = max(1, math.ceil(size / 6 / bucket_entries)), max(1, math.ceil(size / (1 << 20))), 0
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    while True:
        schema = f"{SCHEMA}, doc_id {kind.simpleString()}, row long, part long, n long, k1 long, k2 long, node long"
        seen = work.table(placed.mapInArrow(_describe(width, buckets, coarse, salt, to_arrow_type(kind)), schema), f"sets-{salt}")
        sets = seen.where("kind = 1").select("doc_id", "row", "part", "n", "k1", "k2", "node")
        stands = sets.where("n > 0").groupBy("node").agg(F.min("row").alias("stands"), *[f(c).alias(f"{name}_{c}") for c in ("n", "k1", "k2") for name, f in (("a", F.min), ("z", F.max))])
        stands = work.table(stands, f"nodes-{salt}")
        if stands.where("a_n != z_n or a_k1 != z_k1 or a_k2 != z_k2").isEmpty():
            break
        salt += 1  # two sets have one name
    copies = sets.where("n > 0").join(_merge(stands.select("node", "stands")), "node").where("row != stands").select("part", "row")
    codes = dealt(seen.where("kind = 0").select("bucket", "kind", "docs", "counts", "keys"), buckets, lambda doc, key: key["bucket"].astype(np.int64), _WIDE, size, coarse=coarse)
    levels = by_bucket(codes, size).applyInArrow(_levels(buckets, parts, coarse), SCHEMA).unionByName(copies.mapInArrow(_copies(parts, coarse), SCHEMA))
    told = work.table(dealt(levels, parts, lambda doc, key: doc, _LEVEL, size, (_ANSWER, _COPY), coarse), "levels")
    index = by_part(placed.select("part", "row", "text"), told, size, _index(width, percent, frequent, buckets, salt), "sig long, node long, text string")
    index = work.table(index, "index")
    work.drop("levels")
    lists, texts = index.where("text is null").select("sig", "node"), index.where("text is not null").select("node", "text")
    leaders = _Join(work, lists, texts, width, percent, chunk).run()
    out = sets.join(_merge(leaders), "node", "left")
    return out.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.coalesce("leader", "node")).alias("component"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    work = Workspace(docs.sparkSession, "ngram-join")
    key = free_name(docs, "row_key")
    found = work.table(connected(with_row_key(docs, work, key), work, row_col=key, id_col=id_col, text_col=text_col, **options), "found")
    name = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = found.join(_merge(name), "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with their columns: of rows that links connect the one with the smallest doc_id (null is smaller than any), of several the smallest key."""
    key = free_name(docs, "row_key")
    keyed = with_row_key(docs, work, key)
    found = work.table(connected(keyed, work, row_col=key, id_col=id_col, text_col=text_col, **options), "found")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = found.join(_merge(first), "component").where("row != first.row").select(F.col("row").alias(key))
    gone = work.table(gone, "near-copies")
    return keyed.join(_merge(gone), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
