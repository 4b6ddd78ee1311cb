"""N-gram Jaccard join: exact links between documents by a blocked product of the document by n-gram incidence.

1. A document's set is the hashes of its word n-grams. Documents with equal sets form a class; one stands for all.
2. Blocks. Two sets of sizes a <= b whose similarity reaches p % differ in at most (100 - p) (a + b) / (100 + p)
   n-grams. If the n-grams are dealt to more parts than that, some part is equal in both. Documents whose sizes allow
   a link therefore share the key of a part, and the documents connected by shared keys form a block. Only parts with
   enough n-grams give keys, as others say little: documents that have too few such parts for the bound to hold also
   give each n-gram of their prefix, of which a linked pair of them shares one. N-grams that many texts of a sample
   have belong to no part and come last in prefixes: passages that are quoted everywhere would tie a share of all
   documents into one block, whose chunk pairs grow with the square of the input.
3. Inside a block the incidence is multiplied row by row against an index of the rarest n-grams of each row: only rows
   that share one of them can reach the bound that the sizes set. Overlaps are accumulated for these, pairs below the
   bound are discarded, and rows that are connected already are passed over. Blocks above a size are cut into chunks,
   and every pair of chunks is multiplied in a task of its own, a chunk's inner pairs where it meets the next.

No pair of documents is ever a row; keys travel as packed arrays, are met in a stream, and a key of any frequency
takes one entry of memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import buffers, mix, positional, shingle_hashes, trim, trimmed, word_hashes
from .graph import components

#: Least number of buckets of keys, and n-grams of all texts to a bucket where there are more; entries that are held before
#: they are packed or merged; n-grams of a chunk of a block.
BUCKETS, BUCKET_GRAMS, HELD, CHUNK = 1 << 10, 1 << 21, 1 << 18, 1 << 20
#: An n-gram is common if so many texts of the sample have it; the sample's least step, its n-grams, its buckets; common
#: n-grams at most, all of which every task gets.
COMMON, SAMPLE_STEP, SAMPLE_GRAMS, SAMPLE_BUCKETS, COMMONS = 4, 16, 1 << 25, 1 << 6, 1 << 19
#: Classes with this share of all rows are hot: at most SHARE of them can be.
HOT, SHARE = 1 << 12, 1 << 12
#: Candidate tables up to so many rows are sent to the texts, larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SIGN = np.uint64(0x8000000000000000)


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data, offsets = buffers(column)
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    return [np.unique(shingle_hashes(words[e - c : e], width)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def identity(grams: np.ndarray) -> int:
    """A signed 64-bit identity of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(grams)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)).view(np.int64)[0])


def node_of(sid: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The identity of a set at a level, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return mix(sid.astype(np.int64).view(np.uint64) + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def levels_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sets x 2: the level of each set's size and the one below; -1 where the set can only link with its equals."""
    first, differ, *_ = levels(percent)
    own = np.searchsorted(first, sizes, side="right") - 1
    both = np.stack([own, own - 1], axis=1)
    return np.where((both >= 0) & (sizes[:, None] > 0) & (differ[np.maximum(both, 0)] > 0), both, -1)


@lru_cache(maxsize=8)
def levels(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First size, allowed difference, parts and least useful part size of each level of sizes.

    A linked pair's sizes lie in one level or in two neighbours; the level of the smaller is where they meet.
    """
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    first = np.array(starts, np.int64)
    largest = first[1:] - 1
    differ = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
    parts, least = [], []
    for size, d in zip(first[:-1].tolist(), differ.tolist(), strict=True):
        for useful in (2, 1):
            fit = None
            for k in range(d + 1, 2 * d + 8) if d < 4096 else (int(d * f) for f in np.arange(1.01, 1.6, 0.01)):
                mean = size / k
                p = 1 - np.exp(-mean) * (1 + mean if useful == 2 else 1)
                if k * p - 2 * np.sqrt(k * p * (1 - p)) >= d + 1:
                    fit = k
                    break
            if fit:
                break
        parts.append(fit or d + 1)
        least.append(useful)
    return first[:-1], differ, np.array(parts, np.int64), np.array(least, np.int64)


def part_keys(sets: list[np.ndarray], percent: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sets' parts at both of their levels, and which set and which level each belongs to.

    ``common`` are sorted n-grams that many sets have, and how many: they belong to no part and come last in prefixes. Any
    such table is right as long as all sets are given the same: a pair differs in no more n-grams without them.
    """
    _, differ, parts, least = levels(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    both = levels_of(sizes, percent) if sets else np.empty((0, 2), np.int64)
    grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    times = np.zeros(len(grams), np.int64)
    if common is not None and len(common[0]) and len(grams):
        at = np.minimum(np.searchsorted(common[0], grams), len(common[0]) - 1)
        times = np.where(common[0][at] == grams, common[1][at], 0)
    keys, owners, at_level = [], [], []
    for below in (0, 1):
        live = both[:, below] >= 0
        which = np.flatnonzero(live)
        if not len(which):
            continue
        level = both[which, below]
        k = parts[level]
        offset = np.concatenate([[0], np.cumsum(k)])
        mask = np.repeat(live, sizes)
        g = mix(grams[mask] + np.uint64(0xA0761D6478BD642F))
        group, often = np.repeat(np.arange(len(which)), sizes[which]), times[mask]
        with np.errstate(over="ignore"):
            cell = offset[group] + (((g >> np.uint64(32)) * k[group].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            g = mix(g)
            # Halves of 32 bits add up exactly in doubles.
            rare = often == 0
            cell, r = cell[rare], g[rare]
            low = np.bincount(cell, (r & np.uint64(0xFFFFFFFF)).astype(np.float64), offset[-1]).astype(np.uint64)
            high = np.bincount(cell, (r >> np.uint64(32)).astype(np.float64), offset[-1]).astype(np.uint64)
            count = np.bincount(cell, minlength=offset[-1])
            owner = np.repeat(np.arange(len(which)), k)
            useful = count >= least[level][owner]
            enough = np.bincount(owner, useful, len(which)) > differ[level]
            if (~enough & (least[level] > 1)).any():
                # These give their parts of one n-gram too, whichever number of them they have.
                useful |= (count > 0) & ~enough[owner]
                enough |= np.bincount(owner, count > 0, len(which)) > differ[level]
            place = np.arange(offset[-1]) - offset[owner]
            seed = mix((level[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
            keys.append(mix(low + (high << np.uint64(32)) + seed)[useful])
            owners.append(which[owner[useful]])
            at_level.append(level[owner[useful]])
            # Both of a pair have enough useful parts, or one has, which then share one, or neither, and the same holds for parts
            # of any n-gram. Where none has enough of these: prefixes, the rarest first, in the order of g.
            few = ~enough[group]
            if few.any():
                g, of = g[few], group[few]
                order = np.lexsort((g, often[few], of))
                g, of = g[order], of[order]
                start = np.searchsorted(of, of)
                n = sizes[which[of]]
                head = np.arange(len(of)) - start <= n - -(-percent * n // 100)
                g, of = g[head], of[head]
                keys.append(mix(g + mix(level[of].astype(np.uint64) + np.uint64(0x3C6EF372FE94F82B))))
                owners.append(which[of])
                at_level.append(level[of])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(at_level)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and row, a hash of all columns: rows that agree in id and row are copies of each other."""
    cells = positional(df)
    text, place = df.columns.index(text_col), df.columns.index(id_col)
    return cells.select(F.col(f"c{place}").cast("long").alias("id"), F.col(f"c{text}").alias("text"), _row_hash(cells).alias("row"))


def _row_hash(cells: DataFrame) -> Column:
    """Of all columns but those of types that cannot be hashed."""
    return F.xxhash64(*(c for c, f in zip(cells.columns, cells.schema, strict=True) if not re.search("map<|variant", f.dataType.simpleString())))


def _slices(batch: pa.RecordBatch, size: int = 1 << 20):
    """Parts of a batch with about so many bytes of text."""
    lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index("text"))], np.int64)
    run, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _describe(width: int, percent: int):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                sets = sets_of(batch.column(1), width)
                sizes = [len(s) for s in sets]
                sids = [identity(s) if len(s) else 0 for s in sets]
                both = levels_of(np.array(sizes, np.int64), percent)
                nodes = [pa.array(node_of(np.array(sids, np.int64), both[:, k]), mask=both[:, k] < 0) for k in (0, 1)]
                sid = pa.array(np.array(sids, np.int64), mask=np.array(sizes) == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), sid, *nodes], names=["id", "row", "n", "sid", "node0", "node1"])

    return trimmed(run)


def _sampled(width: int):
    """The n-grams of texts that differ, packed by bucket."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                grams = np.concatenate([np.empty(0, np.uint64), *sets_of(batch.column(0), width)])
                grams = np.sort(grams)
                cuts = np.searchsorted(grams, np.arange(SAMPLE_BUCKETS, dtype=np.uint64) << np.uint64(65 - SAMPLE_BUCKETS.bit_length()))
                packed = [x.tobytes() for x in np.split(grams, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(SAMPLE_BUCKETS), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    return trimmed(run)


def _often(table: pa.Table) -> pa.Table:
    grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["packed"].combine_chunks()])
    grams, n = np.unique(grams, return_counts=True)
    keep = n >= COMMON
    return pa.table({"gram": pa.array(grams[keep].view(np.int64)), "n": pa.array(n[keep].astype(np.int64))})


def common_grams(docs: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that COMMON texts of a sample have, sorted, and how many have each; the most frequent COMMONS of them.

    They only say where documents meet: with any others the same links are found, in larger blocks.
    """
    step = max(SAMPLE_STEP, -(-total // SAMPLE_GRAMS))
    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct()
    found = texts.mapInArrow(_sampled(width), "bucket int, packed binary").groupBy("bucket").applyInArrow(_often, "gram long, n long")
    found = found.orderBy(F.desc("n"), "gram").limit(COMMONS).toArrow()
    grams, n = found["gram"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(grams)
    return grams[order], n[order]


def _keys(width: int, percent: int, buckets: int, common=None):
    """Keys and nodes packed by bucket; ``buckets`` is a power of two, ``common`` a broadcast table of common n-grams."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            keys, sids = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (keys >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, sids, bucket = keys[order], sids[order], bucket[order]
            full, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(bucket))
            packed = [keys[a:b].tobytes() + sids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

        for whole in batches:
            for batch in _slices(whole):
                ids = batch.column(0)
                sets, sids = [], []
                for s, i in zip(sets_of(batch.column(1), width), ids, strict=True):
                    if len(s) and i.is_valid and (sid := identity(s)) not in seen:
                        seen.add(sid)
                        sets.append(s)
                        sids.append(sid)
                keys, owner, level = part_keys(sets, percent, common.value if common else None)
                if len(keys):
                    held.append((keys, node_of(np.array(sids, np.int64)[owner], level)))
                    n += len(keys)
                if n >= HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return trimmed(run)


def _stars(batches):
    """Edges from the first set seen with a key to each further one, over a stream of packed keys in order of their buckets;
    only the keys of one bucket are held."""
    bucket = None
    known, first = np.empty(0, np.uint64), np.empty(0, np.int64)
    held: list[bytes] = []
    size = 0

    def merge():
        nonlocal known, first
        halves = [(np.frombuffer(b, np.uint64, len(b) // 16), np.frombuffer(b, np.int64, offset=len(b) // 2)) for b in held]
        keys, sids = (np.concatenate(x) for x in zip(*halves, strict=True))
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        lead = sids[head][np.cumsum(head) - 1]
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            old = known[at] == keys
            lead = np.where(old, first[at], lead)
            head &= ~old
        if head.any():
            known, first = np.concatenate([known, keys[head]]), np.concatenate([first, sids[head]])
            order = np.argsort(known, kind="stable")
            known, first = known[order], first[order]
        far = lead != sids
        pairs = np.unique(np.stack([lead[far], sids[far]], axis=1), axis=0) if far.any() else np.empty((0, 2), np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        for of, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if of != bucket or size >= HELD:
                if held:
                    yield merge()
                    size = 0
                if of != bucket:
                    bucket, known, first = of, np.empty(0, np.uint64), np.empty(0, np.int64)
            held.append(packed.as_py())
            size += len(held[-1]) // 16
    if held:
        yield merge()


def link_block(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, within: tuple[bool, bool] = (True, True)) -> list[int]:
    """The smallest linked row of each row of a block's incidence, by links of at least ``percent``.

    With ``side`` (0 or 1 for each row) pairs of rows on different sides are multiplied, and those of one side if
    ``within`` says so.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(column)
    # Columns in order of frequency: a row's first ones are its rarest.
    rank = np.empty(len(grams), np.int32)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(grams), dtype=np.int32)
    column = rank[column]
    frequency = np.sort(frequency, kind="stable")
    ends = np.cumsum(sizes)
    rows = [column[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    # Any link of a row needs an overlap of percent % of its size, so it shares one of the first size - needed + 1.
    heads = []
    for r, s in zip(rows, sizes.tolist(), strict=True):
        r.sort()
        h = r[: s - -(-percent * s // 100) + 1]
        heads.append(h[frequency[h] > 1])
    flat = np.concatenate(heads)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h in heads])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    mark = np.zeros(len(grams), bool)
    for row in range(n):
        h = heads[row]
        if not len(h):
            continue
        lo, hi = np.searchsorted(flat, h), np.searchsorted(flat, h, side="right")
        others = np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        # Later rows that are not connected yet, on the other side, of a size that allows the link.
        others = others[(others > row) & (label[others] != label[row])]
        if side is not None and not within[side[row]]:
            others = others[side[others] != side[row]]
        size = sizes[row]
        others = np.unique(others[100 * np.minimum(size, sizes[others]) >= percent * np.maximum(size, sizes[others])])
        if not len(others):
            continue
        mark[rows[row]] = True
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            lengths = sizes[part]
            hits = mark[np.concatenate([rows[o] for o in part.tolist()])]
            overlap = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
            linked = part[100 * overlap >= percent * (size + lengths - overlap)]
            if len(linked):
                joined = np.unique(np.concatenate([label[linked], label[row : row + 1]]))
                label[np.isin(label, joined)] = joined[0]
        mark[rows[row]] = False
    return label.tolist()


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("block", "sid", "chunk", "chunks", "ci", "cj")]
        order = np.lexsort((columns[1], columns[0]))
        blocks, sids, chunk, chunks, ci, cj = (x[order] for x in columns)
        packed = [x for part in table["grams"].chunks for x in part]
        a, b = [], []
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            sets = [np.frombuffer(packed[k].as_buffer(), np.uint64) for k in order[lo:hi].tolist()]
            first, second, count = int(ci[lo]), int(cj[lo]), int(chunks[lo])
            side, within = None, (True, True)
            if first != second:
                side, within = (chunk[lo:hi] == second).astype(int), ((first + 1) % count == second, (second + 1) % count == first)
            for k, root in enumerate(link_block(sets, percent, side, within)):
                if root != k:
                    a.append(int(sids[lo + root]))
                    b.append(int(sids[lo + k]))
        del packed, sets
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(width: int):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                sets = sets_of(batch.column(batch.schema.get_field_index("text")), width)
                sids = batch.column(batch.schema.get_field_index("sid")).to_pylist()
                keep = pa.array([len(s) > 0 and identity(s) == i for s, i in zip(sets, sids, strict=True)], pa.bool_())
                names = [n for n in batch.schema.names if n != "text"]
                cells = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=[*names, "grams"]).filter(keep)

    return trimmed(run)


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes (id, row, n, sid of every row) and links (a, b: sids): a forest that spans every component of linked sets."""
    docs = _documents(df, id_col, text_col)
    classes = materialize(docs.mapInArrow(_describe(width, percent), "id long, row long, n long, sid long, node0 long, node1 long"), "ngram-classes")
    # Keys grow with the n-grams, so do their buckets; the rows of a bucket come one after another.
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, 1 << (total // BUCKET_GRAMS).bit_length())
    # Texts that share what many have (notices, quotations) would all hang together; a table that fits one chunk needs no care.
    common = df.sparkSession.sparkContext.broadcast(common_grams(docs, width, total)) if total > CHUNK else None
    packed = docs.select("id", "text").mapInArrow(_keys(width, percent, buckets, common), "bucket int, packed binary")
    packed = packed.repartition("bucket") if buckets <= BUCKETS else packed.repartition(buckets // 4, "bucket")
    stars = packed.sortWithinPartitions("bucket").mapInArrow(trimmed(_stars), "a long, b long")
    blocks = components(stars, "ngram-blocks").select("node", F.col("root").alias("block"))
    sets = classes.where("id is not null").groupBy("sid").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("node0").alias("node0"), F.max("node1").alias("node1"))
    members = sets.withColumn("node", F.explode(F.array("node0", "node1"))).join(blocks, "node").select("id", "sid", "n", "block")
    members = materialize(members, "ngram-members")
    sums = members.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).where("rows > 1")
    bins = max(256, -(-members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // CHUNK) * 4)
    chunk = F.pmod(F.xxhash64("sid"), "chunks").cast("int")
    placed = members.join(sums, "block").withColumn("chunks", F.ceil(F.col("total") / CHUNK).cast("int")).withColumn("chunk", chunk)
    placed = materialize(placed.groupBy("id", "sid").agg(F.collect_list(F.struct("block", "chunk", "chunks")).alias("spots")), "ngram-placed")
    discard(members)
    # A set stands in at most two blocks, so a row of the table has a fixed size.
    texts = docs.select("id", "text").join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, "id")
    spot = "array<struct<block:bigint,chunk:int,chunks:int>>"
    grams = texts.mapInArrow(_sets(width), f"id long, sid long, spots {spot}, grams binary").select("sid", "grams", F.inline("spots"))
    # A chunk meets every other one; its own pairs are multiplied where it meets the next, so it is sent nowhere else.
    every = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: (k != F.col("chunk")) | (F.col("chunks") == 1))
    other = F.explode(every)
    spread = grams.withColumn("other", other).select(
        "sid", "block", "chunk", "chunks", "grams", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"),
        F.when(F.col("chunks") > 1, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins))).alias("bin"),
        (F.col("chunks") > 1).alias("large"),
    )
    found = spread.groupBy("large", "bin", "ci", "cj").applyInArrow(_multiply(percent), "a long, b long")
    return classes, found


def _joined_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Of every set: sid, rows (that have it), head (the least id and row of its component)."""
    roots = components(found, "ngram-components").select(F.col("node").alias("sid"), "root")
    least = classes.where("id is not null and sid is not null").groupBy("sid").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("rows"))
    joined = materialize(least.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "ngram-roots")
    # Per root a partial aggregate: a component of any size meets in one row per task. Most sets are their own component.
    several = joined.where("root <> sid").select("root").distinct()
    linked = joined.join(several, "root", "left_semi")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    alone = joined.join(several, "root", "left_anti").select("sid", "rows", F.col("least").alias("head"))
    bound = max(HOT, -(-linked.count() // SHARE))
    hot = F.broadcast(heads.join(linked.groupBy("root").count().where(F.col("count") >= bound).select("root"), "root").select("root", F.col("head").alias("hot")))
    marked = linked.join(hot, "root", "left")
    cold = marked.where("hot is null").join(heads, "root").select("sid", "rows", "head")
    return alone.union(marked.where("hot is not null").select("sid", "rows", F.col("hot").alias("head"))).union(cold)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles (the set's size), component_id (the smallest id reachable by links, the row's own included).

    Two rows link when 100 x intersection >= percent x union of their sets of n-grams. Defined cases: with fewer words
    than an n-gram has, the whole sequence is the one n-gram; null, empty and blank texts have the empty set, link with
    nothing and are their own component; rows with null ids link with nothing and have a null component; rows that
    repeat an id are each returned; texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    classes, found = links(df, id_col, text_col, width, percent)
    named = materialize(_joined_components(classes, found).select("sid", "rows", F.col("head.id").alias("component_id")), "ngram-named")
    # A class of copies may hold any share of the rows. Those of a large one meet its name by broadcast (at most SHARE
    # classes are large), rows without a set take no part, and only the rest is joined by a shuffle.
    valid = (F.col("sid").isNotNull()) & F.col("id").isNotNull()
    bound = max(HOT, -(-classes.count() // SHARE))
    hot = F.broadcast(named.where(F.col("rows") >= bound).select("sid", F.col("component_id").alias("hot")))
    marked = classes.join(hot, "sid", "left").select("id", "n", "sid", "hot")
    rest = marked.where(valid & F.col("hot").isNull()).join(named.where(F.col("rows") < bound).select("sid", "component_id"), "sid")
    other = marked.where(~valid | F.col("hot").isNotNull()).withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce(F.when(valid, F.col("hot")), "id")))
    out = rest.select("id", "n", "component_id").union(other.select("id", "n", "component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near copies: of each component of linked rows the one with the smallest id stays.

    Decided by row, not by id. Defined cases: of rows with one id and different texts each is judged by its own text; of
    several rows of a component with its smallest id the one with the smallest hash of all columns stays, and one of
    rows that agree in all columns; null, empty and blank texts link with nothing, so such rows all stay, repeated or
    not; rows with null ids stay; texts are read whole; an empty table gives no rows; other columns may have any names.
    """
    classes, found = links(df, id_col, text_col, width, percent)
    heads = materialize(_joined_components(classes, found).select(F.col("head.id").alias("id"), F.col("head.row").alias("row")).distinct(), "ngram-heads")
    judged = classes.where("id is not null and sid is not null").groupBy("id", "row").agg(F.count("*").alias("rows"))
    judged = judged.join(heads.withColumn("stays", F.lit(True)), ["id", "row"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    # Rows that go, and rows of which only one of several copies stays; all others are not touched.
    judged = materialize(judged.where("not stays or rows > 1"), "ngram-judged")
    cells = positional(df)
    keyed = cells.withColumn("id", F.col(f"c{df.columns.index(id_col)}").cast("long")).withColumn("row", _row_hash(cells))
    out = keyed.join(judged.select("id", "row"), ["id", "row"], "left_anti").select(*cells.columns)
    copied = judged.where("stays").select("id", "row")
    if not copied.isEmpty():
        # Copies meet in one row per task before they are moved.
        one = keyed.join(copied, ["id", "row"]).groupBy("id", "row").agg(F.first(F.struct(*cells.columns)).alias("x"))
        out = out.union(one.select("x.*"))
    return out.toDF(*df.columns)
