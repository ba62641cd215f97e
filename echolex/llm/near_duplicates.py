"""Near-duplicate records: all pairs whose sets of character n-grams are similar enough.

Method: grouped prefix join. The n-grams of a record are ordered from rare to frequent; two sets with Jaccard
similarity of at least `threshold` share an n-gram in their prefixes of |x| - ceil(threshold |x|) + 1 members.

1. Records with identical prefixes and equal size collapse into one group (copies always do).
2. Groups are joined on the n-grams of their prefixes. A pair of groups passes if its sizes are compatible, if the
   places of the common n-gram leave room for enough common members, and if the members' bitmaps don't already
   prove too many differences (for a group, the bits that all members have against those that any has).
3. Pairs of groups are expanded to the different sets in them, and each is verified on the exact n-grams.
4. The result is pairs of different texts and, for each record, the text it has. Groups of linked records and link
   counts come from these; pairs of records, copies with copies included, only where a caller asks for them.

The order is by a table of counts over all records, hashed to a fixed number of counters; any order gives the same
pairs, so it is bounded without loss. The join of one n-gram is a grid of cells whose side follows the number of
prefixes that have it, so a frequent n-gram is split over many tasks. The members of a large group meet in such a grid,
too. The filters of a cell run in numpy over whole blocks, and so does the verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.llm import components
from echolex.session import Scratch

#: Counters of the table of n-gram counts: a fixed 512 KB, whatever the number of records or of different n-grams.
COUNTERS = 1 << 16
#: Entries of one n-gram on one side of a cell of the join, about so many at most.
CELL = 8192
#: Which side of the join an entry stands on: the smaller set of a pair, the larger one, or, in an undivided n-gram, both.
SMALLER, LARGER, EITHER = range(3)
#: Words of 64 bits in the bitmap of a set.
WORDS = 4
#: Entries of the larger side of a block compared at once (a power of 2, so that places in it are cheap to take apart),
#: and of the smaller side.
BLOCK, ROWS = 2048, 256
#: Grams of all pairs verified at once.
VERIFIED = 2_000_000


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, n-gram) of all different n-grams of each text, by record and n-gram. An n-gram of up to three code
    points is its own number; of a longer one it is a 64-bit hash, and verification decides."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    record = np.repeat(np.arange(len(texts)), sizes)
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = len(points) - n + 1
    gram = np.zeros(count, np.uint64)
    for i in range(n):
        gram = (gram << np.uint64(21)) | points[i : i + count] if n <= 3 else _spread(gram * np.uint64(31) + points[i : i + count] + np.uint64(1))
    inside = record[:count] == record[n - 1 :]
    record, gram = record[:count][inside], gram[inside]
    order = np.lexsort((gram, record))
    record, gram = record[order], gram[order]
    new = np.ones(len(record), bool)
    new[1:] = (record[1:] != record[:-1]) | (gram[1:] != gram[:-1])
    return record[new], gram[new]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (_spread(gram) >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)


def _bitmaps(record: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
    """A bitmap of 64 * WORDS bits for each record."""
    bit = (_spread(gram ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(17)).astype(np.int64) % (64 * WORDS)
    maps = np.zeros((rows, WORDS), np.uint64)
    np.bitwise_or.at(maps, (record, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return maps


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _short(size: np.ndarray, threshold: float) -> np.ndarray:
    """The prefix that is enough for the smaller set of a pair."""
    return prefix_size(size, 2 * threshold / (1 + threshold))


def _few_rows(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * bytes_at_once // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def gram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of the n-grams of all rows of the column `text`, hashed to COUNTERS slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in _few_rows(batches):
            _, gram = gram_sets(batch.column(0).to_pylist(), n)
            total += np.bincount(_slot(gram), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    return _summed(texts.select("text").mapInArrow(count, "slot int, n bigint"))


def _summed(counted: DataFrame) -> np.ndarray:
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefix_rows(texts: DataFrame, counts, n: int, threshold: float) -> DataFrame:
    """(text_id, size, prefix array<bigint>, b0..b3 bigint) of every text with an n-gram; b0..b3 are its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in _few_rows(batches):
            texts = batch.column(1).to_pylist()
            record, gram = gram_sets(texts, n)
            size = np.bincount(record, minlength=len(texts))
            order = np.lexsort((gram, table[_slot(gram)], record))
            gram_by = gram[order]
            starts = np.cumsum(size) - size
            place = np.arange(len(gram)) - np.repeat(starts, size)
            taken = place < np.repeat(prefix_size(size, threshold), size)
            lengths = np.bincount(record[taken], minlength=len(texts))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(gram_by[taken].view(np.int64)))
            bits = _bitmaps(record, gram, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), prefix, *(pa.array(bits[:, i].copy()) for i in range(WORDS))],
                ["text_id", "size", "prefix", *(f"b{i}" for i in range(WORDS))],
            )

    out = "text_id bigint, size int, prefix array<bigint>, " + ", ".join(f"b{i} bigint" for i in range(WORDS))
    return texts.select("text_id", "text").mapInArrow(run, out)


def _entry_counts(held: DataFrame) -> np.ndarray:
    """Counts of the entries of the column `prefix`, hashed to COUNTERS slots: how large the join of each n-gram gets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_slot(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["slot", "n"])

    return _summed(held.select("prefix").mapInArrow(count, "slot int, n bigint"))


def cell_numbers(own: np.ndarray, side_cells: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entry, cell) for each cell that an entry goes to: a row of the grid on the smaller side, a column on the larger."""
    at = np.repeat(np.arange(len(own)), side_cells)
    other = np.arange(len(at)) - np.repeat(np.cumsum(side_cells) - side_cells, side_cells)
    width = side_cells[at].astype(np.int64)
    return at, own[at] * width + other if smaller else other * width + own[at]


def _cells(groups: DataFrame, counts, threshold: float) -> DataFrame:
    """(gram, cell, side, size, place, id, all_bits, any_bits) of (id, size, prefix, bitmaps): the entries of the join.
    The smaller set of a pair needs only a shorter prefix. `any_bits` is null where it equals `all_bits`, that is in a
    group of one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in _few_rows(batches, 1 << 20):
            ids = batch.column(0).to_numpy()
            size = batch.column(1).to_numpy().astype(np.int64)
            held = batch.column(2)
            lengths = np.diff(held.offsets.to_numpy())
            gram = held.flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), lengths)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            maps = [np.stack([batch.column(3 + k * WORDS + i).to_numpy() for i in range(WORDS)], 1) for k in (0, 1)]
            one = (maps[0] == maps[1]).all(1)
            low, high = (pa.array([r.tobytes() for r in m], pa.binary()) for m in maps)
            high = pc.if_else(pa.array(one), pa.scalar(None, pa.binary()), high)
            side_cells = np.maximum(1, -(-table[_slot(gram.view(np.uint64))] // CELL))
            own = (_spread(ids[row].astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % side_cells
            whole = np.flatnonzero(side_cells == 1)
            parts = [(whole, np.zeros(len(whole), np.int64), np.full(len(whole), EITHER))]
            split = np.flatnonzero(side_cells > 1)
            for side in (SMALLER, LARGER):
                use = split[place[split] < _short(size, threshold)[row[split]]] if side == SMALLER else split
                at, cell = cell_numbers(own[use], side_cells[use], side == SMALLER)
                parts.append((use[at], cell, np.full(len(at), side)))
            at, cell, side = (np.concatenate(p) for p in zip(*parts))
            pick = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[at]), pa.array(cell, pa.int64()), pa.array(side, pa.int8()), pa.array(size[row[at]], pa.int32()),
                 pa.array(place[at], pa.int32()), batch.column(0).take(pick), low.take(pick), high.take(pick)],
                ["gram", "cell", "side", "size", "place", "id", "all_bits", "any_bits"],
            )

    out = "gram bigint, cell bigint, side tinyint, size int, place int, id bigint, all_bits binary, any_bits binary"
    return groups.mapInArrow(run, out)


def _maps(column: pa.Array) -> np.ndarray:
    """Bitmaps of a binary column; zero for null."""
    fixed = pc.fill_null(column, bytes(8 * WORDS)).cast(pa.binary(8 * WORDS))
    raw = np.frombuffer(fixed.buffers()[1], np.uint64)[fixed.offset * WORDS :]
    return raw[: len(fixed) * WORDS].reshape(-1, WORDS)


def _cell_pairs(side, size, place, ids, low, high, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of groups of one n-gram and cell that pass all filters. Entries are in order of size."""
    ratio = threshold / (1 + threshold)
    small = np.flatnonzero((side != LARGER) & (place < _short(size, threshold)))
    large = np.flatnonzero(side != SMALLER)
    kind = np.float32 if len(size) and size.max() < 20_000 else np.float64
    weight = (ratio * size).astype(kind)
    spare = (size - place - ratio * size + 0.01).astype(kind)
    # what a set may have that the other hasn't, at most: the other is as large, or larger
    most = np.minimum(size - np.ceil(2 * ratio * size - 1e-6), 255).astype(np.uint8)[small]
    words = [np.ascontiguousarray(low[small, k]) for k in range(WORDS)]
    absent = [np.ascontiguousarray(~high[large, k]) for k in range(WORDS)]
    big, big_weight, big_spare = size[large], weight[large], spare[large]
    left, right = [], []
    for start in range(0, len(small), ROWS):
        rows = small[start : start + ROWS]
        first = int(np.searchsorted(big, size[rows[0]]))
        last = int(np.searchsorted(big, size[rows[-1]] / threshold + 0.01, "right"))
        for y in range(first, last, BLOCK):
            z = min(last, y + BLOCK)
            fits = np.zeros((len(rows), BLOCK), bool)
            np.greater_equal(spare[rows, None], big_weight[None, y:z], out=fits[:, : z - y])
            fits[:, : z - y] &= big_spare[None, y:z] >= weight[rows, None]
            flat = np.flatnonzero(fits)
            i, j = flat // BLOCK + start, flat % BLOCK + y
            apart = np.zeros(len(i), np.uint8)
            for k in range(WORDS):  # a sum that would not fit into a byte is capped, which lets the pair pass on
                apart = np.minimum(apart, 191) + np.bitwise_count(words[k].take(i) & absent[k].take(j))
                if k:
                    keep = np.flatnonzero(apart <= most.take(i))
                    i, j, apart = i.take(keep), j.take(keep), apart.take(keep)
            i, j = small[i], large[j]
            once = (size[i] < size[j]) | ((size[i] == size[j]) & (ids[i] < ids[j]))
            i, j, apart = i[once], j[once], apart[once]
            room = size[i] - np.ceil(ratio * (size[i] + size[j]) - 1e-6)
            keep = np.bitwise_count(low[j] & ~high[i]).sum(1, dtype=np.int64) <= room + size[j] - size[i]
            keep &= apart <= room
            left.append(ids[i[keep]])
            right.append(ids[j[keep]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _close_pairs(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of ids that pass the filters, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            numbers = [batch.column(i).to_numpy() for i in range(6)]
            low = _maps(batch.column(6))
            return (*numbers, low, _maps(batch.column(7)) | low)

        def compare() -> None:
            if waiting:
                _, _, side, size, place, ids, low, high = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                if len(ids) > 1:
                    found.append(_cell_pairs(side, size.astype(np.int64), place, ids, low, high, threshold))

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found))
            found.clear()
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = arrays(batch)
            gram, cell = whole[0], whole[1]
            edges = [0, *(np.flatnonzero((gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(gram)]
            for start, stop in zip(edges, edges[1:]):
                if waiting and (waiting[-1][0][0] != gram[start] or waiting[-1][1][0] != cell[start]):
                    compare()
                waiting.append(tuple(x[start:stop] for x in whole))
            if sum(len(a) for a, _ in found) > 100_000:
                yield flush()
        compare()
        if found:
            yield flush()

    by_cell = cells.repartition("gram", "cell").sortWithinPartitions("gram", "cell", "size")
    return by_cell.mapInArrow(run, "a bigint, b bigint").distinct()


def _numbered_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(record, number, numbers in all) of the different n-grams of each text, in order; equal numbers only for equal
    n-grams."""
    if n <= 3:
        record, gram = gram_sets(texts, n)
        held, number = np.unique(gram, return_inverse=True)
        return record, number, len(held)
    names: dict[str, int] = {}
    sets = [sorted({names.setdefault(t[i : i + n], len(names)) for i in range(len(t) - n + 1)}) for t in texts]
    record = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return record, np.array([g for x in sets for g in x], np.int64), len(names)


def common_members(record: np.ndarray, number: np.ndarray, numbers: int, rows: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members that the sets x and y of each pair have in common, members of both together)."""
    size = np.bincount(record, minlength=rows)
    start = np.cumsum(size) - size
    common = np.zeros(len(x), np.int64)
    step = max(1, VERIFIED * len(x) // max(1, int(size[x].sum() + size[y].sum())))
    for low in range(0, len(x), step):
        keys = []
        for side in (x[low : low + step], y[low : low + step]):
            pair = np.repeat(np.arange(len(side)), size[side])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(size[side]) - size[side], size[side])
            keys.append(pair * numbers + number[start[side][pair] + nth])
        both = np.sort(np.concatenate(keys), kind="stable")  # merges two sorted runs
        twice = both[1:][both[1:] == both[:-1]] // numbers
        common[low : low + step] += np.bincount(twice, minlength=len(common[low : low + step]))
    return common, size[x] + size[y] - common


def _verify(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The (a, b, text_a, text_b) rows whose exact similarity is at least the threshold, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).dictionary_encode()
            at = texts.indices.to_numpy().astype(np.int64)
            record, number, numbers = _numbered_grams(texts.dictionary.to_pylist(), n)
            x, y = at[: batch.num_rows], at[batch.num_rows :]
            common, whole = common_members(record, number, numbers, len(texts.dictionary), x, y)
            yield batch.select([0, 1]).filter(pa.array(common >= threshold * whole - 1e-9, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def similar_texts(
    records: DataFrame, id_col: str = "phrase_id", text_col: str = "phonemes", n: int = 3, threshold: float = 0.6
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, text_id, copies), one row for each record that is a case, with the smallest id
    that has the same text and the number of those that have it; and pairs (a, b) of all text ids whose sets of
    different n-grams (of characters) have a Jaccard similarity of at least `threshold`, each once, a <> b.

    Null texts, texts shorter than `n` and rows with a null id are no case. Ids are unique longs. An empty table gives
    no rows; other columns don't matter.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = records.sparkSession
    scratch = Scratch(spark, "near")
    rows = records.select(records[id_col].cast("bigint").alias("id"), records[text_col].alias("text")).where(
        F.col("id").isNotNull() & (F.length("text") >= n)
    )
    texts = scratch.cut(rows.groupBy("text").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("copies")))
    counts = spark.sparkContext.broadcast(gram_counts(texts, n))
    prefixes = scratch.cut(_prefix_rows(texts, counts, n, threshold))
    bits = [F.bit_and(f"b{i}").alias(f"l{i}") for i in range(WORDS)] + [F.bit_or(f"b{i}").alias(f"h{i}") for i in range(WORDS)]
    prefixes = prefixes.withColumn("k1", F.xxhash64("size", "prefix")).withColumn("k2", F.xxhash64(F.lit("prefix"), "prefix", "size"))
    groups = prefixes.groupBy("k1", "k2").agg(
        F.min("text_id").alias("group_id"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), *bits, F.count(F.lit(1)).alias("members")
    )
    groups = scratch.cut(groups)
    names = [f"{x}{i}" for x in "lh" for i in range(WORDS)]

    def joined(entries: DataFrame) -> DataFrame:
        return _close_pairs(_cells(entries, spark.sparkContext.broadcast(_entry_counts(entries)), threshold), threshold)

    near = joined(groups.select("group_id", "size", "prefix", *names))
    # groups of one set are their set; others are expanded, and their members meet under the key they have in common
    large = groups.where("members > 1").select("k1", "k2", "group_id")
    members = scratch.cut(prefixes.join(large, ["k1", "k2"]))
    own = [F.col(f"b{i}").alias(f"{x}{i}") for x in "lh" for i in range(WORDS)]
    inside = joined(members.select("text_id", "size", F.array(F.xxhash64("k1", "k2")).alias("prefix"), *own))

    def expand(pairs: DataFrame, side: str) -> DataFrame:
        of = members.select(F.col("group_id").alias(side), F.col("text_id").alias("member"))
        return pairs.join(of, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")

    candidates = scratch.cut(expand(expand(near, "a"), "b").select("a", "b").unionByName(inside))
    texts_a = texts.select(F.col("text_id").alias("a"), F.col("text").alias("text_a"))
    texts_b = texts.select(F.col("text_id").alias("b"), F.col("text").alias("text_b"))
    pairs = scratch.cut(_verify(candidates.join(texts_a, "a").join(texts_b, "b"), n, threshold))
    return rows.join(texts, "text").select("id", "text_id", "copies"), pairs


def similar_pairs(
    records: DataFrame, id_col: str = "phrase_id", text_col: str = "phonemes", n: int = 3, threshold: float = 0.6
) -> DataFrame:
    """(a, b), a < b: `similar_texts` as pairs of record ids, copies of one text included. As many rows as there are
    similar pairs: the square of the copies of a text, among others; `similar_groups` has one row for each record."""
    members, pairs = similar_texts(records, id_col, text_col, n, threshold)
    copied = members.where("copies > 1").select("text_id", "id")

    def copies(rows: DataFrame, side: str) -> DataFrame:
        of = copied.select(F.col("text_id").alias(side), F.col("id").alias("copy"))
        return rows.join(of, side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")

    between = copies(copies(pairs, "a"), "b")
    same = copied.alias("x").join(copied.alias("y"), "text_id").where("x.id < y.id")
    same = same.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same)


def similar_groups(
    records: DataFrame, id_col: str = "phrase_id", text_col: str = "phonemes", n: int = 3, threshold: float = 0.6
) -> DataFrame:
    """(`id_col`, group_id, n_links): one row for each record with an id. `group_id` is the smallest id that it is linked
    to over any chain of similar records; `n_links` counts the records similar to it, copies included. A record that is
    no case is a group of its own with no links."""
    members, pairs = similar_texts(records, id_col, text_col, n, threshold)
    texts = members.where("id = text_id").select("text_id", "copies")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = ends.join(texts.select(F.col("text_id").alias("b"), "copies"), "b")
    links = of.groupBy(F.col("a").alias("text_id")).agg(F.sum("copies").alias("links"))
    roots = components.decompose(pairs)
    least = roots.groupBy("root").agg(F.min("v").alias("least"))
    known = roots.join(least, "root").select(F.col("v").alias("text_id"), "least").join(links, "text_id")
    found = members.join(known, "text_id", "left").select(
        F.col("id"), F.coalesce("least", "text_id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    ids = records.select(records[id_col].cast("bigint").alias("id")).dropna()
    return ids.join(found, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("least", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links")
    )
