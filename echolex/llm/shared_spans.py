"""Long exact spans that several documents share.

Method: content-defined chunking with a gear rolling hash. The gear hash of a place depends on the last GEAR characters
only. Every window of `span` characters is assigned to the cut that lies in it: the place with the smallest gear hash
(the last one, if several are equal). The windows with one cut form a chunk: a variable piece of text that depends on
its content alone, so an insertion elsewhere moves it but doesn't change it, and a window that occurs in two documents
lies in both in a chunk with the same cut. Chunks are deduplicated by digest:

1. cuts whose gear hash occurs in one document only drop out;
2. chunks whose digest occurs in several documents are shared as a whole;
3. the other chunks at a shared cut (the ends of shared passages) are refined: their windows are put into classes of
   CLASS neighbours by their distance from the cut. A class drops out if the text common to its windows occurs in one
   document only, and is shared as a whole if all of its text occurs in several; in the classes left, the digests of
   the single windows decide.

Each step groups by digest with partial aggregates (the smallest and the largest document of a digest differ), so a
passage that a third of all documents hold is never gathered, and no pairs are formed. Chunks, classes and windows are
compared by two digests of their whole text, polynomials of different bases modulo 2**64; the cut only limits what is
compared. Texts aren't compared character by character after that.

The chunks with all their digests come from one map over the texts. The texts are joined once more, to cut out the chunks
that are refined; the steps that follow read these pieces only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolex.session import Scratch

#: Characters that a gear hash looks back on.
GEAR = 32
#: Windows of a class in the refinement of a chunk.
CLASS = 16
#: Odd multipliers of the two polynomial digests, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Characters hashed at once; a longer single text is hashed whole.
CHARS_AT_ONCE = 2_000_000

_powers: list[list[tuple[np.ndarray, np.ndarray]]] = []


def _mixed(points: np.ndarray) -> np.ndarray:
    """A fixed random-looking 64-bit number for each code point (the finisher of splitmix64)."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gear(mixed: np.ndarray) -> np.ndarray:
    """h[i] = sum of mixed[i - k] << k for k < GEAR, by doubling; the first GEAR - 1 places lack a full history."""
    h = mixed.copy()
    width = 1
    while width < GEAR:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and their inverses up to n."""
    if not _powers or len(_powers[0][0][0]) <= n:
        size = max(n + 1, CHARS_AT_ONCE + 2)
        made = []
        for base in BASES:
            both = []
            for factor in (base, pow(base, -1, 1 << 64)):
                p = np.ones(size, np.uint64)
                p[1:] = np.uint64(factor)
                both.append(np.multiply.accumulate(p))
            made.append((both[0], both[1]))
        _powers[:] = [made]
    return _powers[0]


def _finished(d: np.ndarray) -> np.ndarray:
    d = d ^ (d >> np.uint64(29))
    return (d * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


class Digests:
    """The two digests of any stretch of a text, from prefix sums."""

    def __init__(self, mixed: np.ndarray) -> None:
        self.parts = []
        for up, down in _power(len(mixed)):
            sums = np.zeros(len(mixed) + 1, np.uint64)
            np.cumsum(mixed * up[: len(mixed)], out=sums[1:])
            self.parts.append((sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [_finished((sums[end] - sums[start]) * down[start]) for sums, down in self.parts]


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each text starts in it (one more entry at the end)."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return points, starts


def _last_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window of `width` neighbours."""
    have, least = 1, key
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def chunks_of(points: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place of the cut, digest of the cut, the chunk's two digests) of every chunk;
    places count from 0 in their text."""
    n = len(points)
    if n < span:
        none = np.zeros(0, np.int64)
        return (none,) * 7
    mixed = _mixed(points)
    hashes = gear(mixed)
    # 32 bits of the hash, then the place from the right: the last of equal ones is the least. Keys are unique.
    bits = np.uint64(32)
    key = (hashes >> bits << bits) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least = _last_least(key[GEAR - 1 :], span - GEAR + 1)
    cut = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)  # by first character of the window
    text = np.searchsorted(starts, np.arange(len(cut)), "right") - 1
    whole = starts[text + 1] - np.arange(len(cut)) >= span
    place = np.flatnonzero(whole)
    if not len(place):
        none = np.zeros(0, np.int64)
        return (none,) * 7
    fresh = np.ones(len(place), bool)
    fresh[1:] = (cut[place[1:]] != cut[place[:-1]]) | (text[place[1:]] != text[place[:-1]])
    first = place[fresh]
    last = np.append(place[np.flatnonzero(fresh)[1:] - 1], place[-1])
    at, start = cut[first], starts[text[first]]
    digests = Digests(mixed)
    return text[first], first - start, last - start, at - start, digests(at - GEAR + 1, at + 1)[0], *digests(first, last + span)


def _held(column: pa.ListArray, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row that each entry of a list of structs is in, and its fields as 64-bit numbers."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    return row, [flat.field(i).to_numpy().astype(np.int64) for i in range(fields)]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * CHARS_AT_ONCE // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in more than one document."""
    docs = rows.groupBy(*keys).agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    return docs.where("low <> high").select(*keys)


def shared_spans(documents: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, start_pos, end_pos): the longest runs of shared characters of each document.

    A character is shared if it lies in a stretch of `span` characters that also occurs in the text of another id.
    Positions are code points from 0, `end_pos` is behind the last one. Null texts and texts shorter than `span` share
    nothing; rows with a null id are left out; rows with one id count as one document each with the other's positions,
    so ids are meant to be unique. An empty table gives no rows.
    """
    if span < 2 * GEAR:
        raise ValueError(f"span must be at least {2 * GEAR}")
    scratch = Scratch(documents.sparkSession, "spans")
    texts = documents.select(documents[id_col].alias("doc"), documents[text_col].alias("body")).where(
        F.col("doc").isNotNull() & (F.length("body") >= span)
    )
    kind = texts.schema["doc"].dataType.simpleString()
    places = "first int, last int, at int"

    def batch_of(docs: pa.Array, names: str, small: tuple, large: tuple) -> pa.RecordBatch:
        columns = [*(pa.array(x, pa.int32()) for x in small), *(pa.array(x) for x in large)]
        return pa.RecordBatch.from_arrays([docs, *columns], ["doc", *names.split()])

    def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_batches(batches):
            text, first, last, at, *digests = chunks_of(*_texts(batch, 1), span)
            yield batch_of(batch.column(0).take(pa.array(text)), "first last at cut d1 d2", (first, last, at), tuple(digests))

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of each chunk that is refined."""
        for batch in _cut_batches(batches):
            row, (first, last, at, cut) = _held(batch.column(2), 4)
            bodies = batch.column(1).to_pylist()
            pieces = [bodies[r][x : y + span] for r, x, y in zip(row.tolist(), first.tolist(), last.tolist())]
            made = batch_of(batch.column(0).take(pa.array(row)), "first last at cut", (first, last, at), (cut,))
            whole = pa.array([len(p) == n for p, n in zip(pieces, (last - first + span).tolist())], pa.bool_())
            yield made.append_column("piece", pa.array(pieces, pa.string())).filter(whole)  # not so if ids are repeated

    def digest_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_batches(batches):
            points, starts = _texts(batch, 5)
            first, last, at, cut = (batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5))
            start, digest = starts[:-1] - first, Digests(_mixed(points))
            low, high = (at - last) // CLASS, (at - first) // CLASS
            number = high - low + 1
            owner = np.repeat(np.arange(len(first)), number)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + low[owner]
            middle = at[owner] - nth * CLASS
            begin = np.maximum(first[owner], middle - CLASS + 1)
            end = np.minimum(last[owner], middle)
            core = (middle, middle - CLASS + 1 + span)  # what the windows of a whole class have in common
            place = _mixed(cut[owner].view(np.uint64) + _mixed(nth.view(np.uint64)))
            u = [_finished(d.view(np.uint64) ^ place) for d in digest(start[owner] + core[0], start[owner] + core[1])]
            f = [d ^ (end - begin) for d in digest(start[owner] + begin, start[owner] + end + span)]
            docs = batch.column(0).take(pa.array(owner))
            yield batch_of(docs, "first last at u1 u2 f1 f2", (begin, end, at[owner]), (*u, *f))

    def digest_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_batches(batches):
            points, starts = _texts(batch, 2)
            row, (first, last, u1, u2) = _held(batch.column(3), 4)
            begin, size = batch.column(1).to_numpy(), np.diff(starts)
            inside = (first >= begin[row]) & (last + span <= begin[row] + size[row])  # not so if ids are repeated
            row, first, last, u1, u2 = (x[inside] for x in (row, first, last, u1, u2))
            start = starts[:-1] - begin
            number = last - first + 1
            owner = np.repeat(np.arange(len(first)), number)
            window = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
            begin = start[row[owner]] + window
            docs = batch.column(0).take(pa.array(row[owner]))
            yield batch_of(docs, "window u1 u2 d1 d2", (window,), (u1[owner], u2[owner], *Digests(_mixed(points))(begin, begin + span)))

    def spans(rows: DataFrame) -> DataFrame:
        return rows.where("whole").select("doc", F.col("first").alias("start_pos"), (F.col("last") + span).alias("end_pos"))

    chunks_at = scratch.write(texts.mapInArrow(cut_chunks, f"doc {kind}, {places}, cut bigint, d1 bigint, d2 bigint"))
    chunks = scratch.read(chunks_at)
    near_at = scratch.write(chunks.join(_several(chunks, "cut"), "cut", "left_semi"))
    scratch.drop(chunks_at)
    scratch.release()
    marked = scratch.cut(_marked(scratch.read(near_at), ["cut"], ["d1", "d2"]))
    rest = scratch.cut(_rest(marked, ["cut"], ["d1", "d2"], ["doc", "first", "last", "at"]))
    scratch.drop(near_at)
    scratch.release()
    held = rest.groupBy("doc").agg(F.collect_list(F.struct("first", "last", "at", "cut")).alias("held"))  # bounded by its own length
    pieces = texts.join(held, "doc").select("doc", "body", "held").mapInArrow(cut_pieces, f"doc {kind}, {places}, cut bigint, piece string")
    pieces = scratch.cut(pieces)
    scratch.release()
    units = "u1 bigint, u2 bigint, f1 bigint, f2 bigint"
    refined = scratch.cut(pieces.mapInArrow(digest_classes, f"doc {kind}, {places}, {units}"))
    kept = scratch.cut(refined.join(_several(refined, "u1", "u2"), ["u1", "u2"], "left_semi"))
    scratch.release()
    classes = scratch.cut(_marked(kept, ["u1", "u2"], ["f1", "f2"]))
    scratch.release()
    left = _rest(classes, ["u1", "u2"], ["f1", "f2"], ["doc", "first", "last", "at"])
    held = left.groupBy("doc", "at").agg(F.collect_list(F.struct("first", "last", "u1", "u2")).alias("held"))  # the classes of a chunk
    # a chunk is a document's only one at its cut
    source = pieces.select("doc", F.col("first").alias("begin"), "piece", "at").join(held, ["doc", "at"]).select("doc", "begin", "piece", "held")
    windows = scratch.cut(source.mapInArrow(digest_windows, f"doc {kind}, window int, u1 bigint, u2 bigint, d1 bigint, d2 bigint"))
    scratch.release()
    keys = ["u1", "u2", "d1", "d2"]
    single = windows.join(_several(windows, *keys), keys, "left_semi").select(
        "doc", F.col("window").alias("start_pos"), (F.col("window") + span).alias("end_pos")
    )
    return merge_runs(spans(marked).unionByName(spans(classes)).unionByName(single)).withColumnRenamed("doc", id_col)


def _marked(units: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """The units (with `doc`) with `whole`: whether their key occurs in several documents, within the group."""
    keys = units.groupBy(*group, *key).agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    return units.join(keys.select(*group, *key, (F.col("low") != F.col("high")).alias("whole")), [*group, *key])


def _rest(marked: DataFrame, group: list[str], key: list[str], row: list[str]) -> DataFrame:
    """The units that aren't shared as a whole, and those they may share a part with: of each key that is shared as a
    whole in their group, the units of two documents, which stand for all."""
    single = marked.where("NOT whole").select(*group, *row)
    alike = marked.where("whole").join(single.select(*group).distinct(), group, "left_semi").groupBy(*group, *key)
    alike = alike.agg(F.min(F.struct(*row)).alias("one"), F.max(F.struct(*row)).alias("two"))
    return single.unionByName(alike.select(*group, F.explode(F.array("one", "two")).alias("it")).select(*group, "it.*"))


def merge_runs(spans: DataFrame) -> DataFrame:
    """The unions of overlapping or touching (doc, start_pos, end_pos)."""
    order = Window.partitionBy("doc").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("reach", reach)
        .withColumn("run", F.sum(F.when(F.col("reach") >= F.col("start_pos"), 0).otherwise(1)).over(order))
        .groupBy("doc", "run")
        .agg(F.min("start_pos").cast("bigint").alias("start_pos"), F.max("end_pos").cast("bigint").alias("end_pos"))
        .select("doc", "start_pos", "end_pos")
    )


def shared_share(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_chars, shared_chars, share): how much of each document is also found elsewhere; a document without
    shared characters, an empty and a null text have share 0."""
    found = spans.groupBy(id_col).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    sizes = documents.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    out = sizes.join(found, id_col, "left").withColumn("shared_chars", shared)
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return out.select(id_col, "n_chars", "shared_chars", share.alias("share"))
