"""Byte-level byte-pair encoding of whole tables with a public vocabulary.

Method: pair occurrence index. The distinct pieces of the texts in an Arrow batch (split by the tokenizer's pattern)
are laid out one after the other as byte symbols. An index maps every mergeable pair, by its rank, to all places where
it stands; the ranks present are applied in ascending order, each at all of its places, and a merge adds the two pairs
it creates to the lists of their ranks. A pair that contains the result of rank r was learned after r, so new ranks
are always larger than the one being applied and one ascending sweep finishes every piece at once. The work is
proportional to bytes plus merges (times a heap step per active rank), also for a single piece of any length.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Splits as the byte-level vocabulary's own pattern does; alternatives that can't start alike are in order of frequency.
PATTERN = (
    r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]++| ?\p{N}++"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Pieces kept with their ids between batches of one task; a full cache is emptied, which changes no result.
CACHED_PIECES = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexEncoder:
    """Encodes pieces of text; `path` is a vocabulary file with `model.vocab` and `model.merges`."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [0] * 256
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocab[symbol]
        self.rank: dict[int, int] = {}
        self.left, self.right, self.result = [], [], []
        for rank, (a, b) in enumerate(merges):
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.result.append(vocab[a + b])
            self.rank[vocab[a] << 32 | vocab[b]] = rank
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def pieces(self, new: Iterable[str]) -> list[list[int]]:
        """The ids of each piece, all pieces merged in one sweep over the ranks."""
        first, rank_of, left, right, result = self.first, self.rank, self.left, self.right, self.result
        symbol: list[int] = []
        starts: list[int] = []
        for piece in new:
            starts.append(len(symbol))
            symbol.extend([first[b] for b in piece.encode("utf-8")])
            symbol.append(-1)  # nothing merges across the end of a piece
        size = len(symbol)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        at: dict[int, list[int]] = {}
        get = rank_of.get
        for place in range(size - 1):
            a, b = symbol[place], symbol[place + 1]
            if a >= 0 <= b:
                rank = get(a << 32 | b)
                if rank is not None:
                    if rank in at:
                        at[rank].append(place)
                    else:
                        at[rank] = [place]
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = at.pop(rank)
            a, b, ab = left[rank], right[rank], result[rank]
            if a == b:
                places.sort()  # runs of one symbol merge from the left
            for place in places:
                if symbol[place] != a:
                    continue
                follower = after[place]
                if symbol[follower] != b:
                    continue
                symbol[place] = ab
                symbol[follower] = -2
                nxt = after[follower]
                after[place] = nxt
                before[nxt] = place
                other = symbol[nxt]
                if other >= 0:
                    made = get(ab << 32 | other)
                    if made is not None:
                        if made in at:
                            at[made].append(place)
                        else:
                            at[made] = [place]
                            heapq.heappush(active, made)
                prev = before[place]
                if prev >= 0:
                    other = symbol[prev]
                    if other >= 0:
                        made = get(other << 32 | ab)
                        if made is not None:
                            if made in at:
                                at[made].append(prev)
                            else:
                                at[made] = [prev]
                                heapq.heappush(active, made)
        out: list[list[int]] = []
        ends = [*starts[1:], size]
        for start, end in zip(starts, ends):
            out.append([s for s in symbol[start : end - 1] if s >= 0])
        return out

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """Splits the texts and puts the ids of all their pieces into `known`."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.known.keys()) if split else []
        if new:
            self.known.update(zip(new, self.pieces(new)))
        return split

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.learn(texts)
        ids_of = self.known.__getitem__
        return [list(chain.from_iterable(map(ids_of, pieces))) for pieces in split]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split = self.learn(texts)
        sizes = {}
        for pieces in split:
            for piece in pieces:
                if piece not in sizes:
                    sizes[piece] = len(self.known[piece])
        return [sum(map(sizes.__getitem__, pieces)) for pieces in split]


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """One encoder for a Python worker; the vocabulary is read once."""
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_FOLDER, f"{name}.json")


def _slices(batches: Iterator[pa.RecordBatch], bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about `bytes_at_once` of text; a longer single text stays whole."""
    for batch in batches:
        rows = max(1, batch.num_rows * bytes_at_once // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """(`id_col`, ids array<int>): one row for each input row, without special tokens.

    Null and empty texts get an empty list; a null id stays null; other columns don't matter and may have any name.
    The strings of special tokens in a text are ordinary text. No shuffle: a map over the scan.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        kind = pa.list_(pa.int32())
        for batch in _slices(batches, 4 << 20):
            ids = tok.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind)], ["row_id", "ids"])

    rows = documents.select(documents[id_col].alias("row_id"), documents[text_col].alias("row_text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", id_col)


def count_tokens(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """(`id_col`, n_tokens bigint): the length of each row's id list; 0 for null and empty texts."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in _slices(batches, 4 << 20):
            counts = tok.count_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["row_id", "n_tokens"])

    rows = documents.select(documents[id_col].alias("row_id"), documents[text_col].alias("row_text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, n_tokens bigint").withColumnRenamed("row_id", id_col)
