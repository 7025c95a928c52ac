"""Best-fit packing of documents into training sequences (operator 3).

The sum-of-squares rule (Csirik et al., "On the Sum-of-Squares Algorithm for
Bin Packing"): keep N(g), the number of open sequences with g tokens left, and
put each piece where the sum of N(g)^2 becomes smallest. Only piece lengths
decide, so token ids never move: the shuffle carries a few numbers a piece.

Groups of pieces are packed independently; what a group leaves in badly filled
sequences is packed again together with what the other groups leave.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, partitions
from .textvec import chunks
from .tokens import tokenizer

#: Pieces that one task packs at most (bounds its memory), and those worth a task of their own.
GROUP_MAX, GROUP_MIN = 524_288, 4_096
#: A sequence with more than this share free is packed again once.
LOOSE = 0.004

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1..capacity), taken in the order given.

    Ties go to the exact fit, then to the smallest remaining gap, then to a new bin.
    """
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; gaps 0 and capacity aren't counted
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    never = np.int64(1) << 60
    used = 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = (2 * int(counts[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            if counts[s] and 1 - 2 * int(counts[s]) <= best:
                best, gap = 1 - 2 * int(counts[s]), s
            here = counts[s + 1 : capacity]
            if len(here):
                change = np.where(here > 0, counts[1 : capacity - s] - here, never)
                k = int(change.argmin())
                value = 2 * (int(change[k]) + 1)
                if change[k] < never and (value < best or value == best and gap == capacity):
                    best, gap = value, k + s + 1
        if gap == capacity:
            b = used
            used += 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bin_of[i], offset[i] = b, capacity - gap
        left = gap - s
        if left:
            open_bins[left].append(b)
            counts[left] += 1
    return bin_of, offset


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """documents -> its pieces (PIECES): ids of the whole text (null: empty), then end_id, cut every capacity ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                flat, off = tok.ids(texts[lo:hi])
                rows: list[tuple] = []
                for k in range(hi - lo):
                    ids = np.append(flat[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [
                        (lo + k, p, p * capacity, len(part := ids[p * capacity : (p + 1) * capacity]), zlib.crc32(part.tobytes()))
                        for p in range(ceil(len(ids) / capacity))
                    ]
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _packed(items: DataFrame, n: int, capacity: int, round_no: int, loose: float) -> DataFrame:
    """Adds sequence_id, place (offset) and loose (in a badly filled sequence); n: the items' number."""
    groups = max(ceil(n / GROUP_MAX), min(partitions(items.sparkSession), ceil(n / GROUP_MIN)), 1)
    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, loose boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        sizes = table["length"].to_numpy()
        order = np.argsort(-sizes, kind="stable")
        bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bin_of[order], offset[order] = sum_of_squares(sizes[order], capacity)
        fill = np.bincount(bin_of, weights=sizes)
        base = (round_no << 56) + (TaskContext.get().partitionId() << 28)
        out = table.append_column("sequence_id", pa.array(bin_of + base))
        out = out.append_column("offset", pa.array(offset)).append_column("loose", pa.array((capacity - fill > loose * capacity)[bin_of]))
        yield from out.to_batches(65_536)

    return items.repartition(groups).select(*names).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """items (any columns, and length: 1..capacity) -> the same rows with sequence_id and offset.

    Sequences are filled gaplessly from offset 0. Columns sequence_id, offset and
    loose of the input are replaced. An empty table gives an empty result.
    """
    items = cut(items.drop("sequence_id", "offset", "loose"))
    first = cut(_packed(items, items.count(), capacity, 0, LOOSE))
    tight, rest = first.where("NOT loose"), first.where("loose").drop("sequence_id", "offset", "loose")
    again = _packed(rest, rest.count(), capacity, 1, LOOSE)
    return tight.unionByName(again).drop("loose")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and still has its end id; a null doc_id stays null;
    repeated rows are packed each; other columns are not looked at.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
