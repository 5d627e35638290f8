"""Operator 1: minimum-bin-slack packing of tokenised documents into training windows.

Every document becomes ids plus an end id. Whole windows are cut off its front; what remains is one piece of
1 to ``capacity`` - 1 ids. Pieces of a block form a multiset of lengths: for each window the longest piece is fixed,
a bitset subset-sum over the other lengths (counts split into powers of two) finds the reachable total closest to the
capacity, and walking the saved bitsets backwards gives how many pieces of each length to take. A choice is used as
often as the counts allow. Slack that no subset fills is filled by cutting one more piece, so that only the last
window of a task carries padding.

Scale: one pass, no shuffle. A task holds one block of pieces (``BLOCK_PIECES`` pieces or ``BLOCK_BYTES`` of ids,
whichever comes first) and carries only the last few of them into the next block.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table

CAPACITY, END_ID = 2048, 1
BLOCK_PIECES, BLOCK_BYTES, CARRY_PIECES = 4096, 16_000_000, 512
#: Texts that hold the special token's own string, and extremely long ones, take the tokenizers library itself.
SPECIAL, LONG_TEXT = "<|endoftext|>", 1_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class ByteBpe:
    """Ids of ``byte_bpe_50k.json`` without added special tokens.

    tiktoken holds the same vocabulary and merges as ranks and is several times faster; the few texts in which the two
    libraries could differ go to the tokenizers library.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def encode(self, text: str) -> list[int]:
        if SPECIAL not in text and len(text) <= LONG_TEXT:
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json_path)
        return self.exact.encode(text, add_special_tokens=False).ids


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest total of at most ``room`` that pieces of these lengths can reach, and how many of each reach it.

    Ties between choices go to the one found first with lengths in descending order. No length fits: (0, {}).
    """
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left > 0:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            power *= 2
        if reach & full:
            break
    total = at = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return total, dict(chosen)


class Packer:
    """Packs pieces (key, start, ids, doc_tokens) into windows and hands out finished rows."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next, self.rows = capacity, first_sequence, []
        self.pieces: dict[int, list[tuple]] = defaultdict(list)
        self.count = self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        total, size = len(ids) // 4, self.capacity
        whole = total - total % size
        for start in range(0, whole, size):
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
        if whole < total:
            self._hold((doc_id, whole, ids[4 * whole :], total))

    def _hold(self, piece: tuple) -> None:
        self.pieces[len(piece[2]) // 4].append(piece)
        self.count += 1
        self.held += len(piece[2])

    def _take(self, length: int) -> tuple:
        stack = self.pieces[length]
        piece = stack.pop()
        if not stack:
            del self.pieces[length]
        self.count -= 1
        self.held -= len(piece[2])
        return piece

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def pack(self, keep: int) -> None:
        """Fill windows until at most ``keep`` pieces are left."""
        while self.count > keep:
            longest = max(self.pieces)
            counts = {length: len(stack) for length, stack in self.pieces.items()}
            counts[longest] -= 1
            total, chosen = best_fill(counts, self.capacity - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - longest - total
            times = min(len(self.pieces[length]) // n for length, n in chosen.items())
            for _ in range(times if slack == 0 else 1):
                window = [self._take(length) for length in sorted(chosen, reverse=True) for _ in range(chosen[length])]
                if slack and self.pieces:
                    doc_id, start, ids, size = self._take(max(self.pieces))
                    window.append((doc_id, start, ids[: 4 * slack], size))
                    if len(ids) > 4 * slack:
                        self._hold((doc_id, start + slack, ids[4 * slack :], size))
                self._emit(window)
                if self.count <= keep:
                    break

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.rows), 2048):
            part = self.rows[i : i + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), ARROW, strict=True)], schema=ARROW)
        self.rows = []


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their place in the windows; ``ids`` holds little-endian uint32 ids.

    Null or empty text: the end id alone. Null and repeated doc_ids are packed like any others, each row by itself.
    An empty table gives no rows. Other columns are ignored. Texts are encoded whole, whatever their length.
    ``sequence_id`` is unique over the job; ``offset`` counts from 0 within a window without gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(json_path, ranks_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = batch.column(1)
            for doc_id, i in zip(batch.column(0).to_pylist(), range(batch.num_rows), strict=True):
                ids = array("I", bpe.encode(texts[i].as_py() or ""))
                ids.append(end_id)
                packer.add(doc_id, ids.tobytes())
                if packer.count >= BLOCK_PIECES or packer.held >= BLOCK_BYTES:
                    packer.pack(CARRY_PIECES)
                if len(packer.rows) >= 2048:
                    yield from packer.batches()
        packer.pack(0)
        yield from packer.batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(spread_table(spark, sf_dir, "documents")))
