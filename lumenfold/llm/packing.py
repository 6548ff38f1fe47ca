"""Vector bin packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import pieces
from lumenfold.llm.tokens import TOKEN_BYTES, default_path, encoder

#: Pieces held open at once; also bounds the memory of a task.
POOL = 512
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]


class VectorPacker:
    """Fills one sequence after another from a bounded pool of pieces.

    A piece demands (tokens, one segment, loss-bearing tokens). The piece placed next is the one that fits and has the
    largest dot product of its demand with the room that is left, both as shares of the limits. When none fits, a piece
    is cut to the room; its rest goes back to the pool. A sequence that cannot be filled (a limit on segments or loss
    is reached, or the input ends) is cut back to the largest power of two, which is never padded.
    """

    def __init__(self, capacity: int = 4096, segments: int = 64, loss: int | None = None, first_sequence: int = 0) -> None:
        self.limits = (capacity, segments, capacity if loss is None else loss)
        if min(self.limits) < 1:
            raise ValueError("limits are at least 1")
        self.sequence = first_sequence
        self._size = 4 * POOL
        self._tokens = np.zeros(self._size, dtype=np.int64)
        self._loss = np.zeros(self._size, dtype=np.int64)
        self._items: list[tuple | None] = [None] * self._size
        self._free = list(range(self._size - 1, -1, -1))
        self._count = 0
        self.out: list[tuple] = []

    # An item is (document, ids, first id with loss, start, end); ids before `first id with loss` bear none.
    @staticmethod
    def _loss_of(item: tuple, start: int, end: int) -> int:
        return max(0, end - max(start, item[2]))

    def _hold(self, item: tuple) -> None:
        if item[4] <= item[3]:
            return
        if not self._free:
            self._tokens = np.concatenate([self._tokens, np.zeros(self._size, dtype=np.int64)])
            self._loss = np.concatenate([self._loss, np.zeros(self._size, dtype=np.int64)])
            self._items += [None] * self._size
            self._free = list(range(2 * self._size - 1, self._size - 1, -1))
            self._size *= 2
        slot = self._free.pop()
        self._items[slot] = item
        self._tokens[slot] = item[4] - item[3]
        self._loss[slot] = self._loss_of(item, item[3], item[4])
        self._count += 1

    def _release(self, slot: int) -> tuple:
        item = self._items[slot]
        self._items[slot], self._tokens[slot] = None, 0
        self._free.append(slot)
        self._count -= 1
        return item

    def add(self, document: object, ids: np.ndarray, loss_from: int = 0) -> None:
        """All ids of a document; sequences are closed as the pool fills."""
        capacity, _, loss = self.limits
        start = 0
        while len(ids) - start >= capacity and self._loss_of((0, 0, loss_from), start, start + capacity) <= loss:
            self._emit([(document, ids, loss_from, start, start + capacity)])
            start += capacity
        while len(ids) > start:  # no piece demands more than a sequence has
            end = min(len(ids), start + capacity, max(start, loss_from) + loss)
            self._hold((document, ids, loss_from, start, end))
            start = end
        while self._count >= POOL:
            self._fill()

    def close(self) -> None:
        while self._count:
            self._fill()

    def _fill(self) -> None:
        capacity, segments, loss = self.limits
        room, seats, loss_room = capacity, segments, loss
        chosen: list[tuple] = []
        while room and seats and self._count:
            tokens, losses = self._tokens, self._loss
            fits = (tokens > 0) & (tokens <= room) & (losses <= loss_room)
            score = tokens * (room / capacity ** 2) + losses * (loss_room / loss ** 2) + seats / segments ** 2
            score[~fits] = -1.0
            slot = int(score.argmax())
            if score[slot] < 0:
                item = self._cut(room, loss_room)
                if item is None:
                    break
            else:
                item = self._release(slot)
            chosen.append(item)
            room -= item[4] - item[3]
            loss_room -= self._loss_of(item, item[3], item[4])
            seats -= 1
        total = capacity - room
        if room and total & (total - 1):
            self._trim(chosen, total - (1 << (total.bit_length() - 1)))
        self._emit(chosen)

    def _cut(self, room: int, loss_room: int) -> tuple | None:
        """The part of a held piece that uses most of the room; its rest stays in the pool."""
        best, end = -1, 0
        for slot in np.argsort(-self._tokens)[:64].tolist():
            item = self._items[slot]
            if item is not None:
                to = min(item[4], item[3] + room, max(item[3], item[2]) + loss_room)
                if best < 0 or to - item[3] > end - self._items[best][3]:
                    best, end = slot, to
        if best < 0 or end <= self._items[best][3]:
            return None
        item = self._release(best)
        self._hold((*item[:3], end, item[4]))
        return (*item[:3], item[3], end)

    def _trim(self, chosen: list[tuple], surplus: int) -> None:
        while surplus:
            item = chosen.pop()
            length = item[4] - item[3]
            keep = max(0, length - surplus)
            self._hold((*item[:3], item[3] + keep, item[4]))
            if keep:
                chosen.append((*item[:3], item[3], item[3] + keep))
            surplus -= length - keep

    def _emit(self, chosen: list[tuple]) -> None:
        offset = 0
        for item in chosen:
            document, ids, _, start, end = item
            piece = ids[start:end].astype("<u4").tobytes()
            self.out.append((document, start, end - start, zlib.crc32(piece), len(ids), self.sequence, offset,
                             self._loss_of(item, start, end), piece))
            offset += end - start
        self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096,
                   segments: int = 64, loss: int | None = None, loss_from: str | None = None,
                   with_ids: bool = True) -> DataFrame:
    """Packs every document (doc_id, text) into sequences of at most `capacity` tokens.

    Returns one row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens (with
    the end id), sequence_id, offset (gapless from 0 in its sequence), loss_tokens and, on demand, ids as little-endian
    32-bit values. `loss_from` names a column with the first token that bears loss, as in instruction data (null or
    none: all tokens do). A sequence holds at most `segments` pieces and `loss` loss-bearing tokens.

    Each task tokenizes and packs what it reads, with a bounded pool: no shuffle, no group, and a document may be cut.
    Sequences are full or a power of two, so nothing is padded. Null and empty text: the end id alone. Null doc_id is
    kept as null; repeated rows are packed as separate documents; an empty table gives no rows; other columns are
    ignored. Sequence ids come from the partition's number, so a repeated task gives the same rows.
    """
    path = tokenizer or default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        packer = VectorPacker(capacity, segments, loss, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[] for _ in range(len(_FIELDS) + 1)]
            packer.out.clear()
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=False)]
            names = [n for n, _ in _FIELDS]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[-1], pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in pieces(batches, "text", TOKEN_BYTES):
            ids, places = words.encode(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            first = batch.column("first").to_pylist()
            for i, name in enumerate(names):
                own = np.append(ids[places[i]:places[i + 1]], np.uint32(end_id))
                packer.add(name, own, min(max(first[i] or 0, 0), len(own)))
            yield rows()
        packer.close()
        yield rows()

    first = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), first.alias("first"))
    schema = ", ".join(f"{n} long" for n, _ in _FIELDS) + (", ids binary" if with_ids else "")
    return chosen.mapInArrow(pack, schema)
