"""Near-duplicate passages through compact windows: Cartesian trees over min-hashes of word shingles."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Words, free_name, mix, pieces, remove, written, written_at

#: Words in a shingle, least words of a passage, hash functions, hash functions that must agree, least similarity.
SHINGLE, PASSAGE, HASHES, ENOUGH, SIMILARITY = 5, 50, 4, 2, 0.8
#: Windows of a task that are grouped before they are shuffled; shingles looked at together.
GROUPED, SEGMENT = 1 << 20, 1 << 22
#: Links of two documents in one row.
LINKED = 256
#: Runs of shared shingles that are chained one by one.
FEW_RUNS = 16
#: Document ids, 8 bytes each, that may be broadcast.
BROADCAST_IDS = 500_000
_LOW = np.uint64((1 << 24) - 1)
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts end to end, and the n + 1 places where the texts begin."""
    counts = np.maximum(np.diff(words.docs) - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(words.docs[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words.hashes[at + k]
    return mix(out), offsets


def compact_windows(hashed: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (left, centre, right) of each text's Cartesian tree that span `least` positions or more.

    All stretches within [left, right] that hold the centre have its hash as their minimum, so one node stands for all
    of them. Such a node is the minimum of some stretch of `least` positions; the ends are the next smaller values,
    which are nodes of that kind themselves. Ties go to the left.
    """
    ends = np.repeat(offsets[1:], np.diff(offsets))
    chosen = np.zeros(len(hashed), dtype=bool)
    for begin in range(0, len(hashed), SEGMENT):
        part = hashed[begin:begin + SEGMENT + least - 1]
        valid = np.arange(begin, min(begin + SEGMENT, begin + len(part))) + least <= ends[begin:begin + SEGMENT]
        low = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= least:  # minima of stretches of 2, 4, 8, ... positions
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        if least > width:
            low = np.minimum(low[:width - least], low[least - width:]) if len(low) > least - width else low[:0]
        chosen[begin + (low[:len(valid)][valid[:len(low)]] & _LOW).astype(np.int64)] = True
    centre = np.flatnonzero(chosen)
    value = hashed[centre] & ~_LOW
    text = np.searchsorted(offsets, centre, "right") - 1
    n = len(centre)
    left = np.arange(n) - 1
    left[np.concatenate([[True], text[1:] != text[:-1]])[:n]] = -1
    right = np.arange(n) + 1
    right[np.concatenate([text[1:] != text[:-1], [True]])[:n]] = n
    value_of = np.append(value, 0)
    while True:  # everything between a pointer and its owner is larger, so a larger neighbour can be jumped over
        jump = np.flatnonzero((left >= 0) & (value_of[left] > value))
        if not len(jump):
            break
        left[jump] = left[left[jump]]
    while True:
        jump = np.flatnonzero((right < n) & (value_of[right] >= value))
        if not len(jump):
            break
        right[jump] = right[right[jump]]
    place = np.append(centre, 0)
    return np.where(left < 0, offsets[text], place[left] + 1), centre, np.where(right >= n, offsets[text + 1] - 1, place[right] - 1)


#: A window (dest, sig, doc, pos) or the links of a document with an earlier one (dest, doc, rep, and a place in each list for a link).
_ROW = "dest long, sig long, doc long, pos long, rep long, kinds array<tinyint>, here array<long>, there array<long>"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("dest", "sig", "doc", "pos", "rep")]
                    + [("kinds", pa.list_(pa.int8())), ("here", pa.list_(pa.int64())), ("there", pa.list_(pa.int64()))])


def _open_rows(sig: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Windows; their lists are empty and not null, as null lists cost Spark's Arrow writer time with the square of a batch."""
    columns = [pa.array(c.astype(np.int64)) for c in (sig, sig, doc, pos)] + [pa.nulls(len(sig), pa.int64())]
    ends = pa.array(np.zeros(len(sig) + 1, dtype=np.int32))
    return pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(ends, pa.array([], f.type.value_type)) for f in list(_SCHEMA)[5:]], schema=_SCHEMA)


def _link_rows(sig: np.ndarray, doc: np.ndarray, pos: np.ndarray, rep: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Links of windows, those of one pair of documents together in rows of at most LINKED."""
    order = np.lexsort((pos, rep, doc))
    sig, doc, pos, rep, at = (x[order].astype(np.int64) for x in (sig, doc, pos, rep, at))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1])])[:len(doc)]
    number = np.arange(len(doc))
    new |= (number - np.maximum.accumulate(np.where(new, number, 0))) % LINKED == 0
    start = np.flatnonzero(new)
    ends = pa.array(np.append(start, len(doc)).astype(np.int32))
    none = pa.nulls(len(start), pa.int64())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((sig & 63).astype(np.int8), pos, at)]
    return pa.RecordBatch.from_arrays([pa.array(mix(doc[start].astype(np.uint64)).view(np.int64)), none, pa.array(doc[start]), none, pa.array(rep[start]), *lists], schema=_SCHEMA)


def _grouped(sig: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by signature, document and place, and for each of them the place of its group's first row."""
    order = np.lexsort((pos, doc, sig))
    s = sig[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])[:len(s)]
    return order, np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else order


def _windows(docs: DataFrame, shingle: int, least: int, hashes: int) -> DataFrame:
    """Windows of all documents, grouped within the task before they are dealt out by signature.

    A row without `rep` is a window. Of a signature's windows in a task only those of its first document go on; the
    others are linked with it at once. So a passage that a third of all documents share sends few rows per task.
    pos is centre, left and right reach (up to 65,535 each) in 32, 16 and 16 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = _grouped(sig, doc, pos)
            sig, doc, pos = sig[order], doc[order], pos[order]
            own = doc == doc[first]
            yield _open_rows(sig[own], doc[own], pos[own])
            other = ~own
            yield _link_rows(sig[other], doc[other], pos[other], doc[first][other], pos[first][other] >> 32)

        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(Words(batch.column("text")), shingle)
            ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
            for k in range(hashes):
                own = mix(hashed ^ _SEEDS[k])
                left, centre, right = compact_windows(own, offsets, least)
                text = np.searchsorted(offsets, centre, "right") - 1
                reach = np.minimum(centre - left, 65535) << 16 | np.minimum(right - centre, 65535)
                sig = ((own[centre] & ~np.uint64(63)) | np.uint64(k)).view(np.int64)
                held.append((sig, ids[text], (centre - offsets[text]) << 32 | reach))
            if sum(len(x[0]) for x in held) >= GROUPED:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _ROW)


def _star(rows: DataFrame, silent: bool = False) -> DataFrame:
    """Links of windows with the first document of their signature; links made before pass.

    With `silent`, rows with an odd pos can be the first of a signature but are not linked themselves.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "dest").sortWithinPartitions("sig", "doc", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = None  # signature, document and place of the group that is open
        for batch in batches:
            made = np.asarray(batch.column("rep").is_valid())
            if made.any():
                yield batch.filter(pa.array(made))
            open_ = batch.filter(pa.array(~made))
            if not open_.num_rows:
                continue
            sig, doc, pos = (np.asarray(open_.column(c), dtype=np.int64) for c in ("sig", "doc", "pos"))
            if rep is not None:
                sig, doc, pos = np.append(rep[0], sig), np.append(rep[1], doc), np.append(rep[2], pos)
            start = np.concatenate([[True], sig[1:] != sig[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))
            rep = (sig[-1], doc[first[-1]], pos[first[-1]])
            other = doc != doc[first]
            if silent:
                other &= pos & 1 == 0
            if other.any():
                yield _link_rows(sig[other], doc[other], pos[other], doc[first][other], pos[first][other] >> 32)

    return dealt.mapInArrow(run, _ROW)


def _enough(doc: np.ndarray, sig: np.ndarray, pos: np.ndarray, least: int, enough: int) -> np.ndarray:
    """Windows that overlap in `least` positions with windows of so many hash functions, their own included.

    Rows are in order of document and centre. Windows that overlap so far and hold both centres in one stretch have
    centres less than `least` apart, so the join looks ahead only that far.
    """
    centre = pos >> 32
    low, high = centre - (pos >> 16 & 65535), centre + (pos & 65535)
    kinds = np.uint64(1) << (sig & 63).astype(np.uint64)
    seen = kinds.copy()
    if enough <= 1:
        return np.ones(len(doc), dtype=bool)
    for shift in range(1, len(doc)):
        near = np.flatnonzero((doc[shift:] == doc[:-shift]) & (centre[shift:] - centre[:-shift] < least))
        if not len(near):
            break
        joined = near[np.minimum(high[near], high[near + shift]) - np.maximum(low[near], low[near + shift]) + 1 >= least]
        seen[joined] |= kinds[joined + shift]
        seen[joined + shift] |= kinds[joined]
    return np.bitwise_count(seen) >= enough


def _candidates(links: DataFrame, least: int, enough: int) -> DataFrame:
    """One row for each pair of documents that share windows: doc, rep and the places of the shared centres."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.select("doc", "rep", "kinds", "here", "there").repartition(parts, "doc").sortWithinPartitions("doc")
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), dtype=np.int64)

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            rows = rows[_enough(rows[:, 0], rows[:, 2], rows[:, 1], least, enough)] if len(rows) else rows
            doc, rep, here, there = rows[:, 0], rows[:, 3], rows[:, 1] >> 32, rows[:, 4]
            order = np.lexsort((there, here, rep, doc))
            rows = np.stack([doc[order], rep[order], here[order], there[order]], axis=1)
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[:len(rows)]]
            start = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[:len(rows)])
            ends = np.append(start, len(rows)).astype(np.int32)
            columns = [pa.array(rows[start, 0]), pa.array(rows[start, 1])] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[:, k].copy())) for k in (2, 3)]
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema([("doc", pa.int64()), ("rep", pa.int64()), ("here", lists), ("there", lists)]))

        for batch in batches:
            n = np.asarray(pc.list_value_length(batch.column("here")))
            doc, rep = (np.repeat(np.asarray(batch.column(c), dtype=np.int64), n) for c in ("doc", "rep"))
            here, kinds, there = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("here", "kinds", "there"))
            held = np.concatenate([held, np.stack([doc, here, kinds, rep, there], axis=1)])
            if len(held) < 1 << 16:
                continue
            last = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last document may go on in the next batch
            if last:
                yield pairs(held[:last])
                held = held[last:]
        if len(held):
            yield pairs(held)

    return dealt.mapInArrow(run, "doc long, rep long, here array<long>, there array<long>")


def _regions(pairs: DataFrame, shingle: int, least: int) -> DataFrame:
    """Replaces the text of the earlier document by the shingles around the shared places, 32 bits of each.

    On both sides that is as much as the places span and four times the least passage: a longer similar stretch has
    shared places of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(Words(batch.column("text")), shingle)
            starts, parts = [], []
            for i, there in enumerate(batch.column("there").to_pylist()):
                reach = max(there) - min(there) + 4 * least
                low = max(0, min(there) - reach)
                starts.append(low)
                part = hashed[offsets[i] + low:min(offsets[i + 1], offsets[i] + max(there) + reach)]
                parts.append((part >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", "rep", "here", "there")), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
                ["doc", "rep", "here", "there", "low", "region"])

    return pairs.mapInArrow(run, "doc long, rep long, here array<long>, there array<long>, low long, region binary")


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal."""
    n, begin, size = min(len(a), len(b)), 0, 128
    while begin < n:
        end = min(n, begin + size)
        differ = a[begin:end] != b[begin:end]
        at = int(differ.argmax())
        if differ[at]:
            return begin + at
        begin, size = end, 4 * size
    return n


def _shared_runs(a: np.ndarray, b: np.ndarray, furthest: float) -> np.ndarray:
    """Runs (start in a, start in b, length) of values that two sequences share, joined by value and cut to maximal runs.

    A value that b repeats is joined where it is nearest to the same place, before and after it. Runs whose places
    differ by more than `furthest` are left out: no passage can bridge that.
    """
    keys = np.sort(b.astype(np.uint64) << np.uint64(32) | np.arange(len(b), dtype=np.uint64))
    wanted = a.astype(np.uint64) << np.uint64(32) | np.arange(len(a), dtype=np.uint64)
    at = np.searchsorted(keys, wanted)
    rows = []
    for near in (at, at - 1):
        inside = np.flatnonzero((near >= 0) & (near < len(keys)))
        inside = inside[keys[near[inside]] >> np.uint64(32) == a[inside]]
        rows.append(np.stack([inside, (keys[near[inside]] & np.uint64(0xFFFFFFFF)).astype(np.int64)]))
    x, y = np.concatenate(rows, axis=1)
    close = np.abs(y - x) <= furthest
    x, y = x[close], y[close]
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.concatenate([[True], (y[1:] - x[1:] != y[:-1] - x[:-1]) | (x[1:] - x[:-1] != 1)])[:len(x)])
    x, y, n = x[start], y[start], np.append(start[1:], len(x)) - start
    # most runs are maximal as they are
    longer = (x > 0) & (y > 0) & (a[x - 1] == b[y - 1])
    ends_x, ends_y = x + n, y + n
    inside = (ends_x < len(a)) & (ends_y < len(b))
    longer |= inside & (a[np.minimum(ends_x, len(a) - 1)] == b[np.minimum(ends_y, len(b) - 1)])
    if not longer.any():
        return np.array([x, y, n]).T
    runs = {}
    for p, q, n, grows in zip(x.tolist(), y.tolist(), n.tolist(), longer.tolist(), strict=True):
        back = _run(a[:p][::-1], b[:q][::-1]) if grows else 0
        runs[p - back, q - back] = n + back + (_run(a[p + n:], b[q + n:]) if grows else 0)
    return np.array([(p, q, n) for (p, q), n in runs.items()], dtype=np.int64).reshape(-1, 3)


def _chains(x: list[int], y: list[int], n: list[int], ends_x: list[int], ends_y: list[int], similarity: float) -> tuple[list[float], list[int]]:
    """What the best chain up to each of a few runs is worth, and its matches; the first are those of no run."""
    worth, matched = [0.0], [0]
    for k, (p, q, size) in enumerate(zip(x, y, n, strict=True)):
        best, at, gain = float("-inf"), 0, size
        for j in range(k + 1):
            cut = max(ends_x[j] - p, ends_y[j] - q, 0)  # of a run that begins too early
            if cut < size:
                value = worth[j] - similarity * (p + q + 2 * cut - ends_x[j] - ends_y[j]) + (1 - similarity) * (size - cut)
                if value > best:
                    best, at, gain = value, j, size - cut
        worth.append(best)
        matched.append(matched[at] + gain)
    return worth, matched


def _stops(a: np.ndarray, b: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Where a passage from the starts of two sequences may end: rows of values used of each and matches.

    Jaccard ratio m / (p + q - m) >= s is (1 + s) m >= s (p + q): a match is worth 1 - s and a value without one costs
    s. For each run of shared values, the row has the chain of runs up to it that is worth most. `most` is the number
    of matches that a passage can have at all, before the starts too, so an edit may not cost more than they are worth.
    """
    run = _run(a, b)
    if run in (len(a), len(b)):
        return np.array([[run, run, run]])
    runs = _shared_runs(a[run:], b[run:], (1 - similarity) * most / similarity + 1e-6)
    if not len(runs):
        return np.array([[run, run, run]])
    runs = runs[np.argsort(runs[:, 0] + runs[:, 2], kind="stable")]
    return _chain_ends(*runs.T, run, similarity, most)


def _chain_ends(x: np.ndarray, y: np.ndarray, n: np.ndarray, run: int, similarity: float, most: int) -> np.ndarray:
    """The rows of `_stops` of runs in order of their ends, behind `run` matches."""
    ends_x, ends_y = np.append(0, x + n), np.append(0, y + n)
    worth, matched = np.full(len(x) + 1, -np.inf), np.zeros(len(x) + 1, dtype=np.int64)
    worth[0] = 0
    if len(x) <= FEW_RUNS:  # too few for arrays to pay
        worth, matched = map(np.array, _chains(*(c.tolist() for c in (x, y, n, ends_x, ends_y)), similarity))
    for k in range(len(x) if len(x) > FEW_RUNS else 0):
        cut = np.maximum(np.maximum(ends_x[:k + 1] - x[k], ends_y[:k + 1] - y[k]), 0)  # of a run that begins too early
        gap = x[k] + y[k] + 2 * cut - ends_x[:k + 1] - ends_y[:k + 1]
        value = np.where(cut < n[k], worth[:k + 1] - similarity * gap + (1 - similarity) * (n[k] - cut), -np.inf)
        best = int(value.argmax())
        worth[k + 1], matched[k + 1] = value[best], matched[best] + n[k] - cut[best]
    usable = worth + (1 - similarity) * most >= -1e-6
    return np.stack([ends_x + run, ends_y + run, matched + run], axis=1)[usable]


def _bounds(sums: np.ndarray, x: int, reach: int) -> tuple[int, int]:
    """The stretch around x, at most `reach` to each side, whose ends some stretch that holds x reaches with a sum of 0."""
    low, high = max(0, x - reach), min(len(sums) - 1, x + reach)
    before, after = sums[low:x + 1], sums[x:high + 1]
    high -= int((after[::-1] >= before.min() - 1e-6).argmax())
    return low + int((before <= after.max() + 1e-6).argmax()), high


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a are in b, not empty."""
    keys = np.sort(b)
    return keys[np.minimum(np.searchsorted(keys, a), len(keys) - 1)] == a


def _keys(values: np.ndarray) -> np.ndarray:
    """Values and their places in one number."""
    return values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64)


def _distances(keys: np.ndarray, sorted_keys: np.ndarray, shift: int) -> np.ndarray:
    """How far each value's place, moved by `shift`, is from the nearest place of that value in the other sequence."""
    place = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) + shift
    value = keys >> np.uint64(32)
    at = np.searchsorted(sorted_keys, value << np.uint64(32) | np.maximum(place, 0).astype(np.uint64))
    out = np.full(len(keys), np.iinfo(np.int64).max)
    for near in (np.minimum(at, len(sorted_keys) - 1), np.maximum(at - 1, 0)):
        found = sorted_keys[near]
        far = np.abs((found & np.uint64(0xFFFFFFFF)).astype(np.int64) - place)
        out = np.where(found >> np.uint64(32) == value, np.minimum(out, far), out)
    return out


def _possible(near: np.ndarray, other: np.ndarray, x: int, y: int, least: int, similarity: float, most: int) -> bool:
    """Whether a passage that holds the places x and y may be long enough.

    `near` and `other` are how far each value of both sequences is from its match along the passage. A passage of at most
    `most` matches has no match further away than the edits it can pay for, and fewer near values leave a shorter passage.
    """
    while True:
        furthest = (1 - similarity) * most / similarity + 1e-6
        inside = other <= furthest
        first, last = _spanned(inside, _sums(inside, similarity), y, int(len(near) / similarity) + 1)
        if last - first < similarity * least:
            return False
        inside = near <= furthest
        low, high = _spanned(inside, _sums(inside, similarity), x, int((last - first) / similarity) + 1)
        if high - low < least:
            return False
        now = min(high - low, last - first)
        if now > 0.9 * most:
            return True
        near, other, x, y, most = near[low:high], other[first:last], x - low, y - first, now


def _sums(shared: np.ndarray, similarity: float) -> np.ndarray:
    """Running sums of shared values less `similarity`."""
    out = np.zeros(len(shared) + 1)
    np.cumsum(shared - similarity, out=out[1:])
    return out


def _spanned(shared: np.ndarray, sums: np.ndarray, x: int, reach: int) -> tuple[int, int]:
    """`_bounds` of shared values, cut to the first and last of them, as passages begin and end with a match."""
    low, high = _bounds(sums, x, reach)
    own = shared[low:high]
    return (low + int(own.argmax()), high - int(own[::-1].argmax())) if own.any() else (x, x)


class Joined:
    """Where the values of a are in b, none of which b repeats: runs (start in a, start in b, length) in order of a."""

    def __init__(self, size: int, other: int, pos: np.ndarray) -> None:
        self.size, self.other, self.pos = size, other, pos
        x = np.flatnonzero(pos >= 0)
        y = pos[x]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] - x[:-1] != 1) | (y[1:] - y[:-1] != 1)])[:len(x)])
        self.x, self.y, self.n = x[new], y[new], np.diff(new, append=len(x))
        self.lists = self.x.tolist(), self.y.tolist(), self.n.tolist()

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """Which values of a and of b the other has."""
        own = self.pos >= 0
        other = np.zeros(self.other, dtype=bool)
        other[self.pos[own]] = True
        return own, other

    def at(self, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of places that are shared, in order, and the run of each."""
        inside = (here >= 0) & (here < self.size) & (there >= 0) & (there < self.other)
        here, there = here[inside], there[inside]
        shared = self.pos[here] == there
        here, there = here[shared], there[shared]
        order = np.lexsort((there, here))
        return here[order], there[order], np.searchsorted(self.x, here[order], "right") - 1

    def _stops(self, run: int, size: int, other: int, runs: list[tuple[int, int, int]], similarity: float, most: int) -> list[tuple[int, int, int]]:
        """What `_stops` returns, of runs by their ends; as tuples if they are few. They are cut to the sizes and to what follows `run`."""
        furthest = (1 - similarity) * most / similarity + 1e-6
        kept = []
        for p, q, n in runs:
            if abs(q - p) <= furthest:
                cut = max(run - q, 0)
                n = min(n, size - p, other - q) - cut
                if n > 0:
                    kept.append((p + cut - run, q + cut - run, n))
        if not kept:
            return [(run, run, run)]
        x, y, n = zip(*kept, strict=True)
        if len(kept) > FEW_RUNS:
            return [tuple(r) for r in _chain_ends(np.array(x), np.array(y), np.array(n), run, similarity, most).tolist()]
        ends_x, ends_y = [0] + [p + k for p, k in zip(x, n, strict=True)], [0] + [q + k for q, k in zip(y, n, strict=True)]
        worth, matched = _chains(x, y, n, ends_x, ends_y, similarity)
        return [(p + run, q + run, m + run) for p, q, m, w in zip(ends_x, ends_y, matched, worth, strict=True) if w + (1 - similarity) * most >= -1e-6]

    def ahead(self, r: int, x: int, y: int, high: int, last: int, similarity: float, most: int) -> list[tuple[int, int, int]]:
        """Where a passage from the places x and y of run r may end."""
        xs, ys, ns = self.lists
        size, other = high - x, last - y
        run = min(xs[r] + ns[r] - x, size, other)
        if run in (size, other):
            return [(run, run, run)]
        end = bisect_left(xs, high, r + 1)
        return self._stops(run, size, other, [(xs[k] - x, ys[k] - y, ns[k]) for k in range(r + 1, end)], similarity, most)

    def behind(self, r: int, x: int, y: int, low: int, first: int, similarity: float, most: int) -> list[tuple[int, int, int]]:
        """Where a passage that ends at the places x and y of run r may begin, counted backwards."""
        xs, ys, ns = self.lists
        size, other = x - low, y - first
        run = min(x - xs[r], size, other)
        if run in (size, other):
            return [(run, run, run)]
        begin = max(bisect_right(xs, low, 0, r) - 1, 0)
        return self._stops(run, size, other, [(x - xs[k] - ns[k], y - ys[k] - ns[k], ns[k]) for k in range(r - 1, begin - 1, -1)], similarity, most)


def join(a: np.ndarray, b: np.ndarray) -> Joined | None:
    """The values of a joined with those of b, unless b repeats one that a has."""
    if not (len(a) and len(b)):
        return Joined(len(a), len(b), np.full(len(a), -1))
    order = np.argsort(b)
    keys = b[order]
    at = np.searchsorted(keys, a)
    at[at == len(keys)] = 0
    shared = keys[at] == a
    if (keys[1:] == keys[:-1]).any():
        again = np.append(keys[1:] == keys[:-1], False)
        if again[at[shared]].any():
            return None
    return Joined(len(a), len(b), np.where(shared, order[at], -1))


def _longest(ahead: list[tuple[int, int, int]], behind: list[tuple[int, int, int]], least: int, similarity: float) -> tuple | None:
    """The longest passage of two ends that is similar enough: the stops on both sides and the similarity."""
    if len(ahead) * len(behind) > FEW_RUNS:
        p, q = np.array(ahead), np.array(behind)
        i, j, m = (np.add.outer(p[:, k], q[:, k]) for k in range(3))
        ratio = m / np.maximum(i + j - m, 1)
        size = np.where((i >= least) & (ratio >= similarity), i + j, -1)
        best = np.unravel_index(int(size.argmax()), size.shape)
        return None if size[best] < 0 else (ahead[best[0]], behind[best[1]], float(ratio[best]))
    found, most = None, -1
    for f in ahead:
        for g in behind:
            i, size, m = f[0] + g[0], f[0] + g[0] + f[1] + g[1], f[2] + g[2]
            if i >= least and size > most and m / max(size - m, 1) >= similarity:
                found, most = (f, g, m / max(size - m, 1)), size
    return found


def align_joined(joined: Joined, here: np.ndarray, there: np.ndarray, least: int, similarity: float) -> list[tuple]:
    """The passages of `align`, whose runs of shared values are worked out once for all places of a pair of documents."""
    found: list[tuple] = []
    xs, ys, rs = joined.at(here, there)
    if not len(xs):
        return found
    own, other = joined.shared()
    sums, other_sums = _sums(own, similarity), _sums(other, similarity)
    done = -1  # runs are in order, and one is tried once
    for x, y, r in zip(xs.tolist(), ys.tolist(), rs.tolist(), strict=True):
        if r == done or any(p[0] <= x < p[1] and p[2] <= y < p[3] for p in found):
            continue
        done = r
        first, last = _spanned(other, other_sums, y, int(joined.size / similarity) + 1)
        if last - first < similarity * least:
            continue
        low, high = _spanned(own, sums, x, int((last - first) / similarity) + 1)
        if high - low < least:
            continue
        reach = int((high - low) / similarity) + 1
        most = min(high - low, last - first)
        ahead = joined.ahead(r, x, y, high, min(y + reach, last), similarity, most)
        behind = joined.behind(r, x, y, low, max(first, y - reach), similarity, most)
        best = _longest(ahead, behind, least, similarity)
        if best is not None:
            f, g, ratio = best
            found.append((x - g[0], x + f[0], y - g[1], y + f[1], ratio))
    return found


def align(a: np.ndarray, b: np.ndarray, here: list[int], there: list[int], least: int, similarity: float) -> list[tuple]:
    """Passages (start, end, start there, end there, similarity) in shingles, grown from shared places and verified.

    Similarity is the Jaccard ratio of the aligned shingles; of the ends it allows the longest passage is taken, however
    long the edits within. A passage has at least `least` shingles.
    """
    found: list[tuple] = []
    tried: dict[int, int] = {}  # ends of the last runs by the difference of their places
    # a shingle that b lacks costs `similarity` and no other brings more than the rest: bounds of what can be similar;
    # a repeated shingle of one side may be alone on the other, so both sides are bounded
    if not (len(a) and len(b)):
        return found
    own, other = _among(a, b), _among(b, a)
    sums, other_sums = _sums(own, similarity), _sums(other, similarity)
    keys = [_keys(v) for v in (a, b)]
    in_order = [np.sort(k) for k in keys]
    for x, y in sorted(zip(here, there, strict=True)):
        if not (0 <= x < len(a) and 0 <= y < len(b)) or a[x] != b[y] or x < tried.get(y - x, 0):
            continue
        if any(p[0] <= x < p[1] and p[2] <= y < p[3] for p in found):
            continue
        tried[y - x] = x + _run(a[x:], b[y:])
        first, last = _spanned(other, other_sums, y, int(len(a) / similarity) + 1)
        if last - first < similarity * least:
            continue
        low, high = _spanned(own, sums, x, int((last - first) / similarity) + 1)  # a longer stretch is less similar to all of b's
        if high - low < least:
            continue
        reach = int((high - low) / similarity) + 1
        most = min(high - low, last - first)
        if not _possible(_distances(keys[0][low:high], in_order[1], y - x), _distances(keys[1][first:last], in_order[0], x - y), x - low, y - first, least, similarity, most):
            continue
        ahead = _stops(a[x:high], b[y:min(y + reach, last)], similarity, most)
        behind = _stops(a[low:x][::-1], b[max(first, y - reach):y][::-1], similarity, most)
        i, j, m = (np.add.outer(ahead[:, k], behind[:, k]) for k in range(3))
        ratio = m / np.maximum(i + j - m, 1)
        size = np.where((i >= least) & (ratio >= similarity), i + j, -1)
        best = np.unravel_index(int(size.argmax()), size.shape)
        if size[best] < 0:
            continue
        f, g = ahead[best[0]], behind[best[1]]
        found.append((x - int(g[0]), x + int(f[0]), y - int(g[1]), y + int(f[1]), float(ratio[best])))
    return found


def _passages(a: np.ndarray, b: np.ndarray, here: np.ndarray, there: np.ndarray, least: int, similarity: float) -> tuple[list[tuple], np.ndarray]:
    """Passages of two documents, and the linked places that they leave unsettled."""
    joined = join(a, b)
    if joined is None:
        here, there = here.tolist(), there.tolist()
        found = align(a, b, here, there, least, similarity)
        return found, _unsettled(a, b, here, there, least, [(p[0], p[1]) for p in found])
    found = align_joined(joined, here, there, least, similarity)
    return found, _unsettled_joined(joined, here, there, least, [(p[0], p[1]) for p in found])


def near_duplicate_passages(docs: DataFrame, shingle: int = SHINGLE, passage: int = PASSAGE, hashes: int = HASHES,
                            enough: int = ENOUGH, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of `passage` words or more that are near-duplicates of one in a document with a smaller doc_id.

    Returns doc_id, start and end (words), kept_doc_id, kept_start and kept_end of the earlier passage, similarity (of
    aligned word shingles, at least `similarity`). One passage may have several earlier ones; the first document of a
    group is only ever named as kept. Exact repetitions of that length always share all windows; others are found when
    at least `enough` of the hash functions agree on overlapping windows, and are verified on the whole texts.

    Windows with one signature are linked with the first document that has it, so a group of n costs n links. Places of
    links that are not settled, and those of the first documents there, are grouped again by longer keys, and once more
    by whole passages where those fail as well (`_regrouped`), whose links cannot fail. Lower-cased words
    parted by ASCII white space count. Rows without doc_id, null, empty and short texts have no passages; rows with one
    doc_id are one document (of different texts, the least counts); an empty table gives no rows; other columns are
    ignored.
    """
    least = passage - shingle + 1
    texts = _texts(docs)
    columns = ["doc_id", "start", "end", "kept_doc_id", "kept_start", "kept_end", "similarity"]

    def verified(links: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
        out = written(_verified(_candidates(links, least, kinds), texts, shingle, least, similarity), "passages")
        return out, out.where("open is null").select(*columns)

    first, found = verified(_star(_windows(texts, shingle, least, hashes)), enough)
    again, path = written_at(_star(_regrouped(first, found, texts, shingle, least), silent=True), "again")
    second, more = verified(again, 1)
    found = found.union(_beyond(more, found))
    third, more = verified(_star(_regrouped(second, found, texts, shingle, least, _far(again)), silent=True), 1)
    remove(docs.sparkSession, path)
    return found.union(_beyond(more, found)).distinct()


def _far(links: DataFrame) -> DataFrame:
    """Places of each document (doc, f) that were linked by the longer stretches (pos & 2); lists of links stay lists."""
    longer = F.transform(F.filter("here", lambda p: p.bitwiseAND(F.lit(2)) == 2), lambda p: F.shiftright(p, 32))
    rows = links.select("doc", F.array_distinct(longer).alias("f")).where("size(f) > 0")
    return rows.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("f"))).alias("f"))


def _beyond(more: DataFrame, found: DataFrame) -> DataFrame:
    """The passages that do not lie within one that was found before."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    inside = F.exists("spans", lambda p: (p["start"] <= F.col("start")) & (F.col("end") <= p["end"]))
    return more.join(spans, "doc_id", "left").where(F.col("spans").isNull() | ~inside).select(*more.columns)


def _repeated(docs: DataFrame) -> bool:
    return docs.where("doc_id is not null and text is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text")) if _repeated(docs) else rows


_VERIFIED = ("doc_id long, start long, end long, kept_doc_id long, kept_start long, kept_end long, similarity double, "
             "open array<long>, shingles array<long>")


def _verified(candidates: DataFrame, texts: DataFrame, shingle: int, least: int, similarity: float) -> DataFrame:
    """Verified passages, and rows with the linked places of a document, and shingles there, that are not settled.

    A place is settled if all stretches of `least` shingles that hold it lie in a passage found for the link and the
    earlier document has them unchanged: whoever has such a stretch too shares it with the earlier document.
    """
    candidates = written(candidates, "pairs")
    involved = candidates.select(F.col("doc").alias("doc_id")).union(candidates.select("rep")).distinct()
    # ids that are known to be few are broadcast, so that only the texts they name are shuffled
    few = involved.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(involved) if few else involved, "doc_id", "left_semi")
    there = texts.select(F.col("doc_id").alias("rep"), "text")
    here = texts.select(F.col("doc_id").alias("doc"), "text")
    pairs = _regions(candidates.join(there, "rep").select("doc", "rep", "here", "there", "text"), shingle, least)
    pairs = pairs.join(here, "doc").select("doc", "rep", "here", "there", "low", "region", "text")
    lists = pa.list_(pa.int64())
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "end", "kept_doc_id", "kept_start", "kept_end")]
                      + [("similarity", pa.float64()), ("open", lists), ("shingles", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(Words(batch.column("text")), shingle)
            short, out = (hashed >> np.uint64(32)).astype("<u4"), []
            columns = [batch.column(c).to_pylist() for c in ("doc", "rep", "low", "region")]
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch.column("here"))))])
            here, there = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("here", "there"))
            for i, (doc, rep, low, region) in enumerate(zip(*columns, strict=True)):
                a, b = short[offsets[i]:offsets[i + 1]], np.frombuffer(region, dtype="<u4")
                here_, there_ = here[ends[i]:ends[i + 1]], there[ends[i]:ends[i + 1]] - low
                found, x = _passages(a, b, here_, there_, least, similarity)
                out += [(doc, p[0], p[1] + shingle - 1, rep, p[2] + low, p[3] + low + shingle - 1, p[4], None, None) for p in found]
                if len(x):
                    out.append((doc, None, None, rep, None, None, None, x.tolist(), hashed[offsets[i] + x].view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return pairs.mapInArrow(run, _VERIFIED)


def _open(x: np.ndarray, n: int, least: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which places of n shingles are in a stretch of `least` shingles that no span (start, end) holds whole."""
    low, high = np.maximum(x - least + 1, 0), np.minimum(x + least, n)
    open_ = high - low >= least
    for a, b in spans:
        open_ &= (low < a) | (high > b)
    if open_.any() and len(spans) > 1:  # spans may hold all stretches between them
        covered = np.zeros(n + 1, dtype=np.int64)
        for a, b in spans:
            if b - a >= least:
                covered[a] += 1
                covered[b - least + 1] -= 1
        free = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:max(n - least + 1, 0)] == 0)])
        at = np.flatnonzero(open_)
        open_[at] = free[np.minimum(x[at], n - least) + 1] > free[low[at]]
    return open_


def _unsettled_joined(joined: Joined, here: np.ndarray, there: np.ndarray, least: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The places of `_unsettled`."""
    x, _, r = joined.at(here, there)
    low, high = joined.x[r], joined.x[r] + joined.n[r]
    exact = x[(low <= np.maximum(x - least + 1, 0)) & (high >= np.minimum(x + least, joined.size))]
    x = np.unique(here[here < joined.size])
    open_ = _open(x, joined.size, least, spans)
    settled = np.zeros(joined.size, dtype=bool)
    settled[exact] = True
    return x[open_ | ~settled[x]]


def _unsettled(a: np.ndarray, b: np.ndarray, here: list[int], there: list[int], least: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Linked places of a with a stretch of `least` shingles that no span holds or that b has not at the linked place."""
    runs: dict[int, tuple[int, int]] = {}
    exact = set()
    for x, y in sorted(zip(here, there, strict=True)):
        if not (0 <= x < len(a) and 0 <= y < len(b)):
            continue
        first, last = runs.get(y - x, (0, 0))
        if x >= last:
            first, last = runs[y - x] = x - _run(a[:x][::-1], b[:y][::-1]), x + _run(a[x:], b[y:])
        if first <= max(0, x - least + 1) and last >= min(len(a), x + least):
            exact.add(x)
    x = np.unique(np.asarray(here, dtype=np.int64))
    x = x[x < len(a)]
    return x[_open(x, len(a), least, spans) | ~np.isin(x, list(exact))]


def _entrants(verified: DataFrame, far: DataFrame | None) -> DataFrame:
    """Documents of the next grouping: places x of their own, and shingles s that are unsettled where they are first.

    With `far` (doc, f), only the places named there count.
    """
    rows = verified.where("open is not null").select(F.col("doc_id").alias("doc"), F.col("kept_doc_id").alias("rep"), F.col("open").alias("x"), F.col("shingles").alias("s"))
    rows = rows.withColumn("f", F.array().cast("array<long>")) if far is None else rows.join(far, "doc").select("doc", "rep", "x", "s", "f")
    limited = far is not None
    lists = pa.list_(pa.int64())
    schema = pa.schema([("doc", pa.int64()), ("x", lists), ("s", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, rep, x, s, f in zip(*(batch.column(c).to_pylist() for c in ("doc", "rep", "x", "s", "f")), strict=True):
                if limited:
                    f = set(f)
                    s = [b for a, b in zip(x, s, strict=True) if a in f]
                    x = [a for a in x if a in f]
                if x:
                    out += [(doc, x, []), (rep, [], list(set(s)))]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    rows = rows.mapInArrow(run, "doc long, x array<long>, s array<long>")
    # a document may be first for all others: what they name is combined before it is dealt
    named = rows.select("doc", F.explode("s").alias("one")).distinct().groupBy("doc").agg(F.collect_list("one").alias("s"))
    own = rows.where("size(x) > 0").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("x"))
    return own.join(named, "doc", "full")


def _regrouped(verified: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, least: int, far: DataFrame | None = None) -> DataFrame:
    """Rows for another grouping: longer keys around the places of links that are not settled, and of their firsts.

    Without `far`, a place has stretches to its left and to its right, of half of `least`, as one of them lies in any
    stretch of `least` that holds the place, and of half of 9/20 of that, as passages of similarity 0.8 always have one
    of 9/20 without an edit; and its distances to the two next places. With `far`, the places of links by the longer
    stretches that are still not settled, the keys are all stretches of `least` that hold a place: a link of those cannot
    fail, so no exact repetition is lost whatever documents the shorter keys met first.

    Places of which all stretches are covered by passages of `found` are only firsts (odd pos), but for the longer
    stretches (pos & 2). Rows of one key are linked, or combined, in the task before they are dealt.
    """
    spark = verified.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: no merged tasks
    lists = "struct<a:array<long>,b:array<long>>"
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(
        F.struct(F.collect_list("start").alias("a"), F.collect_list(F.col("end") - (shingle - 1)).alias("b")).cast(lists).alias("spans"))
    none = F.array().cast("array<long>")
    entered = _entrants(verified, far).join(spans, "doc", "left").select(
        "doc", F.coalesce("x", none).alias("x"), F.coalesce("s", none).alias("s"), F.coalesce("spans", F.struct(none.alias("a"), none.alias("b"))).alias("spans"))
    entered = written(entered, "entered")
    ids = entered.select(F.col("doc").alias("doc_id"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    rows = texts.repartition(parts, "doc").join(entered, "doc").select("doc", "x", "s", "spans", "text")
    half, short, whole = -(-least // 2), max(1, least * 9 // 40), far is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = _grouped(key, doc, pos)
            key, doc, pos = key[order], doc[order], pos[order]
            own = doc == doc[first]
            yield _open_rows(key[own], doc[own], pos[own])
            made = ~own & (pos & 1 == 0)
            yield _link_rows(key[made], doc[made], pos[made], doc[first][made], pos[first][made] >> 32)

        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(Words(batch.column("text")), shingle)
            columns = [batch.column(c).to_pylist() for c in ("doc", "x", "s", "spans")]
            for i, (doc, x, named, own) in enumerate(zip(*columns, strict=True)):
                s = hashed[offsets[i]:offsets[i + 1]]
                x = np.asarray(x, dtype=np.int64)
                if named:
                    x = np.append(x, np.flatnonzero(np.isin(s, np.asarray(named, dtype=np.int64).view(np.uint64))))
                x = np.unique(x[x < len(s)])
                spans_ = list(zip(own["a"], own["b"], strict=True))
                if not len(x):
                    continue

                def stretches(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
                    inside = (start >= 0) & (start + length <= len(s))
                    start = start[inside]
                    key = np.full(len(start), length, dtype=np.uint64)
                    for k in range(length):
                        key = key * np.uint64(0xD1342543DE82EF95) + s[start + k]
                    return mix(key), inside

                def add(key: np.ndarray, place: np.ndarray, flag: np.ndarray) -> None:
                    held.append((key.view(np.int64), np.full(len(key), doc), place << 32 | flag))

                if whole:
                    start = np.unique(np.add.outer(x, np.arange(1 - least, 1)))
                    key, inside = stretches(start, least)
                    start = start[inside]
                    covered = np.zeros(len(start), dtype=np.int64)
                    for a, b in spans_:
                        covered |= (start >= a) & (start + least <= b)
                    add(key, start, covered)
                    continue
                covered = (~_open(x, len(s), least, spans_)).astype(np.int64)
                for length in (half, short):
                    for start in (x - length + 1, x):
                        key, inside = stretches(start, length)
                        add(key, x[inside], covered[inside] if length == short else np.full(len(key), 2))
                for shift in (1, 2):
                    gap = x[shift:] - x[:-shift]
                    near = np.flatnonzero((gap >= shingle) & (gap < least))
                    add(mix(s[x[near]] ^ mix(s[x[near + shift]] + mix(gap[near].astype(np.uint64)))), x[near], covered[near])
            if sum(len(h[0]) for h in held) >= GROUPED:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, _ROW)


def remove_passages(docs: DataFrame, **options: object) -> DataFrame:
    """The documents, all columns, with each near-duplicate passage cut out of all but its first document.

    A passage goes with the white space after it; n_chars, if there is such a column, is counted anew where a text
    changed. No row is dropped; a document that is all repetition ends up with an empty text.
    """
    found = near_duplicate_passages(docs, **options)
    id_, text_, list_ = (free_name(f"_cut_{n}", docs.columns) for n in ("id", "text", "spans"))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.array("start", "end")).alias(list_))
    same = F.col("doc_id").cast("long") == F.col(id_)
    if _repeated(docs):  # the text that was compared
        spans = spans.join(_texts(docs).select("doc_id", F.xxhash64("text").alias(text_)), "doc_id")
        same = same & (F.xxhash64(F.col("text").cast("string")) == F.col(text_))
    joined = docs.join(spans.withColumnRenamed("doc_id", id_), same, "left").withColumn(list_, F.coalesce(list_, F.array().cast("array<array<long>>")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans_ = batch.column(list_).to_pylist()
            batch = batch.select(names)
            if any(spans_):
                words = Words(batch.column("text"))
                texts_, counts = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist() if "n_chars" in names else None
                for i, own in enumerate(spans_):
                    if own:
                        texts_[i] = _cut(words, i, own)
                        if counts:
                            n = len(texts_[i])
                            counts[i] = str(n) if pa.types.is_string(batch.schema.field("n_chars").type) else n
                batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(texts_, batch.schema.field("text").type))
                if counts:
                    batch = batch.set_column(names.index("n_chars"), batch.schema.field("n_chars"), pa.array(counts, batch.schema.field("n_chars").type))
            yield batch

    return joined.mapInArrow(run, docs.schema)


def _cut(words: Words, i: int, spans: list[list[int]]) -> str:
    """Text i without the words of the spans."""
    first, last = words.docs[i], words.docs[i + 1]
    drop = np.zeros(last - first + 1, dtype=np.int64)
    for a, b in spans:
        drop[min(a, last - first)] += 1
        drop[min(b, last - first)] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    begin = words.starts[first:last]
    limits = np.append(begin, words.offsets[i + 1])
    if len(limits) and keep.all():
        return words.raw[words.offsets[i]:words.offsets[i + 1]].tobytes().decode()
    parts = [words.raw[limits[k]:limits[k + 1]].tobytes() for k in np.flatnonzero(keep)]
    return (words.raw[words.offsets[i]:limits[0]].tobytes() + b"".join(parts)).decode()
