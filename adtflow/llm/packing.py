"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents are tokenised once; what is packed are piece lengths, of which there are at most ``capacity`` different
ones. The plan is therefore made on a histogram of lengths (a bounded table on the driver, whatever the corpus):
around the largest length left, undominated fillings of the rest of its sequence are enumerated depth first,
pruned by the waste that a better plan than the incumbent could still afford, and tried in the order of their waste,
each applied as often as the counts allow or once. Where no better plan can follow, the last choice is taken back.
Best-fit decreasing gives the first incumbent; a plan that meets the volume bound ends the search. A bulk application
leaves less of one length than the filling holds of it, so a dive has at most capacity/1 + capacity/2 + .. + 1
patterns, about 16,000 at 2048, however long the corpus is; the effort after the first dive is bounded by a parameter.

Documents then find their places without a sort of the corpus: a piece's rank among those of its length is its
rank within its task plus a prefix sum over tasks, and the plan maps (length, rank) to (sequence, offset).

Defined results: a null or empty text is the end id alone (one piece of length 1); a document longer than the
capacity, its end id included, is cut into full pieces after a first piece that holds the remainder; equal rows
are packed each on its own; an empty table gives no pieces. Extra columns are not carried along.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adtflow.llm.common import materialize, sub_batches

CAPACITY = 2048

#: Texts of these characters alone are split alike by both libraries' pattern engines; all others are encoded by
#: the tokenizer file itself.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞€]")


@lru_cache(maxsize=2)
def _encoders(path: str, ranks_path: str | None, added: bool):
    """The tokenizer file's encoder, the fast one and a pattern of the added tokens that the file finds in texts."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    contents = [re.escape(t.content) for t in whole.get_added_tokens_decoder().values()] if added else []
    own = re.compile("|".join(contents)) if contents else None
    if ranks_path is None:
        return whole, None, own
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), own


def encode(text: str | None, path: str, ranks_path: str | None = None, added: bool = False) -> np.ndarray:
    """The ids of ``text`` by the tokenizer file at ``path`` as uint32; ``ranks_path`` names the same vocabulary's
    ranks, used where both give the same ids (plain texts), as they are several times as fast. ``added`` leaves the
    file as it is: added tokens within a text have their own ids, else they are spelled like other text."""
    if not text:
        return np.zeros(0, np.uint32)
    whole, fast, own = _encoders(path, ranks_path, added)
    if fast is not None and not _PLAIN.search(text) and not (own and own.search(text)):
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
    return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; ``nth`` counts the pieces of that length within the task that made them."""

    def run(batches):
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for big in batches:
            for batch in sub_batches(big, "text"):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text, path, ranks_path, added=True), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        nth = seen.get(b - a, 0)
                        seen[b - a] = nth + 1
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, nth))
                columns = list(zip(*out, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


# --------------------------------------------------------------------------------------------------------
# The plan
# --------------------------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The volume bound, sharpened by the lengths over half: those need a sequence each."""
    volume = -(-sum(n * c for n, c in counts.items()) // capacity)
    return max(volume, sum(c for n, c in counts.items() if 2 * n > capacity))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times): each sequence gets, again and again, the largest length left that fits."""
    left, out = dict(counts), []
    order = sorted(left, reverse=True)
    while any(left.values()):
        pattern, room, used = [], capacity, dict.fromkeys(left, 0)
        for n in order:
            while n <= room and used[n] < left[n]:
                pattern.append(n)
                used[n] += 1
                room -= n
        times = min(left[n] // used[n] for n in set(pattern))
        for n in set(pattern):
            left[n] -= used[n] * times
        order = [n for n in order if left[n]]
        out.append((tuple(pattern), times))
    return out


def _covers(bins: tuple[int, ...], items: tuple[int, ...], effort: list[int]) -> bool:
    """Whether ``items`` can be packed into bins of these sizes, so that a filling of the bins' sizes is as good as one
    of the items. Both descend. An answer that the effort doesn't reach is no."""
    if sum(items) > sum(bins):
        return False
    room = list(bins)

    def put(k: int) -> bool:
        if k == len(items):
            return True
        effort[0] -= 1
        tried = set()
        for b in range(len(room)):
            if room[b] >= items[k] and room[b] not in tried and effort[0] > 0:
                tried.add(room[b])
                room[b] -= items[k]
                if put(k + 1):
                    return True
                room[b] += items[k]
        return False

    return put(0)


def fillings(left: list[int], order: list[int], room: int, allowed: int, nodes: int) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """(fillings of ``room`` with their waste, least first; the effort spent) from the counts ``left``.

    Lengths are tried from the largest down, maximal sets only; a single length that fills the room exactly dominates
    everything and ends the search. Branches that must waste more than ``allowed`` are cut. After the effort ``nodes`` the
    enumeration ends early.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [nodes]
    tail = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        tail[i] = tail[i + 1] + order[i] * left[order[i]]

    def visit(start: int, room: int, chosen: list[int]) -> None:
        budget[0] -= 1
        low, high = start, len(order)
        while low < high:  # the first length that fits
            mid = (low + high) // 2
            if order[mid] > room:
                low = mid + 1
            else:
                high = mid
        for i in range(low, len(order)):
            n = order[i]
            if left[n] - chosen.count(n) <= 0:
                continue
            if room - tail[i] > allowed or budget[0] <= 0 and found:
                break
            chosen.append(n)
            visit(i, room - n, chosen)
            chosen.pop()
        if room <= allowed and (room < order[-1] or all(n > room or left[n] <= chosen.count(n) for n in order) if order else True):
            found.append((room, tuple(chosen)))

    if room < len(left) and left[room]:
        return [(0, (room,))], 1
    visit(0, room, [])
    found.sort(key=lambda f: (f[0], len(f[1]), [-n for n in f[1]]))
    return found, nodes - budget[0]


def undominated(found: list[tuple[int, tuple[int, ...]]], steps: list[int]):
    """Those of ``found``, in order, whose lengths can't be packed into those of one before; ``steps`` counts the effort."""
    kept: list[tuple[int, ...]] = []
    for waste, items in found:
        effort = [200]
        if not any(_covers(g, items, effort) for g in kept):
            kept.append(items)
            yield waste, items
        steps[0] += len(kept) + 200 - effort[0]


def _half_bound(left: list[int], order: list[int], capacity: int) -> int:
    """A lower bound of the sequences for what is left: for each threshold, lengths over half the capacity stand alone,
    and those of at least the threshold fill what the ones that leave so much room leave."""
    best = 0
    big = [n for n in order if 2 * n > capacity]
    for least in {0, *(n for n in order if 2 * n <= capacity)}:
        alone = sum(left[n] for n in big)
        room = sum((capacity - n) * left[n] for n in big if n <= capacity - least)
        fill = sum(n * left[n] for n in order if least <= n and 2 * n <= capacity)
        best = max(best, alone + max(0, -(-(fill - room) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 400, effort: int = 400_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their times, by branch and bound.

    At each node the largest length left is completed; the children are its undominated fillings, each applied as often
    as the counts allow or once, least waste first. A node is left, and the last choice taken back, where the waste
    so far (or what is left, by its lower bound) rules out fewer sequences than the incumbent has, or where its remainder has
    failed before. ``effort`` bounds the steps of all enumerations after the first dive, and ``nodes`` those of one; they
    bound the search, never what is packed. Short lists are solved exactly.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c}
    incumbent = best_fit_decreasing(counts, capacity)
    best, bound = sum(t for _, t in incumbent), lower_bound(counts, capacity)
    volume = sum(n * c for n, c in counts.items())
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    used, waste, failed = 0, 0, {}
    stack: list[tuple[Iterator, list[int], tuple | None]] = []  # open choices, lengths left, key of the remainder
    path: list[tuple[tuple[int, ...], int, int]] = []
    steps = [0]

    def choices(top: int, found: list) -> Iterator[tuple[tuple[int, ...], int, int]]:
        for lost, items in undominated(found, steps):
            pattern = (top, *items)
            most = min(left[n] // pattern.count(n) for n in set(pattern))
            for times in dict.fromkeys((most, 1)):
                yield pattern, times, lost

    def opened(order: list[int]) -> tuple[Iterator, list[int], tuple | None]:
        top, small = order[0], len(order) <= 48
        key = tuple((n, left[n]) for n in order) if small else None
        if key is not None and (failed.get(key, used + 1) <= used or used + _half_bound(left, order, capacity) >= best):
            return iter(()), order, None
        left[top] -= 1
        rest = order if left[top] else order[1:]
        spare = (best - 1) * capacity - volume - waste
        found, spent = fillings(left, rest, capacity - top, spare, nodes) if spare >= 0 else ([], 1)
        steps[0] += spent + (len(order) ** 2 // 16 if small else 0)
        left[top] += 1
        return choices(top, found), order, key

    def apply(pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            left[n] -= times

    if best > bound:
        stack.append(opened(sorted(counts, reverse=True)))
    dive = True  # the first one isn't counted
    while stack and best > bound and (dive or steps[0] < effort):
        open_choices, order, key = stack[-1]
        choice = next(open_choices, None)
        if choice is None:
            if dive:
                dive, steps[0] = False, 0
            stack.pop()
            if key is not None and len(failed) < 200_000:
                failed[key] = min(used, failed.get(key, used))
            if path:
                pattern, times, lost = path.pop()
                apply(pattern, -times)
                used, waste = used - times, waste - lost * times
            continue
        pattern, times, lost = choice
        if waste + lost * times > (best - 1) * capacity - volume:
            continue
        apply(pattern, times)
        used, waste = used + times, waste + lost * times
        path.append((pattern, times, lost))
        rest = [n for n in order if left[n]]
        if rest:
            stack.append(opened(rest))
            continue
        best, incumbent = used, [(p, t) for p, t, _ in path]  # all is packed, in fewer sequences than before
        apply(pattern, -times)
        path.pop()
        used, waste = used - times, waste - lost * times
    return incumbent


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a sequence, first sequence, offset), ascending by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in dict.fromkeys(pattern):
            k = pattern.count(n)
            out.setdefault(n, []).append((ranks.get(n, 0), k, sequence, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def place(length: np.ndarray, rank: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces with these lengths and ranks among their length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length):
        rows, here = table[int(n)], np.flatnonzero(length == n)
        row = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
        k = rank[here] - row[:, 0]
        sequence[here] = row[:, 2] + k // row[:, 1]
        offset[here] = row[:, 3] + k % row[:, 1] * n
    return sequence, offset


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    The pieces' places (48 bytes each, no ids) are written to the shared folder once, so that ranks stay what they
    are whatever is recomputed. The driver gets the histogram: at most ``capacity`` rows.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, path, ranks_path, capacity, end_id), "pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # bounded by the capacity alone, see above

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = place(length, rank, table.value)
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = made.join(base, ["length", "task"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def volume_bound(rows: DataFrame, capacity: int = CAPACITY) -> int:
    """The least number of sequences that the total length allows."""
    return math.ceil((rows.agg(F.sum("length").alias("n")).first()["n"] or 0) / capacity)
