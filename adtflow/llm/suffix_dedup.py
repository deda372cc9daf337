"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers.

A suffix array of a whole corpus would need many times the corpus; what repeats is a small part of it. So:

1. Windows are dealt by content. Each window of LENGTH bytes has an anchor: the rightmost of its ``GRAM``-byte
   substrings of least hash. Equal windows have equal anchors at equal places. Windows of one anchor are neighbours
   and make up a region, a short piece of text.
2. Anchors found once are dropped, the regions of the others counted by (anchor, content). A region found twice is repeated as a whole. Where an anchor has
   regions of more than one content, one text of each goes to the anchor's shard.
3. In each shard, regions of an anchor that have a core of the text around it in common are sorted by a suffix
   array built by induced sorting: suffixes are classified as smaller or larger than the next,
   leftmost smaller substrings are sorted and named, the string of names is solved recursively, and
   two linear sweeps induce all the rest. The first level sweeps a bucket at a time on arrays. Permuted common
   prefixes with the neighbour in suffix order follow from the irreducible ones. A window is repeated where its
   common prefix with either neighbour reaches LENGTH.
4. An anchor with very many regions (a passage in a large part of all documents) is dealt by those cores, a part of
   each region to the shard of each of its cores. A shard that is still very large is solved in pieces; the windows
   that are single within a piece are then counted by hash over all pieces, so none is missed.
5. Marks go back to every occurrence, and documents are cut.

   Anchors, and regions, that a large part of all documents hold meet their rows in joins of two written tables, whose
   hot keys Spark splits; all that is grouped is grouped in each task first.

Strings are judged on the input. Matches never cross documents. Documents are known by id and a hash of their
text, so repeated ids and rows are told apart or count as the copies they are. Two modes: a string may be repeated
anywhere, in its own document too, or (``across``) has to occur in two documents; each region and window then carries
the least and the greatest document that holds it, and rows of equal id and text are one document.

Defined results: null text is empty; a document under LENGTH bytes keeps all; an empty table gives an empty result.
Regions are the same where their 64-bit hashes under one anchor are; within shards bytes are compared.
Cutting inside a character of several bytes is possible in the digest, as bytes are what is judged; ``cut`` (for
documents as text) drops the broken characters at the edges of what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.common import _BYTE_VALUE, discard, materialize, mix, powers, signed, sub_batches, text_bytes

LENGTH = 400
GRAM = 32
#: Rows of one anchor whose regions are dealt whole; more are dealt by their cores (step 4).
HOT = 2048
#: Texts of one core that one suffix array takes; more are solved in pieces (step 4).
PIECE = 8192
#: Bytes of text in one suffix array.
SHARD = 1 << 19

# --------------------------------------------------------------------------------------------------------
# Suffix arrays by induced sorting
# --------------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the empty suffix after the end is smallest."""
    n = len(t)
    smaller = np.zeros(n, bool)
    if n < 2:
        return smaller
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    place = np.arange(n)
    decided = np.where(step != 0, place, n)
    following = np.minimum.accumulate(decided[::-1])[::-1]  # the next place where neighbours differ
    return step[following] > 0


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    """Places of smaller suffixes whose predecessor is larger."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce_buckets(t: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induce all suffixes from ``lms`` (leftmost smaller ones in order), a bucket at a time."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    larger = ~smaller
    head = starts.copy()
    of = t[lms]
    order = np.argsort(of, kind="stable")
    grouped, first = lms[order], np.searchsorted(of[order], np.arange(size + 1))

    def spread(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[larger[before]]
        if not len(before):
            return
        c = t[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        k = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        many = np.diff(np.append(k, len(c)))
        sa[np.repeat(head[c[k]], many) + np.arange(len(c)) - np.repeat(k, many)] = before
        head[c[k]] += many

    spread(np.array([n], np.int64))  # the empty suffix comes first and induces the last one
    used = np.flatnonzero(counts)
    for c in used:
        i = starts[c]
        while i < head[c]:
            j = head[c]
            spread(sa[i:j])
            i = j
        if first[c] < first[c + 1]:
            spread(grouped[first[c] : first[c + 1]])
    tail = ends.copy()

    def back(block: np.ndarray) -> None:
        before = block[::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if not len(before):
            return
        c = t[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        k = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        many = np.diff(np.append(k, len(c)))
        sa[np.repeat(tail[c[k]], many) - 1 - (np.arange(len(c)) - np.repeat(k, many))] = before
        tail[c[k]] -= many

    for c in used[::-1]:
        i = ends[c]
        while i > tail[c]:
            j = tail[c]
            back(sa[j:i])
            i = j
        if starts[c] < head[c]:
            back(sa[starts[c] : head[c]])
    return sa


def _induce_one(t: list[int], size: int, smaller: list[bool], lms: list[int]) -> list[int]:
    """The same, suffix by suffix: for strings of names, whose buckets are many and small."""
    n = len(t)
    counts = [0] * (size + 1)
    for c in t:
        counts[c + 1] += 1
    for c in range(size):
        counts[c + 1] += counts[c]
    tail = counts[1:]
    sa = [-1] * n
    for p in reversed(lms):
        c = t[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = counts[:-1]
    if n and not smaller[n - 1]:
        sa[head[t[n - 1]]] = n - 1
        head[t[n - 1]] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not smaller[p]:
            c = t[p]
            sa[head[c]] = p
            head[c] += 1
    tail = counts[1:]
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and smaller[p]:
            c = t[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return sa


def _induce(t: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    if size <= 4096 and len(t) > 64 * size or size <= 260 and len(t) > 20_000:
        return _induce_buckets(t, size, smaller, lms)
    return np.array(_induce_one(t.tolist(), size, smaller.tolist(), lms.tolist()), np.int64)


def _names(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost smaller substrings (equal substrings, equal names), by place; and how many names."""
    n = len(t)
    span = np.append(lms[1:], n) - lms + 1  # each reaches to the next one's first letter, the last past the end
    rank = np.full(n, -1, np.int64)
    rank[lms] = np.arange(len(lms))
    which = rank[ordered]
    a, b = ordered[:-1], ordered[1:]
    differ = (span[which[:-1]] != span[which[1:]]) | (a == lms[-1]) | (b == lms[-1])
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        same = (t[a[live] + k] == t[b[live] + k]) & (smaller[a[live] + k] == smaller[b[live] + k])
        differ[live[~same]] = True
        k += 1
        live = live[same]
        live = live[span[which[live]] > k]
    name = np.concatenate(([0], np.cumsum(differ)))
    out = np.empty(len(lms), np.int64)
    out[which] = name
    return out, int(name[-1]) + 1


def suffix_array(t: np.ndarray, size: int | None = None) -> np.ndarray:
    """The suffix array of small non-negative integers, by induced sorting."""
    t = np.asarray(t)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    size = size or int(t.max()) + 1
    smaller = _types(t)
    lms = _leftmost(smaller)
    if not len(lms):
        return _induce(t, size, smaller, lms)
    rough = _induce(t, size, smaller, lms)  # any order of the starts within a bucket: sorts their substrings
    mark = np.zeros(n, bool)
    mark[lms] = True
    ordered = rough[mark[rough]]
    names, many = _names(t, smaller, lms, ordered)
    if many == len(lms):
        ordered = lms[np.argsort(names, kind="stable")]
    else:
        ordered = lms[suffix_array(names, many)]
    return _induce(t, size, smaller, ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each suffix, by place, its length in common with the one before it in order;
    and that one's place (-1 for the first).

    A suffix is reducible where the letters before it and before its neighbour agree: its value is then that of the
    place before, less 1. Only the irreducible ones are compared, 16 letters at a time and all at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = np.zeros(n, bool)
    some = np.flatnonzero((before > 0) & (place > 0))
    reducible[some] = t[some - 1] == t[before[some] - 1]
    # The place before is its own neighbour's follower only if the two continue alike; that holds by definition.
    irreducible = np.flatnonzero(~reducible)
    length = np.zeros(n, np.int64)
    irreducible = irreducible[before[irreducible] >= 0]
    padded = np.concatenate([np.asarray(t, np.int32), np.full(16, -1, np.int32)])
    other = np.concatenate([np.asarray(t, np.int32), np.full(16, -2, np.int32)])
    k = np.arange(16)
    for begin in range(0, len(irreducible), 1 << 15):
        live = irreducible[begin : begin + (1 << 15)]
        while len(live):
            at, of = live + length[live], before[live] + length[live]
            same = padded[np.minimum(at[:, None] + k, n + 15)] == other[np.minimum(of[:, None] + k, n + 15)]
            run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            length[live] += run
            live = live[run == 16]
    last = np.maximum.accumulate(np.where(reducible, 0, place))
    value = length[last] - (place - last)
    return value, before


def repeated_starts(texts: list[bytes], length: int = LENGTH, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text, which starts have a string of ``length`` bytes that starts elsewhere in these texts too.

    ``owners``: the least and greatest owner of each text; a string then counts only where all that hold it have more
    than one owner between them.
    """
    if not texts:
        return []
    t = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    sizes = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    t[first + sizes] = 0  # between texts, smaller than any byte
    sa = suffix_array(t, 257)
    common, before = common_prefixes(t, sa)
    left = np.repeat(first + sizes, sizes + 1) - np.arange(len(t))
    hit = (common >= length) & (left >= length)
    hit &= left[np.maximum(before, 0)] >= length
    both = hit.copy()
    if owners is None:
        both[before[hit]] = True
    else:  # in suffix order, equal strings stand together
        begin = np.flatnonzero(~hit[sa])
        of = np.repeat(owners, sizes + 1, axis=0)[sa]
        several = np.minimum.reduceat(of[:, 0], begin) != np.maximum.reduceat(of[:, 1], begin)
        both[sa] = np.repeat(several, np.diff(np.append(begin, len(sa))))
        both &= left >= length
    return [both[a : a + max(0, s - length + 1)] for a, s in zip(first, sizes, strict=True)]


def _cells(off, size, length: int):
    """For each depth class q of an anchor at ``off`` in a region of ``size`` bytes: which regions have windows there,
    and their least and greatest distance from start to anchor. Works on numbers and on arrays."""
    step = max(1, (length - GRAM) // 4)
    least = np.maximum(0, off - (size - length))
    for q in range((length - 1) // step + 1):
        near, far = np.maximum(least, q * step), np.minimum(off, q * step + step - 1)
        yield q, step, near, far, near <= far


def contested_starts(held: list[tuple[int, int, bytes]], length: int = LENGTH, owners: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """Repeated starts of regions (anchor, the anchor's place, text), of different texts for one anchor.

    ``owners`` has the least and greatest owner of each region; without, each region is an owner of its own. Windows whose anchor stands about as deep in them share a core of the text around it, so only regions that have
    a core in common go into the suffix array, and of those the part around it alone, equal parts once.
    """
    sizes = np.array([len(p) for *_, p in held], np.int64)
    flags = [np.zeros(max(0, n - length + 1), bool) for n in sizes]
    off = np.array([o for _, o, _ in held], np.int64)
    raw = np.frombuffer(b"".join(p for *_, p in held), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=sums[1:])
    anchor = np.array([a for a, _, _ in held], np.int64).view(np.uint64)
    who, lows, highs, keys, parts = [], [], [], [], []
    for q, step, near, far, there in _cells(off, sizes, length):
        i = np.flatnonzero(there)
        if not len(i):
            continue
        at = first[i] + off[i]
        core = (at - q * step, at - (q * step + step - 1) + length)
        part = (at - far[i], at - near[i] + length)
        hashed = [mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)) for a, b in (core, part)]
        keys.append(mix(hashed[0] + mix(anchor[i] + np.uint64(q))))
        parts.append(mix(keys[-1] + mix(hashed[1] + (at - part[0]).astype(np.uint64))))
        who.append(i)
        lows.append(part[0] - first[i])
        highs.append(part[1] - first[i])
    if not who:
        return flags
    who, lows, highs, keys, parts = map(np.concatenate, (who, lows, highs, keys, parts))
    _, one, of = np.unique(parts, return_index=True, return_inverse=True)
    owned = np.array(owners, np.int64).reshape(-1, 2) if owners is not None else np.repeat(np.arange(len(held)), 2).reshape(-1, 2)
    owned = owned[who]
    least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(least, of, owned[:, 0])
    np.maximum.at(most, of, owned[:, 1])
    for k in np.flatnonzero((least != most)[of]).tolist():  # the same text in regions of two owners
        flags[who[k]][lows[k] : highs[k] - length + 1] = True
    between = np.column_stack([least, most])
    _, group, kinds = np.unique(keys[one], return_inverse=True, return_counts=True)
    order = np.argsort(group, kind="stable")
    order = order[kinds[group[order]] > 1]
    chosen, starts, texts, taken, begun, size = one[order], {}, [], [], 0, 0
    for i, k in enumerate(chosen.tolist()):
        texts.append(held[who[k]][2][lows[k] : highs[k]])
        taken.append(int(parts[k]))
        size += len(texts[-1])
        last = i + 1 == len(chosen)
        if last or size >= SHARD and group[order[i]] != group[order[i + 1]]:
            starts.update(zip(taken, repeated_starts(texts, length, between[order[begun : i + 1]]), strict=True))
            texts, taken, begun, size = [], [], i + 1, 0
    for k in np.flatnonzero(np.isin(parts, parts[chosen])).tolist():
        flags[who[k]][lows[k] : highs[k] - length + 1] |= starts[int(parts[k])]
    return flags


# --------------------------------------------------------------------------------------------------------
# Regions
# --------------------------------------------------------------------------------------------------------


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of w values."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def regions(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document row, first byte within the document, bytes, the anchor's place in it, anchor hash, content hash) of
    every region."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64(0xFFFFFFFF)
    v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost counts
    least = _window_min(v, length - gram + 1)
    start = np.arange(n - length + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(start)]
    inside = np.flatnonzero(at[row + 1] - start >= length)
    if not len(inside):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    least, start, row = least[inside], start[inside], row[inside]
    begin = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]))))
    final = np.append(begin[1:], len(start)) - 1
    lo, hi = start[begin], start[final] + length
    anchor = (low - (least[begin] & low)).astype(np.int64)
    content = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    content = mix(content + (anchor - lo).astype(np.uint64))
    return row[begin], lo - at[row[begin]], hi - lo, anchor - lo, h[anchor], content


def _regions_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for big in batches:
            for batch in sub_batches(big, "__text"):
                raw, at = text_bytes(batch.column("__text"))
                row, lo, size, off, anchor, content = regions(raw, at, length)
                order = np.lexsort((lo, content, anchor, row))  # a document's equal regions (of a repeated line) are one row
                row, lo, size, off, anchor, content = (x[order] for x in (row, lo, size, off, anchor, content))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
                first = np.flatnonzero(new)
                take = pa.array(row[first])
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(lo.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__id").take(take), batch.column("__hash").take(take), places, pa.array(size[first].astype(np.int32)),
                        pa.array(off[first].astype(np.int32)), pa.array(signed(anchor[first])), pa.array(signed(content[first])),
                    ],
                    names=["__id", "__hash", "los", "size", "off", "anchor", "content"],
                )

    return docs.select("__id", "__hash", "__text").mapInArrow(run, "__id long, __hash long, los array<int>, size int, off int, anchor long, content long")


_FETCHED = "anchor long, content long, shard int, base int, off int, piece binary, least long, most long"


def _fetch(length: int):
    """The bytes asked for, out of each document; of hot anchors a row for each core."""

    def run(batches):
        for big in batches:
            for batch in sub_batches(big, "__text"):
                out: list[tuple] = []
                for text, asked in zip(batch.column("__text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                    data = text.encode()
                    for a in asked:
                        piece, off = data[a["lo"] : a["lo"] + a["size"]], a["off"]
                        if not a["hot"]:
                            out.append((a["anchor"], a["content"], 0, 0, off, piece, a["least"], a["most"]))
                            continue
                        for q, step, near, far, there in _cells(off, a["size"], length):
                            if there:
                                core = piece[off - q * step : off - q * step - step + 1 + length]
                                shard = int.from_bytes(hashlib.blake2b(core, digest_size=3, salt=bytes((q,))).digest(), "little") + 1
                                low = int(off - far)
                                out.append((a["anchor"], a["content"], shard, low, int(far), piece[low : off - int(near) + length], a["least"], a["most"]))
                columns = list(zip(*out, strict=True)) or [()] * 8
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in _FETCHED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


_MARKS = "anchor long, content long, a int, b int, window long, least long, most long"


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sort_shards(length: int):
    """Rows arrive sorted by (anchor, shard, content); a suffix array takes whole (anchor, shard) groups, or pieces of a
    very large one."""

    def solve(held, in_pieces: bool):
        """Marks [a, b) of repeated bytes within a region; of a group in pieces also each window's hash and owners, as
        a window may have its equal in another piece."""
        flags = contested_starts([(r[0], r[4], r[5]) for r in held], length, [(r[6], r[7]) for r in held])
        out = []
        for (anchor, content, _, base, _, piece, least, most), f in zip(held, flags, strict=True):
            out += [(anchor, content, base + a, base + b + length - 1, None, None, None) for a, b in _runs(f)]
            for s in range(len(f)) if in_pieces else ():
                digest = hashlib.blake2b(piece[s : s + length], digest_size=8).digest()
                out.append((anchor, content, base + s, base + s + length, int.from_bytes(digest, "little", signed=True), least, most))
        return out

    def emit(out):
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _MARKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        held, size, last, group, in_pieces = [], 0, None, 0, False
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and r[:4] == last[:4]:
                    continue  # asked of two equal documents
                if last is None or r[0] != last[0] or r[2] != last[2]:
                    if held and (size >= SHARD or in_pieces):
                        yield emit(solve(held, in_pieces))
                        held, size = [], 0
                    group, in_pieces = 0, False
                elif group >= PIECE:
                    alone = [x for x in held if x[0] == r[0] and x[2] == r[2]]
                    others = held[: len(held) - len(alone)]
                    if others:
                        yield emit(solve(others, False))
                    yield emit(solve(alone, True))
                    held, size, group, in_pieces = [], 0, 0, True
                held.append(r)
                size += len(r[5])
                group += 1
                last = r
        if held:
            yield emit(solve(held, in_pieces))

    return run


def marks(docs: DataFrame, length: int = LENGTH, across: bool = False) -> DataFrame:
    """(__id, __hash, __spans): for each document with any, the [start, end) of repeated bytes, overlapping.

    ``docs`` has __id, __hash and __text. Only regions (2 for each ``length`` - GRAM bytes, 40 bytes each), the texts
    of contested ones and the spans move; the regions are written once to the shared folder, and go as soon as the
    result is written.
    """
    made = materialize(_regions_of(docs, length), "regions")
    owner = F.xxhash64("__id", "__hash") if across else F.col("content")  # without ``across`` each region counts
    per = made.groupBy("anchor").agg(
        F.sum(F.size("los")).alias("total"), F.count("*").alias("rows"), F.min(owner).alias("first"), F.max(owner).alias("final"),
        (F.min("content") != F.max("content")).alias("contested"),
    )
    per = per.where("first <> final" if across else "total > 1").select("anchor", "contested", (F.col("rows") > HOT).alias("hot"))
    per = materialize(per, "anchors")
    live = materialize(made.join(per, "anchor"), "live")  # of most anchors there is one region in all the corpus
    discard(made, per)
    kinds = live.groupBy("anchor", "content").agg(
        F.sum(F.size("los")).alias("n"), F.min(owner).alias("least"), F.max(owner).alias("most"), F.max("contested").alias("contested"), F.max("hot").alias("hot"),
        F.min(F.struct("__id", "__hash", F.element_at("los", 1).alias("lo"), "size", "off")).alias("at"),
    )
    kinds = materialize(kinds, "kinds")
    asked = kinds.where("contested").select("at.__id", "at.__hash", F.struct("anchor", "content", "hot", "at.lo", "at.size", "at.off", "least", "most").alias("q"))
    asked = asked.groupBy("__id", "__hash").agg(F.collect_list("q").alias("asked"))
    pieces = docs.join(asked, ["__id", "__hash"]).select("__text", "asked").mapInArrow(_fetch(length), _FETCHED)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.repartition(n, "anchor", "shard").sortWithinPartitions("anchor", "shard", "content")
    found = materialize(dealt.mapInArrow(_sort_shards(length), _MARKS), "marks")
    sure = found.where("window is null").select("anchor", "content", "a", "b")
    single = found.where("window is not null")  # of groups solved in pieces: equal windows in different pieces
    again = single.groupBy("anchor", "window").agg(F.min("least").alias("first"), F.max("most").alias("final")).where("first <> final").select("anchor", "window")
    pieced = single.join(again, ["anchor", "window"]).select("anchor", "content", "a", "b")
    whole = kinds.where("least <> most" if across else "n > 1").select("anchor", "content", F.lit(0).alias("a"), F.col("at.size").alias("b"))
    spans = sure.unionByName(pieced).unionByName(whole).groupBy("anchor", "content").agg(F.collect_set(F.struct("a", "b")).alias("ab"))
    spans = materialize(spans, "spans")  # so that Spark may split a region of very many rows in the join below
    placed = F.flatten(F.transform("los", lambda lo: F.transform("ab", lambda s: F.struct((lo + s["a"]).alias("a"), (lo + s["b"]).alias("b")))))
    back = live.join(spans, ["anchor", "content"]).select("__id", "__hash", placed.alias("s"))
    out = materialize(back.groupBy("__id", "__hash").agg(F.flatten(F.collect_set("s")).alias("__spans")), "repeats")
    discard(live, kinds, found, spans)
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjoining spans, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_identity(docs: DataFrame) -> DataFrame:
    """``docs`` with __id (null: the least long), __hash and __text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__hash": F.xxhash64(text), "__text": text})


def judged(docs: DataFrame, columns: list[str], length: int = LENGTH, across: bool = False) -> DataFrame:
    """``columns`` of ``docs`` with __text and spans (null where nothing repeats)."""
    own = with_identity(docs)
    found = marks(own.select("__id", "__hash", "__text"), length, across)
    return own.select(*[F.col(f"`{c}`") for c in columns], "__id", "__hash", "__text").join(found, ["__id", "__hash"], "left").drop("__id", "__hash")


def digests(docs: DataFrame, length: int = LENGTH, across: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches):
        for big in batches:
            for batch in sub_batches(big, "__text"):
                out = []
                for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                    data, runs = text.encode(), merged(spans)
                    kept, at = hashlib.sha256(), 0
                    for a, b in runs:
                        kept.update(data[at:a])
                        at = b
                    kept.update(data[at:])
                    out.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    whole = judged(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], length, across)
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_words(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    """The part of data[a:b] from its first to its last whole word, and how many there are; words stand between ASCII
    white space."""
    part = data[a:b]
    words = part.split()
    if words and a and not data[a - 1 : a].isspace() and not part[:1].isspace():
        part, a, words = part[len(words[0]) :], a + len(words[0]), words[1:]
    if words and b < len(data) and not data[b : b + 1].isspace() and not part[-1:].isspace():
        part, words = part[: len(part) - len(words[-1])], words[:-1]
    a += len(part) - len(part.lstrip())
    return a, a + len(part.strip()), len(words)


def cut(docs: DataFrame, length: int = LENGTH, across: bool = False, least_words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; a document of which nothing is left goes.

    With ``least_words`` a maximal run of repeated bytes goes only if it has so many whole words, and those words alone
    go. A document that was empty before stays. ``n_chars``, where there, is counted anew. Other columns are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for big in batches:
            for batch in sub_batches(big, "__text"):
                texts, keep = [], []
                for i, (text, spans) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)):
                    runs, data = merged(spans), text.encode() if spans else b""
                    if least_words:
                        runs = [(a, b) for a, b, many in (_whole_words(data, *r) for r in runs) if many >= least_words]
                    if runs:
                        parts, at = [], 0
                        for a, b in runs:
                            parts.append(data[at:a].decode(errors="ignore"))
                            at = b
                        text = "".join([*parts, data[at:].decode(errors="ignore")])
                        if not text.strip():
                            continue
                    texts.append(text)
                    keep.append(i)
                taken = batch.take(pa.array(keep, pa.int64()))
                columns = {f.name: taken.column(f.name) for f in arrow if f.name != "text"}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return judged(docs, docs.columns, length, across).mapInArrow(run, schema)
