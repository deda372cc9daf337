"""N-gram Jaccard join, exact, by an inverted index with skipping and answers derived from similar sets.

A document's set is its distinct word shingles. Two sets link when 100 * |A and B| >= PERCENT * |A or B|; what is
asked for are the classes of documents that links connect.

1. Equal sets become one, whatever their number of copies.
2. Shingles are put into one global order, frequent ones last (their counts cover all documents; the order steers
   cost alone). Two sets that link share a shingle among the first n - ceil(PERCENT n / 100) + 1 of either, so
   only those are indexed.
3. An index list is sorted by set size. Size and position of an entry (what follows its shingle bounds what it can
   share) say where the sets become too large to link: the rest of the list is skipped as a block. Then entries are
   skipped by their own position, and by a lower bound of the difference from a histogram of 16 counters. Pairs that are left are held against finer profiles, of a size that
   grows with the set. Long lists make no pairs: their entries gather around leaders, by those profiles and the triangle
   inequality. Very frequent shingles do so within each task, and only leaders are dealt by shingle, so no task gets a
   list that grows with the corpus. What is left connects sets into families, loosely: no link leaves a family.
4. A family is solved by differences. Every set is kept as its symmetric difference to a centre (what most of the
   family holds), so a set's answers follow from those of the centre: sets near it link for certain by two
   numbers, and others only if they share enough differing shingles, which a second index of rare ones finds.
   Pairs already connected are skipped. Lists of that index that are long are families again, with a centre of their own.

5. A family of more than BIG sets is spread. Its centre comes from a bounded sample of its sets (it steers cost alone).
   Sets near the centre link to the nearest one for certain and are done; the others are held against all sets of the
   family in cells of at most two times CELL sets, so no task holds a family.

A family's sets move as shingle hashes, and are held as differences only. No pair list of a group is ever made.

Defined results: null, empty and blank texts have no set, 0 shingles, and link with nothing; a text of fewer words
than a shingle is one shingle; repeated rows and repeated ids are linked like any equal texts; an empty table
gives an empty result. A null id stays null in its row and is never the least of a class; a class of null ids alone
has a null ``component_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adtflow.llm.common import discard, materialize, mix, shingles, signed, sub_batches, text_bytes, word_hashes, words

WORDS = 3
PERCENT = 90
#: Lists of more entries are dealt around leaders (step 3) or solved as families (step 4).
LONG = 64
#: Shingles whose count in some two million neighbours reaches FREQUENT are counted overall; the order tells apart
#: the REMEMBERED commonest of them. Neither changes a result.
FREQUENT, REMEMBERED, CHUNK = 4, 1 << 20, 1 << 21

#: Prefix shingles of this frequency class (counted 1024 times or more) gather their sets within each task before any
#: shuffle (step 3); memory for that, in bytes.
HOT_CLASS, LED_BYTES = 11, 64 << 20

#: Sets of a family that one task solves; of a larger one, cells of CELL sets and CELL others, and a sample for its centre.
BIG, CELL, SAMPLE = 1024, 512, 256


def _hashes(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    start, end, row = words(raw, at)
    return shingles(word_hashes(raw, start, end), row, n)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes (about the logarithm of the count) of frequent shingles, sorted by hash; bounded."""

    def run(batches):
        held, size = [], 0

        def flush() -> list:
            if not held:
                return [pa.array([], pa.int64()), pa.array([], pa.int64())]
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return [pa.array(signed(h[c >= FREQUENT])), pa.array(c[c >= FREQUENT])]

        for big in batches:
            for batch in sub_batches(big, "_text"):
                h, _ = _hashes(batch.column("_text"), n)
                held.append(h)
                size += len(h)
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays(flush(), names=["h", "c"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays(flush(), names=["h", "c"])

    counted = materialize(docs.select("_text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    kind = F.floor(F.log2("c")).cast("int")
    # As many classes, from the most frequent down, as REMEMBERED hashes have room for: 64 rows decide, no sort.
    room, least = REMEMBERED, 64
    for r in sorted(counted.groupBy(kind.alias("k")).count().collect(), key=lambda r: -r["k"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["k"]
    top = counted.where(kind >= least).toPandas()
    discard(counted)
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.minimum(63, 1 + np.log2(np.maximum(1, top["c"].to_numpy(float)))).astype(np.uint64)[order]


def _ordered(h: np.ndarray, known: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hashes as places in the global order: 6 bits of frequency class, then 58 of the hash."""
    v = h >> np.uint64(6)
    if len(known):
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = known[at] == h
        v[hit] |= kind[at[hit]] << np.uint64(58)
    return v


def _sets(column, n: int, order) -> list[np.ndarray]:
    """Each document's distinct shingles in the global order."""
    h, row = _hashes(column, n)
    v = _ordered(h, *order)
    edges = np.searchsorted(row, np.arange(len(column) + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        s = np.sort(v[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b - a > 1 else s)
    return out


def profile(s: np.ndarray) -> bytes:
    """Counts modulo 256 of a set's shingles by hash, in a power of two of at least n/8 (and 16) counters: random sets
    differ in it by more than any link allows, at every size."""
    size = 16
    while size * 8 < len(s):
        size *= 2
    m = mix(s + np.uint64(1)) & np.uint64(size - 1)
    return (np.bincount(m.astype(np.int64), minlength=size) & 255).astype(np.uint8).tobytes()


def profiles_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the finer profile is folded to the coarser one's counters."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.uint8)
    return int(_apart(x, y))


def _digest(sets: list[np.ndarray], percent: int, ids, texts) -> pa.RecordBatch:
    size = np.array([len(s) for s in sets], np.int64)
    first, second, hist, prefix = (np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), 16), np.uint8), [])
    for i, s in enumerate(sets):
        if not len(s):
            prefix.append(s.view(np.int64))
            continue
        m = mix(s + np.uint64(1))
        first[i], second[i] = m.sum(dtype=np.uint64), mix(m ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)
        hist[i] = (np.bincount((m & np.uint64(15)).astype(np.int64), minlength=16) & 255).astype(np.uint8)
        keep = len(s) - (-(-percent * len(s) // 100)) + 1
        prefix.append(s[:keep].view(np.int64))
    h = hist.view(np.int64).reshape(len(sets), 2) if len(sets) else np.zeros((0, 2), np.int64)
    signature = pa.array([profile(s) for s in sets], pa.binary())
    lengths = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays(
        [ids, texts, pa.array(size), pa.array(signed(first)), pa.array(signed(second)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), signature, flat],
        names=["doc_id", "_hash", "n", "k1", "k2", "h1", "h2", "profile", "prefix"],
    )


class Unions:
    """Disjoint sets of any hashable members."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference from histograms modulo 256."""
    d = a.astype(np.int16) - b
    d = np.abs(d)
    return np.minimum(d, 256 - d).sum(axis=-1)


def _near_pairs(token, sid, n, pos, hist, percent: int):
    """Pairs of places with one token that no bound excludes, in lists of at most LONG entries sorted by size.

    With what follows its shingle, an entry can link to sets of at most (n - pos) (100 + percent) / percent - n
    shingles: beyond the last of those the rest of the list is skipped as a block.
    """
    if not len(token):
        return np.zeros((0, 2), np.int64)
    of = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
    span = int(n.max()) * 100 // percent + 2
    most = (n - pos) * (100 + percent) // percent - n
    end = np.searchsorted(of * span + n, of * span + np.clip(most, -1, span - 1), side="right")
    first = np.arange(1, len(n) + 1)
    many = np.maximum(0, end - first)
    total, found, begin = np.cumsum(many), [], 0
    while begin < len(n):  # some 2**17 pairs at a time
        base = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, base + (1 << 17), side="right")))
        some = many[begin:stop]
        i = np.repeat(np.arange(begin, stop), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[begin:stop], some)
        ok = (n[j] - pos[j]) * (100 + percent) >= percent * (n[i] + n[j])
        i, j = i[ok], j[ok]
        ok = (100 + percent) * _apart(hist[i], hist[j]) <= (100 - percent) * (n[i] + n[j])
        found.append(np.unique(np.column_stack([sid[i[ok]], sid[j[ok]]]), axis=0) if ok.any() else np.zeros((0, 2), np.int64))
        begin = stop
    return np.unique(np.concatenate(found), axis=0)


#: An entry joins a leader nearer than this share of the reach of its links, else it leads.
NEAR = 0.4


def _fold(v: np.ndarray, size: int) -> np.ndarray:
    return v if len(v) == size else v.reshape(-1, size).sum(axis=0, dtype=np.uint8)


class _Leaders:
    """Leaders of one list, whose entries come by ascending size; only leaders are held.

    An entry whose profile is near a leader's joins that leader, any other leads. If x (of leader p) and y (of leader q)
    link, p and q are at most as far apart as x's way to p, y's way to q and the link's own reach; leaders that may be
    so near are connected. All distances are lower bounds, from profiles and from sizes. An entry may itself have led
    others in a part of the list, up to ``radius`` away.
    """

    def __init__(self, percent: int):
        self.factor = (100 - percent) * (1 + 100 / percent) / (100 + percent)  # reach of a link, as a share of the size
        self.sid: list[int] = []
        self.n: list[int] = []
        self.reach: list[float] = []  # of the largest member
        self.radius: list[float] = []  # to the farthest member
        self.profile: list[np.ndarray] = []
        self.tables: dict[int, list] = {}  # by length of profile: rows in use, places of leaders, matrix

    def _far(self, v: np.ndarray, n: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the leaders that sizes don't put out of ``limit``; their profiles are no longer than ``v``."""
        places, far = [], []
        for size, (used, where, matrix) in self.tables.items():
            if size > len(v):  # larger sets, which come later
                continue
            here = np.array(where[:used])
            away = n - np.array(self.n)[here]
            keep = away <= limit
            if keep.any():
                places.append(here[keep])
                far.append(np.maximum(_apart(matrix[:used][keep], _fold(v, size)), away[keep]))
        return (np.concatenate(places), np.concatenate(far)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, sid: int, n: int, profile: bytes, reach: float = 0.0, radius: float = 0.0):
        """The leader's sid that this entry joins, or None."""
        v, own = np.frombuffer(profile, np.uint8), self.factor * n
        places, far = self._far(v, n, NEAR * own)
        if len(far) and far.min() <= NEAR * own:
            at = far.argmin()
            k = int(places[at])
            self.reach[k] = max(self.reach[k], own, reach)
            self.radius[k] = max(self.radius[k], float(far[at]) + radius)
            return self.sid[k]
        table = self.tables.setdefault(len(v), [0, [], np.zeros((8, len(v)), np.uint8)])
        if table[0] == len(table[2]):
            table[2] = np.concatenate([table[2], np.zeros_like(table[2])])
        table[2][table[0]] = v
        table[1].append(len(self.sid))
        table[0] += 1
        self.sid.append(sid)
        self.n.append(n)
        self.reach.append(max(own, reach))
        self.radius.append(radius)
        self.profile.append(v)
        return None

    def edges(self):
        """Pairs of leaders' sids that members could link across."""
        reach, radius, n = np.array(self.reach), np.array(self.radius), np.array(self.n)
        most, widest = reach.max(initial=0), radius.max(initial=0)
        for k in range(1, len(self.sid)):
            places, far = self._far(self.profile[k], self.n[k], most + 2 * widest)
            before = places < k
            places, far = places[before], far[before]
            limit = radius[k] + radius[places] + np.minimum(reach[k], reach[places])
            for j in places[far <= limit].tolist():
                yield self.sid[j], self.sid[k]


def _forest(forest: Unions) -> np.ndarray:
    pairs = np.array([(x, forest.find(x)) for x in forest.up], np.int64).reshape(-1, 2)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _lead(percent: int):
    """Rows arrive sorted by (token, n, sid), of long lists only. Each task gives a forest over what must stay connected."""

    def run(batches):
        forest, token, leaders = Unions(), None, None
        for batch in batches:
            for t, *entry in zip(*(batch.column(c).to_pylist() for c in ("token", "sid", "n", "profile", "reach", "radius")), strict=True):
                if t != token:
                    for a, b in leaders.edges() if leaders else ():
                        forest.join(a, b)
                    token, leaders = t, _Leaders(percent)
                joined = leaders.add(*entry)
                if joined is not None:
                    forest.join(joined, entry[0])
        for a, b in leaders.edges() if leaders else ():
            forest.join(a, b)
        pairs = _forest(forest)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


_LED = "token long, sid long, n long, profile binary, reach double, radius double, joined long"


def _lead_here(percent: int):
    """Sets arrive by ascending size, with their very frequent tokens. For each such token the sets of this task are
    gathered around leaders; given are the leaders as entries, and what joined which (``joined``, without token)."""

    def run(batches):
        lists: dict[int, _Leaders] = {}
        forest, held = Unions(), 0

        def settle():
            rows = [
                (t, x.sid[k], x.n[k], x.profile[k].tobytes(), x.reach[k], x.radius[k], None)
                for t, x in lists.items()
                for k in range(len(x.sid))
            ]
            rows += [(None, a, None, None, None, None, b) for a, b in _forest(forest).tolist()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64())
            names = [c.split()[0] for c in _LED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for sid, n, profile, tokens in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "profile", "tokens")), strict=True):
                for t in tokens:
                    joined = lists.setdefault(t, _Leaders(percent)).add(sid, n, profile)
                    if joined is None:
                        held += 8 * len(profile) + 512
                    else:
                        forest.join(joined, sid)
                if held > LED_BYTES:
                    yield settle()
                    lists, forest, held = {}, Unions(), 0
        yield settle()

    return run


def _connect(percent: int):
    """Rows arrive sorted by (token, n, sid). Gives pairs of sets, each once a task, still to be held against the finer
    profiles; and the entries of lists too long for pairs, as (token, sid) with ``long`` set."""

    def run(batches):
        pairs, entries, held = [], [], []

        def settle(token, sid, n, pos, hist):
            edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            size = np.diff(edge)
            many = np.repeat(size > LONG, size)
            if many.any():
                entries.append(np.column_stack([token[many], sid[many]]))
            few = np.repeat(size <= LONG, size) & np.repeat(size > 1, size)
            pairs.append(_near_pairs(token[few], sid[few], n[few], pos[few], hist[few], percent))

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("token", "sid", "n", "pos", "h1", "h2")])
            token, sid, n, pos, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = np.searchsorted(token, token[-1]) if len(token) else 0  # the last list may go on
            hist = np.column_stack([h1, h2]).view(np.uint8).reshape(-1, 16)
            if cut:
                settle(token[:cut], sid[:cut], n[:cut], pos[:cut], hist[:cut])
            held = [[c[cut:] for c in (token, sid, n, pos, h1, h2)]]
        if held:
            token, sid, n, pos, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
            if len(token):
                settle(token, sid, n, pos, np.column_stack([h1, h2]).view(np.uint8).reshape(-1, 16))
        near = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        both = np.concatenate([near, *entries])
        flags = np.arange(len(both)) >= len(near)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(flags)], names=["a", "b", "long"])

    return run


def _profiled(percent: int):
    """Leaves pairs whose profiles allow a link."""

    def run(batches):
        for batch in batches:
            names = ("na", "nb", "pa", "pb")
            keep = [
                (100 + percent) * profiles_apart(x, y) <= (100 - percent) * (n + m)
                for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            ]
            taken = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([taken.column("a"), taken.column("b")], names=["a", "b"])

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root): the connected components of edges (a, b), by contraction.

    Every round each vertex points at the least of its neighbourhood in a hashed order, pointers are followed once,
    and edges between what they point at remain: a constant share of vertices goes each round, so rounds are
    logarithmic; more than ``rounds`` (of 2**60 vertices, say) raise an error. Nothing reaches the driver but counts.
    All that is joined is written first, so that Spark can split hubs.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        if len(maps) == rounds:
            raise RuntimeError(f"components are not finished after {rounds} rounds")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = materialize(least.select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("p")), "steps")
        jump = step.alias("x").join(step.select(F.col("v").alias("p"), F.col("p").alias("q")).alias("y"), "p").select("v", F.col("q").alias("p"))
        jump = materialize(jump, "pointers")
        maps.append(jump)
        moved = left.join(jump.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(jump.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        rest = materialize(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
        discard(left, step)
        left = rest
    if not maps:
        return materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0), "components")
    out = maps[0].withColumnRenamed("p", "root")
    for later in maps[1:]:
        out = out.join(later.select(F.col("v").alias("root"), F.col("p").alias("_p")), "root", "left").select("v", F.coalesce("_p", "root").alias("root"))
    out = materialize(out, "components")
    discard(left, *maps)
    return out


def solve_family(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the place of the first one that it is connected to by links."""
    labels = np.arange(len(sets))
    if len(sets) < 2:
        return labels
    centre = sets[0]
    differing = [np.setxor1d(centre, s, assume_unique=True) for s in sets]
    return _solve(differing, np.array([len(s) for s in sets], np.int64), percent, 0)


def _solve(differing: list[np.ndarray], size: np.ndarray, percent: int, depth: int) -> np.ndarray:
    """Classes of sets given as differences to one centre: x and y link when c_x + c_y <= 2 B * (common differences)."""
    count = len(differing)
    a, b = 100 - percent, 100 + percent
    value, times = np.unique(np.concatenate(differing), return_counts=True)
    move = value[2 * times > count]
    if len(move):  # the centre moves to what most sets hold
        differing = [np.setxor1d(d, move, assume_unique=True) for d in differing]
    lengths = np.array([len(d) for d in differing], np.int64)
    cost = b * lengths - a * size
    up = np.arange(count)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)

    best = int(cost.argmin())
    for x in np.flatnonzero(cost + cost[best] <= 0).tolist():
        if x != best:
            join(best, x)
    root = np.array([find(x) for x in range(count)])
    outside = root != root[best]
    if not outside.any():
        return root
    # An outsider can link to any set, any other set only to outsiders: so much they must have in common at least.
    other = np.where(outside, cost[best], cost[outside].min())
    needed = np.maximum(1, -(-(cost + other) // (2 * b)))
    _, of, times = np.unique(np.concatenate(differing), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), lengths)
    order = np.lexsort((of, times[of], owner))  # rare ones first, in each set
    of, owner = of[order], owner[order]
    place = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    listed = (place <= (lengths - needed)[owner]) & (times[of] > 1)
    of, owner = of[listed], owner[listed]
    order = np.lexsort((owner, of))
    of, owner = of[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, np.int64)
    long_or_short = np.diff(edge)
    for k in np.flatnonzero(long_or_short > LONG).tolist():
        members = owner[edge[k] : edge[k + 1]]
        if len({find(x) for x in members.tolist()}) < 2:
            continue
        if len(members) < count and depth < 6:
            sub = _solve([differing[x] for x in members], size[members], percent, depth + 1)
            for x, y in zip(members.tolist(), members[sub].tolist(), strict=True):
                join(x, y)
        else:
            for i in range(len(members)):
                x = int(members[i])
                for y in members[i + 1 :].tolist():
                    if find(x) != find(y) and cost[x] + cost[y] <= 2 * b * len(np.intersect1d(differing[x], differing[y], assume_unique=True)):
                        join(x, y)
    few = np.repeat((long_or_short <= LONG) & (long_or_short > 1), long_or_short)
    of, owner = of[few], owner[few]
    tried = []
    for d in range(1, LONG):
        i = np.flatnonzero(of[d:] == of[:-d]) if d < len(of) else np.zeros(0, np.int64)
        if not len(i):
            break
        tried.append(np.unique(owner[i].astype(np.int64) * count + owner[i + d]))
    for code in np.unique(np.concatenate(tried)).tolist() if tried else []:
        x, y = divmod(code, count)
        if find(x) != find(y) and cost[x] + cost[y] <= 2 * b * len(np.intersect1d(differing[x], differing[y], assume_unique=True)):
            join(x, y)
    return np.array([find(x) for x in range(count)])


def _families(percent: int):
    """Rows arrive sorted by family; a set is kept as its difference to the family's first set."""

    def run(batches):
        family, centre, held, sizes, ids = None, None, [], [], []

        def close():
            root = _solve(held, np.array(sizes, np.int64), percent, 0) if len(held) > 1 else np.zeros(len(held), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(ids, np.int64)[root])], names=["sid", "root"])

        for batch in batches:
            values = batch.column("tokens")
            for f, sid, s in zip(batch.column("family").to_pylist(), batch.column("sid").to_pylist(), values, strict=True):
                tokens = s.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if f != family:
                    if ids:
                        yield close()
                    family, centre, held, sizes, ids = f, tokens, [], [], []
                if ids and sid == ids[-1]:
                    continue  # fetched from two rows of equal id and text
                held.append(np.setxor1d(centre, tokens, assume_unique=True))
                sizes.append(len(tokens))
                ids.append(sid)
        if ids:
            yield close()

    return run


def _centres(batches):
    """Rows arrive sorted by family: what more than half of its sampled sets hold."""
    family, held = None, []

    def close():
        value, times = np.unique(np.concatenate(held), return_counts=True)
        centre = value[2 * times > len(held)]
        flat = pa.ListArray.from_arrays(pa.array([0, len(centre)], pa.int32()), pa.array(centre))
        return pa.RecordBatch.from_arrays([pa.array([family], pa.int64()), flat], names=["family", "centre"])

    for batch in batches:
        for f, s in zip(batch.column("family").to_pylist(), batch.column("tokens"), strict=True):
            if f != family and held:
                yield close()
                held = []
            family = f
            held.append(s.values.to_numpy(zero_copy_only=False))
    if held:
        yield close()


def _differences(percent: int):
    """Each set as its difference to its family's centre, with its size and the cost of linking."""

    def run(batches):
        for batch in batches:
            out, size = [], []
            for s, c in zip(batch.column("tokens"), batch.column("centre"), strict=True):
                out.append(np.setxor1d(s.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False), assume_unique=True))
                size.append(len(s.values))
            lengths = np.array([len(d) for d in out], np.int64)
            n = np.array(size, np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))
            cost = (100 + percent) * lengths - (100 - percent) * n
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("sid"), pa.array(n), pa.array(cost), flat], names=["family", "sid", "n", "cost", "delta"])

    return run


def _cells(percent: int):
    """Rows arrive sorted by (family, cell, block, sid). Gives the links' forest of each."""

    def run(batches):
        key, held, sizes, ids = None, [], [], []

        def close():
            root = _solve(held, np.array(sizes, np.int64), percent, 0)
            some = np.flatnonzero(root != np.arange(len(root)))
            sid = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(sid[root[some]])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "cell", "block", "sid", "n")]
            for f, c, k, sid, n, s in zip(*columns, batch.column("delta"), strict=True):
                if (f, c, k) != key:
                    if len(ids) > 1:
                        yield close()
                    key, held, sizes, ids = (f, c, k), [], [], []
                if ids and sid == ids[-1]:
                    continue
                held.append(s.values.to_numpy(zero_copy_only=False))
                sizes.append(n)
                ids.append(sid)
        if len(ids) > 1:
            yield close()

    return run


def _spread(sets: DataFrame, counts: DataFrame, percent: int, shuffle: int) -> DataFrame:
    """Edges (a, b) that connect each big family's sets exactly as its links do. ``counts`` has (family, members)."""
    rank = W.partitionBy("family").orderBy(F.xxhash64("sid"))
    # The sample is found by an aggregate of bounded state, not by sorting a family in one task.
    threshold = F.lit(-(2**63)).cast("double") + F.lit(2.0**64) * (2 * SAMPLE) / F.col("members")
    sample = sets.join(counts, "family").where(F.xxhash64("sid").cast("double") <= threshold).withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= SAMPLE)
    centres = sample.select("family", "tokens").repartition(shuffle, "family").sortWithinPartitions("family").mapInArrow(_centres, "family long, centre array<long>")
    placed = sets.join(centres, "family", "left").select("family", "sid", "tokens", F.coalesce("centre", F.array().cast("array<bigint>")).alias("centre"))
    delta = materialize(placed.mapInArrow(_differences(percent), "family long, sid long, n long, cost long, delta array<long>"), "differences")
    nearest = delta.groupBy("family").agg(F.min(F.struct("cost", "sid")).alias("g"))
    judged = delta.join(nearest, "family")
    sure = F.col("cost") + F.col("g.cost") <= 0
    main = judged.where(sure & (F.col("sid") != F.col("g.sid"))).select(F.col("sid").alias("a"), F.col("g.sid").alias("b"))
    others = judged.where(~sure).drop("g")
    n_others = others.groupBy("family").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    parts = counts.join(n_others, "family").select("family", F.ceil(F.col("members") / CELL).cast("int").alias("cells"), "blocks")
    deal = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    every = delta.join(parts, "family").select("family", deal(F.col("cells")).alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", "n", "delta")
    asked = others.join(parts, "family").select("family", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), deal(F.col("blocks")).alias("block"), "sid", "n", "delta")
    both = every.unionByName(asked).repartition(shuffle, "family", "cell", "block").sortWithinPartitions("family", "cell", "block", "sid")
    return main.unionByName(both.mapInArrow(_cells(percent), "a long, b long"))


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    return _rows(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def _rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``classes`` with the hash of each row's text and its class (null without words): ids may be null or repeat."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    order = spark.sparkContext.broadcast(frequent(own, n))  # at most REMEMBERED hashes

    def digest(batches):
        for big in batches:
            for batch in sub_batches(big, "_text"):
                yield _digest(_sets(batch.column("_text"), n, order.value), percent, batch.column("doc_id"), batch.column("_hash"))

    made = materialize(own.mapInArrow(digest, "doc_id long, _hash long, n long, k1 long, k2 long, h1 long, h2 long, profile binary, prefix array<long>"), "sets")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("_hash").alias("hash"))).alias("at")
    # The least id that is not null stands apart from the row that the set is fetched from.
    one = made.where("n > 0").groupBy("k1", "k2").agg(least, F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("profile").alias("profile"), F.first("prefix").alias("prefix"))
    one = materialize(one.withColumn("sid", F.monotonically_increasing_id()), "distinct")

    shuffle = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    very = lambda t: F.shiftrightunsigned(t, 58) >= HOT_CLASS
    posted = one.select("sid", "n", "h1", "h2", F.posexplode("prefix").alias("pos", "token")).where(~very(F.col("token")))
    dealt = posted.select("token", "sid", "n", "pos", "h1", "h2").repartition(shuffle, "token").sortWithinPartitions("token", "n", "sid")
    pairs = materialize(dealt.mapInArrow(_connect(percent), "a long, b long, long boolean"), "pairs")
    side = lambda c: one.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("profile").alias(f"p{c}"))
    near = pairs.where(~F.col("long")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_profiled(percent), "a long, b long")
    lists = pairs.where(F.col("long")).select(F.col("a").alias("token"), F.col("b").alias("sid")).join(one.select("sid", "n", "profile"), "sid")
    led = one.select("sid", "n", "profile", F.filter("prefix", very).alias("tokens")).where(F.size("tokens") > 0).sortWithinPartitions("n", "sid")
    led = materialize(led.mapInArrow(_lead_here(percent), _LED), "led")
    lists = lists.withColumns({"reach": F.lit(0.0), "radius": F.lit(0.0)}).unionByName(led.where("token is not null").drop("joined"))
    lists = lists.repartition(shuffle, "token").sortWithinPartitions("token", "n", "sid").mapInArrow(_lead(percent), "a long, b long")
    here = led.where("token is null").select(F.col("sid").alias("a"), F.col("joined").alias("b"))
    family = components(near.unionByName(lists).unionByName(here))

    wanted = one.join(family, one["sid"] == family["v"]).select("sid", F.col("root").alias("family"), F.col("at.id").alias("_id"), F.col("at.hash").alias("_hash"))
    fetched = own.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(wanted, ["_id", "_hash"]).select("family", "sid", "_text")

    def tokens(batches):
        for big in batches:
            for batch in sub_batches(big, "_text"):
                sets = _sets(batch.column("_text"), n, order.value)
                lengths = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("family"), batch.column("sid"), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], names=["family", "sid", "tokens"]
                )

    whole = materialize(fetched.mapInArrow(tokens, "family long, sid long, tokens array<long>"), "families")
    counts = materialize(family.groupBy(F.col("root").alias("family")).agg(F.count("*").alias("members")).where(F.col("members") > BIG), "big")
    small = whole.join(counts, "family", "left_anti")
    solved = small.repartition(shuffle, "family").sortWithinPartitions("family", "sid").mapInArrow(_families(percent), "sid long, root long")
    if not counts.isEmpty():
        links = _spread(whole.join(counts, "family", "left_semi"), counts, percent, shuffle)
        solved = solved.unionByName(components(links).withColumnRenamed("v", "sid"))
    solved = materialize(solved, "classes")
    joined = one.select("sid", "k1", "k2", "low").join(solved, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    joined = materialize(joined, "joined")  # this and the next are written so that Spark may split a large class
    top = materialize(joined.groupBy("root").agg(F.min("low").alias("component_id")), "tops")
    of_set = joined.join(top, "root").select("k1", "k2", "component_id", "root")
    some = made.where("n > 0").select("doc_id", "_hash", "n", "k1", "k2").join(of_set, ["k1", "k2"]).select("doc_id", "_hash", F.col("n").alias("n_shingles"), "component_id", "root")
    none = made.where("n = 0").select("doc_id", "_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    out = materialize(some.unionByName(none), "rows")
    discard(made, one, pairs, led, family, whole, counts, solved, joined, top)
    return out


def one_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class: that of the least (id, hash of text), a null id being the least, and any one of rows
    that are equal in both. Documents without words stay.

    Rows are told apart by id and text, so a row that shares its id with one of another class is judged on its own.
    """
    row = F.struct("doc_id", "_hash")
    rows = _rows(docs, n, percent).where("root is not null").groupBy("root", "doc_id", "_hash").agg(F.count("*").alias("times"))
    rows = materialize(rows, "class-rows")
    tops = materialize(rows.groupBy("root").agg(F.min(row).alias("top")), "class-tops")  # so that Spark may split a large class
    judged = rows.join(tops, "root").withColumn("first", row.eqNullSafe(F.col("top")))
    judged = materialize(judged.where(~F.col("first") | (F.col("times") > 1)).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), "first"), "judged")
    discard(rows, tops)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_of"))
    alone = docs.join(judged, same, "left_anti")
    repeated = docs.join(judged.where("first"), same).dropDuplicates(["_id", "_of"]).select(docs.columns)
    return alone.unionByName(repeated)
