"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are runs of letters, digits and bytes beyond ASCII, with ASCII capitals folded, so punctuation and case
don't hide a copy. Every run of ``SEED`` words of a test item is looked up in all documents, and the number of
documents that hold it is counted, and likewise every run of ``SEED`` + 2. An item's seeds are its rare n-grams: those
that at most FEW documents or one in 1000 hold; and those that are frequent because the item is, which shows in at
least half of their documents also holding a longer run of the item around them. A passage copied everywhere therefore
keeps its seeds, and a common turn of phrase is none. Where that leaves words of an item in no seed, its longer runs
of as few documents stand in, and where all are frequent, the least frequent of every STRETCH in a row, so that no
item is without seeds over its length. A document that holds a seed is aligned with the item around the seed's diagonal by
Smith-Waterman on words (match 2, mismatch -1, gap -1), which bridges words that were changed, dropped or put in.
A pair counts as contaminated where the score is at least ``THRESHOLD`` of what a full copy of the item, or of 50
of its words, would score.

Two scans of the documents, no shuffle of text. The test set is broadcast in blocks of at most ``BLOCK_BYTES`` of
text, each with its own scans, so its size bounds the number of scans and not memory.

Defined results: null and empty texts match nothing, as do items without words; an item of fewer than ``SEED``
words is its own seed; repeated rows are judged each on its own and give one row per (doc_id, item_id) of the
best score; empty tables give an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.common import shingles, sub_batches, text_bytes, word_hashes, words

SEED = 3
THRESHOLD = 0.5
FULL = 50
MATCH, MISMATCH, GAP = 2, 1, 1
FEW = 20
STRETCH = 5
BLOCK_BYTES = 32 << 20

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, document rows, start and end bytes of a text column."""
    raw, at = text_bytes(column)
    start, end, row = words(raw, at, _BREAK)
    return word_hashes(raw, start, end), row, start - at[row] if len(row) else start, end - at[row] if len(row) else end


class Members:
    """Membership of hashes in a sorted set: a bit table by the low 20 bits first, a binary search for what is left."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = np.zeros(1 << 20, bool)
        self.table[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``hashes`` of the members, and their indexes into the set."""
        maybe = np.flatnonzero(self.table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.values, hashes[maybe])
        at[at == len(self.values)] = 0
        real = self.values[at] == hashes[maybe] if len(self.values) else np.zeros(len(maybe), bool)
        return maybe[real], at[real]


class Items:
    """Test items as word hashes, with an index from seed to (item, place)."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        self.ids, self.seed = np.array(ids, np.int64), seed
        h, row, _, _ = tokens(pa.array(texts, pa.string()))
        self.words = [h[row == i] for i in range(len(ids))]
        grams, place, item = [], [], []
        for i, w in enumerate(self.words):
            g, _ = shingles(w, np.zeros(len(w), np.int64), seed)
            grams.append(g)
            place.append(np.arange(len(g)))
            item.append(np.full(len(g), i))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.gram, self.place, self.item = join(grams, np.uint64), join(place, np.int64), join(item, np.int64)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.place, self.item = self.gram[order], self.place[order], self.item[order]
        self.members: Members | None = None
        self.runs = False  # whether longer runs are among the seeds

    def longer(self) -> np.ndarray:
        """Hashes of all runs of ``seed`` + 2 words of the items."""
        parts = [shingles(w, np.zeros(len(w), np.int64), self.seed + 2)[0] for w in self.words if len(w) >= self.seed + 2]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def keep_rare(self, documents: dict[int, int], total: int) -> None:
        """Leave the seeds alone; ``documents`` has the number of documents of each n-gram and longer run."""
        held = np.array([documents.get(int(g), 0) for g in self.gram.view(np.int64)], np.int64)
        keep = held <= max(FEW, total / 1000)
        for i in np.unique(self.item[~keep]).tolist():
            w = self.words[i]
            around = np.zeros(max(1, len(w) - self.seed + 1), np.int64)  # the most documents of a longer run over each place
            if len(w) < self.seed + 2:
                around[:] = np.iinfo(np.int64).max
            else:
                runs = shingles(w, np.zeros(len(w), np.int64), self.seed + 2)[0].view(np.int64).tolist()
                for k, n in enumerate(documents.get(r, 0) for r in runs):
                    around[k : k + 3] = np.maximum(around[k : k + 3], n)
            mine = np.flatnonzero((self.item == i) & ~keep)
            keep[mine] = around[self.place[mine]] >= held[mine] / 2
        bare = np.unique(self.item[~keep]).tolist()
        parts = [(self.gram[keep], self.place[keep], self.item[keep])]
        for i in bare:
            runs, place = self._stand_ins(i, self.place[keep & (self.item == i)], documents, max(FEW, total / 1000))
            parts.append((runs, place, np.full(len(runs), i)))
        self.gram, self.place, self.item = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.place, self.item = self.gram[order], self.place[order], self.item[order]
        self.runs = len(parts) > 1

    def _stand_ins(self, i: int, places: np.ndarray, documents: dict[int, int], limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Longer runs (hashes, places) to seed item ``i`` with where no seed at ``places`` lies within them."""
        w = self.words[i]
        if len(w) < self.seed + 2:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        runs = shingles(w, np.zeros(len(w), np.int64), self.seed + 2)[0]
        held = np.array([documents.get(int(r), 0) for r in runs.view(np.int64)], np.int64)
        seeded = np.zeros(len(w) + 1, np.int64)
        np.add.at(seeded, places + 1, 1)
        seeded = np.cumsum(seeded)
        bare = seeded[np.minimum(np.arange(len(runs)) + 3, len(w))] == seeded[: len(runs)]
        chosen = bare & (held <= limit)
        left = np.flatnonzero(bare & ~chosen)
        for stretch in np.split(left, np.flatnonzero(np.diff(left) > 1) + 1):
            alone = not (len(places) or chosen.any())
            for k in range(0, len(stretch) if alone else len(stretch) - STRETCH + 1, STRETCH):
                part = stretch[k : k + STRETCH]
                chosen[part[held[part].argmin()]] = True
        return runs[chosen], np.flatnonzero(chosen)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``grams`` and into this index, one pair for each equal n-gram."""
        if self.members is None:
            self.members = Members(np.unique(self.gram))
        here, _ = self.members.where(grams)
        lo, hi = np.searchsorted(self.gram, grams[here], side="left"), np.searchsorted(self.gram, grams[here], side="right")
        times = hi - lo
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(here, times), np.repeat(lo, times) + within


def align(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of many pairs at once, and where in ``b`` each ends (index after).

    ``a`` and ``b`` are (pairs, words) arrays of hashes, padded; linear gaps make each row one running maximum.
    """
    n, m = b.shape[0], b.shape[1]
    ramp = np.arange(m + 1, dtype=np.int32) * GAP
    inside = np.arange(m)[None, :] < b_len[:, None]
    row = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        same = (a[:, i : i + 1] == b) & inside & (i < a_len)[:, None]
        new = np.zeros((n, m + 1), np.int32)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, -MISMATCH), row[:, 1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _candidates(items: Items, h, row, grams, gram_row, word_first):
    """(document row, item, first word, last word): windows around runs of near diagonals."""
    which, entry = items.hits(grams)
    if not len(which):
        return np.zeros((0, 4), np.int64)
    doc, item, diagonal = gram_row[which], items.item[entry], word_first[which] - items.place[entry]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.array([len(w) for w in items.words], np.int64)[item]
    slack = size // 4 + 4
    begin = np.ones(len(doc), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    heads = np.flatnonzero(begin)
    lo = diagonal[heads] - slack[heads]
    hi = np.maximum.reduceat(diagonal, heads) + size[heads] + slack[heads]
    return np.column_stack([doc[heads], item[heads], lo, hi])


def find(items: Items, column, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score share, start byte, end byte) of the pairs that reach the threshold."""
    h, row, start, end = tokens(column)
    if not len(h):
        return []
    grams, gram_row, first = grams_of(h, row, items.seed)
    if items.runs:
        both = zip((grams, gram_row, first), grams_of(h, row, items.seed + 2), strict=True)
        grams, gram_row, first = (np.concatenate(x) for x in both)
    found = _candidates(items, h, row, grams, gram_row, first)
    count = np.bincount(row, minlength=len(column))
    base = np.cumsum(count) - count
    out = []
    sizes = np.array([len(w) for w in items.words], np.int64)
    order = np.argsort(sizes[found[:, 1]], kind="stable") if len(found) else []
    for begin in range(0, len(found), 256):
        part = found[order[begin : begin + 256]]
        a_len = sizes[part[:, 1]]
        lo = np.maximum(part[:, 2], base[part[:, 0]])
        hi = np.minimum(part[:, 3], base[part[:, 0]] + count[part[:, 0]])
        b_len = np.maximum(0, hi - lo)
        a = np.zeros((len(part), int(a_len.max(initial=1))), np.uint64)
        b = np.zeros((len(part), int(b_len.max(initial=1))), np.uint64)
        for k in range(len(part)):
            a[k, : a_len[k]] = items.words[part[k, 1]]
            b[k, : b_len[k]] = h[lo[k] : hi[k]]
        score, last = align(a, b, a_len, b_len)
        share = score / (MATCH * np.minimum(a_len, FULL))
        for k in np.flatnonzero(share >= threshold):
            final = lo[k] + last[k] - 1
            opening = max(lo[k], final - a_len[k] - a_len[k] // 4 + 1)
            shared = np.flatnonzero(np.isin(h[opening : final + 1], items.words[part[k, 1]]))
            opening += shared[0] if len(shared) else 0
            out.append((int(part[k, 0]), int(part[k, 1]), float(min(1.0, share[k])), int(start[opening]), int(end[final])))
    return out


def grams_of(h: np.ndarray, row: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document row and first word of every n-gram; documents of fewer words are one n-gram each."""
    grams, gram_row = shingles(h, row, seed)
    count = np.bincount(row)
    base = np.cumsum(count) - count
    per = np.where(count == 0, 0, np.maximum(1, count - seed + 1))
    within = np.arange(len(grams)) - np.repeat(np.cumsum(per) - per, per)
    return grams, gram_row, base[gram_row] + within


def _blocks(benchmark: DataFrame):
    """The test set in blocks of at most BLOCK_BYTES of text, read in the order of ids, one block on the driver at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.coalesce("text", F.lit("")) != "").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, score, start_byte, end_byte): pairs of a document and an item copied or edited into it.

    The span is of UTF-8 bytes and reaches from the first to the last aligned word, the first one to within the
    words an edit may have put before it.
    """
    out = _found(docs, benchmark, threshold, seed)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start_byte"), "end_byte")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("start_byte"), "b.end_byte")


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, seed: int) -> DataFrame:
    """What ``contaminated`` gives, a row for each row of ``docs`` and item, with the hash of the row's text."""
    spark = docs.sparkSession
    schema = "doc_id long, _hash long, item_id long, score double, start_byte long, end_byte long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("_hash"), F.col("text").cast("string").alias("text"))
    out = None
    for ids, items_text in _blocks(benchmark):
        items = Items(ids, items_text, seed)
        index = spark.sparkContext.broadcast(Members(np.union1d(items.gram, items.longer())))

        def count(batches, index=index, seed=seed):
            total: dict[int, int] = {}
            rows = 0
            for big in batches:
                for batch in sub_batches(big, "text"):
                    rows += batch.num_rows
                    h, row, _, _ = tokens(batch.column("text"))
                    grams, gram_row, _ = grams_of(h, row, seed)
                    mine, at = index.value.where(grams)
                    runs, run_row = shingles(h, row, seed + 2)
                    more, at_more = index.value.where(runs)
                    pairs = np.unique(np.column_stack([np.concatenate([gram_row[mine], run_row[more]]), np.concatenate([at, at_more])]), axis=0)
                    for k, n in zip(*np.unique(pairs[:, 1], return_counts=True), strict=True):
                        total[int(k)] = total.get(int(k), 0) + int(n)
            grams = index.value.values[list(total)].view(np.int64) if total else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*grams.tolist(), None], pa.int64()), pa.array([*total.values(), rows], pa.int64())], names=["gram", "n"]
            )

        held = {r["gram"]: r["n"] for r in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        items.keep_rare(held, held.get(None, 0) or 0)
        chosen = spark.sparkContext.broadcast(items)

        def scan(batches, chosen=chosen):
            for big in batches:
                for batch in sub_batches(big, "text"):
                    doc, of, items = batch.column("doc_id"), batch.column("_hash"), chosen.value
                    found = find(items, batch.column("text"), threshold)
                    columns = list(zip(*found, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc.take(pa.array(columns[0], pa.int64())), of.take(pa.array(columns[0], pa.int64())), pa.array(items.ids[np.array(columns[1], np.int64)], pa.int64()),
                            pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
                        ],
                        names=["doc_id", "_hash", "item_id", "score", "start_byte", "end_byte"],
                    )

        part = texts.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no test item was found, with all their columns. Rows are judged each on its own, by id
    (null ones too) and text.
    """
    bad = _found(docs, benchmark, threshold, SEED).select(F.col("doc_id").alias("_bad"), F.col("_hash").alias("_of")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")) & (_text_hash() == F.col("_of"))
    return docs.join(bad, same, "left_anti")
