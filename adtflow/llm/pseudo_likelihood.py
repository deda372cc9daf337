"""LM scoring by masked pseudo-likelihood: how well the words on both sides together predict every word.

A network is trained in numpy to predict a masked token from its window of two tokens on either side: each neighbour has
an embedding (one for each side, weighed by distance), their sum goes through tanh, and a binary tree over all tokens
turns it into probabilities: at each inner node a logistic unit on the hidden layer decides for a branch. These are
a proper distribution over the whole vocabulary at a cost of the path's length. A document's score is the sum over its
tokens of the logarithm of the probability that the network gives to each, the token itself hidden.

Tokens: words between ASCII white space (capitals folded). The vocabulary grows with the corpus: all words that it
holds LEAST times or more, and of those as many classes of like counts as WORDS has room for. Other words are cut into pieces of three bytes, which
are tokens like any other, predicted from both sides; pieces are known by one of PIECES hash buckets, and beginnings of words
have their own.

What is learnt covers all rows. One pass counts all words (the counts give the tree, a Huffman code, and its units their
starting biases, so that before any training the model is the corpus's unigram distribution). Texts are then cut into tokens,
which are stored (16 bits each) for training and for scoring. Every task trains
a copy of the network on its own rows, every token a target (each STRIDE-th, where asked for), in minibatches; the copies' changes are averaged
row by row, each weighed by how often the task met that row, so rare words keep what few tasks learnt. What is gathered
grows with the corpus (a count for each distinct word of each part, a set of changes for each task) and is summed by the
executors; the driver receives the vocabulary and one set of parameters, of a size bounded by WORDS + PIECES.

Defined results: null, empty and blank texts have 0 words, score 0 and per_word 0; repeated rows score alike and
count as often as they occur; an empty table trains nothing and gives an empty result. Extra columns are kept, those
named like results replaced. Training adds in an order that Spark chooses: scores of two runs agree to rounding only.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.common import _LOWER, discard, materialize, mix, signed, sub_batches, text_bytes, word_hashes, words

WORDS, PIECES, LEAST = 24_576, 8_192, 3
LEAVES = WORDS + PIECES
EDGE = LEAVES  # the neighbour beyond a document's end
ID = np.dtype("<u2")  # what a stored token takes
WIDTH = 16
STRIDE, BATCH, RATE = 1, 8192, 0.15
#: Inner nodes next to the root that are read as one matrix (they hold some six tenths of all steps down the tree), and tokens at a time.
TOP, SLICE = 64, 4096
#: Tasks with less text go over it again until they have made so many steps.
STEPS = 60
#: Words counted, targets trained on, and bytes of text or tokens read, at a time.
CHUNK, TARGETS, PART = 1 << 22, 1 << 19, 1 << 20
#: Rows of a parameter table that travel together.
BLOCK = 1024


# -- tokens -------------------------------------------------------------------------------------------------


def pieces(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, place in it) of the pieces of three bytes of words, in order."""
    many = (end - start + 2) // 3
    of = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    at = start[of] + 3 * place
    size = np.minimum(3, end[of] - at)
    low = np.concatenate([_LOWER[raw], np.zeros(2, np.uint8)]).astype(np.uint64)
    value = low[at] | np.where(size > 1, low[at + 1] << np.uint64(8), np.uint64(0)) | np.where(size > 2, low[at + 2] << np.uint64(16), np.uint64(0))
    key = value | size.astype(np.uint64) << np.uint64(24) | (place == 0).astype(np.uint64) << np.uint64(27)
    return (mix(key + np.uint64(1)) % np.uint64(PIECES)).astype(np.int64), of, place


class Ranks:
    """The rank of each hash in a vocabulary, by three small tables on different bits; the few words that all three lose
    to others are searched for."""

    BITS = 17

    def __init__(self, vocab: np.ndarray):
        self.vocab, self.tables = np.append(vocab, np.uint64(0)), []
        left = np.arange(len(vocab))
        for level in range(3):
            table = np.full(1 << self.BITS, len(vocab), np.int32)
            slot = self._slot(vocab[left], level)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        left = left[np.argsort(vocab[left])]
        self.rest, self.known = left, vocab[left]

    def _slot(self, h: np.ndarray, level: int) -> np.ndarray:
        return (h >> np.uint64(self.BITS * level) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        """-1 for words outside."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, table in enumerate(self.tables):
            mine = np.take(h, open_)
            rank = np.take(table, self._slot(mine, level))
            hit = (np.take(self.vocab, rank) == mine) & (rank < len(self.vocab) - 1)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        if len(self.rest):
            mine = np.take(h, open_)
            at = np.minimum(np.searchsorted(self.known, mine), len(self.rest) - 1)
            hit = np.take(self.known, at) == mine
            out[open_[hit]] = self.rest[at[hit]]
        return out


def encode(column, ranks: Ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their document rows, the rows of whole words)."""
    raw, at = text_bytes(column)
    start, end, row = words(raw, at)
    rank = ranks.of(word_hashes(raw, start, end) | np.uint64(PIECES))
    rare = np.flatnonzero(rank < 0)
    bucket, of, place = pieces(raw, start[rare], end[rare])
    many = np.ones(len(start), np.int64)
    many[rare] = (end[rare] - start[rare] + 2) // 3
    first = np.cumsum(many) - many
    ids = np.empty(int(many.sum()), np.int64)
    ids[first[rank >= 0]] = rank[rank >= 0]
    ids[first[rare[of]] + place] = WORDS + bucket
    return ids, np.repeat(row, many), row


def stored_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, their document rows) of a binary column that ``encoded`` made."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // ID.itemsize if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(data, ID)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, ID)
    return ids.astype(np.int64), np.repeat(np.arange(len(column)), np.diff(at))


def windows(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token those one and two places to the left and to the right, EDGE beyond its document."""
    out = np.full((len(ids), 4), EDGE, np.int32)
    for k, step in enumerate((1, 2)):
        if len(ids) > step:
            same = row[step:] == row[:-step]
            out[step:, k] = np.where(same, ids[:-step], EDGE)
            out[:-step, 2 + k] = np.where(same, ids[step:], EDGE)
    return out


# -- the corpus's counts ------------------------------------------------------------------------------------


def counts(texts: DataFrame) -> DataFrame:
    """(h, n): occurrences of every distinct word by hash, and under the numbers below PIECES of pieces in distinct words."""

    def run(batches):
        held, spelled, size = [], np.zeros(PIECES, np.int64), 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            used = np.flatnonzero(spelled)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([signed(h), used])), pa.array(np.concatenate([n, spelled[used]]))], names=["h", "n"])

        for big in batches:
            for batch in sub_batches(big, "_text", PART):
                raw, at = text_bytes(batch.column("_text"))
                start, end, _ = words(raw, at)
                h = word_hashes(raw, start, end) | np.uint64(PIECES)
                held.append(h)
                _, one = np.unique(h, return_index=True)
                spelled += np.bincount(pieces(raw, start[one], end[one])[0], minlength=PIECES)
                size += len(start)
                if size >= CHUNK:
                    yield flush()
                    held, spelled, size = [], np.zeros(PIECES, np.int64), 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the vocabulary's words by rank, expected occurrences of all LEAVES tokens)."""
    made = materialize(counts(texts), "word-counts")
    piece = F.col("h").between(0, PIECES - 1)
    common = made.where(~piece & (F.col("n") >= LEAST))
    kind = F.floor(16 * F.log2("n")).cast("int")
    # As many classes of counts, from the most frequent down, as WORDS has room for: some hundred rows decide, no sort.
    room, least = WORDS, 1 << 20
    for r in sorted(common.groupBy(kind.alias("k")).count().collect(), key=lambda r: -r["k"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["k"]
    rows = common.where(kind >= least).toPandas().sort_values(["n", "h"], ascending=[False, True])
    total = made.where(~piece).agg(F.sum("n")).first()[0] or 0
    spelled = made.where(piece).toPandas()
    discard(made)
    out = np.zeros(LEAVES)
    out[: len(rows)] = rows["n"].to_numpy(float)
    buckets = np.zeros(PIECES)
    buckets[spelled["h"].to_numpy(np.int64)] = spelled["n"].to_numpy(float)
    # Rare words have some three pieces each; how these are distributed is read off the distinct words.
    out[WORDS:] = 3 * (total - out.sum()) * buckets / max(1.0, buckets.sum())
    return rows["h"].to_numpy(np.int64).view(np.uint64), out


# -- the network --------------------------------------------------------------------------------------------


class Tree:
    """A Huffman code of tokens with these counts: inner nodes of each token's path to the root, and the branch taken.

    Inner nodes are numbered by ascending weight, so the TOP heaviest are the last ones and every path ends in them. ``low``
    and ``high`` have the paths below and in the top, a row a token, as 2 * node + (1 for a positive side); in ``high`` nodes
    count from ``top``, and what a path leaves free points behind the last."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        weight = np.concatenate([weights + 0.5, np.zeros(n - 1)])
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        heap = [(w, i) for i, w in enumerate(weight[:n].tolist())]
        heapq.heapify(heap)
        odds = np.zeros(n - 1)
        for k in range(n, 2 * n - 1):
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = k
            side[a], side[b] = 1, -1
            odds[k - n] = np.log(wa / wb)
            heapq.heappush(heap, (wa + wb, k))
        at, nodes, sides = np.arange(n), [], []
        root = 2 * n - 2
        while (at != root).any():
            live = at != root
            nodes.append(np.where(live, parent[at] - n, -1))
            sides.append(np.where(live, side[at], 0))
            at = np.where(live, parent[at], root)
        grid, turn = np.array(nodes).T, np.array(sides).T
        self.length = (grid >= 0).sum(axis=1)
        self.node = grid[grid >= 0].astype(np.int64)
        self.side = turn[grid >= 0].astype(np.float32)
        self.start = np.cumsum(self.length) - self.length
        self.odds = odds.astype(np.float32)
        self.top = max(0, n - 1 - TOP)
        self.below = ((grid >= 0) & (grid < self.top)).sum(axis=1).astype(np.uint16)
        code = np.where(grid >= 0, 2 * grid + (turn > 0), 2 * (n - 1) + 1)
        depth = int((self.length - self.below).max(initial=1))
        at = np.minimum(self.below[:, None] + np.arange(depth), grid.shape[1])
        code = np.column_stack([code, np.full(n, 2 * (n - 1) + 1)])
        self.high = np.ascontiguousarray(np.take_along_axis(code, at, axis=1) - 2 * self.top, np.int32)
        self.low = np.ascontiguousarray(code[:, : int(self.below.max(initial=0))], np.min_scalar_type(2 * n))
        # Tokens by ``below``, and then as they hang in the tree: neighbours share most of their paths.
        down = np.maximum(self.length[:, None] - 1 - np.arange(grid.shape[1]), -1)
        hung = np.where(down >= 0, np.take_along_axis(turn, np.maximum(down, 0), axis=1), 0)
        self.place = np.empty(n, np.min_scalar_type(n))
        self.place[np.lexsort([*hung.T[::-1], self.below])] = np.arange(n)

    def paths_below(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(inner nodes, branches) of the paths below the top of tokens that ascend by ``below``, and for all tokens with
        one length: from which to which they stand, and from which to which their paths do."""
        many, grid = np.take(self.below, tokens), np.take(self.low, tokens, axis=0)
        parts, spans, at = [np.zeros(0, grid.dtype)], [], 0
        for a, b in _runs(many):
            if size := int(many[a]):
                parts.append(grid[a:b, :size].ravel())
                spans.append((a, b, at, at + len(parts[-1])))
                at += len(parts[-1])
        code = np.concatenate(parts)
        return (code >> 1).astype(np.int64), _side(code), spans

    def paths(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inner nodes, branches, the token's place in ``tokens``) of all paths, and where each path begins."""
        many = self.length[tokens]
        first = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(self.start[tokens] - first, many)
        return np.take(self.node, at), np.take(self.side, at), np.repeat(np.arange(len(tokens)), many), first


class Network:
    """h = tanh(sum of weighed neighbour embeddings + h0); p(token) = product over its path of sigma(side * (u . h + bias))."""

    TABLES = ("left", "right", "u", "bias", "weigh", "h0")

    def __init__(self, weights: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tree = Tree(weights)
        n = len(weights)
        self.left = rng.normal(0, 0.4, (n + 1, WIDTH)).astype(np.float32)
        self.right = rng.normal(0, 0.4, (n + 1, WIDTH)).astype(np.float32)
        self.u = np.zeros((n - 1, WIDTH), np.float32)
        self.bias = self.tree.odds[:, None].copy()
        self.weigh = np.repeat(np.array([1.0, 0.5, 1.0, 0.5], np.float32)[:, None], WIDTH, axis=1)
        self.h0 = np.zeros((1, WIDTH), np.float32)

    def hidden(self, around: np.ndarray, near: list | None = None) -> np.ndarray:
        """The hidden layer; ``near`` gets the neighbours' rows."""
        out = np.repeat(self.h0, len(around), axis=0)
        for k, table in enumerate((self.left, self.left, self.right, self.right)):
            rows = np.take(table, around[:, k], axis=0)
            if near is None:
                rows *= self.weigh[k]
                out += rows
            else:
                near.append(rows)
                out += rows * self.weigh[k]
        return np.tanh(out, out=out)

    def _top(self) -> np.ndarray:
        """Vectors of the top, each with its bias, with a last unit that is sure of its branch."""
        top = self.tree.top
        sure = np.zeros((1, WIDTH + 1), np.float32)
        sure[0, -1] = 60
        return np.concatenate([np.column_stack([self.u[top:], self.bias[top:]]), sure])

    def _low_z(self, h: np.ndarray, taken: np.ndarray, node: np.ndarray, side: np.ndarray, spans: list) -> np.ndarray:
        z = np.empty(len(node), np.float32)
        for a, b, c, d in spans:
            np.einsum("nlk,nk->nl", taken[c:d].reshape(b - a, -1, WIDTH), h[a:b], out=z[c:d].reshape(b - a, -1))
        z += np.take(self.bias[:, 0], node)
        z *= side
        return z

    def log_p(self, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
        """The logarithm of each token's probability in its window."""
        out, top = np.zeros(len(tokens)), self._top()
        for a in range(0, len(tokens), SLICE):  # so few that what is gathered stays in a core's cache
            some = a + np.argsort(np.take(self.tree.place, tokens[a : a + SLICE]), kind="stable")
            mine = np.take(tokens, some)
            h = self.hidden(np.take(around, some, axis=0))
            code = np.take(self.tree.high, mine, axis=0)
            z = np.take((_with_one(h) @ top.T).ravel(), _flat(code, len(top))) * _side(code)
            each = _log_sigma(z).sum(axis=1, dtype=np.float64)
            node, side, spans = self.tree.paths_below(mine)
            z = _log_sigma(self._low_z(h, np.take(self.u, node, axis=0), node, side, spans))
            for b, e, c, d in spans:
                each[b:e] += z[c:d].reshape(e - b, -1).sum(axis=1, dtype=np.float64)
            out[some] = each
        return out

    def step(self, tokens: np.ndarray, around: np.ndarray, memory: dict[str, np.ndarray], met: dict[str, np.ndarray], rate: float) -> float:
        """One minibatch of Adagrad; ``memory`` has the squares so far, ``met`` counts the rows' uses. The mean loss."""
        tree, n = self.tree, len(tokens)
        order = np.argsort(np.take(tree.place, tokens), kind="stable")
        tokens, around = np.take(tokens, order), np.take(around, order, axis=0)
        h, loss, top, weigh = np.empty((n, WIDTH), np.float32), 0.0, self._top(), np.zeros_like(self.weigh)
        change, back = np.zeros(WIDTH, np.float32), {k: np.empty((2 * n, WIDTH), np.float32) for k in ("left", "right")}
        grad_top, used = np.zeros_like(top), np.zeros(len(top), np.int64)
        nodes, slopes = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for start in range(0, n, SLICE):
            some, near = slice(start, min(n, start + SLICE)), []
            h[some] = mine = self.hidden(around[some], near)
            # The top: all its units for all tokens, of which each token's own are picked.
            code, one = np.take(tree.high, tokens[some], axis=0), _with_one(mine)
            flat, side, z = _flat(code, len(top)), _side(code), one @ top.T
            g, lost = _slope(np.take(z.ravel(), flat) * side, side)
            z.fill(0)
            z.ravel()[flat] = g
            z[:, -1] = 0
            dh = z @ np.ascontiguousarray(top[:, :-1])
            grad_top += z.T @ one
            used += np.bincount((code >> 1).ravel(), minlength=len(top))
            # Below, where units are many and each is met by few.
            node, side, spans = tree.paths_below(tokens[some])
            taken = np.take(self.u, node, axis=0)
            g, lost_below = _slope(self._low_z(mine, taken, node, side, spans), side)
            for a, b, c, d in spans:
                dh[a:b] += np.einsum("nl,nlk->nk", g[c:d].reshape(b - a, -1), taken[c:d].reshape(b - a, -1, WIDTH))
            mine *= mine
            dh *= np.subtract(1, mine, out=mine)
            change += dh.sum(axis=0)
            for k, rows in enumerate(near):
                weigh[k] += np.einsum("ij,ij->j", dh, rows)
                np.multiply(dh, self.weigh[k], out=back["left" if k < 2 else "right"][some.start + k % 2 * n : some.stop + k % 2 * n])
            nodes.append(node)
            slopes.append(g)
            loss += lost + lost_below
        node, g = np.concatenate(nodes), np.concatenate(slopes)
        rows, by, many = _by_row(node, len(self.bias))
        of = np.repeat(np.arange(n), np.take(tree.below, tokens))
        here = np.take(h, np.take(of, by), axis=0)
        met_top = np.flatnonzero(used[:-1])
        grad_u = np.concatenate([_sums(here, many, np.take(g, by)), grad_top[met_top, :-1]])
        grad_bias = np.concatenate([np.bincount(node, weights=g, minlength=len(self.bias))[rows], grad_top[met_top, -1]]).astype(np.float32)
        rows, many = np.concatenate([rows, met_top + tree.top]), np.concatenate([many, used[met_top]])
        changes = {"u": (rows, many, grad_u), "bias": (rows, many, grad_bias[:, None])}
        for name, places in (("left", (0, 1)), ("right", (2, 3))):
            rows, by, many = _by_row(np.concatenate([around[:, k] for k in places]), len(getattr(self, name)))
            changes[name] = rows, many, _sums(np.take(back[name], by, axis=0), many)
        for name, (rows, many, grad) in changes.items():
            squares, table = memory[name], getattr(self, name)
            grad /= np.sqrt(many, dtype=np.float32)[:, None]
            total = np.take(squares, rows, axis=0)
            total += grad * grad
            _put(squares, rows, total)
            grad *= np.float32(rate)
            grad /= np.sqrt(total, out=total)
            _put(table, rows, np.take(table, rows, axis=0) - grad)
            met[name][rows] += many
        for name, grad in (("h0", change[None, :]), ("weigh", weigh)):
            squares, table = memory[name], getattr(self, name)
            part = grad / np.float32(n**0.5)
            squares += part * part
            table -= np.float32(rate) * part / np.sqrt(squares)
            met[name] += n
        return loss / max(1, n)

    def train(self, tokens: np.ndarray, around: np.ndarray, state: dict | None = None, steps: int = 0, seed: int = 0, rate: float = RATE) -> dict:
        """Minibatches of all targets in a random order, again and again until ``steps`` of them; returns the state."""
        if state is None:
            state = {"memory": {n: np.full(getattr(self, n).shape, 0.1, np.float32) for n in self.TABLES}, "met": {n: np.zeros(len(getattr(self, n))) for n in self.TABLES}, "losses": []}
        rng, done, rows = np.random.default_rng(seed), 0, np.column_stack([around, tokens]).astype(np.int32)
        while len(tokens) and (not done or done < steps):
            order = rng.permutation(len(tokens))
            for a in range(0, len(order), BATCH):
                some = np.take(rows, order[a : a + BATCH], axis=0)
                state["losses"].append(self.step(some[:, 4], some[:, :4], state["memory"], state["met"], rate))
                done += 1
        return state


def _with_one(h: np.ndarray) -> np.ndarray:
    """A last column of ones, for biases."""
    out = np.ones((len(h), WIDTH + 1), np.float32)
    out[:, :-1] = h
    return out


def _flat(code: np.ndarray, units: int) -> np.ndarray:
    """Places of the nodes of ``high`` in a matrix with a row a token."""
    return (code >> 1) + np.arange(0, len(code) * units, units, dtype=np.int32)[:, None]


def _side(code: np.ndarray) -> np.ndarray:
    return (code & 1).astype(np.float32) * np.float32(2) - np.float32(1)


def _log_sigma(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z)))


def _slope(z: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, float]:
    """(the loss's derivatives by what the units give, the loss), where z is that times the side."""
    low = np.exp(np.minimum(-z, 30))
    loss = float(np.log1p(low).sum())
    low /= -1 - low
    low *= side
    return low, loss


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Beginnings and ends of runs of one value."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True)) if len(values) else []


def _by_row(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the rows met, from the least met to the most; the order that puts their entries together; how many each has)."""
    count = np.bincount(row, minlength=rows)
    met = np.flatnonzero(count)
    met = met[np.argsort(count[met].astype(np.min_scalar_type(len(row))), kind="stable")]
    rank = np.zeros(rows, np.min_scalar_type(rows))  # numbers of 16 bits are sorted in linear time
    rank[met] = np.arange(len(met))
    return met, np.argsort(np.take(rank, row), kind="stable"), count[met]


def _sums(value: np.ndarray, many: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The sums of each ``many`` consecutive rows, weighed if so asked; rows with like counts are added together."""
    out, at = np.empty((len(many), value.shape[1]), np.float32), 0
    for a, b in _runs(many):
        size = int(many[a])
        end = at + (b - a) * size
        part = value[at:end].reshape(b - a, size, -1)
        if weight is not None:
            np.einsum("nl,nlk->nk", weight[at:end].reshape(b - a, size), part, out=out[a:b])
        elif size <= 4:
            out[a:b] = part[:, 0]
            for k in range(1, size):
                out[a:b] += part[:, k]
        else:
            np.matmul(np.ones(size, np.float32), part, out=out[a:b])
        at = end
    return out


def _put(table: np.ndarray, rows: np.ndarray, value: np.ndarray) -> None:
    """table[rows] = value, a row in one piece."""
    whole = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(whole)[rows, 0] = value.view(whole)[:, 0]


# -- training and scoring on tables -------------------------------------------------------------------------

_CHANGES = "name string, block int, deal int, changes binary, met binary"


def _trained(shared, stride: int, steps: int):
    """Each task's changes to the network, as sums weighed by use, in blocks of rows."""

    def run(batches):
        network = shared.value
        mine = copy.deepcopy(network)
        state, held, size = None, [], 0

        def flush(state):
            tokens, around = (np.concatenate(x) for x in zip(*held, strict=True))
            return mine.train(tokens, around, state, steps if state is None else 0, seed=1)

        for big in batches:
            for batch in sub_batches(big, "_tokens", PART):
                ids, row = stored_ids(batch.column("_tokens"))
                targets = np.arange(0, len(ids), stride)
                held.append((ids[targets], windows(ids, row)[targets]))
                size += len(targets)
                if size >= TARGETS:
                    state, held, size = flush(state), [], 0
        if size:
            state = flush(state)
        if state is None:
            return
        deal = TaskContext.get().partitionId() % 64
        for name in Network.TABLES:
            met = state["met"][name]
            change = (getattr(mine, name) - getattr(network, name)) * met[:, None]
            for a in range(0, len(met), BLOCK):
                if met[a : a + BLOCK].any():
                    part = (change[a : a + BLOCK].astype(np.float32).tobytes(), met[a : a + BLOCK].astype(np.float32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a // BLOCK], pa.int32()), pa.array([deal], pa.int32()), pa.array([part[0]], pa.binary()), pa.array([part[1]], pa.binary())], names=["name", "block", "deal", "changes", "met"])

    return run


def _added(batches):
    """Rows arrive sorted by (name, block, deal): the sums of each."""
    key, change, met = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())], names=["name", "block", "deal", "changes", "met"])

    for batch in batches:
        for *k, c, m in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            c, m = np.frombuffer(c, np.float32), np.frombuffer(m, np.float32)
            if k == key:
                change, met = change + c, met + m
                continue
            if key is not None:
                yield row()
            key, change, met = k, c, m
    if key is not None:
        yield row()


_RESULTS = {"n_words": "long", "log_likelihood": "double", "per_word": "double"}


def _schemas(docs: DataFrame, kept: list[str], more: dict[str, str]):
    """Schemas for Spark and Arrow of ``kept`` columns and more."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(t).alias(n) for n, t in more.items()]).schema
    for f in schema:
        f.nullable = True
    return schema, to_arrow_schema(schema)


def encoded(docs: DataFrame, vocab: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words and the tokens of every row (_tokens)."""
    kept = [c for c in docs.columns if c not in _RESULTS and c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema, arrow = _schemas(source, kept, {"n_words": "long", "_tokens": "binary"})
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most WORDS hashes

    def run(batches):
        ranks = Ranks(shared.value)
        for big in batches:
            for batch in sub_batches(big, "_text", PART):
                ids, row, of_words = encode(batch.column("_text"), ranks)
                at = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))) * ID.itemsize
                tokens = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.astype(ID))])
                columns = [*(batch.column(c) for c in kept), pa.array(np.bincount(of_words, minlength=batch.num_rows)), tokens]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def _fitted(stored: DataFrame, weights: np.ndarray, stride: int, steps: int) -> Network:
    """The network trained on all tokens."""
    spark, network = stored.sparkSession, Network(weights)
    shared = spark.sparkContext.broadcast(network)  # LEAVES rows of each table at most
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = stored.select("_tokens").mapInArrow(_trained(shared, stride, steps), _CHANGES)
    for keys in (["name", "block", "deal"], ["name", "block"]):
        made = made.withColumn("deal", F.lit(0)) if len(keys) == 2 else made
        made = made.repartition(n, *keys).sortWithinPartitions("name", "block", "deal").mapInArrow(_added, _CHANGES)
    for r in made.collect():  # one row a block
        table = getattr(network, r["name"])
        met = np.frombuffer(r["met"], np.float32)[:, None]
        rows = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(met))
        table[rows] += np.frombuffer(r["changes"], np.float32).reshape(len(met), -1) / np.maximum(met, 1)
    return network


def _scored(tokens: DataFrame, network: Network) -> DataFrame:
    kept = [c for c in tokens.columns if c not in (*_RESULTS, "_tokens")]
    schema, arrow = _schemas(tokens, kept, _RESULTS)
    shared = tokens.sparkSession.sparkContext.broadcast(network)  # bounded, see _fitted

    def run(batches):
        for big in batches:
            for batch in sub_batches(big, "_tokens", PART):
                ids, row = stored_ids(batch.column("_tokens"))
                n = np.asarray(batch.column("n_words"))
                total = np.bincount(row, weights=shared.value.log_p(ids, windows(ids, row)), minlength=batch.num_rows)
                columns = [*(batch.column(c) for c in kept), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return tokens.mapInArrow(run, schema)


def learn(docs: DataFrame, text: str = "text", stride: int = STRIDE, steps: int = STEPS) -> tuple[np.ndarray, Network]:
    """(the vocabulary, the trained network), from all rows."""
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    vocab, weights = vocabulary(texts)
    stored = materialize(encoded(texts, vocab, "_text"), "tokens")
    network = _fitted(stored, weights, stride, steps)
    discard(stored)
    return vocab, network


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, log_likelihood (summed) and per_word (its mean)."""
    return _scored(encoded(docs, model[0], text), model[1])


def learn_and_score(docs: DataFrame, text: str = "text", stride: int = STRIDE, steps: int = STEPS) -> DataFrame:
    """``score`` by what ``learn`` learns from the same rows; texts are cut into tokens once, and these stored for both."""
    vocab, weights = vocabulary(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")))
    stored = materialize(encoded(docs, vocab, text), "tokens")
    return _scored(stored, _fitted(stored, weights, stride, steps))
