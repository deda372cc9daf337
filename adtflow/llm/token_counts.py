"""Token counts without tokens: a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character; dynamic
programming carries the best score and, beside it, how many pieces the best path has. No piece is ever built.
Distinct words are solved together: the automaton's goto table is an array, and one step advances all words by
one character. Words that are very long, or hold a character outside the vocabulary's, are solved one at a time
on the same automaton in its sparse form.

The tie rules are those of the unigram model of the ``tokenizers`` library: of pieces ending at one place, longer
ones (earlier starts) come first and a later one must score strictly more; where no piece covers a single
character, an unknown of the vocabulary's least score less 10 does, and adjoining unknowns count once. Spaces
become U+2581, one is put before the text, and each starts a new word, so pieces never cross words.

Defined results: null and empty texts have 0 tokens; repeated rows each get their count; an empty table gives an
empty result; extra columns are kept, and ``n_tokens`` replaced.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adtflow.llm.common import sub_batches

SPACE = "▁"
#: Words of at most so many characters are solved together.
SHORT = 48
#: Characters of distinct words remembered by a worker; when full, the memory starts afresh.
REMEMBERED = 8_000_000


class Counter:
    """Counts pieces of words under a unigram vocabulary [(piece, score)]."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.scores = {}
        for piece, score in vocabulary:
            if piece:
                self.scores[piece] = score
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10.0
        self.sparse = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.sparse.add_word(piece, (len(piece), score))
        if len(self.sparse):
            self.sparse.make_automaton()
        self._build()

    def _build(self) -> None:
        """The dense automaton: goto over the vocabulary's commonest characters, and for every state the piece
        that ends there and the next state back whose piece is a proper suffix."""
        use: dict[str, int] = {}
        for piece in self.scores:
            for c in piece:
                use[c] = use.get(c, 0) + 1
        common = sorted(use, key=lambda c: (-use[c], c))[:160]
        self.column = {c: i for i, c in enumerate(common)}
        children: list[dict[int, int]] = [{}]
        length, score, parent_depth = [0], [0.0], [0]
        for piece in sorted(self.scores):
            state = 0
            if any(c not in self.column for c in piece):
                continue  # a word that could hold it is solved by the sparse form
            for c in piece:
                k = self.column[c]
                if k not in children[state]:
                    children[state][k] = len(children)
                    children.append({})
                    length.append(0)
                    score.append(0.0)
                    parent_depth.append(parent_depth[state] + 1)
                state = children[state][k]
            length[state], score[state] = len(piece), self.scores[piece]
        states = len(children)
        self.goto = np.zeros((states, max(1, len(common))), dtype=np.int32)
        fail, back = np.zeros(states, np.int32), np.zeros(states, np.int32)
        level = [0]
        while level:
            following = []
            for state in level:
                row = self.goto[fail[state]].copy() if state else np.zeros(self.goto.shape[1], np.int32)
                for k, child in children[state].items():
                    fail[child] = row[k] if state else 0
                    f = fail[child]
                    back[child] = f if length[f] else back[f]
                    row[k] = child
                    following.append(child)
                self.goto[state] = row
            level = following
        self.length, self.score, self.back = np.array(length, np.int32), np.array(score), back
        self.table = np.full(0x3000, -1, np.int32)
        for c, k in self.column.items():
            if ord(c) < len(self.table):
                self.table[ord(c)] = k

    def one(self, word: str) -> int:
        """The count of one word of any length."""
        n = len(word)
        best, count, unknown = [float("-inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.sparse):
            for end, piece in self.sparse.iter(word):
                ends[end].append(piece)
        for e in range(1, n + 1):
            single = False
            for size, score in sorted(ends[e - 1], reverse=True):
                single |= size == 1
                if (s := best[e - size] + score) > best[e]:
                    best[e], count[e], unknown[e] = s, count[e - size] + 1, False
            if not single and (s := best[e - 1] + self.unknown) > best[e]:
                best[e], count[e], unknown[e] = s, count[e - 1] + (not unknown[e - 1]), True
        return count[n]

    def many(self, words: list[str]) -> np.ndarray:
        """The counts of many words; one array step for each character place and each piece ending there."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.cumsum(sizes) - sizes
        known = np.full(len(flat), -1, np.int32)
        inside = flat < len(self.table)
        known[inside] = self.table[flat[inside]]
        bad = np.zeros(len(words), bool)
        bad[np.repeat(np.arange(len(words)), sizes)[known < 0]] = True
        bad |= sizes > SHORT
        for i in np.flatnonzero(bad):
            out[i] = self.one(words[i])
        live = np.flatnonzero(~bad)
        for begin in range(0, len(live), 1 << 16):
            part = live[begin : begin + (1 << 16)]
            part = part[np.argsort(-sizes[part], kind="stable")]  # longest first: those still running are a prefix
            self._solve(part, sizes[part], first[part], known, out)
        return out

    def _solve(self, part, sizes, first, known, out) -> None:
        n, longest = len(part), int(sizes.max(initial=0))
        best = np.full((longest + 1, n), -np.inf)
        count = np.zeros((longest + 1, n), np.int32)
        unknown = np.zeros((longest + 1, n), bool)
        best[0] = 0
        state = np.zeros(n, np.int32)
        for e in range(1, longest + 1):
            m = int(np.searchsorted(-sizes, -e, side="right"))  # words of at least e characters
            state = self.goto[state[:m], known[first[:m] + e - 1]]
            b, c = np.full(m, -np.inf), np.zeros(m, np.int32)
            single = np.zeros(m, bool)
            at = np.where(self.length[state] > 0, state, self.back[state])
            who = np.flatnonzero(at)
            while len(who):
                s = at[who]
                size = self.length[s]
                score = best[e - size, who] + self.score[s]
                better = score > b[who]
                w = who[better]
                b[w], c[w] = score[better], count[e - size[better], w] + 1
                single[who[size == 1]] = True
                at[who] = self.back[s]
                who = who[at[who] > 0]
            score = best[e - 1, :m] + self.unknown
            u = ~single & (score > b)
            b[u] = score[u]
            c[u] = count[e - 1, :m][u] + ~unknown[e - 1, :m][u]
            best[e, :m], count[e, :m], unknown[e, :m] = b, c, u
        out[part] = count[sizes, np.arange(n)]


def words_of(text: str) -> list[str]:
    """The text's words as the model sees them: each starts at a space or at the beginning."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    if not text.startswith(SPACE):
        text = SPACE + text
    return [SPACE + w for w in text[1:].split(SPACE)]


@lru_cache(maxsize=2)
def from_sentencepiece(path: str) -> Counter:
    """The pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""
    return Counter(vocabulary_of(path))


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """The pieces that text can hold: control, unknown, byte and unused ones never match it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``. Map-only; a worker holds the automaton and a bounded memory of words."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in ("n_tokens", text)]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_tokens")).schema
    for f in schema:
        f.nullable = True
    arrow = to_arrow_schema(schema)

    def run(batches):
        counter, memory, held = from_sentencepiece(path), {}, 0
        for big in batches:
            for batch in sub_batches(big, text):
                split = [words_of(t) for t in batch.column(text).to_pylist()]
                fresh = list({w for ws in split for w in ws}.difference(memory))
                held += sum(map(len, fresh))
                if held > REMEMBERED:
                    memory.clear()
                    fresh = list({w for ws in split for w in ws})
                    held = sum(map(len, fresh))
                memory.update(zip(fresh, counter.many(fresh).tolist(), strict=True))
                get = memory.__getitem__
                counts = pa.array([sum(map(get, ws)) for ws in split], pa.int64())
                columns = [*(batch.column(c) for c in kept), counts]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)
