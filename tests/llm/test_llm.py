"""Training-data operators against brute-force versions, on small tables with nulls, empty texts, ties and repeats."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
import pytest
from pyspark.sql import functions as F

from adtflow.llm import (
    chat,
    common,
    decontaminate,
    fingerprints,
    jaccard_join,
    packing,
    pseudo_likelihood,
    quality,
    suffix_dedup,
    token_counts,
    url_rules,
)
from adtflow.llm.queries import OP6_SQL, OP8_SQL, URL_RULES

tokenizers = pytest.importorskip("public_tokenizers")
BPE, RANKS, PIECES = (tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, host string"


def word(rng, letters="abcdefghij"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, a shared passage, a repeated line, odd characters, one word, blanks, null."""
    rng = random.Random(5)
    passage, base = prose(rng, 120), prose(rng, 150)
    out = [prose(rng, rng.randint(1, 300)) for _ in range(25)]
    out += [base] * 4 + [base.replace(w, "zzz", 1) for w in base.split()[:60:6]]
    out += [prose(rng, rng.randint(0, 40)) + " " + passage + " " + prose(rng, rng.randint(0, 40)) for _ in range(12)]
    out += [("the same line over and over\n" * 60) + prose(rng, k) for k in (0, 3)]
    out += [None, "", "   \n\t ", "one", "two words", "ÄÖ 漢字 " * 30, "漢" * 500, "x" * 3000, "THE The tHe " * 5]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, "clash", 0.5, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- packing ----------------------------------------------------------------------------------------------


def test_fast_ids_are_the_tokenizer_files(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True  # as ``encode`` does unless told to take added tokens
    for t in [*texts, "<|endoftext|> don't  we'll\n\n\n x", "a\u00a0b\u2003c\u200b", "١٢٣ ²³ ½", "e\u0301\u0301", "\x00\x1f\x7f"]:
        want = whole.encode(t or "", add_special_tokens=False).ids
        assert packing.encode(t, BPE, RANKS).tolist() == want and packing.encode(t, BPE).tolist() == want


def test_packed_ids_are_the_unmodified_tokenizers(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    rows = list(enumerate([*texts, "end <|endoftext|> start", "<|endoftext|>", "a\u2003<|endoftext|>é", "<|endoftext|"]))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for ranks in (RANKS, None):
        got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(table, BPE, ranks, 1 << 20).collect()}
        for i, t in rows:
            ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_is_whole_gapless_and_exact(docs, texts):
    rows = packing.pack(docs, BPE, RANKS, 256).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.append(packing.encode(t, BPE), 0).astype("<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 256 for p in pieces[1:]) and (len(ids) > 256 or len(pieces) == 1)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


def test_plans_reach_the_volume_bound():
    rng = random.Random(2)
    for capacity, n in ((2048, 5000), (100, 300), (10, 50), (7, 1)):
        counts = collections.Counter(rng.randint(1, capacity) if rng.random() < 0.2 else rng.randint(1, capacity // 2 + 1) for _ in range(n))
        made = packing.plan(counts, capacity)
        used = collections.Counter()
        for pattern, times in made:
            assert sum(pattern) <= capacity
            for k in pattern:
                used[k] += times
        assert used == counts
        assert sum(t for _, t in made) <= packing.lower_bound(counts, capacity) + 1


def fewest(lengths, capacity):
    """By dynamic programming over all subsets: (sequences, fill of the last) of each."""
    best = [(0, capacity)] + [None] * ((1 << len(lengths)) - 1)
    for s in range(1, 1 << len(lengths)):
        options = []
        for i, n in enumerate(lengths):
            if s >> i & 1:
                bins, fill = best[s ^ 1 << i]
                options.append((bins, fill + n) if fill + n <= capacity else (bins + 1, n))
        best[s] = min(options)
    return best[-1][0]


def test_plans_of_short_lists_are_the_fewest():
    rng = random.Random(40)
    better = 0
    for k in range(1200):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, rng.choice([capacity, capacity // 2 + 1])) for _ in range(rng.randint(1, 9))]
        counts = collections.Counter(lengths)
        made = packing.plan(counts, capacity)
        assert sum((collections.Counter({n: t * p.count(n) for n in set(p)}) for p, t in made), collections.Counter()) == counts
        assert all(sum(p) <= capacity for p, _ in made)
        assert sum(t for _, t in made) == fewest(lengths, capacity), (lengths, capacity)
        better += sum(t for _, t in packing.best_fit_decreasing(counts, capacity)) > sum(t for _, t in made)
    assert better
    hard = collections.Counter((44, 43, 40, 40, 38, 35, 33, 25, 25, 22, 21, 17, 16))
    assert sum(t for _, t in packing.best_fit_decreasing(hard, 100)) == 5 and sum(t for _, t in packing.plan(hard, 100)) == 4


def test_dominance_is_packing_into_the_others_lengths():
    covers = lambda bins, items: packing._covers(bins, items, [1000])
    assert not covers((8, 4), (7, 3, 2)) and covers((8, 5), (7, 3, 2)) and covers((9,), (4, 3, 2)) and not covers((5, 5), (4, 4, 2)) and covers((6, 4), (4, 4, 2))
    left = [0, 0, 1, 1, 1, 0, 0, 1, 1]
    kept = list(packing.undominated(packing.fillings(left, [8, 7, 4, 3, 2], 12, 12, 1000)[0], [0]))
    assert (0, (8, 4)) in kept and (1, (8, 3)) not in kept and (0, (7, 3, 2)) in kept


def test_plans_of_middling_lengths_are_near_the_bound():
    rng = random.Random(41)
    for _ in range(4):
        counts = collections.Counter(rng.randint(400, 900) for _ in range(300))
        made = packing.plan(counts, 2048)
        assert sum(t for _, t in made) <= packing.lower_bound(counts, 2048) + 3


def test_packing_nothing(empty):
    assert packing.pack(empty, BPE).count() == 0


# -- suffix-array dedup -----------------------------------------------------------------------------------


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        k, n = rng.choice([1, 2, 3, 26]), rng.randint(1, 80)
        t = np.array([rng.randrange(k) for _ in range(n)])
        want = sorted(range(n), key=lambda i: tuple(t[i:]))
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == want
        smaller = suffix_dedup._types(t)
        lms = set(suffix_dedup._leftmost(smaller).tolist())
        assert suffix_dedup._induce_buckets(t, k, smaller, np.array([p for p in want if p in lms], np.int64)).tolist() == want
        common_length, before = suffix_dedup.common_prefixes(t, sa)
        for a, b in zip(want, want[1:], strict=False):
            m = 0
            while max(a, b) + m < n and t[a + m] == t[b + m]:
                m += 1
            assert common_length[b] == m and before[b] == a


def covered(texts, length, across=False):
    """Each text's bytes, and which of them a repeated string covers."""
    data = [(t or "").encode() for t in texts]
    counts, holders = collections.Counter(), collections.defaultdict(set)
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] += 1
            holders[b[i : i + length]].add(k)
    for b in data:
        f = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if (len(holders[b[i : i + length]]) if across else counts[b[i : i + length]]) > 1:
                f[i : i + length] = True
        yield b, f


def removed(texts, length, across=False):
    out = []
    for b, f in covered(texts, length, across):
        kept = bytes(np.frombuffer(b, np.uint8)[~f])
        runs = int((np.diff(np.concatenate(([0], f.astype(np.int8)))) == 1).sum())
        out.append((len(b), int(f.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize(("hot", "piece", "length"), [(2048, 8192, 400), (2, 8192, 400), (2, 3, 400), (2048, 8192, 150), (2, 3, 150)])
def test_removed_bytes_are_exactly_the_repeated_ones(docs, texts, monkeypatch, hot, piece, length, across):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    cloudpickle.register_pickle_by_value(suffix_dedup)  # so that workers see the limits
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, length, across).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    want = removed(texts, length, across)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 0


def test_cut_texts(docs, texts):
    got = {r.doc_id: r for r in suffix_dedup.cut(docs).collect()}
    want = removed(texts, 400)
    for i, (n, gone, _, digest) in enumerate(want):
        if gone == 0:
            assert got[i].text == (texts[i] or "") and got[i].n_chars == len(texts[i] or "")
        elif all(ord(c) < 128 for c in texts[i]) and i in got:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest
    assert suffix_dedup.cut(docs).columns == docs.columns and got[0].spans == "clash"


def test_passages_across_documents_go_and_all_else_stays(spark):
    rng = random.Random(31)
    passage, short, own = prose(rng, 55), prose(rng, 40), prose(rng, 60)
    rows = [(i, f"{prose(rng, 30)} {chr(0x4E00 + i)} {passage} {chr(0x6E00 + i)} {prose(rng, 20 + i)}", "x") for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 30)} {short}\n{prose(rng, 20)}", "x") for i in range(5)]
    rows += [(200, f"{own}. {own}\n{own}", "x"), (201, passage, "x"), (202, None, "x"), (203, "", "x"), (204, prose(rng, 30_000) + " 漢 " + passage, "x")]
    kept = {r.doc_id: r.text for r in suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string, spans string"), 150, across=True, least_words=50).collect()}
    for i, text, _ in rows:
        if i == 201:
            assert i not in kept
        elif text and passage in text:
            a, b = text.split(passage)
            assert kept[i] == a + b
        else:
            assert kept[i] == (text or "")


def test_words_of_a_run_are_whole_ones():
    data = b"aa bbb cc dd"
    assert suffix_dedup._whole_words(data, 0, 12) == (0, 12, 4)
    assert suffix_dedup._whole_words(data, 1, 11) == (3, 9, 2)
    assert suffix_dedup._whole_words(data, 1, 10) == (3, 9, 2)
    assert suffix_dedup._whole_words(data, 2, 9) == (3, 9, 2)
    assert suffix_dedup._whole_words(data, 4, 6)[2] == 0 == suffix_dedup._whole_words(b"abcd", 1, 3)[2]
    assert suffix_dedup._whole_words(data, 3, 6) == (3, 6, 1)


def test_one_region_in_very_many_rows(spark):
    rng = random.Random(32)
    line = prose(rng, 100)
    rows = [(i, f"{line} {i} {line if i % 3 else word(rng)}") for i in range(700)] + [(None, line)] * 300
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(x[:2] for x in removed([t for _, t in rows], 400))


def test_repeated_ids_and_rows(spark, texts):
    rows = [(1, texts[1] + texts[2] * 2), (1, texts[1] + texts[2] * 2), (1, texts[3]), (None, texts[2] * 2), (None, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(x[:2] for x in removed([t for _, t in rows], 400))


def test_dedup_nothing(empty):
    assert suffix_dedup.digests(empty).count() == 0


# -- token counts -----------------------------------------------------------------------------------------


def test_counts_are_the_librarys(docs, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    # The library wants its unknown piece in the vocabulary: one that no text holds, at a score that moves no minimum.
    model = Tokenizer(models.Unigram([("\U0010fffe\U0010fffe", -1.0), *token_counts.vocabulary_of(PIECES)], unk_id=0, byte_fallback=False))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_special_pieces_are_ordinary_text():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = dict(token_counts.vocabulary_of(PIECES))
    for i in range(model.get_piece_size()):
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        assert (model.id_to_piece(i) in pieces) != special
    counter = token_counts.from_sentencepiece(PIECES)
    assert counter.one("▁a<s>b") == counter.one("▁a<t>b") > 3 and counter.one("▁<0x41>") > 2


def test_counts_of_very_long_texts(spark):
    rng = random.Random(35)
    long_word, many = "".join(rng.choice("abcdefgh") for _ in range(60_000)), prose(rng, 30_000)
    rows = spark.createDataFrame([(0, long_word), (1, many)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, PIECES).collect()}
    counter = token_counts.from_sentencepiece(PIECES)
    assert got == {0: counter.one("▁" + long_word), 1: sum(counter.one("▁" + w) for w in many.split())}


def test_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("bc", -2.0), ("ca", -1.5), ("▁", -0.5)]
    counter, model = token_counts.Counter(vocabulary), Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd▁é") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    want = [len(model.encode(w).ids) for w in words]
    assert counter.many(words).tolist() == want and [counter.one(w) for w in words] == want


def test_counts_of_nothing(empty, docs):
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert token_counts.count_tokens(docs, PIECES).columns == [c for c in docs.columns if c != "text"] + ["n_tokens"]


# -- decontamination --------------------------------------------------------------------------------------


def score_of(a, b):
    """Smith-Waterman of two word lists, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(4)
    for _ in range(40):
        a, b = [[rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        got, end = decontaminate.align(np.array([a], np.uint64), np.array([b], np.uint64), np.array([len(a)]), np.array([len(b)]))
        assert got[0] == score_of(a, b) and (got[0] == 0 or score_of(a, b[: end[0]]) == got[0])


def test_copies_and_edited_copies_are_found_and_clean_ones_left(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (12, 25, 50, 2, 0, 400)]
    edited = items[2].split()
    for k in (5, 15, 25, 35, 45):
        edited[k] = "changed"
    del edited[30]
    edited.insert(10, "put in")
    docs = [
        (0, prose(rng, 100) + ". " + items[0].upper().replace(" ", ", ") + "! " + prose(rng, 50)), (1, prose(rng, 30) + "\n" + " ".join(edited)), (2, prose(rng, 200)), (3, None), (4, ""),
        (5, items[1][: len(items[1]) // 5] + prose(rng, 50)), (6, items[5] + " " + items[1]), (6, items[1]), (None, items[0]), (7, " ".join(items[5].split()[:60])),
    ]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (1, items[1])], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table, benchmark).collect()}
    assert set(got) == {(0, 0), (1, 2), (6, 5), (6, 1), (None, 0), (7, 5)}
    assert got[0, 0].score == 1.0 and 0.5 < got[1, 2].score < 1
    span = got[0, 0]
    assert docs[0][1].encode()[span.start_byte : span.end_byte].decode() == items[0].upper().replace(" ", ", ")
    assert sorted(str(r.doc_id) for r in decontaminate.clean(table, benchmark).collect()) == ["2", "3", "4", "5"]


def test_leaking_rows_go_by_id_and_text(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(24)
    item, other = prose(rng, 30), prose(rng, 60)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, item), (None, other), (None, None), (1, item), (1, other), (2, other)], "doc_id long, text string")
    kept = cp.without_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, other), (None, None), (1, other), (2, other)]))


def test_an_item_copied_everywhere_is_found(spark):
    rng = random.Random(7)
    item = prose(rng, 30)
    table = spark.createDataFrame([(i, prose(rng, 20) + " " + item) for i in range(60)], "doc_id long, text string")
    assert decontaminate.contaminated(table, spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 60


def test_items_of_frequent_phrases_keep_seeds(spark):
    rng = random.Random(22)
    item = prose(rng, 40).split()
    grams = [" ".join(item[k : k + 3]) for k in range(38)]
    common = [(i, prose(rng, 3) + " " + f" {prose(rng, 1)} ".join(grams)) for i in range(60)]
    copies = [(100, prose(rng, 30) + " " + " ".join(item) + " " + prose(rng, 30)), (101, " ".join(item[:25]))]
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(common + copies, "doc_id long, text string"), benchmark)
    assert {100, 101} <= {r.doc_id for r in found.collect()}


def test_every_item_keeps_seeds_over_its_length():
    rng = random.Random(23)
    for n in (3, 5, 6, 9, 40):
        items = decontaminate.Items([0], [prose(rng, n)], 3)
        counts = {int(g): 1000 for g in items.gram.view(np.int64)} | {int(g): 100 for g in items.longer().view(np.int64)}
        items.keep_rare(counts, 5000)
        assert len(items.gram) and np.diff(np.sort(items.place)).max(initial=0) < 2 * decontaminate.STRETCH
        assert len(items.place) == 1 or items.place.min() < decontaminate.STRETCH


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [prose(rng, 15) for _ in range(9)]
    table = spark.createDataFrame([(i, prose(rng, 20) + " " + t) for i, t in enumerate(items)], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, benchmark).collect()} == {(i, i) for i in range(9)}


def test_no_benchmark_or_documents(empty, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.contaminated(empty, spark.createDataFrame([(0, "a b c d")], "item_id long, text string")).count() == 0


# -- fingerprints -----------------------------------------------------------------------------------------


def test_sketches_estimate_resemblance_containment_and_count(spark):
    rng = random.Random(9)
    words = [word(rng) for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:3000])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a"), 512).alias("a"), fingerprints.sketch(F.col("b"), 512).alias("b"), fingerprints.sketch(F.concat_ws(" ", "a", "b"), 512).alias("ab"))
    got = row.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fingerprints.containment(F.col("a"), F.col("b"), 512).alias("c"), fingerprints.distinct_count(F.col("a"), 512).alias("n"),
        fingerprints.merge(F.col("a"), F.col("b"), 512).alias("m"), "ab",
    ).first()
    assert abs(got.j - 1496 / 2996) < 0.1 and abs(got.c - 0.75) < 0.12 and abs(got.n - 1996) < 250
    assert len(set(got.m) - set(got.ab)) <= 4  # the joined text has four shingles more


def test_short_sketches_are_exact(spark, docs, texts):
    made = fingerprints.fingerprint(docs, k=4000)
    for r in made.collect():
        w = (texts[r.doc_id] or "").split()
        ascii_only = all(ord(c) < 128 for c in texts[r.doc_id] or "")
        if ascii_only:
            assert len(r.sketch) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w))) == r.n_distinct
        assert r.sketch == sorted(r.sketch)


@pytest.mark.parametrize("parts", [2, 3, 7])
def test_next_document_is_cyclic(spark, parts):
    rows = [(5, "e"), (3, "c"), (9, "i"), (1, "a"), (7, "g"), (None, "null"), (3, "c")]
    got = sorted((r.text, r.next_text) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect())
    assert got == sorted([("i", "g"), ("g", "e"), ("e", "c"), ("c", "c"), ("c", "a"), ("a", "null"), ("null", "i")])
    assert [(r.text, r.next_text) for r in fingerprints.with_next(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [("", "")]
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_query_against_the_definition(spark, tmp_path):
    from adtflow.llm.queries import op5_fingerprints

    rng = random.Random(37)
    base = prose(rng, 400)
    rows = [(1, base), (2, base + " more"), (5, None), (9, ""), (12, "é" * 7), (20, prose(rng, 3)), (31, prose(rng, 20_000)), (40, base)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_fingerprints(spark, str(tmp_path)).collect()}
    texts, ids = {i: t or "" for i, t in rows}, sorted((i for i, _ in rows), reverse=True)

    def edit(i):
        text, after = texts[i], texts[ids[(ids.index(i) + 1) % len(ids)]]
        cut = len(text) // 2
        return text[: len(text) - cut] + after[:cut]

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    def near(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a or b else 1.0

    assert len(rows) == len(got)
    for k, i in enumerate(ids):
        r, after = got[i], texts[ids[(k + 1) % len(ids)]]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edit(i).encode()).hexdigest()
        assert abs(r.near_edited - near(texts[i], edit(i))) < 0.18 and abs(r.near_next - near(texts[i], after)) < 0.18
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert got[1].fingerprint == got[40].fingerprint != got[12].fingerprint and got[5].fingerprint == got[9].fingerprint
    assert (got[1].edited_fingerprint == got[40].edited_fingerprint) == (edit(1) == edit(40))


# -- chat -------------------------------------------------------------------------------------------------


def turns(spark):
    rows = [
        (1, 0, "system", "be <|good|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "<\\|x"), (1, 700, None, "who"), (1, 700, "", "who"), (2, None, "ann", "x"), (2, 0, "ann", ""), (None, 1, "user", "y"),
        (3, 0, "system", "alone"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_perspectives(spark):
    got = chat.rotate(turns(spark)).toPandas()
    con = duckdb.connect()
    con.register("conversations", turns(spark).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(OP6_SQL).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    fix = lambda df: df.astype({"conv_id": "Int64", "turn": "Int64"})
    assert key(fix(got)) == key(fix(want)) and set(got[got.conv_id == 1].perspective) == {"ann", "bob", "unknown"} and 3 not in set(got.conv_id)
    whole = {(r.conv_id, r.perspective): r.text for r in chat.dialogues(chat.rotate(turns(spark))).collect()}
    text = whole[1, "ann"]
    assert text.startswith("<|system|>\nbe <\\|good|><|end|>\n<|assistant|>\nhi<|end|>\n<|user|>bob\n<|end|>\n")
    for r in got[(got.conv_id == 1) & (got.perspective == "ann")].itertuples():
        assert text[r.start : r.start + r.length] == r.rendered
        assert text[r.mask_start : r.mask_start + r.mask_length].endswith("<|end|>") == (r.role == "assistant")


def test_long_conversations_are_gapless(spark):
    rows = [(7, k, who, f"turn {k}") for k in range(1500) for who in ("ann", "bob")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for person in ("ann", "bob"):
        at = 0
        for r in got.where(F.col("perspective") == person).orderBy("start").collect():
            assert r.start == at and r.length == len(r.rendered)
            at += r.length


def test_guarding_is_reversible(spark):
    t = spark.createDataFrame([("a<|b",), ("<\\|",), ("<\\\\|<|",), ("plain \\ < |",), ("",)], "t string")
    for r in t.select("t", chat.guarded(F.col("t")).alias("g"), chat.restored(chat.guarded(F.col("t"))).alias("r")).collect():
        assert r.r == r.t and "<|" not in r.g


# -- LM scoring -------------------------------------------------------------------------------------------


def tree_log_p(net, token, around):
    """The definition, node by node."""
    h = np.tanh(sum(t[w] * c for t, w, c in zip((net.left, net.left, net.right, net.right), around, net.weigh, strict=True)) + net.h0[0])
    total, a = 0.0, int(net.tree.start[token])
    for node, side in zip(net.tree.node[a : a + net.tree.length[token]], net.tree.side[a : a + net.tree.length[token]], strict=True):
        total -= math.log1p(math.exp(-float(side) * float(net.u[node] @ h + net.bias[node, 0])))
    return total


def test_network_learns_both_sides():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 12, (2, 40_000))
    around = np.column_stack([left, rng.integers(0, 12, 40_000), right, rng.integers(0, 12, 40_000)])
    tokens = (left // 3 + right // 3) % 8
    net = pseudo_likelihood.Network(np.bincount(tokens, minlength=12).astype(float))
    everything = np.arange(12)
    start = -net.log_p(tokens, around).mean()
    assert np.isclose(np.exp(net.log_p(everything, np.repeat(around[:1], 12, axis=0))).sum(), 1, atol=1e-5)
    p = np.bincount(tokens, minlength=12) + 0.5
    assert math.isclose(start, -np.log(p[tokens] / p.sum()).mean(), rel_tol=1e-4)  # untrained, it is the unigram distribution
    few = np.argsort(net.tree.length[tokens[:200]], kind="stable")
    before, state = net.log_p(tokens[:200], around[:200]).mean(), net.train(tokens[:0], around[:0])
    assert math.isclose(net.step(tokens[few], around[few], state["memory"], state["met"], 0.05), -before, rel_tol=1e-4)
    assert net.log_p(tokens[:200], around[:200]).mean() > before
    net.train(tokens, around, steps=600)
    assert -net.log_p(tokens, around).mean() < 0.6 * start
    for k in range(20):
        assert np.isclose(np.exp(net.log_p(everything, np.repeat(around[k : k + 1], 12, axis=0))).sum(), 1, atol=1e-4)
        assert math.isclose(net.log_p(tokens[k : k + 1], around[k : k + 1])[0], tree_log_p(net, tokens[k], around[k]), rel_tol=1e-4, abs_tol=1e-5)


def test_tokens_are_words_and_pieces():
    column = pa.array(["the Abcdefg the", None, "zz", "", "the"])
    vocab = common.word_hashes(np.frombuffer(b"zzthe", np.uint8), np.array([0, 2]), np.array([2, 5])) | np.uint64(pseudo_likelihood.PIECES)
    ranks = pseudo_likelihood.Ranks(vocab)
    ids, row, whole = pseudo_likelihood.encode(column, ranks)
    assert ids[[0, 4, 5, 6]].tolist() == [1, 1, 0, 1] and (ids[1:4] >= pseudo_likelihood.WORDS).all() and row.tolist() == [0] * 5 + [2, 4] and whole.tolist() == [0, 0, 0, 2, 4]
    same, _, _ = pseudo_likelihood.encode(pa.array(["ABCDEFG"]), ranks)
    assert same.tolist() == ids[1:4].tolist()
    edge = pseudo_likelihood.EDGE
    assert pseudo_likelihood.windows(np.array([7, 8, 9]), np.array([0, 0, 1])).tolist() == [[edge, edge, 8, edge], [7, edge, edge, edge], [edge] * 4]


def test_ranks_of_words():
    rng = np.random.default_rng(6)
    vocab = np.unique(np.concatenate([rng.integers(0, 2**63, 3000).astype(np.uint64), np.arange(40, dtype=np.uint64) << np.uint64(52)]))  # the last share all three slots
    ranks = pseudo_likelihood.Ranks(vocab)
    assert len(ranks.rest) and ranks.of(vocab).tolist() == list(range(len(vocab)))
    assert (ranks.of(vocab + np.uint64(1)) == np.where(np.isin(vocab + np.uint64(1), vocab), 1, -1)).all() or not np.isin(vocab + np.uint64(1), vocab).any()
    assert (pseudo_likelihood.Ranks(vocab[:0]).of(vocab) == -1).all()


def test_scores_follow_the_definition(docs, texts):
    model = pseudo_likelihood.learn(docs, steps=5)
    vocab, net = model
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, model).collect()}
    for i, t in enumerate(texts):
        ids, row, _ = pseudo_likelihood.encode(pa.array([t]), pseudo_likelihood.Ranks(vocab))
        around = pseudo_likelihood.windows(ids, row)
        assert got[i].n_words == len((t or "").encode().split())
        total = sum(tree_log_p(net, w, c) for w, c in list(zip(ids, around, strict=True))[:80])
        assert math.isclose(net.log_p(ids, around)[:80].sum(), total, rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(got[i].log_likelihood, net.log_p(ids, around).sum(), rel_tol=1e-5, abs_tol=1e-4)
        assert math.isclose(got[i].per_word, got[i].log_likelihood / max(1, got[i].n_words), rel_tol=1e-9)


def test_held_out_loss_is_below_unigrams_and_bigrams(spark):
    rng = random.Random(50)
    names = [word(rng) + str(k) for k in range(60)]

    def text():
        out = []
        for _ in range(60):  # the word between two others follows from both, by neither alone
            a, b = rng.randrange(60), rng.randrange(60)
            out += [names[a], f"m{(a % 6 + b % 6) % 6}", names[b]]
        return " ".join(out)

    train, test = [text() for _ in range(300)], [text() for _ in range(40)]
    vocab, net = pseudo_likelihood.learn(spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string").repartition(2), stride=1, steps=250)
    ids, row, _ = pseudo_likelihood.encode(pa.array(test), pseudo_likelihood.Ranks(vocab))
    mine = -net.log_p(ids, pseudo_likelihood.windows(ids, row)).mean()
    seen, pairs = collections.Counter(), collections.Counter()
    for t in train:
        w = t.split()
        seen.update(w)
        pairs.update(zip(w, w[1:], strict=False))
    total, unigram, bigram, n = sum(seen.values()), 0.0, 0.0, 0
    for t in test:
        w = t.split()
        for k, x in enumerate(w):
            p = seen[x] / total
            unigram -= math.log(p)
            bigram -= math.log((pairs[w[k - 1], x] + 5 * p) / (seen[w[k - 1]] + 5) if k else p)
            n += 1
    assert mine < bigram / n < unigram / n


def test_language_model_of_nothing(empty):
    assert pseudo_likelihood.score(empty, pseudo_likelihood.learn(empty)).count() == 0


# -- URL rules --------------------------------------------------------------------------------------------


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=None)
    return host, path, best[0] if best else None, best[1] if best else default


@pytest.mark.parametrize("ranges", [1, 4, 17])
def test_url_rules_against_each_pair(spark, ranges):
    rng = random.Random(10)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "xample.org", "example.com", "com", "org", "Org.EXAMPLE.com", "example.org.", "example-x.org", "é.org", ""]
    rules = [url_rules.parse_rule(*r) for r in URL_RULES] + [("example.com", "", "block"), ("a.example.org", "/", "block"), ("b.a.example.org", "/en/12", "allow"), ("", "/", "block")]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/123?x=1', '/fr/#a', '/de/x', '?q', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "http:/x", "://", "a://b://c/d"] + ["http://a.example.org/en/1"] * 300
    table = spark.createDataFrame([(i, u, "kept", "clash", "also") for i, u in enumerate(urls)], "page_id long, url string, _key string, rule string, c0 string")
    out = url_rules.apply_rules(table, spark.createDataFrame([*rules, rules[0]], "host string, path string, verdict string"), ranges=ranges)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert len(got) == len(urls) == out.count() and out.columns == ["page_id", "_key", "c0", "host", "path", "rule", "verdict"]
    assert {(r["_key"], r.c0) for r in out.collect()} == {("kept", "also")}
    for i, u in enumerate(urls):
        assert got[i] == judge(u, [r for r in rules if r[0]]), u


def test_nested_paths_of_one_host(spark):
    rng = random.Random(36)
    rules = sorted({("a.org", "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6))), rng.choice(["allow", "block"])) for _ in range(300)})
    rules = list({r[:2]: r for r in rules}.values())
    urls = ["http://" + rng.choice(["a.org", "x.a.org"]) + "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    out = url_rules.apply_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules)


def test_url_sql_and_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_rules.apply_rules(none, rules).count() == 0
    one = url_rules.apply_rules(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules, default="block")
    assert [tuple(r) for r in one.collect()] == [(1, "a.b", "/c", None, "block")] and "WITH" in OP8_SQL


# -- quality ----------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        good = rng.random() < 0.8
        words = [word(rng) for _ in range(rng.randint(1, 200))]
        rows.append((i, ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "." if good else " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in words), int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert 0 < len(model.rules) < 80
    scored = quality.score(docs, model)
    got = {r.doc_id: r for r in scored.withColumn("out", quality.held_out(F.col("doc_id"))).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.out for r, _ in held) and sum(r.predicted == q for r, q in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[900].score == got[901].score
    kept = quality.accepted(docs, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 1} and kept.columns == docs.columns


def test_quality_without_labels(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs, none)
    assert model.rules == [] and quality.score(empty, model).count() == 0
    one_kind = quality.learn(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int"))
    assert one_kind.rules == [] and one_kind.intercept > 0


def test_repeated_and_missing_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    x, y = quality.training_rows(docs, labels, "quality", 20)
    assert len(x) == len(y) == 20
    assert docs.where(quality.held_out(F.col("doc_id")) & F.col("doc_id").isNull()).count() == 1


# -- Jaccard join -----------------------------------------------------------------------------------------


def linked(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_classes_are_the_links(docs, texts, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts, n, percent)


@pytest.mark.parametrize(("long", "big", "cell"), [(64, 1024, 512), (4, 1024, 512), (64, 20, 16), (4, 8, 5)])
def test_families_of_near_copies(spark, monkeypatch, long, big, cell):
    rng = random.Random(12)
    bases = [prose(rng, 120).split() for _ in range(2)]
    made = []
    for _ in range(110):
        w = list(rng.choice(bases) if not made or rng.random() < 0.6 else rng.choice(made).split())
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = word(rng)
        made.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "BIG", big)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 6)
    cloudpickle.register_pickle_by_value(jaccard_join)
    try:
        out = jaccard_join.classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard_join)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert [got[i] for i in range(len(made))] == linked(made, 3, 90)


def test_solving_a_family_against_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(40):
        percent, n = (90, 80)[trial % 2], int(rng.integers(10, 120))
        bases, sets = [rng.choice(50_000, n, replace=False) for _ in range(3)], []
        for _ in range(int(rng.integers(2, 120))):
            b = (sets[rng.integers(len(sets))] if sets and rng.random() < 0.4 else bases[rng.integers(3)]).copy()
            k = rng.choice(len(b), rng.integers(0, 1 + int(len(b) * rng.choice([0.02, 0.08, 0.2]))), replace=False)
            b[k] = rng.integers(0, [300, 50_000][rng.integers(2)], len(k))
            sets.append(np.unique(b).astype(np.int64))
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j], assume_unique=True))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
        got = jaccard_join.solve_family(sets, percent).tolist()
        same = lambda labels: [labels.index(v) for v in labels]
        assert same(got) == same([find(x) for x in range(len(sets))])


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_leaders_leave_no_link_apart(percent):
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = int(rng.integers(5, 700))
        bases, sets = [rng.integers(0, 2**57, n).astype(np.uint64) for _ in range(3)], []
        for _ in range(70):
            b = bases[rng.integers(3)].copy()
            k = rng.choice(n, rng.integers(0, 1 + n // 3), replace=False)
            b[k] = rng.integers(0, 2**57, len(k))
            sets.append(np.unique(b[: int(n * rng.uniform(0.7, 1))]))
        sets.sort(key=len)
        leaders, forest = jaccard_join._Leaders(percent), jaccard_join.Unions()
        for i, x in enumerate(sets):
            joined = leaders.add(i, len(x), jaccard_join.profile(x))
            if joined is not None:
                forest.join(joined, i)
        for a, b in leaders.edges():
            forest.join(a, b)
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j], assume_unique=True))
                apart = len(x) + len(sets[j]) - 2 * both
                assert jaccard_join.profiles_apart(jaccard_join.profile(x), jaccard_join.profile(sets[j])) <= apart
                if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                    assert forest.find(i) == forest.find(j)


@pytest.mark.parametrize("percent", [90, 80])
def test_pairs_of_a_list_against_each_pair(percent):
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = np.sort(rng.integers(1, 60, 40))
        token = np.sort(rng.integers(0, 4, 40))
        order = np.lexsort((n, token))
        token, n = token[order], n[order]
        pos = np.array([rng.integers(0, x - -(-percent * x // 100) + 1) for x in n])
        hist = rng.integers(0, 3, (40, 16)).astype(np.uint8)
        got = {tuple(x) for x in jaccard_join._near_pairs(token, np.arange(40), n, pos, hist, percent).tolist()}
        want = set()
        for i in range(40):
            for j in range(i + 1, 40):
                enough = min(n[i] - pos[i], n[j] - pos[j]) * (100 + percent) >= percent * (n[i] + n[j])
                near = (100 + percent) * np.abs(hist[i].astype(int) - hist[j]).sum() <= (100 - percent) * (n[i] + n[j])
                if token[i] == token[j] and enough and near:
                    want.add((i, j))
        assert got == want


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_very_frequent_shingles_gather_in_each_task(spark, monkeypatch, held):
    rng = random.Random(33)
    line = prose(rng, 40)
    made = [f"{line} {prose(rng, rng.randint(0, 6))}" for _ in range(120)] + [f"{prose(rng, 90)} {line}" for _ in range(20)]
    monkeypatch.setattr(jaccard_join, "HOT_CLASS", 3)
    monkeypatch.setattr(jaccard_join, "LED_BYTES", held)
    cloudpickle.register_pickle_by_value(jaccard_join)
    try:
        out = jaccard_join.classes(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard_join)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert [got[i] for i in range(len(made))] == linked(made, 3, 90)


def test_null_ids_of_classes(spark):
    rng = random.Random(34)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(None, a), (5, a), (3, a), (None, b), (None, b), (None, None), (9, "")]
    got = sorted(map(str, map(tuple, jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(None, 48, 3), (5, 48, 3), (3, 48, 3), (None, 48, None), (None, 48, None), (None, 0, None), (9, 0, 9)]))


def test_unfinished_components_are_an_error(spark):
    with pytest.raises(RuntimeError):
        jaccard_join.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), rounds=1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.v: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1 and got[5000] == got[5001] and len(set(got.values())) == 3


def test_one_of_each(docs, texts, empty):
    kept = {r.doc_id for r in jaccard_join.one_each(docs).collect()}
    assert kept == {i for i, (_, c) in enumerate(linked(texts, 5, 80)) if c == i}
    assert jaccard_join.classes(empty).count() == 0 and jaccard_join.one_each(empty).count() == 0


def test_one_row_of_each_class(spark):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b), (4, c), (4, d), (5, c), (6, ""), (None, None), (7, d)]
    kept = jaccard_join.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, a), (None, b), (4, c), (4, d), (6, ""), (None, None)]))


# -- shared parts -----------------------------------------------------------------------------------------


def test_words_and_shingles():
    column = pa.array(["a  B\tc\n", None, "", "x", " y z "])
    raw, at = common.text_bytes(column)
    start, end, row = common.words(raw, at)
    assert [bytes(raw[a:b]) for a, b in zip(start, end, strict=True)] == [b"a", b"B", b"c", b"x", b"y", b"z"] and row.tolist() == [0, 0, 0, 3, 4, 4]
    h = common.word_hashes(raw, start, end)
    assert h[1] == common.word_hashes(np.frombuffer(b"b", np.uint8), np.array([0]), np.array([1]))[0]
    g, where = common.shingles(h, row, 2)
    assert where.tolist() == [0, 0, 3, 4] and len(set(g.tolist())) == 4
    assert [b.num_rows for b in common.sub_batches(pa.record_batch([pa.array(["aaaa", "bb", None, "cc"])], names=["t"]), "t", 4)] == [1, 3]


# -- pipeline ---------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline_by_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    before = docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before.count()
        if name == "n-gram Jaccard join":
            texts = {r.doc_id: r.text for r in before.collect()}
            ids = sorted(texts)
            want = linked([texts[i] for i in ids], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {ids[k] for k, (_, c) in enumerate(want) if c == k}
        if name == "suffix-array dedup":
            rows, kept = before.orderBy("doc_id").collect(), {r.doc_id: r.text for r in docs.collect()}
            for r, (b, f) in zip(rows, covered([r.text for r in rows], cp.PASSAGE_BYTES, across=True), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0]))))
                runs = [suffix_dedup._whole_words(b, x, y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                gone = sum(y - x for x, y, n in runs if n >= 50)
                assert len(kept.get(r.doc_id, "").encode()) == len(b) - gone or r.doc_id not in kept
                assert r.doc_id in kept or gone
            shared = collections.defaultdict(set)
            for i, text in kept.items():
                w = text.split()
                for k in range(len(w) - 50):
                    shared[tuple(w[k : k + 51])].add(i)
            assert not [k for k, v in shared.items() if len(v) > 1]
        before = docs
    last = cp.STAGES[-1][1](spark, docs, sf)
    assert last.agg(F.sum("length")).first()[0] == sum(len(packing.encode(r.text, BPE)) + 1 for r in docs.collect())
    assert last.select("sequence_id").distinct().count() <= packing.volume_bound(last) + 1
    assert cp.run(spark, sf).count() == last.count()


def test_every_token_is_a_training_target(spark):
    """Words that stand at no fourth place are learnt like the others."""
    lines = ["a b c zebra"] * 400  # only "a" stands at every fourth place
    docs = spark.createDataFrame([(1, " ".join(lines))], "doc_id long, text string").repartition(1)
    vocab, net = pseudo_likelihood.learn(docs, steps=40)
    ids, row, _ = pseudo_likelihood.encode(pa.array([" ".join(lines)]), pseudo_likelihood.Ranks(vocab))
    each = net.log_p(ids, pseudo_likelihood.windows(ids, row))
    assert all(each[k::4][1:-1].mean() > -0.5 for k in range(4))


def plain_step(net, tokens, around, memory, rate):
    """A step of training by its definition: all paths node by node, sums by np.add.at."""
    near = [t[around[:, k]] for k, t in enumerate((net.left, net.left, net.right, net.right))]
    h = np.tanh(sum(r * c for r, c in zip(near, net.weigh, strict=True)) + net.h0)
    grads, dh, loss = {n: np.zeros(getattr(net, n).shape) for n in net.TABLES}, np.zeros(h.shape), 0.0
    uses = {n: np.zeros(len(getattr(net, n)), int) for n in net.TABLES}
    for i, token in enumerate(tokens):
        path = slice(int(net.tree.start[token]), int(net.tree.start[token] + net.tree.length[token]))
        node, side = net.tree.node[path], net.tree.side[path]
        z = side * (net.u[node] @ h[i] + net.bias[node, 0])
        g = -side / (1 + np.exp(z))
        loss += np.log1p(np.exp(-z)).sum()
        grads["u"][node] += g[:, None] * h[i]
        grads["bias"][node, 0] += g
        uses["u"][node] += 1
        uses["bias"][node] += 1
        dh[i] = g @ net.u[node]
    dh *= 1 - h * h
    for k, name in enumerate(("left", "left", "right", "right")):
        np.add.at(grads[name], around[:, k], dh * net.weigh[k])
        np.add.at(uses[name], around[:, k], 1)
        grads["weigh"][k] = (dh * near[k]).sum(axis=0)
    grads["h0"][0] = dh.sum(axis=0)
    uses["weigh"][:] = uses["h0"][:] = len(tokens)
    for name, grad in grads.items():
        part = grad / np.sqrt(np.maximum(uses[name], 1))[:, None]
        memory[name] += (part * part).astype(np.float32)
        setattr(net, name, (getattr(net, name) - rate * part / np.sqrt(memory[name])).astype(np.float32))
    return loss / len(tokens), uses


def test_steps_follow_the_definition():
    """Three steps over paths in the tree's top and below it, in slices, change all tables as the definition does."""
    rng = np.random.default_rng(8)
    weights = 20_000 / np.arange(1, 2001) ** 1.1
    tokens = rng.choice(2000, 9000, p=weights / weights.sum())
    tokens[:2] = 0, 1999
    around = rng.choice(2000, (9000, 4), p=weights / weights.sum())
    around[::50, 1] = 2000
    mine, plain = pseudo_likelihood.Network(weights), pseudo_likelihood.Network(weights)
    state, memory = mine.train(tokens[:0], around[:0]), {n: np.full(getattr(plain, n).shape, 0.1, np.float32) for n in plain.TABLES}
    met = {n: 0 for n in plain.TABLES}
    for a in (0, 3000, 6000):
        few = slice(a, a + 3000)
        loss, uses = plain_step(plain, tokens[few], around[few], memory, 0.1)
        assert math.isclose(mine.step(tokens[few], around[few], state["memory"], state["met"], 0.1), loss, rel_tol=1e-5)
        met = {n: met[n] + uses[n] for n in met}
    for name in plain.TABLES:
        assert np.allclose(getattr(mine, name), getattr(plain, name), atol=2e-4), name
        assert np.allclose(state["memory"][name], memory[name], rtol=1e-3, atol=1e-5), name
        assert (state["met"][name] == met[name]).all(), name


def test_heavy_units_are_read_as_one_matrix():
    """Less than three fifths of the steps down the tree are gathered one by one; nothing of a path is left out."""
    weights = 1e6 / np.arange(1, 5001)
    tree = pseudo_likelihood.Network(weights).tree
    tokens = np.argsort(tree.place)
    node, side, spans = tree.paths_below(tokens)
    assert (node < tree.top).all() and len(spans) == len(set(tree.below.tolist()) - {0})
    assert (weights * tree.below).sum() < 0.6 * (weights * tree.length).sum()
    got = {}
    for a, b, c, d in spans:
        for i, (nodes, sides) in enumerate(zip(node[c:d].reshape(b - a, -1), side[c:d].reshape(b - a, -1), strict=True)):
            got[int(tokens[a + i])] = list(zip(nodes.tolist(), sides.tolist(), strict=True))
    for token in range(5000):
        path = slice(int(tree.start[token]), int(tree.start[token] + tree.length[token]))
        high = [(c // 2 + tree.top, c % 2 * 2.0 - 1) for c in tree.high[token].tolist() if c // 2 + tree.top < 4999]
        assert got.get(token, []) + high == list(zip(tree.node[path].tolist(), tree.side[path].tolist(), strict=True))


def test_tokens_are_stored_once_for_learning_and_scoring(docs, monkeypatch):
    """Tokens come back from storage as they were, and scores are those of the two steps apart."""
    column = pa.array(["the Abcdefg", None, "", "zz the"])
    ids, row, _ = pseudo_likelihood.encode(column, pseudo_likelihood.Ranks(np.zeros(0, np.uint64)))
    raw = pa.array([ids[row == k].astype(pseudo_likelihood.ID).tobytes() for k in range(4)])
    for part, few in ((slice(0, 4), row >= 0), (slice(1, 4), row >= 1), (slice(1, 3), row == 9), (slice(0, 0), row == 9)):
        got, of = pseudo_likelihood.stored_ids(raw.slice(part.start, part.stop - part.start))
        assert got.tolist() == ids[few].tolist() and of.tolist() == (row[few] - part.start).tolist()
    apart = {r.doc_id: r for r in pseudo_likelihood.score(docs, pseudo_likelihood.learn(docs, steps=5)).collect()}
    cut = []
    encoded = pseudo_likelihood.encoded
    monkeypatch.setattr(pseudo_likelihood, "encoded", lambda *a: cut.append(a) or encoded(*a))
    once = pseudo_likelihood.learn_and_score(docs, steps=5)
    assert set(once.columns) == {*docs.columns, "n_words", "log_likelihood", "per_word"} - {"text"} and len(cut) == 1
    for r in once.collect():
        assert r.n_words == apart[r.doc_id].n_words
        assert math.isclose(r.log_likelihood, apart[r.doc_id].log_likelihood, rel_tol=1e-3, abs_tol=1e-3)
