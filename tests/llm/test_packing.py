"""Packing against the tokenizers library, a packer that goes document by document, and the least number of sequences."""

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute_pieces(library, rows, size):
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            out.append((doc_id, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    return out


def gapless(rows, size):
    """Whether pieces (sequence_id, offset, length) fill their sequences from 0 without gaps or overlaps."""
    made = defaultdict(list)
    for sequence, offset, length in rows:
        made[sequence].append((offset, length))
    for own in made.values():
        at = 0
        for offset, length in sorted(own):
            if offset != at:
                return False
            at += length
        if at > size:
            return False
    return True


def check(spark, library, docs, size):
    done = packing.pack(docs, PATH, size).collect()
    rows = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in done]
    want = brute_pieces(library, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], size)
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert gapless([(r["sequence_id"], r["offset"], r["length"]) for r in done], size)
    return len({r["sequence_id"] for r in done}), -(-sum(r["length"] for r in done) // size)


@pytest.mark.parametrize("size", [2048, 64])
def test_odd_texts(spark, library, odd, size):
    used, least = check(spark, library, odd, size)
    assert used <= least + 2


def test_documents(spark, library, sf_dir):
    used, least = check(spark, library, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7), 2048)
    assert used <= 1.01 * least + 1


def test_nothing(spark, nothing):
    assert packing.pack(nothing, PATH).count() == 0


def test_a_third_of_all_pieces_has_one_length(spark, library):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.expr("repeat('word and ', cast(id % 97 as int))")).alias("text")).repartition(6)
    used, least = check(spark, library, docs, 128)
    assert used == least


def one_by_one(lengths, size):
    """Best-two-fit over single documents: the definition."""
    left, made = sorted(lengths), []
    while left:
        own, gap = [], size
        while fitting := [x for x in left if x <= gap]:
            own.append(fitting[-1])
            left.remove(fitting[-1])
            gap -= fitting[-1]
        if gap:
            room = gap + own[-1]
            pairs = [(left[i] + left[j], left[j], left[i]) for i in range(len(left)) for j in range(i + 1, len(left)) if own[-1] < left[i] + left[j] <= room]
            if pairs:
                _, a, b = max(pairs)
                out = own.pop()
                left.remove(a)
                left.remove(b)
                own += [a, b]
                left = sorted([*left, out])
        made.append(tuple(sorted(own, reverse=True)))
    return Counter(made)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_two_fit(seed):
    draw = np.random.default_rng(seed)
    size = int(draw.integers(5, 60))
    lengths = draw.integers(max(1, size // int(draw.integers(2, 9))), size + 1, int(draw.integers(1, 90))).tolist()
    planned = Counter()
    for times, own in packing.plan(dict(Counter(lengths)), size):
        planned[tuple(x for x, n in own for _ in range(n))] += times
    # pairs of one sum may differ; everything else may not
    want = one_by_one(lengths, size)
    assert sum(planned.values()) == sum(want.values())
    assert Counter(x for own, n in planned.items() for x in own * n) == Counter(lengths)
    assert sorted(sum(x) for x in planned.elements()) == sorted(sum(x) for x in want.elements())


def test_two_replace_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]


def test_the_plan_does_not_grow_with_the_documents():
    draw = np.random.default_rng(3)
    histogram = {x: int(n) for x, n in enumerate(draw.integers(1, 10**9, 2049)) if x}
    made = packing.plan(histogram, 2048)
    assert len(made) < 3 * 2048
    total = sum(x * n for x, n in histogram.items())
    assert sum(times for times, _ in made) <= -(-total // 2048) * 1.01


def test_places_are_a_numbering():
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 33, 500)
    places = packing.Places(packing.plan(dict(Counter(lengths.tolist())), 32))
    seen, rank = Counter(), []
    for x in lengths.tolist():
        rank.append(seen[x])
        seen[x] += 1
    sequence, offset = places.find(lengths, np.array(rank))
    assert gapless(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True), 32)
    assert set(sequence.tolist()) == set(range(places.sequences))


WORDS = ["the", "The", "don't", "WE'LL", "a.b,c", "x1y22", "§", "½", "é", "naïve", "日本", "Σας", "İx", "é", "́", "<|endoftext|>", "a\x1cb", "\x85", "\xa0", "'s", "''", "--", "ŉ", "😀", "#$%", "long" * 30, " ", "\x00"]


@pytest.mark.parametrize("seed", range(20))
def test_ids_are_the_librarys(library, seed, monkeypatch):
    draw = np.random.default_rng(seed)
    monkeypatch.setattr(packing, "LETTERS_AT_A_TIME", int(draw.integers(1, 60)))
    monkeypatch.setattr(packing, "WORDS_KEPT", int(draw.integers(1, 30)))
    own = packing.Ids(PATH)
    texts = ["".join(str(w) + str(draw.choice(["", " ", "\n", "  ", "\t", "."])) for w in draw.choice(WORDS[: int(draw.integers(3, len(WORDS)))], int(draw.integers(0, 40)))) for _ in range(30)]
    got = [np.frombuffer(b"".join(own.blocks(t)), "<u4").tolist() for t in texts]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_that_keep_white_space(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    done = {(r["doc_id"], r["start"] + r["length"]) for r in packing.pack(odd, path, 1 << 20).collect()}
    assert done == {(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.select("doc_id", "text").collect()}


def test_sequences(spark, library, odd):
    packed = packing.pack(odd, PATH, 64, keep_ids=True)
    made = packing.sequences(packed).collect()
    pieces = {(r["sequence_id"], r["offset"]): np.frombuffer(r["ids"], "<u4").tolist() for r in packed.collect()}
    assert sum(len(r["spans"]) for r in made) == len(pieces)
    for r in made:
        for span in r["spans"]:
            assert r["ids"][span["offset"] : span["offset"] + span["length"]] == pieces[r["sequence_id"], span["offset"]]
