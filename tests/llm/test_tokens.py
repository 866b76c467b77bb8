"""Token counts and BPE against the libraries."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import bpe, token_counts
from framewright.scratch import new_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def strange(seed, n=300):
    """Random texts over scripts, marks, blanks, digits, special strings and long words."""
    draw = random.Random(seed)
    alphabets = ["abcdefghij", "ABCÄÖß", "0123456789²½٣", " \t\n\r\x0b\x0c\x1c\x85  　​", "'’.,;-_<>|#\"", "日本語漢字", "éèıİŉǅǆ", "éäͅ", "ΑΒΣςσ", "אبتहि", "😀👩‍👩", "ﬁﬀﬀÅÅẞ"]
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 12)):
            letters = draw.choice(alphabets)
            parts.append("".join(draw.choice(letters) for _ in range(draw.randint(1, draw.choice([3, 8, 90])))))
            if draw.random() < 0.2:
                parts.append(draw.choice(["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "</w>", " don't ", "<|ENDOFTEXT|>"]))
        yield "".join(parts)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoding_equals_the_library(path):
    own, lib = bpe.Encoder(path), library(path)
    decoder = bpe.Decoder(own.table)
    for text in [*strange(1, 2000), "Hello World, it's 1234 fine", "  two  blanks \n\n and tabs\t"]:
        want = lib.encode(text, add_special_tokens=False).ids
        pieces = list(own.pieces(text))
        assert list(map(int, " ".join(pieces).split())) == want, ascii(text)
        assert decoder.decode(pieces) == lib.decode(want, skip_special_tokens=False), ascii(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_decoding_in_any_pieces(path):
    lib, decoder = library(path), bpe.Decoder(bpe.BpeTable(path))
    for text in strange(2, 400):
        ids = lib.encode(text, add_special_tokens=False).ids
        draw = random.Random(len(ids))
        for seq in (ids, ids[1:], draw.sample(ids, len(ids))):
            cuts = sorted(draw.randint(0, len(seq)) for _ in range(3))
            pieces = [" ".join(map(str, seq[a:b])) for a, b in zip([0, *cuts], [*cuts, len(seq)])]
            assert decoder.decode(pieces) == lib.decode(seq, skip_special_tokens=False), ascii(text)


def test_files_of_another_make_are_refused(tmp_path):
    made = json.loads(open(WORD).read())
    for change in ({"normalizer": {"type": "StripAccents"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "WordPiece"}}, {"model": made["model"] | {"unk_token": "x"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(made | change))
        with pytest.raises(ValueError, match="known"):
            bpe.Encoder(str(path))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tokens_leave_within_the_lookahead(path):
    """Every token is emitted once its end is lookahead + STEP letters back or earlier, and most long before the word's end."""
    table, lib = bpe.BpeTable(path), library(path)
    draw, early = random.Random(5), 0
    words = ["".join(draw.choice("abcdeinorst") for _ in range(n)) for n in (30, 60, 64, 200, 5000)]
    words += ["a" * 3000, "ab" * 1500, "the" * 1000, "ha" * 700 + "x", "international" * 100]
    for word in words:
        own, out, sent = bpe.Transducer(table), [], 0
        for k, letter in enumerate(word[:-1]):
            for token in own.feed(letter):
                out.append(token)
                sent += len(token)
            assert k + 1 - sent <= own.bound
            assert len(own.letters) == k + 1 - sent
        early += len(out)
        out += own.finish(word[-1])
        assert [table.vocab[t] for t in out] == lib.encode(word, add_special_tokens=False).ids
    assert early > 1000
    short = bpe.Transducer(table)
    assert short.feed("thequickbrownfoxjumpsoverthelazydogandrunsaway")  # within one word of a usual length


def test_streaming_keeps_a_bounded_window_and_any_cut_gives_the_same():
    table = bpe.BpeTable(WORD)
    draw, lib = random.Random(3), library(WORD)
    for length in (10, 100, 5000, 40_000):
        word = "".join(draw.choice("abcdeinorst") for _ in range(length))
        own, got, at, most = bpe.Transducer(table), [], 0, 0
        while at < length - 1:
            step = min(draw.randint(1, 700), length - 1 - at)
            got += own.feed(word[at : at + step])
            most = max(most, len(own.letters))
            at += step
        got += own.finish(word[-1])
        assert [table.vocab[t] for t in got] == lib.encode(word, add_special_tokens=False).ids
        assert most <= own.bound


def test_counting_equals_the_library():
    own, lib = token_counts.PieceCounter(BYTE), library(BYTE)
    for text in strange(4, 3000):
        assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids), ascii(text)


def test_sentencepiece_counts(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd.filter("length(text) < 1000 and doc_id is not null")
    done = token_counts.token_counts(docs, new_path(spark, "t"), path)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(lib.encode(texts[r["doc_id"]])) for r in done.collect())


def test_cache_encodes_only_misses(spark, odd):
    path = new_path(spark, "cache")
    first = sorted(map(tuple, token_counts.token_counts(odd, path, BYTE, 5).collect()), key=repr)
    n = token_counts.read_cache(spark, path).count()
    assert n == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert sorted(map(tuple, token_counts.token_counts(odd, path, BYTE, 5).collect()), key=repr) == first
    assert token_counts.read_cache(spark, path).count() == n
    token_counts.token_counts(odd, path, WORD, 5).count()
    assert token_counts.read_cache(spark, path).count() == 2 * n


@pytest.mark.parametrize("sent", [500_000, 0])
def test_only_new_contents_are_read_again(spark, odd, monkeypatch, sent):
    """With a warm cache only missing contents are encoded, whether their digests are sent along or joined."""
    monkeypatch.setattr(token_counts, "MAX_SENT", sent)
    path = new_path(spark, "cache")
    token_counts.fill_cache(odd.filter("doc_id < 8"), path, BYTE)
    before = {bytes(r["content_sha256"]) for r in token_counts.read_cache(spark, path).collect()}
    got = sorted(map(tuple, token_counts.token_counts(odd, path, BYTE, 5).collect()), key=repr)
    rows = token_counts.read_cache(spark, path).collect()
    assert len(rows) == len({bytes(r["content_sha256"]) for r in rows}) > len(before) > 0
    assert got == sorted(map(tuple, token_counts.token_counts(odd, new_path(spark, "cache"), BYTE, 5).collect()), key=repr)
    smaller = new_path(spark, "cache")
    token_counts.compact_cache(spark, path, smaller, 1)
    assert sorted(map(repr, token_counts.read_cache(spark, smaller).collect())) == sorted(map(repr, rows))


def test_token_counts_odd_rows(spark, odd, nothing):
    lib = library(BYTE)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 5) for r in odd.collect()), key=repr)
    got = token_counts.token_counts(odd, new_path(spark, "t"), BYTE, 5).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts.token_counts(nothing, new_path(spark, "t"), BYTE).count() == 0


def test_bpe_odd_rows(spark, odd, nothing):
    lib = library(WORD)
    got = bpe.encode_decode(odd, WORD).collect()
    want = []
    for r in odd.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), tuple(ids), lib.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(nothing, WORD).count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_bpe_query(spark, sf_dir, name):
    from framewright.llm.queries import QUERIES

    lib = library(WORD)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op4_bpe"](spark, sf_dir).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
