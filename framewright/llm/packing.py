"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily: the longest document that fits, again and again. If a
gap remains, the shortest document in it makes room for the two unpacked documents
whose lengths together fill the widened gap best, if they fill it better than it did.

Documents of one length are alike to a packer, so it is enough to know how many there
are of each length. This histogram has at most ``size`` rows whatever the input; it is
the only thing that the driver sees. ``plan`` runs best-two-fit over it, for all
sequences at once that come out alike: what it gives is what packing one document
after the other would give, over all documents together, not shard by shard.

The rest is done by Spark. Tokenising is narrow and numbers a task's pieces of each
length; counts by task and length give every piece its rank among all pieces of its
length; the plan, a few thousand ranges of ranks, is broadcast and maps the rank to a
sequence and a place in it. No task holds all pieces of a length.

Token ids come from the tokenizers library. Where the file drops white space and a text has
none but plain characters, its words go to the library's model when first met, and each
worker keeps their ids; other texts go to the library as they are. Long texts are handled
in parts that end at a blank or a line's end.

Defined cases: a null or empty text is one end mark, a sequence piece of length 1. A
document longer than ``size`` is cut into pieces of ``size`` tokens and a shorter last
one; no other document is cut. Ids may be null or repeated, each row is packed by itself;
ties between pieces of one length go by task and place. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import charsets, worker
from framewright.llm.bpe import WORD_LEVEL, byte_letters
from framewright.scratch import Tables

#: Words whose ids a Python worker keeps in each of two generations, and the longest one kept.
WORDS_KEPT, WORD_LENGTH_KEPT = 250_000, 32
#: Characters of a text that are cut into words at a time.
LETTERS_AT_A_TIME = 1 << 19

_BREAK, _CONTROL = re.compile("[ \n]"), re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f]")
#: The words of files that drop white space, in texts of plain characters.
_WORDS = re.compile(f"[{charsets.LETTERS}]+|[{charsets.DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{charsets.SPACE}{charsets.LETTERS}{charsets.DIGITS}]+")


class Ids(dict):
    """Texts to ids, as bytes of little-endian 32-bit numbers; the ids of short words are kept as this dict's values.

    A full dict becomes the older generation, so words in use outlive it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters, self.older = self.library.model, byte_letters(), {}
        made = json.loads(Path(path).read_text())
        steps, cuts = ((x or {}).get(n, [x or {}]) for x, n in ((made.get("normalizer"), "normalizers"), (made.get("pre_tokenizer"), "pretokenizers")))
        #: True if words never hold white space and are spelled by their bytes, so that they can be encoded one by one.
        self.by_word = (cuts[0].get("pattern") or {}).get("Regex") == WORD_LEVEL and cuts[0].get("behavior") == "Removed" and bool(cuts[0].get("invert")) and cuts[-1].get("type") == "ByteLevel"
        self.lowers = any(x.get("type") == "Lowercase" for x in steps)
        added = [re.escape(x["content"]) for x in made.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) <= WORD_LENGTH_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        found = self.model.tokenize(spelled)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, block by block; one at least."""
        for block in pieces_of(text) if self.by_word else [text]:
            if self.by_word and not (self.added and self.added.search(block)) and is_plain(block):
                yield b"".join(map(self.__getitem__, _WORDS.findall(block.lower() if self.lowers else block)))
            else:
                found = self.library.encode(block, add_special_tokens=False).ids
                yield struct.pack(f"<{len(found)}I", *found)


def is_plain(text: str) -> bool:
    """As ``charsets.is_plain``; quicker for texts of ASCII."""
    return _CONTROL.search(text) is None if text.isascii() else charsets.is_plain(text)


def pieces_of(text: str) -> Iterator[str]:
    """A text in blocks of about LETTERS_AT_A_TIME characters that end where white space begins."""
    at = 0
    while len(text) - at > LETTERS_AT_A_TIME and (found := _BREAK.search(text, at + LETTERS_AT_A_TIME)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def ids_of(path: str) -> Ids:
    """This process's Ids for a tokenizer file."""
    kept = worker.store("packing")
    if path not in kept:
        kept[path] = Ids(path)
    return kept[path]


def cut(blocks: Iterator[bytes], size: int, end_id: int = 0) -> Iterator[bytes]:
    """The ids of one document, and the end mark behind them, in pieces of size ids; the last may be shorter."""
    kept = bytearray()
    for block in blocks:
        kept += block
        at = 0
        while len(kept) - at > 4 * size:  # a piece is given once more follows, so the end mark finds room in the last
            yield bytes(kept[at : at + 4 * size])
            at += 4 * size
        del kept[:at]
    kept += struct.pack("<I", end_id)
    yield bytes(kept[: 4 * size])
    if len(kept) > 4 * size:
        yield bytes(kept[4 * size :])


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over counts of lengths: (sequences of this make, [(length, copies), ...] with falling lengths).

    Sequences come out alike until a length runs out that the choice depends on, so they
    are made together up to there.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made = []
    while left.any():
        lengths = np.flatnonzero(left)
        order = lengths.tolist()
        gap, taken, top = size, {}, len(order)
        while top and gap:
            top = bisect_right(order, gap, 0, top)
            if top:
                x = order[top - 1]
                taken[x] = min(int(left[x]), gap // x)
                gap -= x * taken[x]
                top -= 1
        needed = dict(taken)
        least = min(taken)
        pair = _better_pair(left, lengths, taken, least, gap) if gap else None
        if pair:
            taken[least] -= 1
            for x in pair:
                taken[x] = taken.get(x, 0) + 1
                needed[x] = needed.get(x, 0) + 1
        times = min((int(left[x]) - needed[x]) // n + 1 for x, n in taken.items() if n)
        for x, n in taken.items():
            left[x] -= times * n
        made.append((times, sorted(((x, n) for x, n in taken.items() if n), reverse=True)))
    return made


def _better_pair(left: np.ndarray, lengths: np.ndarray, taken: dict[int, int], least: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that is over least and fits where least and the gap are."""
    room = gap + least
    rest = left[lengths]
    for x, n in taken.items():
        rest[np.searchsorted(lengths, x)] -= n
    free, rest = lengths[rest > 0], rest[rest > 0]
    first = free < room
    a = free[first]
    at = np.searchsorted(free, np.minimum(a, room - a), "right") - 1  # the longest second one that is not longer than the first
    alone = (at >= 0) & (free[at] == a) & (rest[first] < 2)
    at = at - alone
    good = at >= 0
    if not good.any():
        return None
    a, b = a[good], free[at[good]]
    best = int(np.argmax(a + b))
    return (int(a[best]), int(b[best])) if a[best] + b[best] > least else None


class Places:
    """Where the plan puts the piece of each rank: ranges of ranks by length, in arrays that a task can search."""

    def __init__(self, made: list[tuple[int, list[tuple[int, int]]]]):
        rows, used, base = [], {}, 0
        for times, lengths in made:
            offset = 0
            for x, n in lengths:
                start = used.get(x, 0)
                rows.append((x, start, n, base, offset))
                used[x] = start + times * n
                offset += x * n
            base += times
        rows.sort()
        self.length, self.start, self.copies, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.first = {int(x): int(k) for x, k in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        at = np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            low = self.first[x]
            high = low + int(np.searchsorted(self.length[low:], x, "right"))
            at[own] = low + np.searchsorted(self.start[low:high], rank[own], "right") - 1
        turn, copy = np.divmod(rank - self.start[at], self.copies[at])
        return self.base[at] + turn, self.offset[at] + copy * length


def _cutting(path: str, size: int, id_col: str, keep_ids: bool):
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = ids_of(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            kept: list[bytes] = []
            for place, text in enumerate(batch.column(1).to_pylist()):
                start = 0
                for k, ids in enumerate(cut(own.blocks(text or ""), size)):
                    n = len(ids) // 4
                    for column, value in zip(rows, (place, k, start, n, zlib.crc32(ids), int(seen[n])), strict=True):
                        column.append(value)
                    seen[n] += 1
                    start += n
                    if keep_ids:
                        kept.append(ids)
            place, piece, start, length, crc, rank = rows
            columns = [batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (rank, pa.int64())))]
            columns.append(pa.array(np.full(len(place), part), pa.int32()))
            names = [id_col, "piece", "start", "length", "ids_crc32", "_rank", "_part"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _placing(places, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_at"))
            sequence, offset = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: its document's id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids, as bytes of 32-bit numbers.

    ``sequences`` makes the sequences of it.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    fields = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _rank long, _part int" + (", ids binary" if keep_ids else "")
    tables = Tables(spark)
    pieces = tables.keep(docs.select(id_col, text_col).mapInArrow(_cutting(tokenizer_path, size, id_col, keep_ids), fields), "pack-pieces")
    counts = tables.write(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    offsets = tables.keep(counts.select("_part", "length", before.alias("_before")), "pack-offsets")
    tables.close()
    places = spark.sparkContext.broadcast(Places(plan(histogram, size)))
    ranked = pieces.join(offsets, ["_part", "length"]).withColumn("_at", F.col("_before") + F.col("_rank"))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns, "_at").mapInArrow(_placing(places, columns), out)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids (array of int) and spans (id, piece, offset, length of each piece, in order) of what pack gives with keep_ids.

    A sequence has at most ``size`` pieces, so a group is small.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids"))).alias("_rows"))
    joined = rows.select("sequence_id", F.transform("_rows", lambda r: r["ids"]).alias("_ids"), F.transform("_rows", lambda r: F.struct(r["id"].alias(id_col), r["piece"].alias("piece"), r["offset"].alias("offset"), r["length"].alias("length"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], ["sequence_id", "ids", "spans"])

    return joined.mapInArrow(run, f"sequence_id long, ids array<int>, spans {joined.schema['spans'].dataType.simpleString()}")
