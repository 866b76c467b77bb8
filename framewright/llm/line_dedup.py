"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

State of a ``LineIndex``, a folder of Parquet tables, one generation per change. A
manifest, written last, names the generation; a folder that has one is opened where it
was left, by any session. A change that was cut off leaves no manifest and is done
again. Older generations stay, as results may still read them, until ``vacuum``.

* ``counts``: line key digest -> number of indexed documents that hold the line.
  Adding documents adds to it, deleting them subtracts, so any order of additions
  and deletions ends in the same table.
* ``filters``: one cuckoo filter per shard of the digest space over the *dropped*
  lines, those found in at least ``min_docs`` documents. When a count crosses the
  threshold the key is inserted into, or deleted from, its shard's filter. Shards are
  doubled, and their filters built anew, when they would hold more than
  ``keys_per_shard`` keys on average.

``apply`` broadcasts the filters while they are below ``max_broadcast_mb`` and
tests each line on the spot, without a shuffle of texts. A filter may also accept
lines that it does not hold; those are found by an exact join with ``counts`` and
sent along as exceptions, so the result is exact. Filters too large to broadcast
are not used: lines then meet ``counts`` in a shuffle join.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased; keys shorter than ``min_chars`` are never dropped. Digests have 128
bits.

Defined cases: a null or empty text is one empty line, its text comes back as the
empty text. A line repeated within a document counts once. A repeated row counts
as another document. An empty table gives empty tables and results. Ids may be
null or repeated: each row is treated by itself. All columns are passed on. The
counts that are added are named ``_n_lines`` and ``_n_dropped``, or, where docs has a
column of that name (in any case), the same with underscores appended until it is free.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import worker
from framewright.scratch import drop_path, new_path

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = b" \t\n\x0b\x0c\r"

COUNTS_SCHEMA = "hi long, lo long, n long"
FILTER_SCHEMA = "shard long, table binary"


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; keys come as two 64-bit halves of a digest."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)  # buckets is a power of two; 0: free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for so many keys at a load of at most 0.8."""
        need = max(4, int(keys / (0.8 * cls.SLOTS)) + 1)
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi, lo = hi.astype(np.int64).view(np.uint64), lo.astype(np.int64).view(np.uint64)
        mark = (hi >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (lo & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether each key may be held; never False for a key that is."""
        mark, a, b = self._places(hi, lo)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, hi: int, lo: int) -> bool:
        """Add a key; False if no place was found, after which the filter must be built anew."""
        mark, a, b = (x[0] for x in self._places(np.array([hi]), np.array([lo])))
        at = int(a)
        for place in (int(a), int(b)):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        for k in range(self.KICKS):
            slot = (k * 7 + at) % self.SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self._jump(np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        """Take out one copy of a key's fingerprint; False if there is none."""
        mark, a, b = (x[0] for x in self._places(np.array([hi]), np.array([lo])))
        for place in (int(a), int(b)):
            found = np.flatnonzero(self.table[place] == mark)
            if len(found):
                self.table[place, found[0]] = 0
                return True
        return False

    @classmethod
    def holding(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys."""
        room = len(hi)
        while True:
            out = cls.sized(room)
            if all(map(out.insert, hi.tolist(), lo.tolist())):
                return out
            room = 2 * room + 8


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line of a text, in UTF-8."""
    return [x.strip(_BLANK) for x in (text or "").encode().translate(_LOWER).split(b"\n")]


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def _counting(min_chars: int):
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(xxhash.xxh3_128_digest(k) for k in set(line_keys(text)) if _chars(k) >= min_chars)
            both = _halves(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(seen.values()), pa.int64())], ["hi", "lo", "n"])

    return run


def _probing(filters, exceptions, shards: int):
    """For batches of (hi, lo, ...): whether the filters hold each key and no exception is made for it."""
    tables = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()}

    def test(both: np.ndarray) -> np.ndarray:
        out = np.zeros(len(both), bool)
        shard = both[:, 0] & (shards - 1)
        for k in np.unique(shard):
            if k in tables:
                at = np.flatnonzero(shard == k)
                out[at] = tables[k].contains(both[at, 0], both[at, 1])
        if exceptions:
            for k in np.flatnonzero(out):
                out[k] = (int(both[k, 0]), int(both[k, 1])) not in exceptions
        return out

    return test


def _tester(sent):
    """The probe of a broadcast value, unpacked once in each worker."""
    kept = worker.store("line_dedup")
    if sent.value["id"] not in kept:
        kept.clear()
        kept[sent.value["id"]] = _probing(sent.value["filters"], sent.value["exceptions"], sent.value["shards"])
    return kept[sent.value["id"]]


def _kept(lines: list[str], drop: np.ndarray) -> str:
    return "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores appended until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _dropping(sent, min_chars: int, names: list[str], text_col: str, added: list[str]):
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _tester(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                keys = [line_keys(x) for x in texts]
                flat = [k for x in keys for k in x]
                hit = test(_halves([xxhash.xxh3_128_digest(k) for k in flat]))
                for k in np.flatnonzero(hit):
                    hit[k] = _chars(flat[k]) >= min_chars
                ends = np.cumsum([len(x) for x in keys])
                drops = np.split(hit, ends[:-1])
                kept = [_kept(x.split("\n"), d) if d.any() else x for x, d in zip(texts, drops, strict=True)]
                columns = [part.column(n) if n != text_col else pa.array(kept, pa.string()) for n in names]
                n_lines = pa.array([len(x) for x in keys], pa.int64())
                n_dropped = pa.array([int(d.sum()) for d in drops], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, n_lines, n_dropped], [*names, *added])

    return run


def _updating(min_docs: int):
    """Brings one shard's filter up to date with the keys that are or were in it."""

    def run(key: tuple, old: pa.Table, keys: pa.Table) -> pa.Table:
        now = keys["n"].to_numpy() >= min_docs
        was = keys["n_old"].to_numpy() >= min_docs
        hi, lo = keys["hi"].to_numpy(), keys["lo"].to_numpy()
        done = old.num_rows > 0
        if done:
            own = CuckooFilter.from_bytes(old["table"][0].as_py())
            gone, new = np.flatnonzero(was & ~now), np.flatnonzero(now & ~was)
            done = all([own.delete(int(hi[k]), int(lo[k])) for k in gone]) and all(own.insert(int(hi[k]), int(lo[k])) for k in new)
        if not done:
            own = CuckooFilter.holding(hi[now], lo[now])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "table": pa.array([own.to_bytes()], pa.binary())})

    return run


class LineIndex:
    """Reference counts and filters of lines, kept in a folder that the cluster shares; opened if the folder holds one."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 20_000, max_broadcast_mb: float = 64):
        self.spark, self.path = spark, path or new_path(spark, "line-index")
        self.min_docs, self.min_chars, self.keys_per_shard, self.max_broadcast_mb = min_docs, min_chars, keys_per_shard, max_broadcast_mb
        self.generation, self.shards = 0, 0
        for name in self._names():
            if (found := re.fullmatch(r"manifest-(\d+)\.json", name)) and int(found[1]) > self.generation:
                self.generation = int(found[1])
        if self.generation:
            told = json.loads(spark.read.text(f"{self.path}/manifest-{self.generation}.json").first()[0])
            if (told["min_docs"], told["min_chars"]) != (min_docs, min_chars):
                raise ValueError(f"the index at {self.path} is for min_docs {told['min_docs']} and min_chars {told['min_chars']}")
            self.shards = told["shards"]

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        where, store = self._store()
        return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []

    def _publish(self, generation: int, shards: int) -> None:
        """The manifest of a generation whose tables are complete: written aside, then renamed."""
        _, store = self._store()
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        aside, final = at(f"{self.path}/.manifest-{generation}.json"), at(f"{self.path}/manifest-{generation}.json")
        out = store.create(aside, True)
        out.write(bytearray(json.dumps({"shards": shards, "min_docs": self.min_docs, "min_chars": self.min_chars}).encode()))
        out.close()
        if not store.rename(aside, final):
            raise RuntimeError(f"generation {generation} is there already: another session has changed {self.path}")
        self.generation, self.shards = generation, shards

    def vacuum(self) -> None:
        """Delete all but the present generation; nothing may read older ones any more."""
        for name in self._names():
            if (found := re.fullmatch(r"(?:counts|filters|change)-(\d+)|manifest-(\d+)\.json", name)) and int(found[1] or found[2]) != self.generation:
                drop_path(self.spark, f"{self.path}/{name}")

    def counts(self) -> DataFrame:
        """hi, lo, n: the two halves of each line's digest and its number of documents."""
        if not self.generation:
            return self.spark.createDataFrame([], COUNTS_SCHEMA)
        return self.spark.read.schema(COUNTS_SCHEMA).parquet(f"{self.path}/counts-{self.generation}")

    def filters(self) -> DataFrame:
        """shard, table: the cuckoo filter of each shard that has keys."""
        if not self.generation:
            return self.spark.createDataFrame([], FILTER_SCHEMA)
        return self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.path}/filters-{self.generation}")

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of docs in."""
        self._change(docs, text_col, 1)

    def remove(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of docs, which were added before, out again."""
        self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> None:
        part = docs.select(text_col).mapInArrow(_counting(self.min_chars), COUNTS_SCHEMA)
        change = part.groupBy("hi", "lo").agg(F.sum("n").alias("n")).withColumn("n_old", F.lit(0).cast("long"))
        if self.generation:
            old = self.counts().select("hi", "lo", F.lit(0).cast("long").alias("n"), F.col("n").alias("n_old"))
            change = change.unionByName(old).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.sum("n_old").alias("n_old"))
        new = self.generation + 1
        table = f"{self.path}/%s-{new}"
        change.select("hi", "lo", (F.col("n_old") + sign * F.col("n")).alias("n"), "n_old").write.mode("overwrite").parquet(table % "change")
        changed = self.spark.read.schema(f"{COUNTS_SCHEMA}, n_old long").parquet(table % "change")
        changed.filter("n > 0").select("hi", "lo", "n").write.mode("overwrite").parquet(table % "counts")
        touched = changed.filter((F.col("n") >= self.min_docs) | (F.col("n_old") >= self.min_docs))
        need = touched.filter(F.col("n") >= self.min_docs).count() // self.keys_per_shard + 1
        shards = max(self.shards, 1 << (need - 1).bit_length())
        filters = self.filters() if shards == self.shards else self.filters().limit(0)
        shard = F.col("hi").bitwiseAND(F.lit(shards - 1))
        made = (
            filters.groupBy("shard")
            .cogroup(touched.withColumn("shard", shard).groupBy("shard"))
            .applyInArrow(_updating(self.min_docs), FILTER_SCHEMA)
        )
        made.write.mode("overwrite").parquet(table % "filters")
        drop_path(self.spark, table % "change")
        self._publish(new, shards)

    def _broadcast(self, exceptions: set) -> object:
        rows = self.filters().collect()
        held = {r["shard"]: bytes(r["table"]) for r in rows}
        value = {"id": f"{self.path}-{self.generation}-{len(exceptions)}", "filters": held, "exceptions": exceptions, "shards": self.shards}
        return self.spark.sparkContext.broadcast(value)

    def _exceptions(self) -> set | None:
        """Keys that the filters accept though they are not to be dropped; None if too many to send along."""
        sent = self._broadcast(set())

        @worker.releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = _tester(sent)
            for batch in batches:
                both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                yield batch.filter(pa.array(test(both)))

        wrong = self.counts().filter(F.col("n") < self.min_docs).mapInArrow(run, COUNTS_SCHEMA).select("hi", "lo")
        bound = int(self.max_broadcast_mb * 1e6 / 200)  # bytes of a pair in a Python set
        rows = wrong.limit(bound + 1).collect()
        return None if len(rows) > bound else {(r["hi"], r["lo"]) for r in rows}

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs without the lines to drop, with _n_lines and _n_dropped (see above) added. Docs must be in the index."""
        exceptions = self._sendable()
        return self._apply_joined(docs, text_col) if exceptions is None else self._apply_sent(docs, text_col, exceptions)

    def _sendable(self) -> set | None:
        """The exceptions, if they and the filters are small enough to send along."""
        size = self.filters().agg(F.coalesce(F.sum(F.length("table")), F.lit(0))).first()[0]
        return self._exceptions() if size <= self.max_broadcast_mb * 1e6 else None

    def _apply_sent(self, docs: DataFrame, text_col: str, exceptions: set) -> DataFrame:
        added = [free_name(docs.columns, x) for x in ("_n_lines", "_n_dropped")]
        schema = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, *((n, "long") for n in added)])
        return docs.mapInArrow(_dropping(self._broadcast(exceptions), self.min_chars, docs.columns, text_col, added), schema)

    def _apply_joined(self, docs: DataFrame, text_col: str) -> DataFrame:
        """The way for filters that are too large to send: lines meet the counts in a shuffle join.

        Each row is known by its place and content hash, so equal rows keep apart.
        """
        min_chars = self.min_chars

        @worker.releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [line_keys(x) for x in batch.column(1).to_pylist()]
                rows = np.repeat(batch.column(0).to_numpy(), [len(x) for x in keys])
                at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in keys)]).astype(np.int64)
                flat = [k for x in keys for k in x]
                both = _halves([xxhash.xxh3_128_digest(k) for k in flat])
                long = np.array([_chars(k) >= min_chars for k in flat], bool)
                yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (rows, at, both[:, 0], both[:, 1])], ["_row", "_at", "hi", "lo"])

        spark, path = self.spark, new_path(self.spark, "line-rows")
        added = [free_name(docs.columns, x) for x in ("_n_lines", "_n_dropped")]
        row, own = free_name(docs.columns, "_row"), free_name(docs.columns, "_lines")
        docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        lines = rows.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")).mapInArrow(run, "_row long, _at long, hi long, lo long")
        drops = lines.join(self.counts().filter(F.col("n") >= self.min_docs), ["hi", "lo"]).groupBy("_row").agg(F.collect_set("_at").alias("_drop"))
        drop_row, drop_at = free_name([*docs.columns, row, own], "_drop_row"), free_name([*docs.columns, row, own], "_drop")
        drops = drops.select(F.col("_row").alias(drop_row), F.col("_drop").alias(drop_at))
        told = rows.join(drops, F.col(row) == F.col(drop_row), "left")
        told = told.withColumn(drop_at, F.coalesce(drop_at, F.array().cast("array<bigint>"))).withColumn(own, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
        kept = F.filter(F.col(own), lambda x, i: ~F.array_contains(F.col(drop_at), i.cast("long")))
        return told.select(
            *[F.array_join(kept, "\n").alias(n) if n == text_col else F.col(f"`{n}`") for n in docs.columns],
            F.size(own).cast("long").alias(added[0]),
            F.size(drop_at).cast("long").alias(added[1]),
        )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """Index docs and drop their common lines: docs' columns, the text shortened, with _n_lines and _n_dropped (see above)."""
    index = LineIndex(docs.sparkSession, min_docs=min_docs, min_chars=min_chars)
    index.add(docs, text_col)
    exceptions = index._sendable()
    if exceptions is None:
        return index._apply_joined(docs, text_col)
    done = index._apply_sent(docs, text_col, exceptions)
    drop_path(docs.sparkSession, index.path)  # all that the result needs is sent along
    return done
