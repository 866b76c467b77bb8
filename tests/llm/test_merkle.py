"""The Merkle manifest against a manifest made row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import merkle
from framewright.llm.queries import op11_merkle

TOLD = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    texts = [None if row[c] is None else str(row[c]) for c in TOLD]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def brute_tree(nodes):
    """The root, and each leaf's (node, is left) pairs on its way up; a level with a node alone has an empty one."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            beside = place ^ 1
            paths[k].append((nodes[beside] if beside < len(nodes) else "", bool(place & 1 and beside < len(nodes))))
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], paths


def fold(node, path):
    for beside, left in path:
        node = sha(beside + node if left else node + beside)
    return node


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    trees = {}
    for lang, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees[lang] = brute_tree([brute_leaf(r) for r in own])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    root, upper = brute_tree([trees[x][0] for x in order])
    out = []
    for lang, over in zip(order, upper, strict=True):
        for r, path in zip(groups[lang], trees[lang][1], strict=True):
            whole, shown = path + over, dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                shown["n_chars"] += 1
            folded = fold(brute_leaf(shown), whole)
            out.append((r["doc_id"], brute_leaf(r), trees[lang][0], root, sha("".join(n for n, _ in whole)), folded, folded == root))
    return out


def made(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    done = [tuple(r) for r in op11_merkle(spark, str(tmp_path)).collect()]
    return sorted(done, key=repr), sorted(brute([r.asDict() for r in docs.collect()]), key=repr)


def test_odd_rows(spark, odd, tmp_path):
    done, want = made(spark, tmp_path, odd)
    assert done == want


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_groups_of_every_size(spark, tmp_path, monkeypatch, levels):
    """Groups of 1 to 40 rows and a null group, in buckets of 2 to 8, so that there are several tiers and ragged ends."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(k * 100 + j if k % 3 else j, f"t {k} {j}", f"l{k}" if k else None, None, j if j % 5 else None) for k in (0, *range(1, 18), 31, 32, 33, 40) for j in range(k + 1)]
    done, want = made(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))
    assert done == want
    assert {x[-1] for x in done} == {True, False}


def test_a_large_group_of_equal_rows(spark, tmp_path):
    """Equal rows stand side by side, each with a path of its own."""
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    done, want = made(spark, tmp_path, docs)
    assert done == want


def test_tables_end_with_buckets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merkle, "ROWS_AT_A_TIME", 10)
    keys = [("a", k // 4) for k in range(30)] + [("b", k // 4) for k in range(9)]
    batches = [pa.RecordBatch.from_pydict({"_tree": [t for t, _ in keys[k : k + 3]], "_bucket": [b for _, b in keys[k : k + 3]]}) for k in range(0, len(keys), 3)]
    tables = list(merkle.whole_buckets(iter(batches)))
    got = [list(zip(t["_tree"].to_pylist(), t["_bucket"].to_pylist(), strict=True)) for t in tables]
    assert sum(got, []) == keys and len(got) > 2
    assert all(not set(a) & set(b) for k, a in enumerate(got) for b in got[k + 1 :])


def test_nothing_and_clashing_names(spark, nothing, odd):
    assert merkle.manifest(nothing, merkle.leaf(TOLD), "lang", "doc_id").count() == 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("_tree", "_node", "_pos", "_n", "_order", "_bucket", "_path", "leaf", "path", "root")})
    assert merkle.manifest(clashing, merkle.leaf(TOLD), "lang", "doc_id", {"root_of": F.lit(1)}).count() == odd.count()
