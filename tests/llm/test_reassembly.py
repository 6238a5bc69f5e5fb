import random
import zlib

import pytest

from tessera.llm import reassembly, scan
from tessera.llm.queries import op12_reassembly
from tessera.llm.reassembly import resolve, states

SF = "/root/testdata/sf0.001"
LOG = "doc_id long, source string, op string, key long, value long"


def replayed(log, every=4):
    """(changes, states) of a log in order, a record at a time."""
    open_, done, commits, store, epochs = {}, [], 0, {}, []
    for i, source, op, key, value in log:
        t = open_.setdefault(source, [[]])
        if op == "change":
            t[-1].append((i, key, value))
        elif op == "savepoint":
            t.append([])
        elif op == "rollback":
            done += [(c[0], c[1], c[2], "rollback", i, None) for c in t[-1]]
            t[-1] = []
            if len(t) > 1:
                t.pop()
        else:
            left = [c for part in t for c in part]
            if op == "commit":
                commits += 1
            done += [(*c, op, i, (commits - 1) // every + 1 if op == "commit" else None) for c in left]
            if op == "commit":
                for _, k, v in left:
                    store.pop(k, None)
                    if v is not None:
                        store[k] = v
                epochs[(commits - 1) // every :] = [((commits - 1) // every + 1, len(store), sum(store.values()))]
            del open_[source]
    done += [(*c, "abort", None, None) for t in open_.values() for part in t for c in part]
    return sorted(done, key=str), epochs


def check(spark, log, partitions=5):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shuffled = random.Random(1).sample(log, len(log))
        changes, commits = resolve(spark.createDataFrame(shuffled, LOG))
        got = sorted([(r["doc_id"], r["key"], r["value"], r["outcome"], r["by"], r["epoch"]) for r in changes.collect()], key=str)
        after = sorted(map(tuple, states(changes, commits).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got, after) == replayed(log)


def made(seed, n, weights, sources):
    draw = random.Random(seed)
    ops = draw.choices(["commit", "abort", "savepoint", "rollback", "change"], weights, k=n)
    return [(k * 3, draw.choice(sources), op, *((draw.randrange(6), draw.choice([None, 5, 9, draw.randrange(2**32)])) if op == "change" else (None, None))) for k, op in enumerate(ops)]


@pytest.fixture
def small(monkeypatch):
    """Chunks of 4 records, blocks of 2 epochs, and groups of 2, so that short logs go through all levels."""
    monkeypatch.setattr(reassembly, "CHUNK_BITS", 2)
    monkeypatch.setattr(reassembly, "BLOCK_BITS", 1)
    monkeypatch.setattr(reassembly, "BITS", 1)
    monkeypatch.setattr(scan, "BITS", 1)


@pytest.mark.parametrize(("seed", "weights", "sources"), [(1, [2, 1, 2, 2, 16], ["a", "a", "a", "b", None]), (2, [1, 1, 12, 9, 6], ["a"]), (3, [1, 0, 1, 20, 6], ["a", "b"]), (4, [0, 0, 5, 4, 9], [None, ""])])
def test_chunks_and_scans_as_a_replay(spark, small, seed, weights, sources):
    check(spark, made(seed, 150, weights, sources))


def test_whole_chunks_as_a_replay(spark):
    check(spark, made(5, 9000, [2, 1, 2, 2, 16], ["a", "a", "a", "b", None, "c"]), 2)


def test_long_transaction_with_its_rollbacks_far_away(spark, small):
    deep = [(k, "a", "savepoint" if k % 2 else "change", k, k) for k in range(60)]
    check(spark, [(k, s, op, *((key, v) if op == "change" else (None, None))) for k, s, op, key, v in deep] + [(100 + k, "a", "rollback", None, None) for k in range(12)] + [(200, "a", "commit", None, None)])


def test_empty_log_repeated_ids_and_records_without_a_place(spark):
    changes, commits = resolve(spark.createDataFrame([], LOG))
    assert changes.collect() == [] and states(changes, commits).collect() == []
    log = [(None, "a", "change", 1, 1), (1, "a", None, 1, 1), (2, "a", "change", 1, 8), (2, "a", "change", 1, 8), (3, "a", "commit", None, None), (4, "b", "abort", None, None)]
    changes, commits = resolve(spark.createDataFrame(log, LOG))
    assert sorted((r["doc_id"], r["outcome"], r["by"]) for r in changes.collect()) == [(2, "commit", 3)] * 2
    assert list(map(tuple, states(changes, commits).collect())) == [(1, 1, 8)]


def test_query_as_a_replay(spark):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    log = []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        h = zlib.crc32(str(r["doc_id"]).encode())
        op = ["commit"] * 2 + ["abort"] + ["savepoint"] * 2 + ["rollback"] * 2 + ["change"] * 16
        key = h // 100 % 300
        value = None if r["text"] is None or r["doc_id"] in toxic else zlib.crc32(f"{key}:{r['text']}".encode())
        log.append((r["doc_id"], r["source"], op[h % 23], key, value))
    changes, epochs = replayed(log)
    want = [("state", *e) for e in epochs] + [(c[3], c[0], c[4], c[1]) for c in changes if c[3] != "commit"]
    assert sorted(map(tuple, op12_reassembly(spark, SF).collect()), key=str) == sorted(want, key=str)
