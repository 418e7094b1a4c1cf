import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie as P
from quarry.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths_of(rows, heads=False):
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    if not heads:
        return {c: tuple(t) for c, t in convs.items()}
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = (*convs.get(c - c % 20, [])[:h], *turns[h:])
    return out


def brute(paths):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1].encode())) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()), key=repr)


def some_rows(seed, convs=300):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.35:                                # a hot conversation, which many shards share
            turns = [("system", "be kind"), ("user", "hello there you"), ("assistant", "hello")]
        else:
            turns = [(rng.choice(["user", None, ""]), rng.choice(["a b", "a  b", "c", None, "", "one two three"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def trie(spark, rows):
    return sorted(map(tuple, P.prefix_trie(P.turn_paths(spark.createDataFrame(rows, SCHEMA))).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shards, ends", [(1, 1 << 14), (3, 2), (8, 5), (40, 1 << 14)])
def test_trie_equals_brute_force_over_any_number_of_shards(spark, monkeypatch, shards, ends):
    monkeypatch.setattr(P, "ENDS", ends)
    monkeypatch.setattr(P, "partitions", lambda _: shards)
    rows = some_rows(shards)
    assert trie(spark, rows) == brute(paths_of(rows))


def test_large_skeletons_are_joined_by_a_salted_key(spark, monkeypatch):
    monkeypatch.setattr(P, "SKELETON", 0)
    rows = some_rows(5)
    assert trie(spark, rows) == brute(paths_of(rows))


def test_nulls_ties_and_an_empty_table(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (2, 0, "b", "x"), (2, 0, "a", "y"), (None, 0, "user", "of no conversation"),
            (-3, 1, "user", "first"), (4, 0, "", ""), (4, 0, "", "")]
    told = [(*r[:3], r[3]) for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or ""))]     # ties: by role
    assert trie(spark, rows) == brute(paths_of(told))
    assert trie(spark, []) == []
    long = [(7, i, "user", "w " * (i % 3)) for i in range(3000)] + [(8, i, "user", "w " * (i % 3)) for i in range(2990)]
    assert trie(spark, long) == brute(paths_of(long))


def test_role_and_text_are_told_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc"), (4, 0, "a", "b c")]
    assert trie(spark, rows) == brute(paths_of(rows))


def test_query_rebuilds_conversations_and_leaves_other_columns(spark, tmp_path):
    rows = [(c + 20 * (c % 3), *r) for c, *r in some_rows(11, 200)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS path", "'x' AS member", "'x' AS depth", "1 AS _p", "'x' AS node")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").sort("role", "text").collect()]
    one = {}
    for r in rows:
        one.setdefault(r[:2], r)
    assert len(one) <= len(rows)
    df = spark.createDataFrame(list(one.values()), SCHEMA)
    df.write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)
    paths = paths_of(list(one.values()), heads=True)
    assert got == brute(paths) and () in paths.values()        # some are left without a turn


def test_query_on_the_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_prefix_trie"](spark, sf)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == brute(paths_of(rows, heads=True))
