"""The prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            found[conv].append(((turn is not None, turn or 0), r, digest, t))
    return {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in found.items()}


def regrown(rows):
    own, out = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*prefix_trie.RESULT).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["", "hé", "x y", "long " * 400, "b"]
    out = []
    for c in [*range(0, 70), -7, -5, -1, 10**12, 10**12 + 3]:
        for turn in range(rng.randint(1, 7)):
            out.append((c, rng.choice([turn, None, 2]), rng.choice(["user", "system", None]), rng.choice([*texts, None])))
    out += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a third are alike
    out += [(300, t, "user", f"t{t // 2}") for t in range(150)]  # one long conversation
    out += [(301, t, "user", f"t{t // 2}") for t in range(149)]
    return [*out, *out[:9], (None, 1, "user", "nobody")]


@pytest.mark.parametrize("shard_turns", [1, 9, 60, 100_000])
def test_every_shard_size_gives_the_same_nodes(spark, rows, shard_turns):
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("path", "sizes", "n", "key", "ends", "depth", "family"):
        table = table.withColumn(name, F.lit("x"))
    assert got(prefix_trie.nodes(prefix_trie.rebuilt(table), shard_turns)) == brute(regrown(rows))


def test_conversations_as_they_are(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.nodes(prefix_trie.paths(table), 40)) == brute(ordered(rows))


def test_turnless_conversations_and_empty_table(spark):
    # Conversation 1 has no first of its family to take turns from: zlib.crc32(b"1") % 9 turns go.
    few = [(1, 0, "user", "a"), (2, 0, "user", "b"), (7, None, None, None)]
    table = spark.createDataFrame(few, SCHEMA)
    assert got(prefix_trie.nodes(prefix_trie.rebuilt(table))) == brute(regrown(few))
    assert prefix_trie.nodes(prefix_trie.rebuilt(table.limit(0))).collect() == []


def test_ids_of_one_node_pass_in_several_texts(spark):
    ids = [0, 5, prefix_trie.ID_RANGE - 1, prefix_trie.ID_RANGE, 3 * prefix_trie.ID_RANGE + 7, -4, -prefix_trie.ID_RANGE]
    few = [(c, 0, "user", "a") for c in ids]
    assert got(prefix_trie.nodes(prefix_trie.paths(spark.createDataFrame(few, SCHEMA)))) == brute(ordered(few))


def test_double_array_holds_every_child_and_no_other():
    rng = random.Random(2)
    for turns in (3, 40, 2_000):
        parent, label, level = [0], [0], [0]
        while len(level) and len(parent) < 3_000:
            nxt = []
            for node in level:
                for t in sorted(rng.sample(range(turns), rng.randint(0, min(turns, 9)))):
                    parent.append(node)
                    label.append(t)
                    nxt.append(len(parent) - 1)
            level = nxt or ([0] if len(parent) == 1 else [])
        trie = prefix_trie.DoubleArray(np.array(parent), np.array(label))
        state = np.zeros(len(parent), dtype=np.int64)
        for node in range(1, len(parent)):
            state[node] = trie.step(state[[parent[node]]], np.array([label[node]]))[0]
        assert len(set(state.tolist())) == len(parent) and (state[1:] > 0).all()
        have = collections.defaultdict(set)
        for node in range(1, len(parent)):
            have[parent[node]].add(label[node])
        for node in rng.sample(range(len(parent)), 50):
            found = trie.step(np.full(turns, state[node]), np.arange(turns))
            assert set(np.flatnonzero(found >= 0).tolist()) == have[node]
