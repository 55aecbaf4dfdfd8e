"""Conversation prefix trie: double-array tries per prefix shard.

Every distinct sequence of first turns is a node.  The way there:

1. A turn becomes a digest of role and text and the size of its text; texts
   are not moved after that.  A conversation is the string of its digests, its
   path.  Conversations with one path are counted together, whole, so however
   many share it, it is one row.
2. Paths are dealt out by ranges in byte order.  A task takes its range in
   runs of about ``SHARD_TURNS`` turns: each run is a prefix shard, bounded
   whatever the task holds, and every prefix of it stands side by side.
3. A shard numbers its turns densely, packs its nodes into BASE and CHECK
   arrays - the child of state s by turn t is state BASE[s] + t, if CHECK there
   says s - and walks all its paths through them, level by level; what arrives
   in a state is that node's aggregate.
4. A node's paths lie in one run of the byte order, so only nodes on the first
   and the last path of a shard can be in another shard as well.  These upper
   nodes are merged globally by a digest of their prefix.  Everything else is
   final in its shard, up to the id of a shared parent.

Subtree sums of shared nodes: a shard adds up what lies below them in nodes of
its own.  Shared nodes themselves are only known after the merge; each is then
owned by one boundary path, which holds all its ancestors too, and a running
sum up each path gives every ancestor its share once.

``ends_sha256`` is a digest over a list of ids in order, so the ids of one node
have to pass one task, as SHA-256 is defined; they get there in texts of up to
``ID_RANGE`` ids each and are hashed as they pass, never held together.

Defined cases: rows with a NULL conv_id belong to no conversation and are left
out; NULL turns come first; equal turns of a conversation are ordered by role,
then by digest; NULL role or text is empty; repeated rows are turns of their
own; an empty table has no nodes; other columns are ignored, whatever their
names.  The digests of one conversation (20 bytes a turn and its size) must fit
a task's memory; its texts need not.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.text import bounded_batches
from voltrail.session import checkpointed, scratch

SHARD_TURNS = 100_000
ID_RANGE = 1 << 16
DIGEST = 16

# Which conversations lend their first turns to which.
FAMILY = 5
MOST_SHARED = 9

NO_IDS = hashlib.sha256(b"").hexdigest()


# --- conversations as paths ------------------------------------------------


def _turns(conversations: DataFrame, *more: Column) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *more,
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), F.md5(named).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("_turn"),
    )


def _in_order() -> Column:
    found = F.sort_array(F.collect_list("_turn"))
    return F.transform(found, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))


def _as_path(turns: Column) -> list[Column]:
    joined = F.array_join(F.transform(turns, lambda t: t["digest"]), "")
    return [F.unhex(joined).alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of every conversation as it is."""
    own = _turns(conversations).groupBy("conv_id").agg(_in_order().alias("_own"))
    return own.select("conv_id", *_as_path(F.col("_own")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` where a conversation's first turns are those of
    the first of its family: as many as its id's CRC says, as far as there are
    any.  All of a family is in one place, so turns are shuffled once."""
    conv = F.col("conv_id").cast("long")
    family = (conv - conv % FAMILY).alias("family")
    own = (
        _turns(conversations, family)
        .repartition("family")
        .groupBy("family", "conv_id")
        .agg(_in_order().alias("_own"))
    )
    heads = own.filter("conv_id = family").select("family", F.slice("_own", 1, MOST_SHARED - 1).alias("_head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), shared), F.slice("_own", 1, 0))
    turns = F.concat(head, F.slice("_own", shared + 1, F.size("_own")))
    return own.join(heads, "family", "left").select("conv_id", *_as_path(turns))


# --- paths as distinct sequences -------------------------------------------


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of ids, by key and in order, to one digest per key."""
    key, state = None, hashlib.sha256()
    for b in batches:
        out = []
        for k, ids in zip(map(bytes, b["key"]), b["ids"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])


def _sequences(found: DataFrame) -> DataFrame:
    """One row per distinct path: its conversations, counted and hashed."""
    spark, folder = found.sparkSession, scratch(found.sparkSession, "prefix-trie")
    found.withColumn("key", F.unhex(F.md5("path"))).write.parquet(f"{folder}/paths")
    stored = spark.read.parquet(f"{folder}/paths")
    counted = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    texts = (
        stored.groupBy("key", F.floor(F.col("conv_id") / ID_RANGE).alias("range"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
        .repartition("key")
        .sortWithinPartitions("key", "range")
    )
    bounded_batches(stored)
    ends = texts.select("key", "ids").mapInPandas(_hashed, "key binary, ends string")
    first = stored.select("conv_id", "path", "sizes").join(counted, "conv_id")
    first.join(ends, "key").select("path", "sizes", "n", "conv_id", "ends").write.parquet(f"{folder}/sequences")
    return spark.read.parquet(f"{folder}/sequences")


# --- one shard -------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK of a trie whose nodes are numbered level by level, the
    children of a node side by side; node 0 is the root, state 0."""

    #: Free places tried for the children of a node before the arrays grow.
    TRIES = 32

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        n, turns = len(parent), int(label.max(initial=0)) + 1
        count = np.bincount(parent[1:], minlength=n)
        first = np.r_[1, np.cumsum(count)[:-1] + 1]
        used = np.zeros(n + turns + 1, dtype=bool)
        used[0] = True
        state, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        top = low = 1
        several = np.flatnonzero(count > 1)
        for node in several[np.argsort(-count[several], kind="stable")].tolist():
            own = label[first[node] : first[node] + count[node]]
            shape = own - own.min()
            while low < top and used[low]:
                low += 1
            free = low + np.flatnonzero(~used[low : min(top, low + 4 * self.TRIES)])[: self.TRIES]
            place = next((p for p in free.tolist() if p + shape.max() < len(used) and not used[p + shape].any()), top)
            if place + shape.max() >= len(used):
                used = np.r_[used, np.zeros(len(used) + int(shape.max()), dtype=bool)]
            used[place + shape] = True
            base[node] = place - own.min()
            state[first[node] : first[node] + count[node]] = place + shape
            top = max(top, place + int(shape.max()) + 1)
        # A single child fits anywhere: the gaps are filled in order.
        single = np.flatnonzero(count == 1)
        gaps = np.flatnonzero(~used)
        if len(gaps) < len(single):
            gaps = np.r_[gaps, len(used) + np.arange(len(single) - len(gaps))]
        state[first[single]] = gaps[: len(single)]
        base[single] = gaps[: len(single)] - label[first[single]]
        size = int(state.max()) + 1
        self.base, self.check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.base[state] = base
        self.check[state[1:]] = state[parent[1:]]

    def step(self, state: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The state after a turn; -1 where the trie has none."""
        to = self.base[state] + turn
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == state), to, -1)


def _dense(digests: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the distinct turns, by first place in ``order``: the children
    of a node then mostly have numbers side by side."""
    ranked = np.lexsort((digests[:, 1], digests[:, 0]))
    d = digests[ranked]
    value = np.zeros(len(d), dtype=np.int64)
    value[ranked] = np.cumsum(np.r_[0, (d[1:] != d[:-1]).any(axis=1)])
    _, at = np.unique(value[order], return_index=True)
    number = np.empty(len(at), dtype=np.int64)
    number[np.argsort(at, kind="stable")] = np.arange(len(at))
    return number[value]


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digest of every prefix of a path, the empty one first."""
    state, out = hashlib.md5(usedforsecurity=False), []
    out.append(state.digest())
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        out.append(state.digest())
    return out


FIELDS = (
    ("shard", pa.binary()), ("side", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()),
    ("ends", pa.string()),
)
SCHEMA = pa.schema([pa.field(n, t) for n, t in FIELDS])
SPARK_SCHEMA = (
    "shard binary, side int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string"
)


def shard_nodes(
    run: list[bytes], sizes: np.ndarray, n: np.ndarray, conv: np.ndarray, ends: list[str]
) -> pa.RecordBatch:
    """The nodes of a run of distinct paths in byte order.

    ``side`` is NULL for a node of this shard alone.  A shared node has a row
    for each boundary path it is on, side 0 the first, side 1 the last; what
    the shard knows of it stands in the first of these rows only.
    """
    lens = np.array([len(p) // DIGEST for p in run], dtype=np.int64)
    total, starts = int(lens.sum()), np.r_[0, np.cumsum(lens)[:-1]]
    digests = np.frombuffer(b"".join(run), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(run)), lens)
    depth = np.arange(total) - np.repeat(starts, lens)
    order = np.lexsort((row, depth))
    turn = _dense(digests, order)
    # A turn opens a node unless the path before has the same turns up to it.
    before = np.where(row > 0, starts[row - 1] + depth, 0)
    same = (row > 0) & (depth < lens[row - 1])
    same &= turn[np.where(same, before, 0)] == turn
    missed = np.cumsum(~same)
    opens = missed > np.r_[0, missed][starts[row]]
    node = np.zeros(total, dtype=np.int64)
    node[order] = np.cumsum(opens[order])
    at = order[opens[order]]
    above = np.where(depth[at] > 0, node[at - 1], 0)
    trie = DoubleArray(np.r_[0, above], np.r_[0, turn[at]])

    # Walk all paths; what arrives in a state is its node's.
    states = len(trie.check)
    state, reached = np.zeros(len(run), dtype=np.int64), np.zeros(total, dtype=np.int64)
    level, size = np.zeros(states, dtype=np.int64), np.zeros(states, dtype=np.int64)
    longest_first = np.argsort(-lens, kind="stable")
    longer = np.searchsorted(-lens[longest_first], -np.arange(int(lens.max(initial=0))))
    for d, k in enumerate(longer.tolist()):
        live = longest_first[:k]
        place = starts[live] + d
        state[live] = trie.step(state[live], turn[place])
        reached[place] = state[live]
    level[reached], size[reached] = depth + 1, sizes
    members, least = np.zeros(states, dtype=np.int64), np.full(states, np.iinfo(np.int64).max)
    np.add.at(members, reached, n[row])
    np.minimum.at(least, reached, conv[row])
    members[0], least[0] = n.sum(), conv.min()
    nodes = np.r_[0, np.flatnonzero(trie.check >= 0)]
    up = trie.check

    edge = [np.r_[0, reached[starts[i] : starts[i] + lens[i]]] for i in (0, len(run) - 1)]
    shared = np.zeros(states, dtype=bool)
    shared[edge[0]] = shared[edge[1]] = True
    own = nodes[~shared[nodes]]
    children = np.zeros(states, dtype=np.int64)
    np.add.at(children, up[own], 1)
    leaves, saved = np.zeros(states, dtype=np.int64), np.zeros(states, dtype=np.int64)
    leaves[own] = children[own] == 0
    saved[own] = (members[own] - 1) * size[own]
    by_level = nodes[np.argsort(level[nodes], kind="stable")]
    cuts = np.searchsorted(level[by_level], np.arange(1, int(level.max(initial=0)) + 2))
    for d in range(len(cuts) - 2, -1, -1):
        low = by_level[cuts[d] : cuts[d + 1]]
        np.add.at(leaves, up[low], leaves[low])
        np.add.at(saved, up[low], saved[low])

    ended = {int(s): e for s, e in zip(state.tolist(), ends, strict=True)}
    keys: dict[int, bytes] = {}
    for i, states_of in zip((0, len(run) - 1), edge, strict=True):
        keys.update(zip(states_of.tolist(), _prefix_keys(run[i]), strict=True))
    shard = hashlib.md5(run[0], usedforsecurity=False).digest()
    rows = [(None, s) for s in own.tolist()]
    told: set[int] = set()
    for side, states_of in enumerate(edge):
        rows += [(side, s) for s in states_of.tolist()]
    columns: dict[str, list] = {name: [] for name, _ in FIELDS}
    put = [columns[name].append for name, _ in FIELDS]
    for side, s in rows:
        parent = int(up[s])
        knows = side is None or s not in told
        if side is not None:
            told.add(s)
        lone_parent = parent >= 0 and not shared[parent]
        values = (
            shard, side, keys.get(s), None if lone_parent else keys.get(parent),
            int(least[s]) if knows else None, int(level[s]), int(least[parent]) if lone_parent else None,
            int(members[s]) if knows else 0, int(children[s]) if knows else 0, int(leaves[s]) if knows else 0,
            int(saved[s]) if knows else 0, int(size[s]), ended.get(s) if knows else None,
        )
        for add, value in zip(put, values, strict=True):
            add(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in FIELDS], schema=SCHEMA)


def _shards(shard_turns: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                turns += len(r["sizes"]) + 1
                if turns >= shard_turns:
                    yield _one(held)
                    held, turns = [], 0
        if held:
            yield _one(held)

    return work


def _one(held: list[dict]) -> pa.RecordBatch:
    return shard_nodes(
        [r["path"] for r in held],
        np.array([s for r in held for s in r["sizes"]], dtype=np.int64),
        np.array([r["n"] for r in held], dtype=np.int64),
        np.array([r["conv_id"] for r in held], dtype=np.int64),
        [r["ends"] for r in held],
    )


# --- all shards ------------------------------------------------------------

COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
RESULT = ("conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")


def _merged(boundary: DataFrame) -> DataFrame:
    """Shared nodes over all shards, but for what shared nodes add to subtrees."""
    summed = boundary.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"),
        F.max("size").alias("size"),
        F.max("ends").alias("ends"),
        F.min(F.struct("shard", "side")).alias("owner"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    below = summed.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("_below")
    )
    children = F.col("n_children") + F.coalesce("_below", F.lit(0))
    return checkpointed(summed.join(below, "key", "left").withColumn("n_children", children).drop("_below"))


def nodes(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie over ``conv_id, path, sizes``; see the module's text."""
    spark, folder = found.sparkSession, scratch(found.sparkSession, "prefix-trie-nodes")
    ranged = _sequences(found).repartitionByRange("path").sortWithinPartitions("path")
    bounded_batches(found)
    ranged.mapInArrow(_shards(shard_turns), SPARK_SCHEMA).write.parquet(folder)
    packed = spark.read.schema(SPARK_SCHEMA).parquet(folder)
    boundary = packed.filter("side IS NOT NULL")
    merged = _merged(boundary)

    # What a shared node adds itself, once, to every node above it.
    adds = merged.select(
        "key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saves"),
    )
    upward = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owns = F.col("owner") == F.struct("shard", "side")
    along = boundary.select("shard", "side", "key", "depth").join(adds, "key")
    sums = [F.sum(F.when(owns, F.col(c)).otherwise(0)).over(upward).alias(c) for c in ("leaf", "saves")]
    added = along.select("key", *sums).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = (
        merged.join(added, "key")
        .join(parents, "parent_key", "left")
        .withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saves")})
    )

    # A node below a shared one takes its parent's id from the shard's own few.
    known = boundary.select("shard", F.col("key").alias("parent_key")).distinct().join(parents, "parent_key")
    lower = packed.filter("side IS NULL")
    open_ends = lower.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(known, ["shard", "parent_key"])
    digest = F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")
    parts = [p.select(*RESULT[:-1], digest) for p in (lower.filter("parent_key IS NULL"), open_ends, upper)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
