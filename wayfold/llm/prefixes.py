"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one per range shard.

Distinct turns (role, text) get dense ids. A conversation is the sequence of its turn ids; sequences
are sorted, equal ones collapsed, and cut into shards of consecutive sequences. Each shard inserts
its sequences into a ternary search tree, medians first, so the trees over the children of a node
are balanced. One iterative traversal, last created node first, sums members, leaves and savings.

Only nodes on the path of a shard's first or last sequence can have members in other shards. Their
partial records are merged afterwards by node key: members add up, and what a merged node adds to
the nodes above it is summed backwards along those paths.

Conversations longer than ``BAND`` turns are cut into bands. A band's sequences hang from the node
where the band before ended, so no value grows with the length of a conversation; all nodes of
such conversations are merged like those at a shard's border."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value
from wayfold.llm.storage import put
from wayfold.operators.ordered import BLOCK, ordinals, running

by_value(__name__)

#: Turns of a conversation in one piece, turns in the tree of one shard.
BAND, SHARD = 1024, 1 << 15

INNER, MERGE, PATH = 0, 1, 2
RECORD = ("kind int, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, depth bigint, turn bigint, bytes bigint, parent_conv_id bigint, "
          "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint")


@dataclass
class Tries:
    """``nodes``: one row per distinct prefix (k1, k2, conv_id, depth, turn, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens); ``ends``: (k1, k2, conv_id), the node each conversation ends
    in; ``turns``: the dictionary (turn, digest, bytes)."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): the turns of each conversation numbered from 1 by ``turn``, null
    first; rows with equal ``turn`` follow the digest of role and text. Null roles and texts are
    empty; rows without a conv_id belong to no conversation and go."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), digest(r, t).alias("digest"),
                                                                   F.octet_length(t).cast("bigint").alias("bytes"))
    bucket = F.when(F.col("turn").isNull(), F.struct(F.lit(0).alias("dated"), F.conv(F.substring("digest", 1, 3), 16, 10).cast("bigint").alias("part"))).otherwise(
        F.struct(F.lit(1).alias("dated"), F.floor(F.col("turn") / BLOCK).alias("part")))
    return ordinals(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], bucket, "pos").select("conv_id", "pos", "digest", "bytes")


def digest(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only; the length keeps ("ab", "c") and ("a", "bc") apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(turns: DataFrame, kept: Column, period: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations whose opening comes from another one: the first ``kept`` (an expression of
    conv_id, at most ``most``) turns of conversation c - c % period, then c's own turns after its
    first ``kept``. Returns the turns and the ids of all conversations, also of those left empty."""
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"), kept.cast("bigint").alias("kept"))
    opening = turns.filter((F.col("conv_id") % period == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    there = opening.groupBy("base").agg(F.count("*").alias("there"))
    known = put(ids.join(there, "base", "left").select("conv_id", "base", "kept", F.least("kept", F.coalesce("there", F.lit(0))).alias("taken")))
    first = known.filter("taken > 0").join(opening, "base").filter("pos <= kept").select("conv_id", "pos", "digest", "bytes")
    own = turns.join(known, "conv_id").filter("pos > kept").select("conv_id", (F.col("pos") - F.col("kept") + F.col("taken")).alias("pos"), "digest", "bytes")
    return first.unionByName(own), known.select("conv_id")


def dictionary(turns: DataFrame) -> DataFrame:
    """(turn, digest, bytes): a dense id from 1 for each distinct turn."""
    kinds = turns.groupBy("digest", "bytes").agg(F.lit(1).alias("_one"))
    return ordinals(kinds, ["_one"], ["digest"], F.conv(F.substring("digest", 1, 3), 16, 10).cast("bigint"), "turn").select("turn", "digest", "bytes")


def mixed(pos: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of a turn at a place; a prefix is known by the exclusive or of its turns'."""
    with np.errstate(over="ignore"):
        z = turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def prefix_keys(flat: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Place of each turn, both keys of the prefix up to it inside its piece, and where pieces start.
    ``base`` is the number of turns before each piece."""
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(flat)) - np.repeat(starts, sizes) + 1 + np.repeat(base, sizes)
    keys = []
    for seed in SEEDS:
        run = np.concatenate(([0], np.bitwise_xor.accumulate(mixed(pos, flat, seed)))) if len(flat) else np.zeros(1, np.int64)
        keys.append(run[1:] ^ np.repeat(run[starts], sizes))
    return pos, keys, starts


def pieces(turns: DataFrame, ids: DataFrame, band: int) -> DataFrame:
    """(conv_id, band, seq, sizes, x1, x2): each conversation's turn ids in order, at most ``band`` to
    a row, as big-endian numbers whose byte order is their order, the bytes of the turns' texts, and
    the keys of the piece. A conversation without turns has one empty piece."""
    marks = ids.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("bytes"))
    placed = turns.select("conv_id", "pos", "turn", "bytes").unionByName(marks).withColumn("band", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / band))
    lists = placed.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "bytes"))).alias("t")).select("conv_id", "band", F.filter("t", lambda x: x["pos"] > 0).alias("t"))
    split = lists.select("conv_id", "band", F.col("t.turn").alias("turn"), F.col("t.bytes").alias("bytes"))

    def run(batches):
        for batch in batches:
            ids, texts, bands = batch.column("turn"), batch.column("bytes"), batch.column("band").to_numpy()
            sizes = np.diff(ids.offsets.to_numpy())
            flat, weight = ids.flatten().to_numpy().astype(np.int64), texts.flatten().to_numpy().astype(np.int64)
            _, keys, starts = prefix_keys(flat, sizes, bands * band)
            ends = starts + sizes
            whole = [[int(k[e - 1]) if s else 0 for e, s in zip(ends, sizes)] for k in keys]
            raw, heavy = flat.astype(">i8").tobytes(), weight.tobytes()
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "band": batch.column("band"), "seq": pa.array([raw[8 * a:8 * b] for a, b in zip(starts, ends)], pa.binary()),
                                              "sizes": pa.array([heavy[8 * a:8 * b] for a, b in zip(starts, ends)], pa.binary()), "x1": pa.array(whole[0], pa.int64()), "x2": pa.array(whole[1], pa.int64())})

    return put(split.mapInArrow(run, "conv_id bigint, band bigint, seq binary, sizes binary, x1 bigint, x2 bigint"))


class Tree:
    """A ternary search tree: ``eq`` leads to the tree over a node's children, ``lo`` and ``hi`` to
    smaller and larger siblings. Node 0 is the root; nodes are numbered as they are created, so
    every node comes after the one it extends."""

    def __init__(self):
        self.key, self.lo, self.eq, self.hi, self.up, self.at = [-1], [-1], [-1], [-1], [-1], [-1]

    def insert(self, seq: list[int], first: int) -> int:
        """The node ``seq`` ends in; ``first`` is where its turns stand in the flat arrays."""
        key, lo, eq, hi, up, at = self.key, self.lo, self.eq, self.hi, self.up, self.at
        node = 0
        for i, turn in enumerate(seq, first):
            now, link, behind = eq[node], eq, node
            while now >= 0 and key[now] != turn:
                link, behind = (lo, now) if turn < key[now] else (hi, now)
                now = link[now]
            if now < 0:
                now = link[behind] = len(key)
                key.append(turn), lo.append(-1), eq.append(-1), hi.append(-1), up.append(node), at.append(i)
            node = now
        return node


def medians(n: int):
    """0..n-1, the middle first, then the middles of both halves and so on."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(lo, mid), (mid + 1, hi)]


def shard_records(rows: list[dict], band: int) -> dict[str, np.ndarray]:
    """Node records of consecutive sequences with one root: inner nodes whole, nodes that may have
    members elsewhere as parts, and the paths of the sequences those lie on."""
    flat = np.frombuffer(b"".join(r["seq"] for r in rows), ">i8").astype(np.int64)
    weight = np.frombuffer(b"".join(r["sizes"] for r in rows), np.int64)
    sizes = np.array([len(r["seq"]) // 8 for r in rows], np.int64)
    level, root = rows[0]["band"], (rows[0]["r1"], rows[0]["r2"])
    pos, keys, starts = prefix_keys(flat, sizes, np.full(len(rows), level * band))
    tree, ids = Tree(), flat.tolist()
    end = [0] * len(rows)
    for i in medians(len(rows)):
        end[i] = tree.insert(ids[starts[i]:starts[i] + sizes[i]], int(starts[i]))
    count, up, eq = len(tree.key), tree.up, tree.eq
    border = [level > 0] * count
    border[0] = True
    carriers = {i for i in range(len(rows)) if i in (0, len(rows) - 1) or sizes[i] == band} if not level else set()
    for i in carriers:
        v = end[i]
        while not border[v]:
            border[v], v = True, up[v]
    n, low, children, leaves, saved = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    for i, r in enumerate(rows):
        n[end[i]] += r["n"]
        low[end[i]] = r["conv_id"]
    heavy = [0] + weight[tree.at[1:]].tolist()
    for v in range(count - 1, 0, -1):
        p = up[v]
        n[p] += n[v]
        if low[p] is None or low[v] < low[p]:
            low[p] = low[v]
        if not border[v]:
            leaves[v] += eq[v] < 0
            saved[v] += (n[v] - 1) * heavy[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    at, above = np.array(tree.at[1:], np.int64), np.array(up[1:], np.int64)
    own = [np.concatenate(([r], k[at] ^ r)) for r, k in zip(root, keys)]
    sides = np.array(border)
    depth = np.concatenate(([level * band], pos[at]))
    low = np.array(low, np.int64)
    # A piece's root is told in full by the band above; here it only gathers what hangs from it.
    parts = {"kind": np.where(sides, MERGE, INNER), "k1": own[0], "k2": own[1], "p1": np.concatenate(([0], own[0][above])), "p2": np.concatenate(([0], own[1][above])), "conv_id": low, "depth": depth,
             "turn": np.array([0] + tree.key[1:]), "bytes": np.array(heavy), "parent_conv_id": np.concatenate(([0], low[above])), "n_convs": np.array(n), "n_children": np.array(children), "n_leaves": np.array(leaves), "saved": np.array(saved)}
    if level:
        parts["n_convs"][0] = 0
        parts["turn"][0] = -1
    walks = [np.arange(starts[i], starts[i] + sizes[i]) for i in sorted(carriers)]
    at = np.concatenate(walks) if walks else np.empty(0, np.int64)
    who = np.repeat([rows[i]["conv_id"] for i in sorted(carriers)], [len(w) for w in walks]).astype(np.int64)
    tops = np.array([rows[i]["conv_id"] for i in sorted(carriers)], np.int64)
    paths = {"kind": np.full(len(at) + len(tops), PATH), "k1": np.concatenate((keys[0][at] ^ root[0], np.full(len(tops), root[0]))), "k2": np.concatenate((keys[1][at] ^ root[1], np.full(len(tops), root[1]))),
             "conv_id": np.concatenate((who, tops)), "depth": np.concatenate((pos[at], np.full(len(tops), level * band)))}
    none = np.zeros(len(paths["kind"]), np.int64)
    return {c: np.concatenate((parts[c], paths.get(c, none))).astype(np.int32 if c == "kind" else np.int64) for c in parts}


def records(kinds: DataFrame, shards: int, band: int, shard: int) -> DataFrame:
    """Node records of all sequences. Rows arrive sorted; a tree ends after ``shard`` turns or where the root changes."""
    order = ["band", "r1", "r2", "seq"]

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (turns >= shard or any(row[c] != held[0][c] for c in order[:3])):
                    yield pa.RecordBatch.from_pydict(shard_records(held, band))
                    held, turns = [], 0
                held.append(row)
                turns += len(row["seq"]) // 8 + 1
        if held:
            yield pa.RecordBatch.from_pydict(shard_records(held, band))

    return put(kinds.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, RECORD))


def paths_of(long: DataFrame, band: int) -> DataFrame:
    """(conv_id, depth, k1, k2) of every node on the way of the given pieces; a piece's root is the
    end of the piece before, or the trie's root."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                flat = np.frombuffer(r["seq"], ">i8").astype(np.int64)
                pos, keys, _ = prefix_keys(flat, np.array([len(flat)]), np.array([r["band"] * band]))
                pos, keys = (pos, keys) if r["band"] else (np.append(pos, 0), [np.append(k, 0) for k in keys])
                yield pa.RecordBatch.from_pydict({"conv_id": np.full(len(pos), r["conv_id"]), "depth": pos, "k1": keys[0] ^ r["r1"], "k2": keys[1] ^ r["r2"]})

    return long.select("conv_id", "band", "seq", "r1", "r2").mapInArrow(run, "conv_id bigint, depth bigint, k1 bigint, k2 bigint")


def tries(turns: DataFrame, ids: DataFrame, band: int = BAND, shard: int = SHARD) -> Tries:
    """The prefix trie of conversations given as turns (conv_id, pos from 1, digest, bytes) and the ids
    of all conversations, which may have no turns.

    A node is a distinct beginning of conversations, from the empty one (depth 0); its members are
    the conversations that begin so. conv_id is the smallest of them. n_leaves and saved_tokens
    cover the node's subtree with itself; a node saves its text's bytes for every member but one.
    Repeated turns of a conversation are turns of their own. No conversations give no nodes."""
    codes = put(dictionary(turns))
    seqs = pieces(turns.join(codes, ["digest", "bytes"]), ids, band)
    # Where a long conversation's bands hang from: keys of all turns before. One row per band.
    longs = seqs.filter("band > 0").select("conv_id").distinct()
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("band").over(Window.partitionBy("conv_id")) == F.col("band")
    roots = put(seqs.select("conv_id", "band", "x1", "x2").join(longs, "conv_id", "left_semi")
                .select("conv_id", "band", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"r{i}") for i in (1, 2)], last.alias("last")))
    known = seqs.join(roots, ["conv_id", "band"], "left").select("conv_id", "band", "seq", "sizes", "x1", "x2", *[F.coalesce(f"r{i}", F.lit(0).cast("bigint")).alias(f"r{i}") for i in (1, 2)],
                                                                 F.col("r1").isNotNull().alias("long"), F.coalesce("last", F.lit(True)).alias("last"))
    ends = known.filter("last").select((F.col("x1").bitwiseXOR(F.col("r1"))).alias("k1"), F.col("x2").bitwiseXOR(F.col("r2")).alias("k2"), "conv_id")
    total = seqs.agg(F.sum(F.octet_length("seq") / 8 + 1)).head()[0] or 0
    kinds = known.groupBy("band", "r1", "r2", "seq", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    table = records(kinds, int(total // shard) + 1, band, shard)
    key, of = ["k1", "k2"], lambda kind: table.filter(F.col("kind") == kind)
    # Merge the parts of border nodes. A band's root has its own facts from the band above (turn >= 0).
    own = F.col("turn") >= 0
    parts = of(MERGE).groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max(F.when(own, F.col("turn"))).alias("turn"), F.max("bytes").alias("bytes"), F.max(F.when(own, F.col("p1"))).alias("p1"),
                                        F.max(F.when(own, F.col("p2"))).alias("p2"), F.sum("n_convs").alias("n_convs"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
    merged = put(parts)
    below = merged.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    merged = put(merged.join(below, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
                 .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")))
    # What a merged node adds to those above it, summed backwards along one of the paths through it.
    way = put(of(PATH).select("conv_id", "depth", *key).unionByName(paths_of(known.filter("long"), band)).distinct())
    owner = way.groupBy(*key).agg(F.min("conv_id").alias("owner"))
    mine = way.join(merged.join(owner, key).select(*key, "owner", "n_leaves", "saved"), key)
    add = {f"s_{c}": (F.when(F.col("conv_id") == F.col("owner"), F.col(c)).otherwise(F.lit(0).cast("bigint")), "sum") for c in ("n_leaves", "saved")}
    summed = running(mine, ["conv_id"], [F.col("depth").desc()], add, F.floor(F.col("depth") / BLOCK), backward=True).groupBy(*key).agg(F.sum("s_n_leaves").alias("n_leaves"), F.sum("s_saved").alias("saved"))
    above = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_low"), (F.col("depth") + 1).alias("depth"))
    facts = [*key, "p1", "p2", "conv_id", "depth", "turn", "n_convs", "n_children"]
    whole = (of(INNER).select(*facts, "n_leaves", "saved", "parent_conv_id")
             .unionByName(merged.select(*facts).join(summed, key).withColumn("parent_conv_id", F.lit(None).cast("bigint"))))
    nodes = (whole.join(above, ["p1", "p2", "depth"], "left")
             .select(*key, "conv_id", "depth", "turn", F.when(F.col("depth") > 0, F.coalesce("parent_low", "parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")))
    return Tries(nodes, ends, codes)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ids that end in a node, ascending and comma-joined.

    A digest takes its input in order, so a node's sorted ids stream through one task, batch after
    batch, and are never gathered."""
    def run(batches):
        node, state = None, None
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1).tolist(), len(ids)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now, piece = (int(k1[a]), int(k2[a])), ",".join(map(str, ids[a:b])).encode()
                if now == node:
                    state.update(b"," + piece)
                else:
                    if state:
                        done.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(piece)
            yield table(done)
        if state:
            yield table([(*node, state.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_pydict({"k1": pa.array([r[0] for r in rows], pa.int64()), "k2": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")
