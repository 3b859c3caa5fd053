"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``room`` tokens. Pieces are dealt in order of length, one to each
partition in turn, so partitions of bounded size hold the same mixture of lengths. Each is packed
best-fit decreasing: longest first, into the fullest sequence that still has room. Dual feasible
functions of the lengths bound from below how few sequences a partition can have; one that meets its
bound is certified. Partitions with a gap give up the documents of all sequences that are not full,
certified ones those of sequences a quarter empty; these are exchanged, dealt anew and packed again,
until the bound of what was given up shows that nothing can be gained or a round gains nothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value, slices
from wayfold.llm.bytepairs import encoder
from wayfold.llm.storage import put
from wayfold.operators.ordered import ordinals

by_value(__name__)

#: Pieces packed in one partition, rounds of exchange at most, steepest step functions tried, bytes
#: of text tokenised at a time, and the sequences that leave a partition.
PART, ROUNDS, STEEP, SLICE = 1 << 16, 6, 64, 4 << 20
LOOSE = "(bins > bound and free > 0) or 4 * free >= {room}"


def pieces(docs: DataFrame, tokenizer: str, room: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, piece, start, length, ids): the tokens of every whole text and an ``end``, in pieces of
    at most ``room``; ids are little-endian 32-bit numbers.

    Only documents longer than ``room`` are cut, the first piece being the shorter one. A null text is
    empty and has the end alone. ``row`` tells documents apart that repeat an id."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict((f.name, f.dataType.simpleString()) for f in source.schema)["doc_id"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, sizes = encoder(tokenizer).encode(part.column("text").to_pylist())
                out = np.empty(len(ids) + len(sizes), "<u4")
                ends = np.cumsum(sizes + 1)
                hole = np.zeros(len(out), bool)
                hole[ends - 1] = True
                out[hole], out[~hole] = end, ids
                sizes = sizes + 1
                count = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                short = (sizes - (count - 1) * room)[doc]
                start = np.where(piece > 0, short + (piece - 1) * room, 0)
                length = np.where(piece > 0, room, short)
                at = (ends - sizes)[doc] + start
                raw = out.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(doc)), part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array([raw[4 * a:4 * b] for a, b in zip(at, at + length)], pa.binary())],
                                                 names=["row", "doc_id", "piece", "start", "length", "ids"])

    return put(source.mapInArrow(run, f"row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids binary"))


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: sequence and place of every piece, and what is left free in each sequence.

    Pieces of one length go together: the fullest sequences that can take one are found by their
    free room, and each takes as many as fit, as it stays the fullest."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    by_free: list[list[np.ndarray]] = [[] for _ in range(room + 1)]
    there, used = np.zeros(room + 1, bool), 0

    def lay(free, which):
        if len(which):
            by_free[free].append(which)
            there[free] = True

    for group in np.split(order, cuts) if len(order) else []:
        size = int(lengths[group[0]])
        while len(group):
            free = size + int(there[size:].argmax())
            if there[free]:
                open_ = by_free[free].pop()
                there[free] = bool(by_free[free])
            else:
                free, open_ = room, None
            fit = free // size
            need = -(-len(group) // fit)
            if open_ is None:
                open_ = np.arange(used, used + need)
                used += need
            taken, rest = open_[:need], open_[need:]
            lay(free, rest)
            now = min(len(group), fit * len(taken))
            bins[group[:now]] = np.repeat(taken, fit)[:now]
            places[group[:now]] = room - free + size * (np.arange(now) % fit)
            full, over = divmod(now, fit)
            lay(free - fit * size, taken[:full])
            if over:
                lay(free - over * size, taken[full:])
            group = group[now:]
    left = np.zeros(used, np.int64)
    for free in np.flatnonzero(there):
        for which in by_free[free]:
            left[which] = free
    return bins, places, left


def least(counts: np.ndarray, room: int) -> int:
    """A lower bound of the sequences that ``counts[l]`` pieces of each length l need.

    The largest over dual feasible functions f (values of any pieces that fit together sum to at most
    1): the plain share l / room; step functions; both with pieces above room - e raised to 1 and
    those below e dropped; and the functions that count pieces by multiples of e. All in whole
    numbers, as numerators over a common denominator."""
    if not counts.any():
        return 0
    counts = counts.astype(np.int64)
    length = np.arange(room + 1)
    below = np.concatenate(([0], np.cumsum(counts)))
    e = np.arange(room // 2 + 1)
    best = 0
    for k in range(STEEP + 1):
        if k:
            value, whole = np.where((k + 1) * length % room == 0, length * k, (k + 1) * length // room * room), k * room
        else:
            value, whole = length, room
        sums = np.concatenate(([0], np.cumsum(counts * value)))
        total = whole * (below[-1] - below[room - e + 1]) + sums[room - e + 1] - sums[e]
        best = max(best, int(-(-total.max() // whole)))
    for step in range(1, room // 2 + 1):
        whole = room // step
        value = np.where(2 * length > room, whole - (room - length) // step, np.where(length >= step, 1, 0))
        best = max(best, int(-(-int((counts * value).sum()) // whole)))
    return best


def dealt(items: DataFrame, counts: np.ndarray, room: int, seed: int, part: int) -> DataFrame:
    """Packs ``items`` (row, piece, length), of which there are ``counts`` of each length, partition by
    partition."""
    groups = max(1, -(-int(counts.sum()) // part))

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        # The order of rows that a shuffle leaves open must not decide anything.
        by = np.lexsort((group.column("piece").to_numpy(), group.column("row").to_numpy()))
        group, lengths = group.take(pa.array(by)), lengths[by]
        bins, places, free = best_fit(lengths, room)
        bound = least(np.bincount(lengths, minlength=room + 1), room)
        n = len(lengths)
        return pa.table({"row": group.column("row"), "piece": group.column("piece"), "length": group.column("length"), "part": group.column("part"), "bin": bins, "offset": places,
                         "free": free[bins], "bins": np.full(n, len(free)), "bound": np.full(n, bound)})

    # Numbered by length; equal lengths in the order of a hash, whose range is split where they are many.
    splits = F.element_at(F.array(*[F.lit(int(-(-n // PART) or 1)) for n in counts]), F.col("length").cast("int") + 1)
    hashed = items.select("row", "piece", "length", F.xxhash64("row", "piece", F.lit(seed)).alias("_h"), F.lit(1).alias("_one"))
    bucket = F.struct("length", F.floor((F.col("_h").cast("double") / 2.0 ** 64 + 0.5) * splits).alias("split"))
    ranked = ordinals(hashed, ["_one"], ["length", "_h"], bucket, "rank") if groups > 1 else hashed.withColumn("rank", F.lit(0).cast("bigint"))
    keyed = ranked.select("row", "piece", "length", F.pmod("rank", F.lit(groups)).alias("part"))
    return put(keyed.groupBy("part").applyInArrow(run, "row bigint, piece int, length bigint, part bigint, bin bigint, offset bigint, free bigint, bins bigint, bound bigint"))


def lengths_of(items: DataFrame, room: int) -> np.ndarray:
    """How many pieces there are of each length; at most ``room`` rows reach the driver."""
    counts = np.zeros(room + 1, np.int64)
    for r in items.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    return counts


def place(items: DataFrame, room: int = 2048, part: int = PART, report: list | None = None) -> DataFrame:
    """(row, piece, sequence_id, offset) of every item (row, piece, length up to ``room``): sequences of at
    most ``room`` tokens, filled without gaps from 0.

    ``report`` takes one (round, pieces, sequences, lower bound) per round. Items must differ in (row,
    piece). No items give no rows."""
    counts = lengths_of(items, room)
    done, now, leaves = [], dealt(items, counts, room, 0, part), LOOSE.format(room=room)
    for turn in range(ROUNDS + 1):
        loose = now.filter(leaves)
        held = lengths_of(loose, room)
        open_ = loose.select("part", "bin").distinct().count()
        if report is not None:
            report.append((turn, int(counts.sum()), now.select("part", "bin").distinct().count(), least(counts, room)))
        number = (F.lit(turn).cast("bigint") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 28) + F.col("bin")).alias("sequence_id")
        more = None
        if turn < ROUNDS and least(held, room) < open_:  # else no packing of them has fewer
            more = dealt(loose.select("row", "piece", "length"), held, room, turn + 1, part)
            if more.select("part", "bin").distinct().count() >= open_:
                more = None
        if more is None:
            done.append(now.select("row", "piece", number, "offset"))
            break
        done.append(now.filter(f"not ({leaves})").select("row", "piece", number, "offset"))
        counts, now = held, more
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves, from ``pieces`` and ``place``."""
    whole = cut.select("row", "piece", "ids").join(placed, ["row", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset. The ids stay
    where ``pieces`` wrote them; only their checksums meet the places. See ``pieces`` and ``place``."""
    cut = pieces(docs, tokenizer, room, end, doc_id, text)
    return cut.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).join(place(cut.select("row", "piece", "length"), room), ["row", "piece"]).drop("row")
