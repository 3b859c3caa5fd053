"""Language-model scoring with an Elias-Fano n-gram trie spread over shards.

Texts become slices of documents, in which every distinct n-gram is asked about once. Level by
level, the slices send their distinct n-grams with their counts in training texts to shards; a shard
merges them, builds its part of the trie with smoothed, quantised probabilities, answers every
slice, and the slices prepare the next level. Only distinct n-grams move, so frequent words and
contexts cost one entry per slice; contexts with many counts are split over shards by next word.

p(w) = (c(w) + 1) / (N + V + 1);  p(w | h) = L c(h w) / c(h) + (1 - L) p(w | shorter h), where
unseen contexts h pass on p(w | shorter h) unchanged. For every context the probabilities of the
known words and one unknown word sum to 1.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value, pack, release, slices, split_words, unpack
from wayfold.llm.storage import drop, put
from wayfold.llm.trie import GRID, Trie, quantise, restore

by_value(__name__)

#: Ids below the words' own: text start, text end; -1 marks a word that no training text has.
START, END, FIRST = 0, 1, 2
#: Weight of the longer context, bytes of text in a slice, text bytes per shard, and the count
#: above which a context is split.
WEIGHT, SLICE, SHARD, HOT = 0.15, 6 << 20, 7 << 20, 2_000_000
MODEL = -1
SCHEMA = "kind string, block bigint, shard int, body array<binary>"
ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("body", pa.list_(pa.binary()))])


def _rows(rows):
    kinds, blocks, shards, bodies = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "block": pa.array(blocks, pa.int64()), "shard": pa.array(shards, pa.int32()), "body": pa.array(bodies, pa.list_(pa.binary()))}, schema=ARROW)


def _by_shard(shard: np.ndarray):
    """(shard, positions) for each shard that occurs; positions ascend."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(shard[part[0]]), part


def _spread(rows: np.ndarray, counts: np.ndarray, shards: int, hot: int) -> np.ndarray:
    """Shard of each n-gram: by its context, and by its last word too where the context is hot."""
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1] - 1):
        h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    parts = (1 + counts // hot).astype(np.uint64)
    mixed = rows[:, -1].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    h = (h + mixed % parts) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _tokenised(docs: DataFrame, shards: int) -> DataFrame:
    """Slices with their words, and the words each asks about."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, at, words = split_words(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(at[np.repeat(train, sizes)], minlength=len(words))
                hashed = pd.util.hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64)
                shard = (hashed % np.uint64(shards)).astype(np.int64)
                block, out = (task << 32) | number, []
                number += 1
                order = pc.sort_indices(pa.table({"shard": shard, "word": pa.array(words, pa.large_string())}), sort_keys=[("shard", "ascending"), ("word", "ascending")]).to_numpy()
                place = np.empty(len(words), np.int32)
                place[order] = np.arange(len(words))
                edges = np.flatnonzero(np.diff(shard[order])) + 1
                for own in np.split(order, edges) if len(words) else []:
                    out.append(("ask", block, int(shard[own[0]]), [zstandard.compress("\n".join([words[i] for i in own.tolist()]).encode("utf-8", "surrogatepass"), 1), pack(counts[own].astype(np.int64))]))
                ids = part.column("doc_id").to_pylist()
                held = np.array([d is None for d in ids])
                out.append(("state", block, None, [pack(v) for v in (np.array([d or 0 for d in ids], np.int64), held.astype(np.uint8), train.astype(np.uint8), sizes.astype(np.int32), place[at])]))
                yield _rows(out)
                del out, words, at, hashed, shard, order, place
                release()

    return docs.mapInArrow(run, SCHEMA)


def _serve_words(shards: int):
    """Answers of one shard of the vocabulary: id and training count of every word asked about."""
    def run(group: pa.Table) -> pa.Table:
        asked, bodies = group.column("block").to_pylist(), group.column("body").to_pylist()
        s = group.column("shard")[0].as_py()
        lists, sums, known = [], {}, None
        for block, body in zip(asked, bodies):
            words = zstandard.decompress(body[0]).split(b"\n")
            counts = unpack(body[1], np.int64)
            if block == MODEL:
                known = dict(zip(words, counts.tolist())) if len(counts) else {}
            lists.append((block, words))
            if known is None:
                for w, c in zip(words, counts.tolist()):
                    if c:
                        sums[w] = sums.get(w, 0) + c
        table = sums if known is None else known
        # Frequent words get small ids, which pack best.
        order = sorted(table, key=lambda w: (-table[w], w))
        ids = {w: FIRST + i * shards + s for i, w in enumerate(order)}
        out = []
        for block, words in lists:
            if block != MODEL:
                out.append(("answer1", block, s, [pack(np.array([ids.get(w, -1) for w in words], np.int64)), pack(np.array([table.get(w, 0) for w in words], np.int64))]))
        counts = np.array([table[w] for w in order], np.int64)
        out.append(("model", MODEL, s, [zstandard.compress(b"\n".join(order), 1), pack(counts), np.array([len(order), counts.sum()], np.int64).tobytes()]))
        return pa.Table.from_batches([_rows(out)])

    return run


def _summed(batches):
    """Distinct words and words in all of the vocabulary's shards."""
    for batch in batches:
        sums = np.array([np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()]).reshape(-1, 2).sum(0)
        yield pa.RecordBatch.from_pydict({"kinds": sums[:1], "total": sums[1:]})


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of the columns: position of one of each, and the row of each entry."""
    key = columns[0]
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _serve(order: int, weight: float):
    """Answers of one shard of level ``order``: code of the smoothed probability and training count
    of every n-gram asked about; the shard's trie and counts go along as a model row."""
    def run(group: pa.Table) -> pa.Table:
        blocks, bodies = group.column("block").to_pylist(), group.column("body").to_pylist()
        s = group.column("shard")[0].as_py()
        given = next((b for k, b in zip(blocks, bodies) if k == MODEL), None)
        asks = [(k, b) for k, b in zip(blocks, bodies) if k != MODEL]
        sizes, columns = [], [[] for _ in range(order + 3)]
        for _, b in asks:
            for j in range(order):
                columns[j].append(np.cumsum(unpack(b[j], np.int64)))
            for j, kind in enumerate((np.int64, np.int32, np.uint16)):
                columns[order + j].append(unpack(b[order + j], kind))
            sizes.append(len(columns[0][-1]))
        asks = [k for k, _ in asks]
        del bodies
        for j, parts in enumerate(columns):
            columns[j] = np.concatenate(parts) if parts else np.empty(0, np.int64)
            parts.clear()
        first, inverse = _distinct(columns[:order])
        rows = np.stack([c[first] for c in columns[:order]], axis=1)
        if given is None:
            sums = np.bincount(inverse, columns[order + 1], len(first)).astype(np.int64)
            seen = sums > 0
            share = sums[seen] / columns[order][first][seen]
            p = weight * share + (1 - weight) * 10.0 ** restore(columns[order + 2][first][seen])
            given = [Trie.of(rows[seen], quantise(np.log10(p))).save(), pack(sums[seen])]
        with tempfile.NamedTemporaryFile() as file:
            file.write(given[0])
            file.flush()
            trie = Trie.open(np.memmap(file.name, np.uint8, "r"))
            place = trie.positions(rows)
            there = place >= 0
            codes = np.zeros(len(rows), np.uint16)
            codes[there] = trie.codes[place[there]]
            del trie
        counts = np.zeros(len(rows), np.int32)
        counts[there] = np.minimum(unpack(given[1], np.int64)[place[there]], 2 ** 31 - 1)
        out, begin = [], 0
        for block, n in zip(asks, sizes):
            own = inverse[begin:begin + n]
            begin += n
            out.append((f"answer{order}", block, s, [pack(codes[own]), pack(counts[own])]))
        out.append(("model", MODEL, s, given))
        del rows, columns, inverse, first, codes, counts, place, there
        release()
        return pa.Table.from_batches([_rows(out)])

    return run


def _with_words(rows):
    """State of each slice with the words' ids and counts in: the texts as positions among the
    slice's words (start, words, end each), and the words' ids, ascending, with their counts."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, null, train, sizes, at = (unpack(b, k) for b, k in zip(row["body"], (np.int64, np.uint8, np.uint8, np.int32, np.int32)))
                answers = sorted(row["answers"], key=lambda a: a["shard"])
                gid = np.concatenate([[START, END]] + [unpack(a["body"][0], np.int64) for a in answers])
                count = np.concatenate([[rows, rows]] + [unpack(a["body"][1], np.int64) for a in answers])
                rank = np.argsort(gid, kind="stable")
                local = np.empty(len(gid), np.int32)
                local[rank] = np.arange(len(gid))
                ends = np.cumsum(sizes + 2)
                stream = np.full(int(ends[-1]), local[1], np.int32)
                stream[ends - sizes - 2] = local[0]
                inner = np.ones(len(stream), bool)
                inner[ends - sizes - 2] = inner[ends - 1] = False
                stream[inner] = local[at + 2]
                yield _rows([("state", row["block"], None, [pack(v) for v in (ids, null, train, sizes, stream, np.diff(gid[rank], prepend=0), count[rank])])])

    return run


class _Slice:
    """A slice on its way up the levels: for each position the code of its probability so far and
    the known n-gram that ends there."""

    SAVED = ("ids", np.int64), ("null", np.uint8), ("train", np.uint8), ("sizes", np.int32), ("stream", np.int32), ("gid", np.int64), ("base", np.float64), ("known", np.int32), ("code", np.uint16), ("node", np.int32), ("count", np.int64), ("length", np.int32)

    def __init__(self, body, total: int, kinds: int, weight: float):
        if len(body) == len(self.SAVED):  # on a level already
            for (name, kind), packed in zip(self.SAVED, body):
                setattr(self, name, unpack(packed, kind))
            self.gid, self.node, self.length, self.weight = np.cumsum(self.gid), self.node.astype(np.int64), int(self.length[0]), weight
            ends = np.cumsum(self.sizes + 2)
            self.first = ends - self.sizes - 2
            self.starts = np.zeros(len(self.stream), bool)
            self.starts[self.first] = True
            return
        kind = (np.int64, np.uint8, np.uint8, np.int32, np.int32, np.int64, np.int64)
        self.ids, self.null, self.train, self.sizes, self.stream, self.gid, self.count = (unpack(b, k) for b, k in zip(body, kind))
        self.gid = np.cumsum(self.gid)
        ends = np.cumsum(self.sizes + 2)
        self.first, self.weight, self.length = ends - self.sizes - 2, weight, 1
        self.starts = np.zeros(len(self.stream), bool)
        self.starts[self.first] = True
        c = self.count[self.stream]
        log_p = np.where(self.starts, 0.0, np.log10((c + 1.0) / (total + kinds + 1.0)))  # the start is given
        self.base = np.add.reduceat(log_p, self.first)
        self.known = np.add.reduceat(((c > 0) & ~self.starts).astype(np.int64), self.first)
        self.code = quantise(log_p)
        self.node = np.where(self.gid[self.stream] >= 0, self.stream, -1).astype(np.int64)

    def save(self) -> list[bytes]:
        values = {name: getattr(self, name) for name, _ in self.SAVED} | {"gid": np.diff(self.gid, prepend=0), "length": np.array([self.length])}
        return [pack(values[name].astype(kind)) for name, kind in self.SAVED]

    def question(self, shards: int, hot: int, send=None):
        """Distinct n-grams one longer than those known: the known one that ends before a position,
        and the word there. Keeps where they came from; returns the columns for each shard that
        ``send`` accepts (none by default)."""
        context = np.concatenate(([-1], self.node[:-1]))
        context[self.starts] = -1
        self.has = context >= 0
        self.has[self.has] = self.count[context[self.has]] > 0
        asks = np.flatnonzero(self.has & (self.gid[self.stream] >= 0))
        first, inverse = _distinct([context[asks], self.stream[asks].astype(np.int64)])
        one = asks[first]
        rows = np.column_stack([self.gid[self.stream[one - j]] for j in range(self.length, -1, -1)])
        counts = np.bincount(inverse, np.repeat(self.train, self.sizes + 2)[asks], len(first)).astype(np.int64)
        around, parts, order = self.count[context[one]], [], []
        for s, own in _by_shard(_spread(rows, around, shards, hot)):
            # Rows ascend, so differences of the leading ids compress best.
            if send and send(s):
                parts.append((s, [pack(np.diff(rows[own, j], prepend=0)) for j in range(rows.shape[1])] + [pack(around[own]), pack(counts[own].astype(np.int32)), pack(self.code[one[own]])]))
            order.append(own)
        self.order = np.concatenate(order) if order else np.empty(0, np.int64)
        self.at = np.full(len(self.stream), -1, np.int64)  # the position's n-gram; they ascend by their ids
        self.at[asks] = inverse
        return parts

    def answer(self, bodies) -> None:
        """Takes the codes and counts of the last question's n-grams in; unseen ones back off."""
        codes, self.count = np.empty(len(self.order), np.uint16), np.empty(len(self.order), np.int64)
        if bodies:
            codes[self.order] = np.concatenate([unpack(b[0], np.uint16) for b in bodies])
            self.count[self.order] = np.concatenate([unpack(b[1], np.int32) for b in bodies])
        found = self.at >= 0
        found[found] = codes[self.at[found]] > 0
        backed = np.minimum(self.code + np.int64(round(-math.log10(1 - self.weight) * GRID)) * self.has, 65535)
        backed[found] = codes[self.at[found]]
        self.code, self.node, self.length = backed.astype(np.uint16), np.where(found, self.at, -1), self.length + 1

    def climb(self, answers, shards: int, hot: int):
        """One level up, by the answers to the last question."""
        self.question(shards, hot)
        self.answer([a["body"] for a in sorted(answers, key=lambda a: a["shard"])])
        return self


def _asking(shards: int, hot: int, facts, turn: int = 0, turns: int = 1):
    """The slices' next question, as far as it goes to this turn's shards."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if own := [("ask", row["block"], s, body) for s, body in _Slice(row["body"], *facts).question(shards, hot, lambda s: s % turns == turn)]:
                    yield _rows(own)
                own = None
                release()

    return run


def _next(shards: int, hot: int, facts):
    """Slices one level up."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows([("state", row["block"], None, _Slice(row["body"], *facts).climb(row["answers"], shards, hot).save())])
                release()

    return run


def _finish(shards: int, hot: int, facts):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _Slice(row["body"], *facts).climb(row["answers"], shards, hot)
                score = np.add.reduceat(np.where(x.starts, 0.0, restore(x.code)), x.first)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x.ids, pa.int64(), mask=x.null.astype(bool)), "train": pa.array(x.train.astype(bool)), "n_tokens": pa.array(x.sizes.astype(np.int64) + 1),
                                                  "n_known": pa.array(x.known, pa.int64()), "base_score": pa.array(x.base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def _joined(states: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each slice's state with all answers to it; both are bounded by the slice."""
    none = F.array().cast("array<struct<kind:string,shard:int,body:array<binary>>>")
    if not answers:
        return states.select("block", "body", none.alias("answers"))
    together = answers[0]
    for more in answers[1:]:
        together = together.unionByName(more)
    lists = together.filter("kind like 'answer%'").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "body")).alias("answers"))
    return states.join(lists, "block", "left").select("block", "body", F.coalesce("answers", none).alias("answers"))


def score(docs: DataFrame, teach: Column | None = None, order: int = 3, weight: float = WEIGHT, model: str | None = None, save: str | None = None, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, train, n_tokens, n_known, base_score (by
    words alone), score (log10 probability of the whole text) and train_tokens.

    Tokens are the words (A-Z lowered) and one end; a null text is empty and has only its end. The
    model (``order`` 2 or more) learns from the rows where ``teach`` holds (all by default), or is
    read from the folder ``model`` that an earlier call wrote as ``save``. Rows that repeat an id are
    separate texts. With nothing to learn from, every token is unknown: log10(1) = 0 each (the code
    grid makes it -1/512). An empty table gives no rows."""
    spark = docs.sparkSession
    given = spark.read.parquet(model) if model else None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.lit(False) if model else F.lit(True) if teach is None else teach, F.lit(False)).alias("train"))
    if model:
        shards, train_docs, order, weight = (float(v) for v in given.filter("kind = 'facts'").head()["body"])
        shards, train_docs, order = int(shards), int(train_docs), int(order)
    else:
        about = rows.agg(F.sum(F.octet_length("text").cast("double")).alias("b"), F.sum(F.col("train").cast("bigint")).alias("t")).head()
        shards, train_docs = max(1, math.ceil((about["b"] or 0) / SHARD)), about["t"] or 0

    def answered(asks, level, serve, turn=0, turns=1):
        asks = asks.select("block", "shard", "body")
        if model:
            asks = asks.unionByName(given.filter(f"kind = 'level{level}' and shard % {turns} = {turn}").select("block", "shard", "body"))
        served = asks.groupBy("shard").applyInArrow(serve, SCHEMA)
        return put(served if save or level == 1 else served.filter("kind <> 'model'"))  # tries are kept only to be saved

    texts = put(_tokenised(rows, shards), "kind")
    words = answered(texts.filter("kind = 'ask'"), 1, _serve_words(shards))
    sums = words.filter("kind = 'model'").select(F.element_at("body", 3).alias("s")).mapInArrow(_summed, "kinds bigint, total bigint").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).head()
    kinds, total = (sums["kinds"] or 0) + (train_docs > 0), (sums["total"] or 0) + train_docs
    facts = (total, kinds, weight)
    states = put(_joined(texts.filter("kind = 'state'"), [words]).mapInArrow(_with_words(train_docs), SCHEMA))
    drop(texts)
    if not save:
        drop(words)
    levels, answers = [(1, words)], []
    for level in range(2, order + 1):
        # Each level climbs once, and slices are written as they stand there. Longer n-grams are
        # asked about in turns of shards, so fewer of them are on disk at once.
        if level > 2:
            higher = put(_joined(states, answers).mapInArrow(_next(shards, hot, facts), SCHEMA))
            for table in [states, *([] if save else answers)]:
                drop(table)
            states, answers = higher, []
        turns = level - 1
        for turn in range(turns):
            answers.append(answered(states.mapInArrow(_asking(shards, hot, facts, turn, turns), SCHEMA), level, _serve(level, weight), turn, turns))
            levels.append((level, answers[-1]))
    if save:
        for level, part in levels:
            part.filter("kind = 'model'").withColumn("kind", F.lit(f"level{level}")).write.mode("append").parquet(save)
        spark.createDataFrame([("facts", 0, 0, [str(v).encode() for v in (shards, train_docs, order, weight)])], SCHEMA).write.mode("append").parquet(save)
    done = _joined(states, answers).mapInArrow(_finish(shards, hot, facts), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(total).cast("bigint"))
