"""Token ids as binary files: frequency-ranked ids, bytes and their lengths kept apart.

Ids are replaced by their rank among all ids written, most frequent first, so common ones fit one
byte. A value takes one to four bytes, little end first; a control byte holds the lengths of four
values, two bits each, and control bytes stand before all data bytes. Reading looks each control
byte up in a table of lengths and gathers whole arrays.

A text is split at white space first; each distinct word of a slice of documents is encoded once.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import by_value, pack, ragged, slices, split_words, unpack
from wayfold.session import cut

by_value(__name__)

#: Bytes of coded data in one segment of a file, files at most (two segments each up to 512 GB of
#: coded data), remembered words per worker, words that go to the library at a time.
SEGMENT, FILES, MEMORY, BATCH = 4 << 20, 1 << 16, 400000, 4096
#: Lengths of the four values of a control byte (low bits first), and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Words of these characters need no Unicode normalisation and lower-case letter by letter.
PLAIN = re.compile("[\x21-\x7e\xc0-\xff]+")
#: The pieces that this tokenizer's own split rule makes of such a word.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: How a file says so, and its normaliser.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                                                       {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def encode(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each run of values; a run's control bytes end with zero bits."""
    values = values.astype(np.uint32)
    width = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    ends = np.concatenate(([0], np.cumsum(width)))
    data = np.empty(int(ends[-1]), np.uint8)
    for b in range(4):
        wide = np.flatnonzero(width > b) if b else np.arange(len(values))
        data[ends[wide] + b] = (values[wide] >> np.uint32(8 * b)) & 0xFF
    groups = -(-sizes // 4)
    codes = np.zeros(int(groups.sum()) * 4, np.uint8)
    codes[ragged((np.cumsum(groups) - groups) * 4, sizes)] = width - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    after, marks = np.cumsum(sizes), np.cumsum(groups)
    return ([control[a:b].tobytes() for a, b in zip(marks - groups, marks)], [data[ends[a]:ends[b]].tobytes() for a, b in zip(after - sizes, after)])


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of one run."""
    width = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(width) - width
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for b in range(1, 4):
        wide = np.flatnonzero(width > b)
        if not len(wide):
            break
        out[wide] |= raw[at[wide] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


class WordEncoder:
    """Ids of single words. White space always ends a piece in this tokenizer, so a text's ids are
    those of its words one after the other. Plain words are cut into pieces here and each new piece
    goes to the library's model; all others take the library's whole path. Of a file with another
    normaliser or split rule whole texts take the place of words."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(file)
        self.tokenize, self.memory = self.whole.model.tokenize, {}
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == PRE_TOKENIZER and told.get("post_processor") is None
        byte_chars = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        table = {c: chr(c) for c in byte_chars} | {c: chr(256 + i) for i, c in enumerate(x for x in range(256) if x not in set(byte_chars))}
        self.letters = {c: "".join(table[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}

    def piece(self, text: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(text.translate(self.letters))]).tobytes()
        if len(self.memory) < MEMORY:  # what comes first is mostly what comes often
            self.memory[text] = ids
        return ids

    def word(self, word: str) -> bytes | None:
        """The ids of a plain word; None for others."""
        if not (word.isascii() or PLAIN.fullmatch(word)) or "<|" in word:
            return None
        low, get, piece = word.lower(), self.memory.get, self.piece
        if low.isalpha():
            return get(low) or piece(low)
        # Mostly letters and one mark or digit, which is a piece of its own.
        parts = (low[:-1], low[-1]) if low[:-1].isalpha() else PIECES.findall(low)
        ids = b"".join([get(text) or piece(text) for text in parts])
        if len(self.memory) < MEMORY:
            self.memory[word] = ids
        return ids

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and the number of ids of each."""
        get, word = self.memory.get, self.word
        each = [get(w) or word(w) for w in words] if self.by_word else [None] * len(words)
        odd = [i for i, ids in enumerate(each) if ids is None]
        for a in range(0, len(odd), BATCH):
            part = odd[a:a + BATCH]
            for i, e in zip(part, self.whole.encode_batch([words[i] for i in part], add_special_tokens=False)):
                each[i] = np.array(e.ids, np.uint32).tobytes()
                if self.by_word and e.ids and len(words[i]) < 64 and len(self.memory) < MEMORY:
                    self.memory[words[i]] = each[i]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        return np.frombuffer(b"".join(each), np.uint32), sizes


def whole_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``split_words``, each text being one word."""
    coded = pc.fill_null(texts.cast(pa.large_string()), "").dictionary_encode()
    return np.ones(len(texts), np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


_ENCODERS: dict = {}


def blocks(docs: DataFrame, file: str, end: int) -> DataFrame:
    """Tokenised slices: doc_ids, words per document, words as positions in the slice's list of
    distinct words, and the ids of those (the last entry of the list is the end id)."""
    def run(batches):
        if file not in _ENCODERS:
            _ENCODERS[file] = WordEncoder(file)
        for batch in batches:
            for part in slices(batch, "text", 20 << 20):
                # Case is left to the tokenizer: it lowers more than A-Z.
                sizes, at, known = split_words(part.column("text"), lower=False) if _ENCODERS[file].by_word else whole_texts(part.column("text"))
                ids, per = _ENCODERS[file].table(known)
                yield pa.RecordBatch.from_pydict({"doc_ids": [part.column("doc_id").to_pylist()], "sizes": [pack(sizes.astype(np.int32))], "words": [pack(at.astype(np.int32))],
                                                  "ids": [pack(np.append(ids, end).astype(np.uint32))], "per": [pack(np.append(per, 1).astype(np.int32))]}, schema=arrow)

    arrow = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("ids", pa.binary()), ("per", pa.binary())])
    return docs.mapInArrow(run, "doc_ids array<bigint>, sizes binary, words binary, ids binary, per binary")


def _read(row) -> tuple:
    return (row["doc_ids"], unpack(row["sizes"], np.int32).astype(np.int64), unpack(row["words"], np.int32), unpack(row["ids"], np.uint32), unpack(row["per"], np.int32).astype(np.int64))


def frequencies(table: DataFrame) -> DataFrame:
    """How often each id is written: (id, n)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, _, words, ids, per = _read(row)
                times = np.bincount(words, minlength=len(per))
                times[-1] += len(docs)
                n = np.bincount(ids, np.repeat(times, per))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(n[seen].astype(np.int64))})

    return table.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def coded(table: DataFrame, ranks: dict[int, int], cuts: list[int]) -> DataFrame:
    """One row per document: bucket (place of its id among ``cuts``), doc_id, n, control, data."""
    def run(batches):
        rank = np.zeros(max(ranks, default=0) + 1, np.uint32)
        rank[list(ranks)] = list(ranks.values())
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes, words, ids, per = _read(row)
                values, begin = rank[ids], np.cumsum(per) - per
                ends = np.cumsum(sizes)
                turn = (np.arange(len(docs)) + ends) // 400_000  # bounds what is expanded at once
                edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(docs)]
                for lo, hi in zip(edges, edges[1:]):
                    first = ends[lo] - sizes[lo]
                    own = words[first:ends[hi - 1]]
                    own = np.insert(own, ends[lo:hi] - first, len(per) - 1)  # the end id after each
                    lengths = per[own]
                    sums = np.concatenate(([0], np.cumsum(lengths)))
                    n = np.diff(sums[np.concatenate(([0], np.cumsum(sizes[lo:hi] + 1)))])
                    control, data = encode(values[ragged(begin[own], lengths)], n)
                    names = docs[lo:hi]
                    place = np.searchsorted(cuts, [-(1 << 63) if d is None else d for d in names], side="left")
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(place, pa.int32()), "doc_id": pa.array(names, pa.int64()), "n": pa.array(n, pa.int64()),
                                                      "control": pa.array(control, pa.binary()), "data": pa.array(data, pa.binary())})

    return table.mapInArrow(run, "bucket int, doc_id bigint, n bigint, control binary, data binary")


def segments(rows: DataFrame) -> DataFrame:
    """Joins sorted documents of a bucket into segments: bucket, segment, tokens, doc_ids, counts
    (packed), control, data."""
    def run(batches):
        names = ("doc_id", "n", "control", "data")
        held, at, used, number = {k: [] for k in names}, None, 0, 0

        def flush():
            nonlocal used, number
            out = pa.RecordBatch.from_pydict({"bucket": pa.array([at], pa.int32()), "segment": pa.array([number], pa.int32()), "tokens": pa.array([sum(held["n"])], pa.int64()),
                                              "doc_ids": pa.array([held["doc_id"]], pa.list_(pa.int64())), "counts": [pack(np.array(held["n"], np.int64))],
                                              "control": [b"".join(held["control"])], "data": [b"".join(held["data"])]})
            for v in held.values():
                v.clear()
            used, number = 0, number + 1
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if held["n"] and (row["bucket"] != at or used >= SEGMENT):
                    yield flush()
                if row["bucket"] != at:
                    at, number = row["bucket"], 0
                for k in names:
                    held[k].append(row[k])
                used += len(row["data"])
        if held["n"]:
            yield flush()

    return rows.mapInArrow(run, "bucket int, segment int, tokens bigint, doc_ids array<bigint>, counts binary, control binary, data binary")


def write(docs: DataFrame, path: str, file: str, end: int = 1) -> None:
    """Writes the ids of ``docs`` (doc_id, text; null: empty) to ``path`` in ascending doc_id order.

    ``path``/ranks lists the ids by rank; ``path``/segments holds the data, in order of bucket and
    segment. A null id sorts first; rows that repeat an id follow each other in order of length and
    content. An empty table writes no segment."""
    docs = docs.select("doc_id", "text")
    table = cut(blocks(docs, file, end))
    counts = frequencies(table).orderBy(F.desc("n"), "id").collect()  # bounded by the vocabulary
    ranks = {r["id"]: i for i, r in enumerate(counts)}
    total = sum(r["n"] for r in counts)
    files = min(FILES, total // (2 * SEGMENT) + 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], 10 * max(files, 4096)).alias("c")).head()["c"] if files > 1 else []
    ordered = coded(table, ranks, sorted(set(cuts or []))).repartition(int(files), "bucket").sortWithinPartitions("bucket", "doc_id", "n", "data")
    spark = docs.sparkSession
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(counts)], "rank int, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")
    segments(ordered).write.option("compression", "zstd").parquet(f"{path}/segments")


def read(spark, path: str) -> DataFrame:
    """Decodes what ``write`` wrote: doc_id, start (ids before the document), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit integers); ``documents`` gives the ids themselves."""
    return _decoded(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of every document in the files."""
    return _decoded(spark, path, "ids array<bigint>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def _decoded(spark, path, column, make, kind) -> DataFrame:
    order = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    name = column.split()[0]

    def run(batches):
        ids = np.array(order, "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack(row["counts"], np.int64)
                groups = -(-n // 4)
                # Each document's control bytes end on a byte, so the segment is one padded run.
                widths = LENGTHS[np.frombuffer(row["control"], np.uint8)].ravel()
                ends, marks, at = np.cumsum(n), np.cumsum(groups), 0
                out = []
                for i in range(len(n)):
                    a, b = int(marks[i] - groups[i]), int(marks[i])
                    size = int(widths[4 * a:4 * a + int(n[i])].sum())
                    out.append(make(ids[decode(row["control"][a:b], row["data"][at:at + size], int(n[i]))]))
                    at += size
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([row["bucket"]] * len(n), pa.int32()), "segment": pa.array([row["segment"]] * len(n), pa.int32()),
                                                  "doc_id": pa.array(row["doc_ids"], pa.int64()), "inside": pa.array(ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), name: pa.array(out, kind)})

    files = spark.read.parquet(f"{path}/segments")
    rows = files.mapInArrow(run, f"bucket int, segment int, doc_id bigint, inside bigint, n_tokens bigint, {column}")
    by_bucket = files.groupBy("bucket").agg(F.sum("tokens").alias("t"))  # at most FILES rows
    before = by_bucket.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    own = F.coalesce(F.sum("tokens").over(Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("bucket", "segment", own.alias("s")).join(before, "bucket").select("bucket", "segment", (F.col("s") + F.col("b")).alias("first"))
    return rows.join(starts, ["bucket", "segment"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", name)
