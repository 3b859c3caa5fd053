"""GeoJSON collections read in parallel, one row per feature, however the file is laid out.

The text reader cuts files after every closing brace, which needs no knowledge of what came before,
so splits of one file go to different tasks. Two running sums over the pieces then tell where
strings and objects begin: the parity of quotes, and the depth of braces outside strings. Pieces
between two returns to the outermost object form one of its members; members of ``features`` become
rows, everything else the document's head. No value is larger than one feature.

A document is a file, or a folder named like one whose part files follow each other by name."""

from __future__ import annotations

import hashlib
import sys
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import ordered
from wayfold.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Bytes of text that are packed for a digest.
PACK_BYTES = 1 << 20
#: Text up to a brace outside strings.
PLAIN = rf'[^"{{]*+(?:{STRING}[^"{{]*+)*+'

#: Entries of a list that are neither objects nor lists, each with its comma.
SCALARS = rf'(?:\s*(?:{STRING}|[^"\[\]{{}}:,\s]+)\s*,)*'


@dataclass
class Collections:
    """``documents``: (file, head, digest), head being the JSON text without its features, null where
    braces or quotes don't close; ``features``: (file, pos, feature), pos dense from 0; ``strays``:
    (file, n), entries of the list of features that are no objects."""

    documents: DataFrame
    features: DataFrame
    strays: DataFrame


def named(path: Column, suffix: str) -> Column:
    """The document a file belongs to: its folder, where that is named like a document, or itself."""
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # paths come encoded
    folder, own = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    return F.when(folder.endswith(suffix), F.regexp_replace(folder, "^file=", "")).otherwise(own)


def pieces(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, at, text, closed): the text between closing braces, in the order of ``at``; ``closed`` tells
    whether a brace follows (it does but at the end of a part)."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    rows = cut(raw.select(named(meta["file_path"], suffix).alias("file"), F.struct(meta["file_name"].alias("part"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("n")).alias("at"),
                          meta["file_size"].alias("size"), F.col("value").alias("text")))
    ends = rows.groupBy("file", F.col("at.part").alias("part")).agg(F.max("at").alias("at"), (F.sum(F.octet_length("text") + 1) > F.max("size")).alias("open")).filter("open").select("file", "at", "open")
    return rows.drop("size").join(ends, ["file", "at"], "left").select("file", "at", "text", F.col("open").isNull().alias("closed"))


def sums(rows: DataFrame, values: dict, inclusive: bool = False) -> DataFrame:
    """Running sums per document over the pieces before each."""
    block = F.struct(F.col("at.part").alias("part"), F.col("at.start").alias("start"), F.floor(F.col("at.n") / ordered.BLOCK).alias("n"))
    return ordered.running(rows, ["file"], ["at"], {k: (v, "sum") for k, v in values.items()}, block, exclusive=not inclusive)


def count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("bigint")


def structure(rows: DataFrame) -> DataFrame:
    """Adds ``depth`` before each piece, ``opens`` and ``shut`` (does it end an object), ``text`` with a
    quote in front where the piece begins inside a string (``within``), and the ``member`` it is in."""
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quoted = sums(rows.withColumn("quotes", count(bare, '"')), {"before": F.col("quotes")})
    within = F.col("before") % 2 == 1
    whole = quoted.select("file", "at", "closed", within.alias("within"), F.when(within, F.concat(F.lit('"'), "text")).otherwise(F.col("text")).alias("text"), ((F.col("before") + F.col("quotes")) % 2 == 0).alias("free"))
    opens = count(F.regexp_replace(F.regexp_replace("text", r"(?s)\\.", ""), r'"[^"]*("|$)', ""), "{")
    deep = sums(whole.withColumn("opens", opens).withColumn("shut", (F.col("closed") & F.col("free")).cast("bigint")), {"depth": F.col("opens") - F.col("shut")})
    ends = (F.col("depth") + F.col("opens") - F.col("shut") == 1) & (F.col("shut") == 1)
    return sums(deep.withColumn("ends", ends.cast("bigint")), {"member": F.col("ends")})


def packed(rows: DataFrame) -> DataFrame:
    """(file, at, data): runs of pieces as compressed bytes, at most ``PACK_BYTES`` and one piece each.

    Many tasks sort and pack blocks of pieces; ``at`` is that of a run's first piece."""
    rows_a_block = ordered.BLOCK  # a number: tasks have no modules of this library

    def run(batches):
        held, first, own, size = [], None, None, 0
        for batch in batches:
            done = []
            for file, part, start, n, text, closed in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "start", "n", "text", "closed"))):
                block = (file, part, start, n // rows_a_block)
                if held and (block != own or size >= PACK_BYTES):
                    done.append((*first, zlib.compress(b"".join(held), 1)))
                    held, size = [], 0
                if not held:
                    first, own = (file, part, start, n), block
                held.append(text.encode() + (b"}" if closed else b""))
                size += len(held[-1])
            yield table(done)
        if held:
            yield table([(*first, zlib.compress(b"".join(held), 1))])

    def table(found):
        kinds = {"file": pa.string(), "part": pa.string(), "start": pa.int64(), "n": pa.int64(), "data": pa.binary()}
        return pa.RecordBatch.from_pydict({name: pa.array([f[k] for f in found], kind) for k, (name, kind) in enumerate(kinds.items())})

    flat = rows.select("file", "at.part", "at.start", "at.n", "text", "closed")
    sorted_blocks = flat.repartition("file", "part", "start", F.floor(F.col("n") / rows_a_block)).sortWithinPartitions("file", "part", "start", "n")
    return sorted_blocks.mapInArrow(run, "file STRING, part STRING, start BIGINT, n BIGINT, data BINARY").select("file", F.struct("part", "start", "n").alias("at"), "data")


def digests(rows: DataFrame) -> DataFrame:
    """(file, digest): SHA-256 of each document; its packed pieces stream through one task in order."""
    def run(batches):
        file, state = None, None
        for batch in batches:
            done = []
            for name, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist()):
                if name != file:
                    if state:
                        done.append((file, state.hexdigest()))
                    file, state = name, hashlib.sha256()
                state.update(zlib.decompress(data))
            yield table(done)
        if state:
            yield table([(file, state.hexdigest())])

    def table(found):
        return pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in found], pa.string()), "digest": pa.array([d for _, d in found], pa.string())})

    return packed(rows).repartition("file").sortWithinPartitions("file", "at").select("file", "data").mapInArrow(run, "file STRING, digest STRING")


def joined(column: str, what: Column) -> Column:
    """Texts of a group's pieces in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(what.isNotNull() & (what != ""), F.struct("at", what.alias("t"))))), lambda p: p["t"]), "").alias(column)


def read(spark: SparkSession, path: str, suffix: str = ".geojson", member: str = "features") -> Collections:
    """Documents below ``path`` and their features. An empty file is a document without a head."""
    rows = cut(pieces(spark, path, suffix))
    placed = cut(structure(rows))
    text, depth = F.col("text"), F.col("depth")
    brace = F.when(F.col("closed"), F.lit("}")).otherwise("")
    outer = F.when(depth == 0, F.regexp_extract("text", rf"(?s)^({PLAIN}\{{{PLAIN})\{{", 1)).otherwise(F.regexp_extract("text", rf"(?s)^({PLAIN})\{{", 1))
    opening = (depth < 2) & (depth + F.col("opens") >= 2)
    lead = F.when(opening, outer).when(depth < 2, F.concat("text", brace))
    body = F.when(opening, F.concat(F.substr("text", F.length(outer) + 1), brace)).when(depth >= 2, F.concat(F.when(F.col("within"), F.substr("text", F.lit(2))).otherwise(F.col("text")), brace))
    # The quote put in front of a piece that begins inside a string belongs to no text.
    lead = F.when(F.col("within"), F.substr(lead, F.lit(2))).otherwise(lead)
    groups = placed.groupBy("file", "member").agg(joined("lead", lead), joined("body", body))
    key = rf'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:\s*(\[{SCALARS})?\s*$'
    name, in_list = F.regexp_extract("lead", key, 1), F.regexp_extract("lead", key, 2) != ""
    keyed = cut(groups.withColumn("own", F.when((F.col("body") != "") & (name != ""), F.struct("member", name.alias("name"), in_list.alias("listed")))))
    known = cut(ordered.running(keyed, ["file"], ["member"], {"key": (F.col("own"), "max")}, F.floor(F.col("member") / ordered.BLOCK)))
    inside = (F.col("body") != "") & F.coalesce((F.col("key.name") == member) & F.col("key.listed"), F.lit(False))
    # Between features stands a comma; other entries of the list are strays.
    marks = F.regexp_replace("lead", STRING, "0")
    between = F.when(F.col("own").isNull() & inside, marks)
    last = F.when(F.col("own").isNotNull() | (F.col("body") == ""), F.regexp_extract(marks, r"(?s)^([^\]:]*)\]", 1))
    first = F.when(inside & F.col("own").isNotNull(), F.regexp_extract(marks, r"(?s)\[([^\[\]]*)$", 1))

    def entries_in(part):
        return F.coalesce(F.size(F.filter(F.split(part, ","), lambda e: F.regexp_replace(e, r"\s", "") != "")), F.lit(0))

    entries = entries_in(F.coalesce(between, last)) + entries_in(first)
    broken = between.isNotNull() & ~F.coalesce(F.regexp_replace(between, r"\s", "").rlike(r"^,([^,]+,)*$"), F.lit(False))
    after = F.regexp_replace("lead", r"(?s)^[^\]:{\"]*\]", "]")
    shown = F.when(inside & F.col("own").isNull(), F.lit("")).when(inside, F.regexp_replace(after, rf"(?s)\[{SCALARS}\s*$", "[")).otherwise(F.concat(after, F.col("body")))
    heads = known.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown != "", F.struct("member", shown.alias("t"))))), lambda p: p["t"]), "").alias("head"), F.bool_or(broken).alias("broken"))
    sound = placed.groupBy("file").agg((F.sum(F.col("opens") - F.col("shut")) == 0).alias("even"), F.max_by("free", "at").alias("free"))
    listed = spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()  # empty files too, which no task reads
    every = spark.createDataFrame([(f,) for f in listed], "path STRING").select(named(F.col("path"), suffix).alias("file")).distinct()
    documents = every.join(heads.join(sound, "file"), "file", "left").join(digests(rows), "file", "left")
    documents = documents.select("file", F.when(F.col("even") & F.col("free") & ~F.col("broken"), F.col("head")).alias("head"), F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))
    numbered = ordered.ordinals(known.filter(inside).select("file", "member", F.col("body").alias("feature")), ["file"], ["member"], F.floor(F.col("member") / ordered.BLOCK), "pos")
    strays = known.select("file", entries.alias("n")).filter("n > 0").groupBy("file").agg(F.sum("n").cast("bigint").alias("n"))
    return Collections(cut(documents), numbered.select("file", (F.col("pos") - 1).alias("pos"), "feature"), strays)
