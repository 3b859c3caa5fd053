"""Elevation profiles of lines, one row a line.

A line's samples follow from its points, so they are worked out again where they are needed and neither
stored nor exchanged. What travels is the raster posts a line needs, and their heights back to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import climbs

#: Samples that are worked out together; a longer line is taken alone.
CHUNK = 200_000
CELL = ["cell_lat", "cell_lon", "brow", "bcol"]


def gather(line_points: DataFrame, *columns: str) -> DataFrame:
    """One row per line of (line_id, seq, lat, lon, columns...): arrays in the order of ``seq``.

    A road's points are physically bounded; they are exchanged before they are gathered."""
    names = ["lat", "lon", *columns]
    rows = (line_points.filter("line_id is not null and lat is not null and lon is not null").select("line_id", "seq", *names).repartition("line_id").groupBy("line_id")
            .agg(F.sort_array(F.collect_list(F.struct("seq", *names))).alias("p")))
    return rows.select("line_id", *[F.col("p")[c].alias(c) for c in names])


def _geometry(step: float, least: float, n: int = 0):
    """(chunks, walk, posts, flat_list) as closures: they travel to the workers by value."""
    metres_per_degree, side, block = geo.METRES_PER_DEGREE_LON, climbs.BLOCK + 1, climbs.BLOCK
    per_side, chunk = n // block + 1, CHUNK

    def flat_list(column):
        """(values, offsets) of a list column."""
        array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = array.offsets.to_numpy()
        return array.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]

    def chunks(batch):
        """Slices of a batch whose lines have about ``chunk`` samples in all."""
        lat, offsets = flat_list(batch.column("lat"))
        lon = flat_list(batch.column("lon"))[0].to_numpy(zero_copy_only=False)
        lat = lat.to_numpy(zero_copy_only=False)
        about = np.zeros(len(lat))
        about[1:] = np.hypot(np.diff(lat), np.diff(lon)) * metres_per_degree / step
        about[offsets[:-1][offsets[:-1] < len(lat)]] = 0
        done = np.concatenate([[0.0], np.cumsum(about)])[offsets] // chunk
        starts = [0, *(np.flatnonzero(np.diff(done[:-1])) + 1), batch.num_rows]
        return [batch.slice(a, b - a) for a, b in zip(starts, starts[1:]) if b > a]

    def walk(part) -> dict:
        """Samples of the lines of one slice, all lines behind one another; ``size`` per line."""
        lat, offsets = flat_list(part.column("lat"))
        lat, lon = lat.to_numpy(zero_copy_only=False), flat_list(part.column("lon"))[0].to_numpy(zero_copy_only=False)
        counts = np.diff(offsets)
        own = np.repeat(np.arange(len(counts)), counts)
        scale = np.cos(np.radians(np.bincount(own, lat, len(counts)) / np.maximum(counts, 1)))
        at = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.array([], int)
        line = own[at]
        metres = np.hypot((lon[at + 1] - lon[at]) * scale[line], lat[at + 1] - lat[at]) * metres_per_degree
        ends, begins, total = np.empty(len(at)), np.empty(len(at)), np.zeros(len(counts))
        borders = np.searchsorted(line, np.arange(len(counts) + 1))
        for k in range(len(counts)):
            a, b = borders[k], borders[k + 1]
            if b > a:
                sums = np.cumsum(metres[a:b])
                ends[a:b], begins[a], begins[a + 1:b], total[k] = sums, 0.0, sums[:-1], sums[-1]
        first = np.ceil(begins / step).astype(np.int64)
        many = np.where(total[line] >= least, np.maximum(0, np.ceil(ends / step).astype(np.int64) - first), 0)
        seg = np.repeat(np.arange(len(at)), many)
        i = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many) + first[seg]
        t, p = (i * step - begins[seg]) / metres[seg], at[seg]
        return {"line": line[seg], "point": p, "t": t, "lat": lat[p] + (lat[p + 1] - lat[p]) * t, "lon": lon[p] + (lon[p + 1] - lon[p]) * t,
                "size": np.bincount(line[seg], minlength=len(counts)).astype(np.int64)}

    def posts(w: dict) -> dict:
        """The raster posts each line needs, by line, block and place in it, and where each sample finds its four."""
        top, left = np.floor(w["lat"]), np.floor(w["lon"])
        y, x = (top + 1 - w["lat"]) * n, (w["lon"] - left) * n
        r, c = (np.clip(np.floor(v), 0, n - 1).astype(np.int64) for v in (y, x))
        home = (((top.astype(np.int64) + 32768) * 65536 + left.astype(np.int64) + 32768) * per_side + r // block) * per_side + c // block
        place = (r % block) * side + c % block
        homes, home = np.unique(home, return_inverse=True)
        key = (w["line"] * max(1, len(homes)) + home) * (side * side) + place
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.array([], bool)  # neighbours share a raster cell
        corners = [key[fresh] + dy * side + dx for dy in (0, 1) for dx in (0, 1)]
        wanted = np.unique(np.concatenate(corners))
        return {"wanted": wanted, "homes": homes, "fy": y - r, "fx": x - c, "cell": np.cumsum(fresh) - 1, "corners": [np.searchsorted(wanted, k) for k in corners]}

    return chunks, walk, posts, flat_list


def raster_posts(lines: DataFrame, rows_per_cell: int, step: float = climbs.STEP_M, least: float = climbs.MIN_LINE_M) -> DataFrame:
    """(line_id, cell_lat, cell_lon, brow, bcol, posts): the places in each block whose height a line needs."""
    chunks, walk, posts, _ = _geometry(step, least, rows_per_cell)
    side, per_side, cell = climbs.BLOCK + 1, rows_per_cell // climbs.BLOCK + 1, CELL
    kind = dict(lines.dtypes)["line_id"]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = posts(walk(part))
                group, place = p["wanted"] // (side * side), (p["wanted"] % (side * side)).astype(np.int16)
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.array([], int)
                if not len(starts):
                    continue
                line, home = group[starts] // len(p["homes"]), p["homes"][group[starts] % len(p["homes"])]
                upper = home // (per_side * per_side)
                parts = [upper // 65536 - 32768, upper % 65536 - 32768, home // per_side % per_side, home % per_side]
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)).astype(np.int32)), pa.array(place))
                yield pa.RecordBatch.from_arrays([part.column("line_id").take(pa.array(line)), *[pa.array(v) for v in parts], lists], ["line_id", *cell, "posts"])

    return lines.select("line_id", "lat", "lon").mapInArrow(per_task, f"line_id {kind}, " + ", ".join(f"{c} bigint" for c in CELL) + ", posts array<smallint>")


def heights(lines: DataFrame, elevation: DataFrame, rows_per_cell: int, step: float = climbs.STEP_M, least: float = climbs.MIN_LINE_M) -> DataFrame:
    """``lines`` with ``heights``: of the posts each needs, in the order of ``raster_posts``. Lines without a sample go."""
    blocks = elevation if "brow" in elevation.columns else climbs.raster_blocks(elevation)
    met = (raster_posts(lines, rows_per_cell, step, least).join(blocks.select(*CELL, F.col("elev").alias("_e")), CELL, "left")
           .select("line_id", F.struct(*CELL, F.transform("posts", lambda p: F.get(F.col("_e"), p.cast("int"))).alias("h")).alias("b")))
    own = met.repartition("line_id").groupBy("line_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["h"])).alias("heights"))
    return lines.join(own, "line_id")


def profile(lines: DataFrame, elevation: DataFrame, rows_per_cell: int, upto: str = "smooth", step: float = climbs.STEP_M, least: float = climbs.MIN_LINE_M) -> DataFrame:
    """``lines`` with ``elev``, the heights every ``step`` metres along them; lines under ``least`` metres drop.

    Steps, as far as ``upto``: "bilinear" heights between the raster's samples, null where one of them is;
    "whole" drops lines with a null; "filled" interpolates on bridges and in tunnels (``flat``) between
    the nearest open samples and drops lines that are flat throughout; "smooth" takes the centred mean of
    three with the end values repeated, but leaves lines of one or two samples alone."""
    chunks, walk, posts, flat_list = _geometry(step, least, rows_per_cell)
    stage = ["bilinear", "whole", "filled", "smooth"].index(upto)
    carried = [c for c in lines.columns]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = walk(part)
                p, high = posts(w), flat_list(part.column("heights"))[0].to_numpy(zero_copy_only=False).astype(float)
                h = [high[k][p["cell"]] for k in p["corners"]]
                fy, fx = p["fy"], p["fx"]
                elev = h[0] * ((1 - fy) * (1 - fx)) + h[1] * ((1 - fy) * fx) + h[2] * (fy * (1 - fx)) + h[3] * (fy * fx)
                size, line = w["size"], w["line"]
                kept = size > 0
                if stage >= 1:
                    kept &= np.bincount(line, np.isnan(elev), len(size)) == 0
                start = (np.cumsum(size) - size)[line]
                if stage >= 2:
                    level = flat_list(part.column("flat"))[0].to_numpy(zero_copy_only=False).astype(float)
                    a = level[w["point"]]
                    open_ = a + (level[w["point"] + 1] - a) * w["t"] <= 0.5
                    kept &= np.bincount(line, open_, len(size)) > 0
                    at, last = np.arange(len(elev)), (start + size[line] - 1)
                    lo = np.maximum.accumulate(np.where(open_, at, -1))
                    hi = np.minimum.accumulate(np.where(open_, at, len(elev))[::-1])[::-1]
                    none_lo, none_hi = lo < start, hi > last
                    lo, hi = np.where(none_lo, np.where(none_hi, at, hi), lo), np.where(none_hi, np.where(none_lo, at, lo), hi)
                    share = (at - lo) / np.maximum(1, hi - lo)
                    elev = np.where(open_, elev, elev[lo] + (elev[hi] - elev[lo]) * np.where(none_lo | none_hi, 0.0, share))
                if stage >= 3:
                    at, last = np.arange(len(elev)), (start + size[line] - 1)
                    mean = (elev[np.maximum(at - 1, start)] + elev + elev[np.minimum(at + 1, last)]) / 3 if len(elev) else elev
                    elev = np.where(size[line] >= 3, mean, elev)
                rows, mine = np.flatnonzero(kept), kept[line]
                offsets = np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(elev[mine], from_pandas=True))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(rows)) for c in carried], lists], [*carried, "elev"])

    schema = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes) + ", elev array<double>"
    return heights(lines, elevation, rows_per_cell, step, least).select(*carried, "heights").mapInArrow(per_task, schema)


def samples(profiles: DataFrame) -> DataFrame:
    """(line_id, i, elev): a row per sample."""
    return profiles.select("line_id", F.posexplode("elev").alias("i", "elev"))


def find(profiles: DataFrame, step: float = climbs.STEP_M, least: float = climbs.MIN_LINE_M) -> DataFrame:
    """Climbs (line_id, reverse, size, start, top) in both directions of each line with the heights and places of
    their ends (elev0, lat0, lon0, elev1, lat1, lon1), their ``steepest`` 200 m in percent, null where shorter,
    and ``name``: the most used road name of the upper half, else of all of it, of equal ones the first, else null.

    Where a climb ends decides where the next one may begin, so a profile is read in order. Places need
    the lines' points (lat, lon), names those of the points (name); without them they are null."""
    read, window, span = climbs._climbs_of, climbs.STEEP_SAMPLES, climbs.STEEP_SAMPLES * step
    chunks, walk, _, flat_list = _geometry(step, least)
    placed, named = {"lat", "lon"} <= set(profiles.columns), {"lat", "lon", "name"} <= set(profiles.columns)
    numbers = ["elev0", "elev1", "lat0", "lon0", "lat1", "lon1", "steepest"]

    def most_used(points, names):
        """The most used name of samples, told by the point before each."""
        low, used = points.min(), {}
        count = np.bincount(points - low)
        for k in np.flatnonzero(count):
            if names[k + low] is not None:
                used[names[k + low]] = used.get(names[k + low], 0) + count[k]
        return min(used, key=lambda name: (-used[name], name)) if used else None

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch) if placed else [batch]:
                elevs, offsets = flat_list(part.column("elev"))
                elevs = elevs.to_numpy(zero_copy_only=False)
                w = walk(part) if placed else {}
                names = flat_list(part.column("name"))[0].to_pylist() if named else None
                rows, whole, decimal, words = [], [], [], []
                for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
                    for reverse in (False, True):
                        elev = elevs[a:b][::-1] if reverse else elevs[a:b]
                        for start, top in read(elev):
                            at = (b - 1 - start, b - 1 - top) if reverse else (a + start, a + top)
                            ends = [w[c][j] for j in at for c in ("lat", "lon")] if placed else [np.nan] * 4
                            rise = np.max(elev[start + window:top + 1] - elev[start:top + 1 - window]) / span * 100 if top - start >= window else np.nan
                            rows.append(k)
                            whole.append((reverse, b - a, start, top))
                            decimal.append((elev[start], elev[top], *ends, rise))
                            if named:
                                half = start + (top - start + 1) // 2
                                points = w["point"][a:b][::-1] if reverse else w["point"][a:b]
                                upper = most_used(points[half:top + 1], names)
                                words.append(most_used(points[start:top + 1], names) if upper is None else upper)
                if rows:
                    whole, decimal = np.array(whole), np.array(decimal, float)
                    yield pa.RecordBatch.from_arrays([
                        part.column("line_id").take(pa.array(rows)), pa.array(whole[:, 0].astype(bool)), *[pa.array(whole[:, j].astype(np.int32)) for j in (1, 2, 3)],
                        *[pa.array(decimal[:, j], from_pandas=True) for j in range(len(numbers))], pa.array(words if named else [None] * len(rows), pa.string())],
                        ["line_id", "reverse", "size", "start", "top", *numbers, "name"])

    kind = dict(profiles.dtypes)["line_id"]
    columns = ["line_id", "elev", *(["lat", "lon"] if placed else []), *(["name"] if named else [])]
    return profiles.select(*columns).mapInArrow(per_task, f"line_id {kind}, reverse boolean, size int, start int, top int, " + ", ".join(f"{c} double" for c in numbers) + ", name string")
