"""Shape files (SRC23, SRC26): polygons and lines of .shp records, in the published binary layout of the format.

Files are read whole, one row each (spark.read.format("binaryFile")); each part of each record becomes a row. Coordinates
must be degrees: other projections are converted beforehand."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format: its file code, the length of its header, and kinds of records.
CODE, HEADER = 9994, 100
LINE, POLYGON = 3, 5


def shape_parts(data: bytes):
    """(record number, part, array of (lon, lat)) for each part of the line and polygon records of a file."""
    at = HEADER
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body, at = data[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind % 10 not in (LINE, POLYGON):  # with heights or measures the plane coordinates stand first as well
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        first = [*np.frombuffer(body, "<i4", n_parts, 44).tolist(), n_points]
        xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
        for part, (a, z) in enumerate(zip(first, first[1:])):
            yield number, part, xy[a:z]


def shape_file(records: list[list[list[dict]]], kind: int) -> bytes:
    """A file of records, each a list of parts of points with lat and lon."""
    out = []
    for number, parts in enumerate(records, 1):
        points = np.array([(p["lon"], p["lat"]) for part in parts for p in part], "<f8").reshape(-1, 2)
        low, high = (points.min(axis=0), points.max(axis=0)) if len(points) else (np.zeros(2), np.zeros(2))
        first = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
        body = struct.pack("<i4dii", kind, *low, *high, len(parts), len(points)) + first.tobytes() + points.tobytes()
        out.append(struct.pack(">ii", number, len(body) // 2) + body)
    size = (HEADER + sum(map(len, out))) // 2
    return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + b"".join(out)


def parts(files: DataFrame) -> DataFrame:
    """id, record, part, line (array of struct lat, lon); files: id, content. Null or cut-off files give the records they hold."""
    point = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])

    def run(batches):
        for b in batches:
            for one, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(one, r, k, [{"lat": y, "lon": x} for x, y in xy.tolist()]) for r, k, xy in shape_parts(data or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.list_(point)))], names=["id", "record", "part", "line"])

    return files.select("id", "content").mapInArrow(run, "id long, record int, part int, line array<struct<lat:double,lon:double>>")


def lines(parts_: DataFrame) -> DataFrame:
    """The parts that are lines (two points or more), numbered anew within their record (SRC26)."""
    kept = parts_.filter(F.size("line") >= 2)
    nth = F.row_number().over(Window.partitionBy("id", "record").orderBy("part")) - 1
    return kept.withColumn("part", nth)
