"""LAS point files (S1, K11) as a Spark data source: spark.read.format("las"), df.write.format("las").

Options of reading: `path` (a file or a folder), `select` (comma-separated columns), `fraction` and `seed` (a random share of
the points, drawn while reading), `rows` (points a partition).  Files of versions 1.0 to 1.4 and point formats 0 to 10 with
their extra bytes; compressed ones (LAZ) are refused.  Writing makes version 1.4 files of format 7, one a partition or more, with
further numeric columns as extra bytes.  The layout is the public ASPRS specification's.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from boscage.sources.files import names, prepare, save, store

_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Intensity", "<u2")]
_OLD = [*_CORE, ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("UserData", "u1"), ("PointSourceID", "<u2")]
_NEW = [*_CORE, ("flags", "u1"), ("more", "u1"), ("class", "u1"), ("UserData", "u1"), ("angle", "<i2"), ("PointSourceID", "<u2"), ("gpstime", "<f8")]
_TIME, _COLOUR, _NIR, _WAVE = [("gpstime", "<f8")], [("R", "<u2"), ("G", "<u2"), ("B", "<u2")], [("NIR", "<u2")], [("wave", "V29")]
#: The fields of each point format, and the types of extra bytes.
FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _COLOUR, 3: _OLD + _TIME + _COLOUR, 4: _OLD + _TIME + _WAVE, 5: _OLD + _TIME + _COLOUR + _WAVE, 6: _NEW, 7: _NEW + _COLOUR, 8: _NEW + _COLOUR + _NIR, 9: _NEW + _WAVE, 10: _NEW + _COLOUR + _NIR + _WAVE}
EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_WHOLE = ("Intensity", "ReturnNumber", "NumberOfReturns", "Classification", "UserData", "PointSourceID", "R", "G", "B", "NIR")


@dataclass
class Header:
    """What reading needs of a file's header."""

    start: int
    points: int
    form: int
    dtype: np.dtype
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    extra: dict[str, tuple[float, float, bool]]

    def columns(self) -> dict[str, T.DataType]:
        out: dict[str, T.DataType] = {a: T.DoubleType() for a in "XYZ"}
        held = self.dtype.names or ()
        for c in _WHOLE:
            if c in held or c in ("ReturnNumber", "NumberOfReturns", "Classification"):
                out[c] = T.IntegerType()
        if "gpstime" in held:
            out["gpstime"] = T.DoubleType()
        for c, (_, _, whole) in self.extra.items():
            out[c] = T.LongType() if whole else T.DoubleType()
        return out


def header(path: str) -> Header:
    """The header of one file, its extra bytes included."""
    fs, at = store(path)
    with fs.open_input_file(at) as f:
        h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        minor, size, start, records = h[25], *struct.unpack_from("<HII", h, 94)
        form, width, points = struct.unpack_from("<BHI", h, 104)
        if form & 0xC0:
            raise ValueError(f"{path} is compressed (LAZ); there is no decoder here")
        if minor >= 4:
            points = struct.unpack_from("<Q", h, 247)[0]
        fields, extra = list(FORMATS[form]), {}
        f.seek(size)
        for _ in range(records):
            _, user, number, length, _ = struct.unpack("<H16sHH32s", f.read(54))
            body = f.read(length)
            if user.rstrip(b"\0") == b"LASF_Spec" and number == 4:
                for i in range(0, len(body) - 191, 192):
                    kind, flags = body[i + 2], body[i + 3]
                    name = body[i + 4 : i + 36].rstrip(b"\0").decode("utf-8", "replace")
                    if kind not in EXTRA:  # bytes of no stated type
                        fields.append((f"\0{i}", f"V{flags}"))
                        continue
                    by, plus = struct.unpack_from("<d", body, i + 112)[0] if flags & 8 else 1.0, struct.unpack_from("<d", body, i + 136)[0] if flags & 16 else 0.0
                    name = name if name not in dict(fields) else f"{name}_extra"
                    fields.append((name, EXTRA[kind]))
                    extra[name] = (by, plus, kind < 9 and not flags & 24)
    used = np.dtype(fields).itemsize
    if used > width:
        raise ValueError(f"{path}: records of {width} bytes hold no format {form} with its extra bytes")
    if used < width:
        fields.append(("\0rest", f"V{width - used}"))
    return Header(start, points, form, np.dtype(fields), struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155), extra)


def decoded(raw: np.ndarray, h: Header, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of raw records; a column that this file lacks is left out."""
    new, out = h.form >= 6, {}
    for c in columns:
        if c in "XYZ":
            i = "XYZ".index(c)
            out[c] = raw[c] * h.scale[i] + h.offset[i]
        elif c == "ReturnNumber":
            out[c] = raw["flags"] & (15 if new else 7)
        elif c == "NumberOfReturns":
            out[c] = raw["flags"] >> 4 if new else raw["flags"] >> 3 & 7
        elif c == "Classification":
            out[c] = raw["class"] if new else raw["class"] & 31
        elif c in h.extra:
            by, plus, whole = h.extra[c]
            out[c] = raw[c].astype(np.int64) if whole else raw[c] * by + plus
        elif c in h.dtype.names:
            out[c] = raw[c]
    return out


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Part]:
        rows, out = int(self.options.get("rows", 1_000_000)), []
        for path in names(self.options["path"], ".las"):
            n = header(path).points
            out += [Part(path, i, min(rows, n - i)) for i in range(0, n, rows)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        h, fraction = header(part.path), float(self.options.get("fraction", 1))
        rng = np.random.default_rng([int(self.options.get("seed", 0)), zlib.crc32(part.path.encode()), part.first])
        fs, at = store(part.path)
        with fs.open_input_file(at) as f:
            f.seek(h.start + part.first * h.dtype.itemsize)
            left = part.count
            while left:
                n = min(left, 65_536)
                raw = np.frombuffer(f.read(n * h.dtype.itemsize), h.dtype)
                if len(raw) < n:
                    raise ValueError(f"{part.path} ends before its last point")
                left -= n
                if fraction < 1:
                    raw = raw[rng.random(n) < fraction]
                got = decoded(raw, h, self.schema.names)
                yield pa.RecordBatch.from_arrays([pa.array(got[c]).cast(arrow.field(c).type) if c in got else pa.nulls(len(raw), arrow.field(c).type) for c in self.schema.names], schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class LasWriter(DataSourceArrowWriter):
    """Each task writes files with names of its own below `path`; those of lost attempts are removed or stay hidden."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        if any(c not in schema.names for c in "XYZ"):
            raise ValueError("a LAS file needs X, Y, Z")
        bad = [f.name for f in schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        if bad:
            raise TypeError(f"{', '.join(bad)}: only numbers are points' attributes")
        self.schema, self.path, self.most, self.step = schema, options["path"], int(options.get("maxrecordsperfile", 2_000_000)), float(options.get("scale", 0.001))
        prepare(self.path, "overwrite" if overwrite else "append")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        held, n, files = [], 0, []

        def flush():
            name = f".draft-{uuid.uuid4().hex}.las"
            save(f"{self.path}/{name}", encoded(pa.Table.from_batches(held), self.step))
            files.append(name)
            held.clear()

        for b in batches:
            for i in range(0, b.num_rows, self.most):
                piece = b.slice(i, self.most)
                if n and n + piece.num_rows > self.most:
                    flush()
                    n = 0
                held.append(piece)
                n += piece.num_rows
        if n:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.move(f"{at}/{name}", f"{at}/{name.replace('.draft', 'part')}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = store(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{at}/{name}")


def encoded(t: pa.Table, step: float = 0.001) -> bytes:
    """A version 1.4 file of point format 7.  Null coordinates are an error; other nulls become 0, or NaN in extra doubles."""
    base = dict(FORMATS[7])
    whole = [c for c in _WHOLE if c in t.column_names and c != "NIR"]
    own = {c: "<f8" if pa.types.is_floating(t.schema.field(c).type) or pa.types.is_decimal(t.schema.field(c).type) else "<i8" for c in t.column_names if c not in base and c not in whole}
    raw = np.zeros(t.num_rows, np.dtype([*FORMATS[7], *own.items()]))
    xyz = np.column_stack([t[a].cast(pa.float64()).to_numpy() for a in "XYZ"]) if t.num_rows else np.zeros((0, 3))
    if not np.isfinite(xyz).all():
        raise ValueError("a point has no coordinates")
    lo, hi = (f(0) if t.num_rows else np.zeros(3) for f in (xyz.min, xyz.max))
    off = np.floor(lo)
    for i, a in enumerate("XYZ"):
        raw[a] = np.rint((xyz[:, i] - off[i]) / step)
    get = lambda c: t[c].cast(pa.int64()).fill_null(0).to_numpy() if c in t.column_names else 0
    for c in whole:
        if c in base:
            raw[c] = get(c)
    raw["flags"], raw["class"] = (get("ReturnNumber") & 15) | ((get("NumberOfReturns") & 15) << 4), get("Classification")
    if "gpstime" in t.column_names:
        raw["gpstime"] = t["gpstime"].cast(pa.float64()).fill_null(0).to_numpy()
    for c, kind in own.items():
        raw[c] = t[c].cast(pa.float64()).fill_null(float("nan")).to_numpy() if kind == "<f8" else t[c].cast(pa.int64()).fill_null(0).to_numpy()
    tag = b"".join(struct.pack("<HBB32s156x", 0, 10 if k == "<f8" else 8, 0, c.encode()[:32]) for c, k in own.items())
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(tag), b"extra bytes") + tag if own else b""
    h = bytearray(375)
    struct.pack_into("<4s", h, 0, b"LASF")
    struct.pack_into("<BB32s32sHHHII", h, 24, 1, 4, b"", b"boscage", 1, 1, 375, 375 + len(record), 1 if own else 0)
    struct.pack_into("<BHI", h, 104, 7, raw.dtype.itemsize, 0)
    struct.pack_into("<6d", h, 131, step, step, step, *off)
    struct.pack_into("<6d", h, 179, *(x for a in range(3) for x in (hi[a], lo[a])))
    struct.pack_into("<Q", h, 247, t.num_rows)
    return bytes(h) + record + raw.tobytes()


class Las(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        """Columns of all the files, or the selected ones; a file that lacks one gives nulls."""
        columns: dict[str, T.DataType] = {}
        for path in names(self.options["path"], ".las"):
            columns |= {c: k for c, k in header(path).columns().items() if c not in columns or isinstance(k, T.DoubleType)}
        chosen = [c.strip() for c in self.options.get("select", ",".join(columns)).split(",") if c.strip()]
        missing = [c for c in chosen if c not in columns]
        if missing:
            raise ValueError(f"the files have no {', '.join(missing)}")
        return T.StructType([T.StructField(c, columns[c]) for c in chosen])

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> LasWriter:
        return LasWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Las)
