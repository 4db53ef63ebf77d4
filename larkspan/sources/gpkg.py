"""GeoPackage files as a Spark data source: ``spark.read.format("gpkg").option("path", ...)``.

Options: ``environment`` and ``bbox`` (four numbers, comma-separated) restrict what is read, ``partitions`` cuts the file by
row number. A filter on ``environmnt`` is pushed into the file's own query.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "hex_ord long, h3_res9_id string, minsignal double, environmnt int, ring array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double, brandname string, technology string"
REQUIRED = ("minsignal", "environmnt", "h3_res9_id")
# Fixed values of the format: bytes of the envelope by its indicator.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def parse_blob(blob: bytes) -> tuple[bytes | None, tuple[float, float, float, float] | None]:
    """WKB (None if empty) and envelope (min x, min y, max x, max y; None if absent) of a geometry blob."""
    if len(blob) < 8 or blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    flags = blob[3]
    kind = flags >> 1 & 7
    if kind not in ENVELOPE_BYTES:
        raise ValueError(f"unknown envelope indicator {kind}")
    box = None
    if kind:
        a, b, c, d = struct.unpack_from(("<" if flags & 1 else ">") + "4d", blob, 8)
        box = (a, c, b, d)
    return (None if flags & 16 else bytes(blob[8 + ENVELOPE_BYTES[kind] :])), box


def parse_ring(wkb: bytes) -> list[tuple[float, float]]:
    """Outer ring of a polygon, or of the first polygon of several, without the closing vertex."""
    at = 0

    def read(fmt: str):
        nonlocal at
        order = "<" if wkb[start] else ">"
        out = struct.unpack_from(order + fmt, wkb, at)
        at += struct.calcsize(order + fmt)
        return out

    start, at = 0, 1
    (kind,) = read("I")
    if kind % 1000 == 6:
        read("I")
        start = at
        at += 1
        (kind,) = read("I")
    if kind % 1000 != 3:
        raise ValueError(f"geometry type {kind} is no polygon")
    width = {0: 2, 1: 3, 2: 3, 3: 4}[kind // 1000]
    (rings,) = read("I")
    if not rings:
        return []
    (n,) = read("I")
    flat = read(f"{n * width}d")
    ring = [(flat[i * width], flat[i * width + 1]) for i in range(n)]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def feature_table(conn: sqlite3.Connection) -> tuple[str, str]:
    """Name and geometry column of the first feature layer."""
    row = conn.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) WHERE c.data_type = 'features' ORDER BY c.rowid LIMIT 1").fetchone()
    if row is None:
        raise ValueError("the file has no feature layer")
    return row


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GpkgReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.environment = int(options["environment"]) if options.get("environment") not in (None, "") else None
        self.box = tuple(float(v) for v in options["bbox"].split(",")) if options.get("bbox") else None
        self.parts = int(options.get("partitions", 1))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("environmnt",) and self.environment is None:
                self.environment = int(f.value)
            else:
                yield f

    def partitions(self):
        with _open(self.path) as conn:
            table, _ = feature_table(conn)
            have = {r[1] for r in conn.execute(f'PRAGMA table_info("{table}")')}
            if missing := [c for c in REQUIRED if c not in have]:
                raise ValueError(f"the layer lacks {', '.join(missing)}")
            low, high = conn.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        with _open(self.path) as conn:
            table, geom = feature_table(conn)
            have = {r[1] for r in conn.execute(f'PRAGMA table_info("{table}")')}
            extra = [f'"{c}"' if c in have else "NULL" for c in ("brandname", "technology")]
            where = "" if self.environment is None else f" AND environmnt = {self.environment}"
            sql = f'SELECT rowid, h3_res9_id, minsignal, environmnt, "{geom}", {", ".join(extra)} FROM "{table}" WHERE rowid >= ? AND rowid < ?{where} ORDER BY rowid'
            for ord_, h3, level, env, blob, brand, tech in conn.execute(sql, (part.low, part.high)):
                if blob is None:
                    continue
                wkb, box = parse_blob(blob)
                if wkb is None or box is not None and self._outside(box):
                    continue
                ring = parse_ring(wkb)
                if not ring:
                    continue
                xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                own = (min(xs), min(ys), max(xs), max(ys))
                if box is None and self._outside(own):
                    continue
                yield (ord_, h3, None if level is None else float(level), env, ring, *own, brand, tech)

    def _outside(self, b: tuple[float, float, float, float]) -> bool:
        q = self.box
        return q is not None and (b[2] < q[0] or b[0] > q[2] or b[3] < q[1] or b[1] > q[3])


class GpkgSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GpkgReader:
        return GpkgReader(dict(self.options))


def register(spark) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GpkgSource)


def write(path: str, rows: list[tuple], envelope: bool = True, table: str = "coverage") -> None:
    """A small file with a layer of (minsignal, environmnt, h3_res9_id, ring), for tests and exchange."""
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, identifier TEXT, srs_id INT)")
        conn.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT, z INT, m INT)")
        conn.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY, geom BLOB, minsignal INT, environmnt INT, h3_res9_id TEXT)')
        conn.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (table, table))
        conn.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', 4326, 0, 0)", (table,))
        for level, env, h3, ring in rows:
            closed = [*ring, ring[0]] if ring else []
            xs, ys = [p[0] for p in ring] or [0.0], [p[1] for p in ring] or [0.0]
            head = b"GP\0" + bytes([(1 | 2 * envelope) | (16 if not ring else 0)]) + struct.pack("<i", 4326)
            box = struct.pack("<4d", min(xs), max(xs), min(ys), max(ys)) if envelope else b""
            body = struct.pack("<BIII", 1, 3, 1, len(closed)) + b"".join(struct.pack("<2d", *p) for p in closed)
            conn.execute(f'INSERT INTO "{table}" (geom, minsignal, environmnt, h3_res9_id) VALUES (?, ?, ?, ?)', (head + box + body, level, env, h3))
    conn.close()
