"""Self-describing binary flight logs as rows.

A record is A3 95, a type byte and a payload. Type 80 describes a type: id, total length, name[4],
format[16], columns[64], as printable ASCII padded with zeros. A later description of the same id replaces an earlier one, wherever its
bytes stand. Here are the format itself, on bytes in memory, and views of records; `logscan` reads folders.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYNC, DESCRIPTION, DESCRIBED = b"\xa3\x95", 0x80, struct.Struct("<BB4s16s64s")
#: Format characters and their codes; those scaled by a hundredth; degrees in ten millionths. Fixed values.
CODES = {
    "b": "b", "B": "B", "h": "h", "H": "H", "i": "i", "I": "I", "f": "f", "d": "d", "n": "4s", "N": "16s", "Z": "64s",
    "c": "h", "C": "H", "e": "i", "E": "I", "L": "i", "M": "B", "q": "q", "Q": "Q",
}
HUNDREDTHS, DEGREES = "cCeE", "L"
#: A text of a description.
PADDED = re.compile(rb"[ -~]*\0*")


def text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("ascii", "replace").strip()


def description(body: bytes) -> tuple[int, tuple] | None:
    """(type id, (length, name, format, fields, layout)) of the payload of a description.

    None without a name or a format, and if a text isn't printable ASCII with zeros behind it: the mark of a description
    also turns up by chance in the numbers of a record, about once in 16 MB of them.
    """
    kind, length, name, form, names = DESCRIBED.unpack(body)
    if not all(PADDED.fullmatch(t) for t in (name, form, names)):
        return None
    name, form, names = text(name), text(form), [n.strip() for n in text(names).split(",") if n.strip()]
    if not name or not form:
        return None
    # an unknown character is left out of the layout, but its column name goes with it
    fields = [(names[i] if i < len(names) else f"field_{i}", c) for i, c in enumerate(form) if c in CODES]
    return kind, (length, name, form, fields, struct.Struct("<" + "".join(CODES[c] for _, c in fields)))


def descriptions(data: bytes) -> dict[int, tuple]:
    """type id -> (length, name, format, fields, layout), the last of each id."""
    out, at = {}, data.find(SYNC + bytes([DESCRIPTION]))
    while at >= 0:
        body = data[at + 3 : at + 3 + DESCRIBED.size]
        found = description(body) if len(body) == DESCRIBED.size else None
        if found:
            out[found[0]] = found[1]
        at = data.find(SYNC + bytes([DESCRIPTION]), at + 1)
    return out


def value(raw, code: str):
    if isinstance(raw, bytes):
        return text(raw)
    return raw / 100 if code in HUNDREDTHS else raw / 1e7 if code in DEGREES else raw


def scanned(data: bytes, types: dict[int, tuple]) -> Iterator[tuple[int, str, dict]]:
    """(offset, name, fields) of the records, stepping over what can't be one."""
    at = data.find(SYNC)
    while 0 <= at < len(data) - 2:
        kind, step = data[at + 2], 3
        found = types.get(kind)
        if kind == DESCRIPTION:
            step = 3 + DESCRIBED.size
        elif found and found[0]:
            length, name, _, fields, layout = found
            if at + length > len(data):
                step = 1
            else:
                step = length if length > 3 else 4
                if length - 3 >= layout.size:
                    yield at, name, {n: value(v, c) for (n, c), v in zip(fields, layout.unpack_from(data, at + 3))}
        at = data.find(SYNC, at + step)


def field(name: str, *others: str, kind: str = "double", default=None):
    """A field of the JSON column: the first of its names that the record has, read as `kind`."""
    found = F.coalesce(*(F.get_json_object("fields", f"$.{n}") for n in (name, *others))).try_cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def gps(records: DataFrame) -> DataFrame:
    """file, seq, t, lat, lon, alt, status, nsats, hdop of GPS records that have time, place and status."""
    r = records.where("name = 'GPS'")
    return r.select("file", "seq", "t", field("Lat").alias("lat"), field("Lng", "Lon").alias("lon"), field("Alt").alias("alt"), field("Status", kind="long").alias("status"), field("NSats", "Nsats", kind="long", default=0).alias("nsats"), field("HDop", "Hdop", default=99.99).alias("hdop")).dropna(subset=["t", "lat", "lon", "alt", "status"])


def baro(records: DataFrame) -> DataFrame:
    return records.where("name = 'BARO'").select("file", "seq", "t", field("Alt").alias("alt")).dropna()


def ekf(records: DataFrame) -> DataFrame:
    """Innovations of either estimator's records; source is 0 for the newer name, which comes first at equal times (order by t, source, seq)."""
    r = records.where(F.col("name").isin("XKF1", "NKF1"))
    return r.select("file", "seq", F.when(F.col("name") == "XKF1", 0).otherwise(1).alias("source"), "t", field("IVN", "VN", default=0.0).alias("ivn"), field("IVE", "VE", default=0.0).alias("ive"), field("IVD", "VD", default=0.0).alias("ivd")).dropna(subset=["t"])


def params(records: DataFrame) -> DataFrame:
    return records.where("name = 'PARM'").select("file", "seq", field("Name", kind="string").alias("param"), field("Value").alias("value")).dropna()


def written(types: list[tuple[int, str, str, str]], records: list[tuple[int, tuple]]) -> bytes:
    """Bytes of a log: types as (id, name, format, columns), records as (id, raw values). For tests and examples."""
    out, layouts = b"", {}
    for kind, name, form, names in types:
        layouts[kind] = struct.Struct("<" + "".join(CODES[c] for c in form if c in CODES))
        out += SYNC + bytes([DESCRIPTION]) + DESCRIBED.pack(kind, 3 + layouts[kind].size, name.encode(), form.encode(), names.encode())
    return out + b"".join(SYNC + bytes([kind]) + layouts[kind].pack(*values) for kind, values in records)
