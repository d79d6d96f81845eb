"""Data source `sav_wide`: an SPSS system file (.sav, plain or with byte compression) as a wide table, and a writer of such files.

Numbers come out as text codes, whole ones without decimals; missing values as null; texts without trailing spaces. The character set
is that of the file, else UTF-8, else Windows-1252. Value labels and variable labels come with `metadata`. Options: path.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Fixed values of the format: record types, the bias of compressed bytes, and the system-missing number.
VARIABLE, LABELS, LABELLED, DOCUMENT, EXTENSION, END = 2, 3, 4, 6, 7, 999
MISSING = -1.7976931348623157e308
BIAS = 100.0


@dataclass
class Variable:
    name: str
    width: int  # 0: a number; else bytes of text
    label: str = ""
    options: dict[str, str] = field(default_factory=dict)


def code_text(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


class SavFile:
    """The dictionary of a file; rows() yields its cases."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            if f.read(4) != b"$FL2":
                raise ValueError(f"{path} is no SPSS system file")
            f.read(60)
            raw = f.read(4)
            self.order = "<" if struct.unpack("<i", raw)[0] in (2, 3) else ">"
            _, self.compression, _, self.cases = struct.unpack(f"{self.order}4i", f.read(16))
            self.bias = struct.unpack(f"{self.order}d", f.read(8))[0]
            f.read(84)
            self._slots: list[Variable | None] = []
            self._raw: list[tuple[Variable, bytes, bytes]] = []
            encoding, long_names, pending = None, {}, {}
            labels: list[tuple[dict[bytes, bytes], list[int]]] = []
            while True:
                kind = self._int(f)
                if kind == VARIABLE:
                    self._variable(f)
                elif kind == LABELS:
                    pending = {}
                    for _ in range(self._int(f)):
                        value, size = f.read(8), f.read(1)[0]
                        pending[value] = f.read((size + 8) // 8 * 8 - 1)[:size]
                elif kind == LABELLED:
                    labels.append((pending, [self._int(f) - 1 for _ in range(self._int(f))]))
                elif kind == DOCUMENT:
                    f.read(80 * self._int(f))
                elif kind == EXTENSION:
                    sub, size, count = self._int(f), self._int(f), self._int(f)
                    data = f.read(size * count)
                    if sub == 20:
                        encoding = data.decode("ascii", "replace").strip()
                    elif sub == 13:
                        long_names = dict(p.split(b"=", 1) for p in data.split(b"\t") if b"=" in p)
                elif kind == END:
                    self._int(f)
                    break
                else:
                    raise ValueError(f"unknown record {kind} in {path}")
            self.start = f.tell()
        self.encoding = encoding or "utf-8"
        for variable, name, label in self._raw:
            variable.name = self.text(long_names.get(name, name)).strip()
            variable.label = self.text(label)
        for values, places in labels:
            for place in places:
                v = self._slots[place]
                for raw_value, label in values.items():
                    key = self.text(raw_value).rstrip() if v.width else code_text(struct.unpack(f"{self.order}d", raw_value)[0])
                    v.options[key] = self.text(label)
        self.variables = [v for v, _, _ in self._raw]

    def _int(self, f) -> int:
        raw = f.read(4)
        if len(raw) < 4:
            raise ValueError(f"{self.path} ends early")
        return struct.unpack(f"{self.order}i", raw)[0]

    def _variable(self, f) -> None:
        width, labelled, missing, _, _ = struct.unpack(f"{self.order}5i", f.read(20))
        name = f.read(8).rstrip()
        label = b""
        if labelled:
            size = self._int(f)
            label = f.read((size + 3) // 4 * 4)[:size]
        f.read(8 * abs(missing))
        if width == -1:
            self._slots.append(None)
        else:
            self._slots.append(Variable("", width))
            self._raw.append((self._slots[-1], name, label))

    def text(self, raw: bytes) -> str:
        for encoding in (self.encoding, "utf-8", "cp1252"):
            try:
                return raw.decode(encoding)
            except (UnicodeDecodeError, LookupError):
                pass
        return raw.decode("latin-1")

    def _words(self) -> Iterator[bytes | float | None]:
        """The 8-byte elements of the cases, one after the other: bytes as they are, numbers of compressed bytes, None for missing."""
        with open(self.path, "rb") as f:
            f.seek(self.start)
            if not self.compression:
                while len(raw := f.read(8)) == 8:
                    yield raw
                return
            while len(codes := f.read(8)) == 8:
                for code in codes:
                    if code == 0:
                        continue
                    if code == 252:
                        return
                    yield f.read(8) if code == 253 else b" " * 8 if code == 254 else None if code == 255 else code - self.bias

    def rows(self) -> Iterator[tuple]:
        words = self._words()
        slots = self._slots
        while True:
            case = []
            for word in words:
                case.append(word)
                if len(case) == len(slots):
                    break
            if len(case) < len(slots) or not slots:
                return
            out, k = [], 0
            for v in self.variables:
                if not v.width:
                    word = case[k]
                    number = word if word is None or isinstance(word, float) else struct.unpack(f"{self.order}d", word)[0]
                    out.append(None if number is None or number == MISSING or number != number else code_text(number))
                    k += 1
                else:
                    n = (v.width + 7) // 8
                    data = b"".join(w if isinstance(w, bytes) else b" " * 8 for w in case[k : k + n])[: v.width]
                    out.append(self.text(data).strip() or None)
                    k += n
            yield tuple(out)


def metadata(path: str) -> list[dict]:
    """Each variable's codigo, texto, tipo (texto or numero) and opciones (labels by code)."""
    return [{"codigo": v.name, "texto": v.label, "tipo": "texto" if v.width else "numero", "opciones": v.options} for v in SavFile(path).variables]


def write_sav(path: str, variables: list[Variable], rows: Iterator[tuple]) -> int:
    """Writes rows (numbers, texts or None) as an uncompressed file in UTF-8; returns the number of cases. Texts have at most 255 bytes."""
    cases = 0
    with open(path, "wb") as f:
        slots = sum(max(1, (v.width + 7) // 8) for v in variables)
        f.write(b"$FL2" + b"@(#) SPSS DATA FILE".ljust(60) + struct.pack("<5id", 2, slots, 0, 0, -1, BIAS) + b"01 Jan 0000:00:00" + b" " * 64 + b"   ")
        at, places = 1, []
        for k, v in enumerate(variables):
            label = v.label.encode()[:252]
            kind = 1 << 16 | max(v.width, 8) << 8 if v.width else 5 << 16 | 8 << 8
            f.write(struct.pack("<6i", VARIABLE, v.width, int(bool(label)), 0, kind, kind) + f"V{k}".encode().ljust(8))
            if label:
                f.write(struct.pack("<i", len(label)) + label.ljust((len(label) + 3) // 4 * 4))
            more = max(1, (v.width + 7) // 8) - 1
            for _ in range(more):
                f.write(struct.pack("<6i", VARIABLE, -1, 0, 0, kind, kind) + b" " * 8)
            places.append(at)
            at += 1 + more
        for v, place in zip(variables, places):
            if v.options and v.width <= 8:
                f.write(struct.pack("<2i", LABELS, len(v.options)))
                for code, label in v.options.items():
                    data = label.encode()[:120]
                    f.write((code.encode().ljust(8)[:8] if v.width else struct.pack("<d", float(code))) + bytes([len(data)]) + data.ljust((len(data) + 8) // 8 * 8 - 1))
                f.write(struct.pack("<3i", LABELLED, 1, place))
        names = "\t".join(f"V{k}={v.name}" for k, v in enumerate(variables)).encode()
        for sub, data in ((13, names), (20, b"UTF-8")):
            f.write(struct.pack("<4i", EXTENSION, sub, 1, len(data)) + data)
        f.write(struct.pack("<2i", END, 0))
        for row in rows:
            for v, value in zip(variables, row):
                if v.width:
                    f.write((value or "").encode()[: v.width].ljust((v.width + 7) // 8 * 8))
                else:
                    f.write(struct.pack("<d", MISSING if value is None else float(value)))
            cases += 1
    return cases


class SavReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from SavFile(partition.value).rows()


class SavWide(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sav_wide"

    def schema(self) -> StructType:
        return StructType([StructField(v.name, StringType()) for v in SavFile(self.options["path"]).variables])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SavReader(self.options["path"])
