"""PE and Mach-O files to numeric features, by small readers of their headers.

Files come from ``binaryFile``; each gives rows of a map from feature name to number and lists of
names. A file that can't be read gives a row with ``error`` set and what was read until then.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.yara import MACHO_COMMANDS, PE_FILE_HEADER, PE_OPTIONAL

SCHEMA = "filename string, features map<string,double>, section_names array<string>, imported_symbols array<string>, exported_symbols array<string>, warnings array<string>, error string"
DIRECTORIES = ("export", "import", "resource", "exception", "security", "basereloc", "debug", "copyright", "globalptr", "tls", "load_config", "bound_import", "iat", "delay_import", "com_descriptor", "reserved")
#: Names of standard sections, and numbers of sections with long names.
STANDARD_SECTIONS = frozenset(
    (
        ".text", ".bss", ".rdata", ".data", ".rsrc", ".edata", ".idata", ".pdata", ".debug", ".reloc", ".stab", ".stabstr", ".tls",
        ".crt", ".gnu_deb", ".eh_fram", ".exptbl", ".rodata",
    )
) | {f"/{i}" for i in range(200)}
_CODES = {1: "B", 2: "H", 4: "I", 8: "Q"}


def byte_entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def _fields(data: bytes, at: int, layout) -> dict[str, int]:
    out = {}
    for name, width in layout:
        if at + width > len(data):
            break
        out[name] = struct.unpack_from("<" + _CODES[width], data, at)[0]
        at += width
    return out


def image_checksum(data: bytes, field: int) -> int:
    """The checksum that an image should state: its 16-bit words added with end-around carry, without the field itself, plus its length."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), dtype="<u2")
    total = int(words.sum(dtype=np.uint64)) - sum(int(words[i]) for i in (field // 2, field // 2 + 1) if i < len(words))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total + len(data)


def _text(data: bytes, at: int, most: int = 512) -> str:
    end = data.find(b"\0", at, at + most)
    return data[at : end if end >= 0 else at + most].decode("ascii", "replace")


class Pe:
    """Headers, sections, imports and exports of a PE image."""

    def __init__(self, data: bytes):
        self.features: dict[str, float] = {"total_size_pe": float(len(data))}
        self.sections: list[tuple[str, int, int, int, int]] = []
        self.imports: list[str] = []
        self.exports: list[str] = []
        self.exported: set[str] = set()
        self.warnings: list[str] = []
        self.data = data
        if data[:2] != b"MZ" or len(data) < 64:
            raise ValueError("no DOS header")
        self.lfanew = struct.unpack_from("<I", data, 60)[0]
        if data[self.lfanew : self.lfanew + 4] != b"PE\0\0":
            raise ValueError("no PE signature")
        self.header = _fields(data, self.lfanew + 4, PE_FILE_HEADER)
        at = self.lfanew + 24
        magic = struct.unpack_from("<H", data, at)[0]
        layout = PE_OPTIONAL.get(magic, PE_OPTIONAL[0x10B])
        self.optional = _fields(data, at, layout)
        at += sum(w for _, w in layout)
        self.directories = {}
        for name in DIRECTORIES[: min(16, self.optional.get("number of rva and sizes", 0))]:
            if at + 8 <= len(data):
                self.directories[name] = struct.unpack_from("<II", data, at)
            at += 8
        at = self.lfanew + 24 + self.header.get("size of optional header", 0)
        for _ in range(self.header.get("number of sections", 0)):
            if at + 40 > len(data):
                self.warnings.append("section table is cut")
                break
            raw, vsize, va, size, ptr = data[at : at + 8], *struct.unpack_from("<IIII", data, at + 8)
            self.sections.append((raw.rstrip(b"\0").decode("ascii", "replace"), va, vsize, ptr, size))
            at += 40
        self._imports(magic == 0x20B)
        self._bound_imports()
        self._exports()
        self._warn()

    def _warn(self) -> None:
        """What looks wrong in the headers."""
        for name, va, vsize, ptr, size in self.sections:
            if size and ptr + size > len(self.data):
                self.warnings.append(f"section {name} goes beyond the end of the file")
        if self.optional.get("number of rva and sizes", 0) > 16:
            self.warnings.append("more than 16 data directories are stated")
        entry = self.optional.get("address of entry point", 0)
        if entry and self._at(entry) is None:
            self.warnings.append("the entry point lies outside of all sections")
        for name in ("import", "export", "resource"):
            rva = self.directories.get(name, (0, 0))[0]
            if rva and self._at(rva) is None:
                self.warnings.append(f"the {name} directory lies outside of all sections")

    def _at(self, rva: int) -> int | None:
        for _, va, vsize, ptr, size in self.sections:
            if va <= rva < va + max(vsize, size):
                return rva - va + ptr
        return None

    def _imports(self, wide: bool) -> None:
        at = self._at(self.directories.get("import", (0, 0))[0]) if self.directories.get("import", (0, 0))[0] else None
        width, flag = (8, 1 << 63) if wide else (4, 1 << 31)
        libraries = 0
        while at is not None and at + 20 <= len(self.data):
            lookup, _, _, name, first = struct.unpack_from("<IIIII", self.data, at)
            if not name:
                break
            where = self._at(name)
            dll = _text(self.data, where).lower() if where is not None else ""
            libraries += 1
            thunk = self._at(lookup or first)
            shift = self._at(first) - thunk if lookup and first and thunk is not None and self._at(first) is not None else 0
            while thunk is not None and thunk + width <= len(self.data):
                value = struct.unpack_from("<" + _CODES[width], self.data, thunk)[0]
                if not value:
                    break
                bound = struct.unpack_from("<" + _CODES[width], self.data, thunk + shift)[0] if 0 <= thunk + shift <= len(self.data) - width else value
                mark = f" bound={bound}" if bound not in (0, value) else ""
                if value & flag:
                    self.imports.append(f"{dll}:ordinal={value & 0xFFFF}{mark}")
                elif (place := self._at(value)) is not None:
                    self.imports.append(f"{dll}:name={_text(self.data, place + 2)}{mark}".lower())
                thunk += width
            at += 20
        self.features |= {"number_of_imports": libraries, "number_of_import_symbols": len(self.imports)}

    def _bound_imports(self) -> None:
        """Libraries whose addresses were bound, and the libraries they forward to."""
        at, libraries, forwarded = self.directories.get("bound_import", (0, 0))[0], 0, 0
        while at and at + 8 <= len(self.data):
            stamp, name, refs = struct.unpack_from("<IHH", self.data, at)
            if not (stamp or name or refs):
                break
            libraries, forwarded, at = libraries + 1, forwarded + refs, at + 8 + 8 * refs
        self.features |= {"number_of_bound_imports": libraries, "number_of_bound_import_symbols": forwarded}

    def _exports(self) -> None:
        """Names, and ordinals of functions without one."""
        at = self._at(self.directories.get("export", (0, 0))[0]) if self.directories.get("export", (0, 0))[0] else None
        if at is not None and at + 40 <= len(self.data):
            base, functions, count, addresses, names, ordinals = struct.unpack_from("<IIIIII", self.data, at + 16)
            table, numbers, places, seen = self._at(names), self._at(ordinals), self._at(addresses), set()
            for i in range(count):
                if table is None or table + 4 * i + 4 > len(self.data):
                    break
                if (place := self._at(struct.unpack_from("<I", self.data, table + 4 * i)[0])) is not None:
                    self.exports.append(_text(self.data, place))
                if numbers is not None and numbers + 2 * i + 2 <= len(self.data):
                    seen.add(struct.unpack_from("<H", self.data, numbers + 2 * i)[0])
            self.exported = {f"name={n}".lower() for n in self.exports}
            bare = 0
            for i in range(functions):
                if places is None or places + 4 * i + 4 > len(self.data):
                    break
                if i not in seen and struct.unpack_from("<I", self.data, places + 4 * i)[0]:
                    bare += 1
                    self.exported.add(f"ordinal={base + i}")
            self.features["number_of_export_symbols"] = len(self.exports) + bare
        self.features.setdefault("number_of_export_symbols", 0)

    def resources(self):
        """(type, language, rva, size) of each resource, in the tree's order; a type is a number or a name."""
        root = self._at(self.directories.get("resource", (0, 0))[0]) if self.directories.get("resource", (0, 0))[0] else None
        seen = set()

        def below(at: int, path: tuple):
            if at in seen or at + 16 > len(self.data):
                return
            seen.add(at)
            for i in range(sum(struct.unpack_from("<HH", self.data, at + 12))):
                if at + 24 + 8 * i > len(self.data):
                    return
                name, to = struct.unpack_from("<II", self.data, at + 16 + 8 * i)
                if name >> 31:
                    where = root + (name & 0x7FFFFFFF)
                    length = struct.unpack_from("<H", self.data, where)[0] if where + 2 <= len(self.data) else 0
                    name = self.data[where + 2 : where + 2 + 2 * length].decode("utf-16-le", "replace")
                if to >> 31:
                    if len(path) < 2:
                        yield from below(root + (to & 0x7FFFFFFF), (*path, name))
                elif len(path) == 2 and root + to + 8 <= len(self.data):
                    rva, size = struct.unpack_from("<II", self.data, root + to)
                    yield path[0], name & 0x3FF if isinstance(name, int) else 0, rva, size

        if root is not None:
            yield from below(root, ())

    def version_strings(self) -> list[tuple[str, str]]:
        """Keys and values of the string tables of the version information."""
        out: list[tuple[str, str]] = []

        def node(at: int, end: int, depth: int) -> int:
            length, value, _ = struct.unpack_from("<HHH", self.data, at)
            end, stop = min(end, at + length), at + 6
            while stop + 2 <= end and self.data[stop : stop + 2] != b"\0\0":
                stop += 2
            key, start = self.data[at + 6 : stop].decode("utf-16-le", "replace"), (stop + 5) // 4 * 4
            if depth == 3:
                out.append((key, self.data[start:end].decode("utf-16-le", "replace").split("\0", 1)[0]))
            elif not depth or depth == 1 and key == "StringFileInfo" or depth == 2:
                inner = (start + (value if not depth else 0) + 3) // 4 * 4
                while inner + 6 <= end:
                    inner = node(inner, end, depth + 1)
            return (at + max(length, 6) + 3) // 4 * 4

        for kind, _, rva, size in self.resources():
            at = self._at(rva)
            if kind == 16 and at is not None and at % 4 == 0 and at + 6 <= len(self.data):
                node(at, min(len(self.data), at + size), 0)
        return out

    def dense(self) -> dict[str, float]:
        f, h, o = self.features, self.header, self.optional
        chars = h.get("characteristics", 0)
        f |= {
            "number_of_sections": len(self.sections), "compile_date": h.get("time date stamp", 0), "check_sum": o.get("checksum", 0), "pe_char": chars,
            "major_version": o.get("major image version", 0), "minor_version": o.get("minor image version", 0), "number_of_rva_and_sizes": o.get("number of rva and sizes", 0),
            "pe_majorlink": o.get("major linker version", 0), "pe_minorlink": o.get("minor linker version", 0), "size_code": o.get("size of code", 0), "size_image": o.get("size of image", 0),
            "size_initdata": o.get("size of initialized data", 0), "size_uninit": o.get("size of uninitialized data", 0), "pe_dll": int(bool(chars & 0x2000)), "pe_exe": int(bool(chars & 2) and not chars & 0x2000),
            "pe_driver": int(o.get("subsystem", 0) == 1), "pe_i386": int(h.get("machine") == 0x14C), "pe_warnings": int(bool(self.warnings)),
            "std_section_names": int(all(n.lower() in STANDARD_SECTIONS for n, *_ in self.sections)),
            "iat_rva": self.directories.get("import", (0, 0))[0], "generated_check_sum": image_checksum(self.data, self.lfanew + 88), "debug_size": self.directories.get("debug", (0, 0))[1], "export_size": self.directories.get("export", (0, 0))[1],
            "sec_raw_execsize": sum(s[4] for s in self.sections), "sec_va_execsize": sum(s[2] for s in self.sections),
        }
        for name in ("export", "import", "resource", "basereloc", "iat"):
            if name in self.directories:
                f[f"datadir_image_directory_entry_{name}_size"] = self.directories.get(name, (0, 0))[1]
        for i, (name, va, vsize, ptr, size) in enumerate(self.sections):
            if i == 0:
                f |= {"virtual_address": va, "virtual_size": vsize}
            elif i == 1:
                f["virtual_size_2"] = vsize
            bare = name.replace(".", "").lower()
            f |= {f"sec_entropy_{bare}": byte_entropy(self.data[ptr : ptr + size]), f"sec_rawptr_{bare}": ptr, f"sec_rawsize_{bare}": size, f"sec_vasize_{bare}": vsize}
        return {k: float(v) for k, v in f.items()}

    def clustering(self) -> dict[str, float]:
        """Header, optional header and data-directory numbers by their names, and place, size and language of the first two resources."""
        dirs = {f"{n} {part}": v for n, pair in list(self.directories.items())[:8] for part, v in zip(("rva", "size"), pair)}
        for i, (_, lang, rva, size) in enumerate(islice(self.resources(), 2)):
            dirs |= {f"resource {i} rva": rva, f"resource {i} size": size, f"resource {i} lang": lang}
        return {k: float(v) for k, v in ({"lfanew": self.lfanew} | self.header | self.optional | dirs).items()}


MACHO_MAGICS = {0xFEEDFACE: ("<", 28), 0xFEEDFACF: ("<", 32), 0xCEFAEDFE: (">", 28), 0xCFFAEDFE: (">", 32)}
MACHO_NAMES = {0x1: "LC_SEGMENT", 0x2: "LC_SYMTAB", 0xB: "LC_DYSYMTAB", 0xC: "LC_LOAD_DYLIB", 0xE: "LC_LOAD_DYLINKER", 0x19: "LC_SEGMENT_64", 0x1B: "LC_UUID", 0x22: "LC_DYLD_INFO", 0x80000022: "LC_DYLD_INFO_ONLY", 0x24: "LC_VERSION_MIN_MACOSX", 0x80000028: "LC_MAIN", 0x1D: "LC_CODE_SIGNATURE", 0x26: "LC_FUNCTION_STARTS"}


def macho(data: bytes) -> list[dict[str, float]]:
    """Numbers of each architecture of a Mach-O file: ``LC_*`` counters and ``lc_*`` fields."""
    if len(data) < 28:
        raise ValueError("too short")
    starts = [0]
    if data[:4] == b"\xca\xfe\xba\xbe":
        count = struct.unpack_from(">I", data, 4)[0]
        starts = [struct.unpack_from(">I", data, 8 + 20 * i + 8)[0] for i in range(count) if 28 + 20 * i <= len(data)]
    out = []
    for start in starts:
        order, size = MACHO_MAGICS.get(struct.unpack_from("<I", data, start)[0], ("", 0))
        if not order:
            raise ValueError("no Mach-O magic")
        f: Counter = Counter({"number of architectures": len(starts)})
        ncmds = struct.unpack_from(order + "I", data, start + 16)[0]
        at = start + size
        for _ in range(ncmds):
            if at + 8 > len(data):
                break
            cmd, length = struct.unpack_from(order + "II", data, at)
            name = MACHO_NAMES.get(cmd, f"LC_{cmd:#x}")
            f[name] += 1
            f[f"{name}:{length}"] += 1
            short = {"LC_SYMTAB": "symtab", "LC_DYSYMTAB": "dysymtab", "LC_DYLD_INFO": "dyld_info", "LC_DYLD_INFO_ONLY": "dyld_info"}.get(name)
            if short:
                for i, field in enumerate(MACHO_COMMANDS[short]):
                    if at + 12 + 4 * i <= len(data):
                        f[f"lc_{short}_{field}"] = struct.unpack_from(order + "I", data, at + 8 + 4 * i)[0]
            elif name in ("LC_SEGMENT", "LC_SEGMENT_64") and data[at + 8 : at + 24].rstrip(b"\0") == b"__PAGEZERO":
                width, code = (8, "Q") if name.endswith("64") else (4, "I")
                for i, field in enumerate(MACHO_COMMANDS["segment"]):
                    f[f"lc_segment{'_64' if width == 8 else ''}_{field}"] = struct.unpack_from(order + code, data, at + 24 + width * i)[0]
            elif name == "LC_VERSION_MIN_MACOSX":
                v = struct.unpack_from(order + "I", data, at + 8)[0]
                f["lc_version_min"] = (v >> 16) + ((v >> 8) & 0xFF) / 10
            at += max(8, length)
        out.append({k: float(v) for k, v in f.items()})
    return out


def _rows(kind: str):
    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if kind == "macho":
                        rows += [(path, f, [], [], [], [], None) for f in macho(content)]
                        continue
                    pe = Pe(content)
                    f = pe.dense() if kind == "pe" else pe.clustering()
                    rows.append((path, f, [s[0].lower() for s in pe.sections], sorted(set(pe.imports)), sorted(pe.exported), pe.warnings, None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((path, {}, [], [], [], [], str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("filename x", "features x", "section_names x", "imported_symbols x", "exported_symbols x", "warnings x", "error x")])

    return run


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one folder with their bytes and digest."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def extract(binaries: DataFrame, kind: str = "pe") -> DataFrame:
    """Features of ``path, content`` rows; kind is pe, pe_cluster or macho."""
    return binaries.select("path", "content").mapInPandas(_rows(kind), SCHEMA)


def as_columns(extracted: DataFrame, names: list[str], missing: float = 0.0) -> DataFrame:
    """The named features as columns; absent ones are ``missing``."""
    return extracted.select("filename", *[F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(missing)).alias(n) for n in names])
