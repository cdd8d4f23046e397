"""YARA rules of single PE and Mach-O files and of Mach-O clusters, by the layout tables.

A file that can't be read gives a rule of its size only.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.yara import MACHO_COMMANDS, PE_FILE_HEADER, PE_OPTIONAL, Rule, cluster_rule, little_endian, masked_header
from siftline.sources.binary import MACHO_MAGICS, MACHO_NAMES, Pe

PRINTABLE = re.compile(rb"[\x09-\x0d\x20-\x7e]{8,}")
CONSTANT = re.compile(rb"[!#-&(-\[\]-~]{6,}")
_CODES = {name: code for code, name in MACHO_NAMES.items()}
_SHORT = {"symtab": "LC_SYMTAB", "dysymtab": "LC_DYSYMTAB", "dyld_info": "LC_DYLD_INFO_ONLY", "segment": "LC_SEGMENT", "segment_64": "LC_SEGMENT_64"}
PE_PARTS = ("dos_header", "file_header", "optional_header", "section_names", "section_info", "imports", "exports", "file_info", "strings")


def _values(fields: dict[str, int], layout, wanted) -> dict[str, str]:
    widths = dict(layout)
    return {n: little_endian(v, widths[n]) for n, v in fields.items() if n in widths and (wanted is None or n in wanted)}


def pe_rule(data: bytes, name: str, parts: tuple[str, ...] = PE_PARTS, wanted: set[str] | None = None) -> Rule:
    """A rule of the chosen parts; of headers only the ``wanted`` fields (all by default), others are wildcards."""
    rule = Rule(name)
    try:
        pe = Pe(data)
    except (ValueError, struct.error):
        rule.size = len(data)
        return rule
    at = pe.lfanew
    optional = PE_OPTIONAL.get(pe.optional.get("magic", 0x10B), PE_OPTIONAL[0x10B])
    table = at + 24 + pe.header.get("size of optional header", 0)
    if "dos_header" in parts:
        rule.offset("dos_magic", data[:2].hex(), 0)
        rule.offset("lfanew", little_endian(at, 4), 60)
        rule.offset("pe_signature", data[at : at + 4].hex(), at)
    for part, fields, layout, where in (("file_header", pe.header, PE_FILE_HEADER, at + 4), ("optional_header", pe.optional, optional, at + 24)):
        if part in parts and (text := masked_header(layout, _values(fields, layout, wanted))):
            rule.offset(part, text, where)
    if "section_names" in parts:
        rule.group("section_name", [data[table + 40 * i : table + 40 * i + 8].hex() for i in range(len(pe.sections))], "hex")
    if "section_info" in parts:
        for i, (_, va, vsize, _, _) in enumerate(pe.sections[:3]):
            rule.offset(f"Section{i}VirtualSize", little_endian(vsize, 4), table + 40 * i + 8)
            rule.offset(f"Section{i}VirtualAddress", little_endian(va, 4), table + 40 * i + 12)
    named = [s.split(" bound=", 1)[0].split(":name=", 1) for s in pe.imports if ":name=" in s]
    if "imports" in parts:
        rule.group("import_string", sorted({x for pair in named for x in pair if x}))
    if "exports" in parts:
        rule.group("export_string", sorted(set(pe.exports)))
    if "file_info" in parts:
        rule.group("file_info_string", [x.encode("utf-16-le").hex() for pair in pe.version_strings() for x in pair if x], "hex")
    if "strings" in parts:
        ignored = {x for pair in named for x in pair} | set(pe.exports) | {s[0] for s in pe.sections}
        found = dict.fromkeys(m.group() for m in PRINTABLE.finditer(data))
        rule.group("misc_string", [s.hex() for s in found if s.decode("ascii").lower() not in {x.lower() for x in ignored}], "hex")
    return rule


def _commands(data: bytes):
    """(order, offset, command, length, start) of each load command of each architecture."""
    starts = [0]
    if data[:4] == b"\xca\xfe\xba\xbe":
        starts = [struct.unpack_from(">I", data, 16 + 20 * i)[0] for i in range(struct.unpack_from(">I", data, 4)[0]) if 28 + 20 * i <= len(data)]
    for start in starts:
        order, size = MACHO_MAGICS.get(struct.unpack_from("<I", data, start)[0], ("", 0))
        if not order:
            raise ValueError("no Mach-O magic")
        at = start + size
        for _ in range(struct.unpack_from(order + "I", data, start + 16)[0]):
            if at + 8 > len(data):
                break
            cmd, length = struct.unpack_from(order + "II", data, at)
            yield order, at, cmd, length, start
            at += max(8, length)


def macho_strings(data: bytes) -> tuple[list[str], list[str]]:
    """Distinct strings of the symbol tables, and literals of the constant pool (sections of C strings)."""
    symbols, literals = set(), set()
    for order, at, cmd, length, start in _commands(data):
        label = MACHO_NAMES.get(cmd)
        if label == "LC_SYMTAB" and at + 24 <= len(data):
            where, size = struct.unpack_from(order + "II", data, at + 16)
            symbols.update(data[start + where : start + where + size].split(b"\0"))
        elif label in ("LC_SEGMENT", "LC_SEGMENT_64"):
            wide = label.endswith("64")
            first, step, code = at + (72 if wide else 56), 80 if wide else 68, "Q" if wide else "I"
            for i in range(struct.unpack_from(order + "I", data, at + (64 if wide else 48))[0]):
                section = first + step * i
                if section + step > min(len(data), at + length):
                    break
                (size,) = struct.unpack_from(order + code, data, section + (40 if wide else 36))
                (where,) = struct.unpack_from(order + "I", data, section + (48 if wide else 40))
                (flags,) = struct.unpack_from(order + "I", data, section + (64 if wide else 56))
                if flags & 0xFF == 2:  # the type of C-string literals
                    literals.update(data[start + where : start + where + size].split(b"\0"))
    fit = lambda found: sorted(x.decode("ascii") for x in found if CONSTANT.fullmatch(x))
    return fit(symbols), fit(literals)


def macho_rule(data: bytes, name: str) -> Rule:
    """Headers, tables, counts of commands, section names, minimum version and constant strings."""
    rule, counts, sections = Rule(name), {}, []
    try:
        commands = list(_commands(data))
    except (ValueError, struct.error):
        rule.size = len(data)
        return rule
    if data[:4] == b"\xca\xfe\xba\xbe":
        rule.offset("fat_magic", data[:4].hex(), 0)
    for start in dict.fromkeys(c[4] for c in commands):
        rule.offset("magic", data[start : start + 4].hex(), start)
        for field, at in (("cputype", 4), ("cpusubtype", 8), ("filetype", 12)):
            rule.offset(field, data[start + at : start + at + 4].hex(), start + at)
    for order, at, cmd, length, start in commands:
        label = MACHO_NAMES.get(cmd, f"LC_{cmd:#x}")
        both = (label, data[at : at + 8].hex())
        counts[both] = counts.get(both, 0) + 1
        if label in ("LC_SYMTAB", "LC_DYSYMTAB", "LC_DYLD_INFO", "LC_DYLD_INFO_ONLY"):
            rule.part(label, data[at : at + length].hex())
        elif label in ("LC_SEGMENT", "LC_SEGMENT_64"):
            wide = label.endswith("64")
            rule.part(f"{label}_{at - start}", data[at : at + (56 if wide else 40)].hex())
            first, step = at + (72 if wide else 56), 80 if wide else 68
            sections += [data[first + step * i : first + step * i + 32].hex() for i in range(struct.unpack_from(order + "I", data, at + (64 if wide else 48))[0]) if first + step * i + 32 <= at + length]
        elif label == "LC_VERSION_MIN_MACOSX":
            rule.part(label, data[at : at + 8].hex() + "??" + data[at + 9 : at + 12].hex())
    for (label, text), n in counts.items():
        rule.part(f"{label}_count", text, count=n)
    rule.group("section", sections, "hex")
    symbols, literals = macho_strings(data)
    rule.group("symboltable", symbols)
    rule.group("constant_pool", literals)
    return rule


def macho_cluster_rule(name: str, constants: dict[str, int]) -> Rule:
    """A rule of a cluster: constant, non-zero ``lc_*`` columns by command, ``LC_*`` columns as command bytes."""
    rule = Rule(name)
    for short in sorted(_SHORT, key=len, reverse=True):  # 64-bit segments before 32-bit ones
        prefix, fields = f"lc_{short}_", MACHO_COMMANDS["segment" if short.startswith("segment") else short]
        width = 8 if short == "segment_64" else 4
        values = {f: little_endian(constants[prefix + f], width) for f in fields if constants.get(prefix + f, 0) > 0}
        if values:
            body = masked_header(tuple((f, width) for f in fields), values)
            rule.part(_SHORT[short], little_endian(_CODES[_SHORT[short]], 4) + "??" * 4 + ("??" * 16 if short.startswith("segment") else "") + body)
    for column, n in sorted(constants.items()):
        label, _, length = column.partition(":")
        if column.startswith("LC_") and n > 0 and label in _CODES:
            rule.part(column.replace(":", "_"), little_endian(_CODES[label], 4) + (little_endian(int(length), 4) if length else "??000000"))
    return rule


def file_rules(files: DataFrame, kind: str = "pe") -> DataFrame:
    """``name, text`` of each ``path, content`` row; the name is the file's SHA-256."""
    make = pe_rule if kind == "pe" else macho_rule

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"name": pdf["sha"], "text": [make(c, n).text() for c, n in zip(pdf["content"], pdf["sha"])]})

    return files.select(F.concat(F.lit("f"), F.sha2("content", 256)).alias("sha"), "content").mapInPandas(run, "name string, text string")


def cluster_rules(labels: DataFrame, extracted: DataFrame, kind: str = "pe") -> DataFrame:
    """``cluster, name, text`` of each cluster of files; ``labels`` is ``filename, cluster``, ``extracted`` the readers' features.

    A feature that all files of a cluster share is a constant. Of PE fields that vary, the hex digits
    that are the same in all files stay: bits that ``bit_and`` and ``bit_or`` agree on. A feature that
    a file of the cluster lacks, and files without a cluster, take no part.
    """
    known = labels.where("cluster is not null").select("filename", F.col("cluster").cast("bigint").alias("cluster"))
    each = known.join(extracted.select("filename", F.explode("features").alias("k", "v")), "filename").withColumn("v", F.col("v").cast("bigint"))
    seen = each.groupBy("cluster", "k").agg(F.count("*").alias("n"), F.bit_and("v").alias("low"), F.bit_or("v").alias("high"))
    shared = seen.join(known.groupBy("cluster").agg(F.count("*").alias("n")), ["cluster", "n"])
    listed = shared.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("fields"))

    def text(cluster: int, fields) -> tuple[int, str, str]:
        name = f"cluster_{cluster}"
        constants = {f["k"]: int(f["low"]) for f in fields if f["low"] == f["high"]}
        if kind != "pe":
            return cluster, name, macho_cluster_rule(name, constants).text()
        magic, masks = constants.get("magic", 0x10B), {}
        widths = dict(PE_FILE_HEADER) | dict(PE_OPTIONAL.get(magic, PE_OPTIONAL[0x10B]))
        for f in fields:
            if f["k"] in widths and f["low"] != f["high"]:
                low, high = (little_endian(int(f[c]) & (256 ** widths[f["k"]] - 1), widths[f["k"]]) for c in ("low", "high"))
                masks[f["k"]] = "".join(a if a == b else "?" for a, b in zip(low, high))
        return cluster, name, cluster_rule(name, constants.get("lfanew"), magic, constants, masks).text()

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([text(c, f) for c, f in zip(pdf["cluster"], pdf["fields"])], columns=["cluster", "name", "text"])

    return listed.mapInPandas(run, "cluster bigint, name string, text string")
