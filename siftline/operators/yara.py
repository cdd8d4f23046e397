"""YARA rules from named parts, from clusters, and from PE and Mach-O layouts.

A rule gathers strings, hex strings, groups, offsets, patterns and a size; parts of 1000 or more
characters are left out. Text is built where the rows are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 1000


def identifier(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", re.sub(r"^\d", "", name))[:128]


def _spaced(value: str) -> str:
    return " ".join(value[i : i + 2].rjust(2, "0") for i in range(0, len(value), 2))


@dataclass
class Rule:
    """Parts are kept in order and once; ``tag`` and ``meta`` may be empty."""

    name: str
    meta: dict[str, str] = field(default_factory=dict)
    tag: str = ""
    groups: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    at: list[tuple[str, str, str, int]] = field(default_factory=list)
    counted: list[tuple[str, str, str, int]] = field(default_factory=list)
    size: int | None = None

    def group(self, name: str, values: list[str], kind: str = "text") -> None:
        """kind: text, wide or hex."""
        self.groups[name] = (kind, list(dict.fromkeys([*self.groups.get(name, (kind, []))[1], *values])))

    def regex(self, name: str, pattern: str) -> None:
        self.patterns[name] = pattern

    def offset(self, name: str, value: str, offset: int, kind: str = "hex") -> None:
        if (part := (kind, name, value, offset)) not in self.at:
            self.at.append(part)

    def part(self, name: str, value: str, kind: str = "hex", count: int = 0) -> None:
        if (part := (kind, name, value, count)) not in self.counted:
            self.counted.append(part)

    def text(self) -> str:
        strings, conditions = [], []

        def written(kind: str, value: str) -> str:
            return f"{{ {_spaced(value)} }}" if kind == "hex" else f'"{value}"' + " wide" * (kind == "wide")

        for wanted in ("text", "wide", "hex"):
            for name, (kind, values) in self.groups.items():
                if kind == wanted and values:
                    fit = [v for v in values if len(v) < LONGEST]
                    strings += [f"${identifier(name)}{i} = {written(kind, v)}" for i, v in enumerate(fit, 1)]
                    conditions.append(f"all of (${identifier(name)}*)")
        for name, pattern in self.patterns.items():
            strings.append(f"${identifier(name)} = /{pattern}/")
            conditions.append(f"${identifier(name)}")
        used: dict[str, int] = {}
        for kind, name, value, offset in self.at:
            if len(value) < LONGEST:
                label = identifier(name)
                used[label] = used.get(label, 0) + 1
                label += f"_{used[label]}" * (used[label] > 1)
                strings.append(f"${label} = {written(kind, value)}")
                conditions.append(f"${label} at {offset}")
        for kind, name, value, count in self.counted:
            if len(value) < LONGEST:
                strings.append(f"${identifier(name)} = {written(kind, value)}")
                conditions.append(f"#{identifier(name)} == {count}" if count else f"${identifier(name)}")
        if self.size is not None:
            conditions.append(f"filesize == {self.size}")
        head = f"rule {identifier(self.name)}" + (f" : {self.tag}" if self.tag else "")
        meta = "meta:\n" + "\n".join(f'    {k} = "{v}"' for k, v in sorted(self.meta.items())) + "\n" if self.meta else ""
        body = "\nstrings:\n    " + "\n    ".join(strings) + "\n" if strings else ""
        return f"{head}\n{{\n{meta}{body}\ncondition:\n    " + (" and\n    ".join(conditions) or "true") + "\n}"


#: Header fields as (name, bytes), in file order (fixed values of the file formats).
PE_FILE_HEADER = (("machine", 2), ("number of sections", 2), ("time date stamp", 4), ("pointer to symbol table", 4), ("number of symbols", 4), ("size of optional header", 2), ("characteristics", 2))
_PE_COMMON = (("magic", 2), ("major linker version", 1), ("minor linker version", 1), ("size of code", 4), ("size of initialized data", 4), ("size of uninitialized data", 4), ("address of entry point", 4), ("base of code", 4))
_PE_MIDDLE = (("section alignment", 4), ("file alignment", 4), ("major operating system version", 2), ("minor operating system version", 2), ("major image version", 2), ("minor image version", 2), ("major subsystem version", 2), ("minor subsystem version", 2), ("win32 version value", 4), ("size of image", 4), ("size of headers", 4), ("checksum", 4), ("subsystem", 2), ("dll characteristics", 2))
_PE_TAIL = (("loader flags", 4), ("number of rva and sizes", 4))
_STACKS = ("size of stack reserve", "size of stack commit", "size of heap reserve", "size of heap commit")
PE_OPTIONAL = {
    0x10B: _PE_COMMON + (("base of data", 4), ("image base", 4)) + _PE_MIDDLE + tuple((n, 4) for n in _STACKS) + _PE_TAIL,
    0x20B: _PE_COMMON + (("image base", 8),) + _PE_MIDDLE + tuple((n, 8) for n in _STACKS) + _PE_TAIL,
}
MACHO_COMMANDS = {
    "symtab": ("symoff", "nsyms", "stroff", "strsize"),
    "dyld_info": tuple(f"{k}_{v}" for k in ("rebase", "bind", "weak_bind", "lazy_bind", "export") for v in ("off", "size")),
    "dysymtab": ("ilocalsym", "nlocalsym", "iextdefsym", "nextdefsym", "iundefsym", "nundefsym", "tocoff", "ntoc", "modtaboff", "nmodtab", "extrefsymoff", "nextrefsyms", "indirectsymoff", "nindirectsyms", "extreloff", "nextrel", "locreloff", "nlocrel"),
    "segment": ("vmaddr", "vmsize", "fileoff", "filesize"),
}


def masked_header(layout: tuple[tuple[str, int], ...], values: dict[str, str]) -> str:
    """Hex of a header whose given fields are hex texts (``?`` allowed) and whose other fields are wildcards; trailing wildcards go."""
    text = "".join((values[n][: 2 * width].ljust(2 * width, "?") if n in values else "??" * width) for n, width in layout)
    while text.endswith("??"):
        text = text[:-2]
    return text


def little_endian(value: int, width: int) -> str:
    return int(value).to_bytes(width, "little").hex()


def cluster_rule(name: str, lfanew: int | None, magic: int, constants: dict[str, int], masks: dict[str, str]) -> Rule:
    """A rule for a cluster of PE files: constant fields by value, varying ones by nibble mask; headers stand anywhere if ``lfanew`` is None."""
    rule, layout = Rule(name), PE_OPTIONAL[0x20B if magic == 0x20B else 0x10B]
    widths = dict(layout) | dict(PE_FILE_HEADER)
    values = {n: little_endian(v, widths[n]) for n, v in constants.items() if n in widths and v >= 0} | {n: m for n, m in masks.items() if n in widths}
    for title, fields, at in (("file_header", PE_FILE_HEADER, 4), ("optional_header", layout, 24)):
        at = None if lfanew is None else lfanew + at
        if text := masked_header(fields, values):
            rule.part(title, text) if at is None else rule.offset(title, text, at)
    return rule


def rule_texts(parts: DataFrame) -> DataFrame:
    """``name, text`` from rows of ``name`` and ``strings``: one rule a row, all strings required."""

    def run(pdfs):
        for pdf in pdfs:
            texts = []
            for name, strings in zip(pdf["name"], pdf["strings"]):
                rule = Rule(name or "")
                rule.group("string", [s for s in (strings if strings is not None else []) if s])
                texts.append(rule.text())
            yield pdf.assign(text=texts)[["name", "text"]]

    return parts.select("name", "strings").mapInPandas(run, "name string, text string")


def write_rules(rules: DataFrame, path: str) -> None:
    """One text file a rule, in a folder named by the rule."""
    rules.select(F.col("name"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("name").text(path)
