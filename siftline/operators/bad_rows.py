"""Rows that fail to parse, set apart with the reason while the valid ones are loaded.

Blocks of records go through columnar checks and the columnar CSV reader at once. A block that fails
is halved, and the halves again, until its bad records stand alone; only these are read by a strict
automaton, which names the first reason in the order of ``REASONS``. The rest of the block stays
columnar; valid records come as typed columns.

A null record is an empty line. A repeated id counts once, by its smallest record; rows without an
id are kept. Text may hold any character; an empty table gives no rows.
"""

from __future__ import annotations

import io
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("date", "domain", "ip", "reverse", "description", "registrant", "asn", "inactive", "country")
REASONS = ("quoting", "column_count", "bad_domain", "bad_ip", "bad_registrant")
#: Records of a block.
BLOCK = 2048
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_LAST = r"(?:[0-9][0-9-]*)?[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_PORT = r"(?::0*(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?"
_REST = r"(?:[/?#](?s:.*))?"
#: The same rules for RE2 (columnar, whole column) as the strict path checks by hand.
DOMAIN_RE = rf"\A(?:-|(?:{_IP}|(?:{_LABEL}\.)+{_LAST}){_PORT}{_REST})\z"
IP_RE = rf"\A(?:-|{_IP})\z"
REGISTRANT_RE = r"\A[^\x{00}-\x{1f}\x{7f}-\x{9f}\x{fffd}]*\z"
_FIELD = r'(?:"(?:[^"]|"")*"|(?:[^",][^",]*)?)'
RECORD_RE = rf"\A{_FIELD}(?:,{_FIELD}){{{len(FIELDS) - 1}}}\z"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def fields_of(record: str) -> list[str] | None:
    """The fields of one record read strictly; None if its quoting is broken."""
    out, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            part, i = [], i + 1
            while True:
                j = record.find('"', i)
                if j < 0:
                    return None
                part.append(record[i:j])
                i = j + 1
                if i < n and record[i] == '"':
                    part.append('"')
                    i += 1
                    continue
                break
            if i < n and record[i] != ",":
                return None
            out.append("".join(part))
        else:
            j = record.find(",", i)
            j = n if j < 0 else j
            if '"' in record[i:j]:
                return None
            out.append(record[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def _is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and (p == "0" or p[0] != "0") and len(p) <= 3 and int(p) <= 255 for p in parts)


def _is_host(text: str) -> bool:
    labels = text.split(".")
    if len(labels) < 2 or not all(0 < len(x) <= 63 and set(x) <= _ALNUM | {"-"} and x[0] != "-" and x[-1] != "-" for x in labels):
        return False
    return any(c.isalpha() for c in labels[-1])


def _is_domain(text: str) -> bool:
    if text == "-":
        return True
    ends = [i for c in "/?#" if (i := text.find(c)) >= 0]
    host, colon, port = text[: min(ends, default=len(text))].partition(":")
    if colon and not (port.isascii() and port.isdigit() and len(port) < 20 and 1 <= int(port) <= 65535):
        return False
    return _is_ip(host) or _is_host(host)


def _is_registrant(text: str) -> bool:
    if text == "-":
        return True
    return not any(c == "�" or unicodedata.category(c) == "Cc" for c in text) and any(c.isalpha() for c in text)


def diagnose(record: str | None) -> tuple[str | None, list[str] | None]:
    """The first reason why a record is bad, or None and its fields."""
    fields = fields_of(record or "")
    if fields is None:
        return "quoting", None
    if len(fields) != len(FIELDS):
        return "column_count", None
    if not _is_domain(fields[1]):
        return "bad_domain", None
    if fields[2] != "-" and not _is_ip(fields[2]):
        return "bad_ip", None
    if not _is_registrant(fields[5]):
        return "bad_registrant", None
    return None, fields


def _csv(records: list[str]) -> pa.Table | None:
    """The columns of well-formed records in one bulk read; None if the reader refuses them or sees another number of rows."""
    joined = ("\n".join(records) + "\n").encode()
    try:
        got = pcsv.read_csv(
            io.BytesIO(joined),
            read_options=pcsv.ReadOptions(column_names=list(FIELDS), use_threads=False, block_size=len(joined) + 16),
            parse_options=pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={f: pa.string() for f in FIELDS}, strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return got.combine_chunks() if got.num_rows == len(records) else None


def _failing(columns: pa.Table) -> np.ndarray:
    """Which rows fail a columnar check of domain, ip or registrant."""
    fits = lambda field, pattern: pc.match_substring_regex(columns.column(field), pattern)
    registrant = columns.column("registrant")
    lettered = pc.or_(pc.equal(registrant, "-"), pc.match_substring_regex(registrant, r"\pL"))
    good = pc.and_(pc.and_(fits("domain", DOMAIN_RE), fits("ip", IP_RE)), pc.and_(fits("registrant", REGISTRANT_RE), lettered))
    return ~good.to_numpy().astype(bool)


def isolate(failing: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of a block without a failing record, and the failing ones, by halving what fails down to single records."""
    before = np.concatenate([[0], np.cumsum(failing)])
    spans, single, parts = [], [], [(0, len(failing))]
    while parts:
        lo, hi = parts.pop()
        if before[hi] == before[lo]:
            if lo < hi:
                spans.append((lo, hi))
        elif hi - lo == 1:
            single.append(lo)
        else:
            middle = (lo + hi) // 2
            parts += [(middle, hi), (lo, middle)]
    return spans, single


def parse_block(values: pa.Array) -> tuple[list, list[list], int]:
    """Reasons (None: valid) and the nine columns of a block, and how many records were read strictly.

    The block is checked in bulk, field by field; a failing part is halved until its bad records
    stand alone. What passes is loaded in bulk, and only isolated records are diagnosed.
    """
    n = len(values)
    reasons: list = [None] * n
    columns: list[list] = [[None] * n for _ in FIELDS]
    texts, strict = values.to_pylist(), 0

    def diagnosed(i: int) -> None:
        nonlocal strict
        strict += 1
        reasons[i], fields = diagnose(texts[i])
        for column, value in zip(columns, fields or ()):
            column[i] = value

    def load(rows: list[int]) -> None:
        got = _csv([texts[i] for i in rows])
        if got is None:  # the reader refuses a record that the pattern takes
            if len(rows) == 1:
                return diagnosed(rows[0])
            load(rows[: len(rows) // 2])
            return load(rows[len(rows) // 2 :])
        spans, single = isolate(_failing(got))
        for column, field in zip(columns, FIELDS):
            read = got.column(field).to_pylist()
            for lo, hi in spans:
                for at in range(lo, hi):
                    column[rows[at]] = read[at]
        for at in single:
            diagnosed(rows[at])

    if n:
        shaped = pc.fill_null(pc.match_substring_regex(values, RECORD_RE), False)
        spans, single = isolate(~shaped.to_numpy(zero_copy_only=False).astype(bool))
        for i in single:
            diagnosed(i)
        if spans:
            load([i for lo, hi in spans for i in range(lo, hi)])
    return reasons, columns, strict


def parsed(raw: DataFrame, id_col: str = "raw_id", value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``raw_id``, ``keep``, ``reason`` and the nine text fields (null where bad) of each record."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in [raw.schema[c]])
    schema = f"raw_id bigint, {kinds + ', ' if kinds else ''}reason string, " + ", ".join(f"`f_{f}` string" for f in FIELDS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                reasons, columns, _ = parse_block(part.column(part.num_columns - 1))
                arrays = [*part.columns[:-1], pa.array(reasons, pa.string()), *(pa.array(c, pa.string()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["raw_id", *keep, "reason", *(f"f_{f}" for f in FIELDS)])

    one = raw.select(F.col(id_col).cast("bigint").alias("raw_id"), *keep, F.col(value_col).cast("string").alias("_v"))
    return one.mapInArrow(run, schema)


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``_row``, which tells rows without an id apart."""
    return rows.withColumn("_row", F.when(F.col("raw_id").isNull(), F.monotonically_increasing_id()))


def bad_records(raw: DataFrame) -> DataFrame:
    """``raw_id``, ``reason`` of the bad records."""
    bad = parsed(raw.select("raw_id", "value")).where("reason is not null").select("raw_id", "reason")
    order = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return _keyed(bad).groupBy("raw_id", "_row").agg(F.min_by("reason", order).alias("reason")).drop("_row")


def loaded(raw: DataFrame) -> DataFrame:
    """The valid records as rows of the feed's table; ``-`` stays as delivered, numbers are cast if they are numbers."""
    rows = parsed(raw, keep=("feed_id", "received_at")).where("reason is null")
    rows = _keyed(rows).groupBy("raw_id", "_row").agg(F.min(F.struct("feed_id", "received_at", *[f"f_{f}" for f in FIELDS])).alias("s")).select("raw_id", "s.*")
    texts = [F.col(f"f_{f}").alias(f) for f in FIELDS[:7]]
    return rows.select(F.col("raw_id").alias("row_id"), "feed_id", "received_at", *texts, *[F.col(f"f_{f}").try_cast("int").alias(f) for f in FIELDS[7:]])
