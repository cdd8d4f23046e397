"""Semi-structured log lines to entries with time, level, component and message, by iterative partitioning.

Every token of a line is put into a class by its marks (parts of a time, level words, names with
pid or line number, key=value, numbers, words; with the brackets and colons around them). The
distinct class sequences of lines that hold a time of day are split by token count, then at the
position with the fewest classes, at a pair of positions whose classes go one to one, and where the
header still varies; a part is a leaf once its leading constant positions settle the header. The
leaf's template gives the slots: the constant positions of the time, of the level and of the
component; all behind them is the message. No list of layouts takes part. JSON objects, on one line
or several, are read by their keys.

Null lines are blank lines. Repeated line ids count once. Lines before the first record of a
log_file belong to no entry; an empty table has no entries. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.runtime import cut, small

#: Lines of a file that one window takes.
CHUNK = 4096
#: Class sequences of one length that one task partitions; larger parts are first split by joins.
NODE = 50_000
#: Lines that must share a header whose marks are unusual.
SUPPORT = 5
#: Levels by the words that headers use (fixed values).
LEVELS = {
    "DEBUG": ("debug", "trace", "dbg", "d", "t", "verbose", "finest", "finer", "fine"),
    "INFO": ("info", "information", "notice", "i", "informational"),
    "WARN": ("warn", "warning", "w"),
    "ERROR": ("error", "err", "e", "severe"),
    "FATAL": ("fatal", "crit", "critical", "panic", "f", "emerg", "emergency", "alert"),
}
_WORDS = {w: level for level, words in LEVELS.items() for w in words}
_LONG = {w for w in _WORDS if len(w) > 1}
_SEVERITY = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
_MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_DAY = rf"(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}|\d{{1,2}}[-/](?:{_MONTH})[-/]\d{{4}})"
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})"
#: Classes of what the marks around a token leave; the first that fits names it.
_CORES = re.compile(
    rf"(?P<TF>{_DAY}[T:_]{_CLOCK}{_ZONE}?)|(?P<TT>\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?{_ZONE}?)|(?P<TD>{_DAY})|(?P<TZ>[+-]\d{{2}}:?\d{{2}})|(?P<MON>{_MONTH})|(?P<WD>Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
    r"|(?P<LD>[A-Z]\d{4})|(?P<N>\d+)|(?P<WN>[\w./-]+\[\d+)|(?P<FN>[\w./-]+\.\w+:\d+)|(?P<CAPS>[A-Z]{2,5})|(?P<DOT>[A-Za-z_]\w*(?:\.\w+)+)|(?P<W>[\w./:@+-]*\w[\w./:@+-]*)"
)
_LEAD, _TRAIL, _RULES = "[({<\"'|~#*", "])}>\"'|~#*:,;", set("-|:=~*#>")
#: Marks that say nothing about a field; a token with several others is a word.
_PLAIN = str.maketrans("", "", "\"',;")
_PRIORITY = re.compile(r"<\d{1,3}>")
_TIME_KEYS, _NAME_KEYS, _LEVEL_KEYS = {"time", "timestamp", "ts", "@timestamp"}, {"logger", "component", "program", "module"}, {"level", "severity", "lvl"}
_TIMES, _CLOCKS = {"TF", "TT", "TD", "TZ", "MON", "WD", "LD", "KT"}, {"TF", "TT", "KT"}
_MEMBER = re.compile(r'\s*"([@\w.]+)"\s*:\s*"?([^",]*)"?,?\s*$')


def classify(token: str) -> str:
    """The class of a token: the kind of its core with the marks around it, two on each side at most."""
    if token[0] == "<" and (m := _PRIORITY.match(token)):
        rest = token[m.end() :]
        return "PRI" if not rest or rest.isdigit() else "PRI+" + classify(rest)
    core = token.lstrip(_LEAD)
    lead, core = token[: len(token) - len(core)], core.rstrip(_TRAIL)
    trail = token[len(lead) + len(core) :]
    if not core or set(core) <= _RULES:
        return "-"
    lead, trail = lead.translate(_PLAIN), trail.translate(_PLAIN)
    if len(lead) > 1 or len(trail) > 1 and trail[-1] != ":":
        return "W"
    key, equals, value = core.partition("=")
    if equals and key.isidentifier():
        key = key.lower()
        kind = "KT" if key in _TIME_KEYS and value[:1].strip("\"'[")[:1].isdigit() | value[1:2].isdigit() else "KL" if key in _LEVEL_KEYS else "KC" if key in _NAME_KEYS | {"comp"} else ""
        return lead + kind + trail if kind else "W"
    if core.lower() in _LONG:
        return lead + "L" + trail
    m = _CORES.fullmatch(core)
    return lead + m.lastgroup + trail if m else "W"


def level_of(word: str | None) -> str:
    return _WORDS.get((word or "").strip().lower(), "")


class _Reader:
    """Class sequences of lines, with a bounded table of tokens seen."""

    def __init__(self):
        self.seen: dict[str, str] = {}

    def read(self, line: str | None) -> tuple:
        """(shape, head, json component, json level, json time): shape is null for a line that can't start a record."""
        if not line or line[0] in " \t\r\n}" or line.isspace():
            if line and '"' in line and (m := _MEMBER.match(line)):
                key = m[1].lower()
                if key in _NAME_KEYS:
                    return None, None, m[2], None, None
                if key in _LEVEL_KEYS:
                    return None, None, None, level_of(m[2]), None
                if key in _TIME_KEYS and m[2]:
                    return None, None, None, None, True
            return None, None, None, None, None
        if line[0] == "{":
            bare = line.rstrip()
            if bare == "{":
                return "{", None, None, None, None
            try:
                got = json.loads(bare)
            except ValueError:
                got = None
            if isinstance(got, dict):
                low = {str(k).lower(): v for k, v in got.items()}
                name = next((str(low[k]) for k in _NAME_KEYS if low.get(k) is not None), None)
                when = any(low.get(k) not in (None, "") for k in _TIME_KEYS)
                level = level_of(next((str(low[k]) for k in _LEVEL_KEYS if low.get(k) is not None), None))
                if name is not None and when:
                    return "{}", None, name, level, True
            return None, None, None, None, None
        tokens = line.split()
        seen, shape = self.seen, []
        for t in tokens:
            if (c := seen.get(t)) is None:
                c = classify(t)
                if len(seen) > 200_000:
                    seen.clear()
                if len(t) < 80:
                    seen[t] = c
            shape.append(c)
        if not any(core_of(c) in _CLOCKS for c in shape):
            return None, None, None, None, None
        return " ".join(shape), " ".join(tokens), None, None, None


_reader = _Reader()


def shapes(lines: DataFrame) -> DataFrame:
    """line_id, log_file, line_no, shape, head, jname, jlevel, jtime of each line."""

    def run(batches):
        for b in batches:
            got = [_reader.read(v) for v in b.column(3).to_pylist()]
            cols = list(zip(*got)) if got else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["line_id", "log_file", "line_no", "shape", "head", "jname", "jlevel", "jtime"])

    one = lines.select(F.col("line_id").cast("bigint").alias("line_id"), F.coalesce("log_file", F.lit("")).alias("log_file"), F.col("line_no").cast("bigint").alias("line_no"), "value")
    return one.mapInArrow(run, "line_id bigint, log_file string, line_no bigint, shape string, head string, jname string, jlevel string, jtime boolean")


def core_of(kind: str) -> str:
    """The kind of a class without its marks."""
    if (got := _SEEN.get(kind)) is None:
        got = _SEEN[kind] = kind.removeprefix("PRI+").strip(_LEAD + _TRAIL) or "-"
    return got


_SEEN: dict[str, str] = {}


def _may_name(kinds: set[str]) -> bool:
    """Could a header field be of one of these classes, if it stands behind the time?"""
    return any(core_of(k) in ("L", "WN", "FN", "KC", "KL", "-") or k[-1] in "]:)}>|" or core_of(k) == "DOT" for k in kinds)


def slots(kinds: list[set[str]]) -> tuple[int, int, int, int, bool] | int | None:
    """The header that the leading constant positions of a part settle, from the classes at each position.

    (first and last position of the time, of the component, of the level, unusual marks?); the level
    is -1 if the first token states it, -2 if there is none. A number is the varied position that
    must be split before the header is settled. None: the lines start no record.
    """
    width, at = len(kinds), 0
    only = lambda i: next(iter(kinds[i])) if i < width and len(kinds[i]) == 1 else ""
    varied = lambda i: i < width and len(kinds[i]) > 1
    level, priority = -2, False
    # before the time: a priority or a level, and names in brackets beside it
    while not varied(at) and at < width and core_of(only(at)) not in _TIMES:
        kind = only(at)
        if kind == "PRI" and not at:
            priority, level = True, -1
        elif core_of(kind) == "L" and level == -2:
            level = at
        elif not (kind[0] in "[({" and core_of(kind) in ("W", "DOT", "CAPS", "N") and kind[-1] in "])}") and kind != "-":
            return None
        at += 1
    if varied(at):
        return at
    early = at > priority
    if at >= width or early and level == -2:
        return None
    time_from = time_to = at
    if only(at).startswith("PRI+"):
        priority, level = True, -1
    letter, clock = core_of(only(at)) == "LD", False
    while at < width:
        if varied(at):
            if not clock or any(core_of(k) in _TIMES or core_of(k) in ("N", "CAPS") for k in kinds[at]):
                return at
            break
        core, before = core_of(only(at)), core_of(only(at - 1)) if at > time_from else ""
        if core in _TIMES and (core != "LD" or at == time_from) and (core != "TT" or not clock):
            clock |= core in _CLOCKS
        elif core == "CAPS" and before == "TT" and only(at) == "CAPS":
            if varied(at + 1):
                return at + 1
            if core_of(only(at + 1)) != "N":
                break
        elif not (core == "N" and (before in ("MON", "WD") or before in ("TT", "TZ", "CAPS") and not letter and any(only(i) == "MON" for i in range(time_from, at)))):
            break
        time_to, at = at, at + 1
    if not clock:
        return None
    name, odd, gap, keyed = -1, False, False, core_of(only(time_from)) == "KT"
    while at < width and name < 0:
        if varied(at):
            return at if _may_name(kinds[at]) or any(core_of(k) in ("W", "CAPS", "N") for k in kinds[at]) else None
        kind, core = only(at), core_of(only(at))
        closes = kind[-1] in "]:" and core in ("WN", "FN") or kind[-1] == ":" and core in ("W", "DOT", "CAPS")
        if kind == "-" or core == "N":
            gap = True
        elif core in ("L", "KL"):
            if level == -2:
                level = at
            gap = False
        elif core == "KC" or closes:
            name, odd = at, kind[-1] == ":" and core not in ("WN", "FN") and level == -2 and at == time_to + 1
        elif keyed and kind == "W":
            gap = False
        elif kind[0] in _LEAD and kind[-1] in _TRAIL and core in ("W", "DOT", "CAPS"):
            # in brackets: the component, or a context of the one that is set off behind it
            if varied(at + 1) and any(core_of(k) in ("W", "DOT") for k in kinds[at + 1]):
                return at + 1
            if core_of(only(at + 1)) in ("W", "DOT") and only(at + 1) in ("W", "DOT"):
                if varied(at + 2):
                    return at + 2
                if only(at + 2) == "-":
                    at += 1
            name, odd = at, kind[:1] != "[" and only(at) == kind or level == -2 and not priority
        elif kind in ("W", "DOT", "CAPS"):
            if varied(at + 1):
                return at + 1
            after = only(at + 1)
            if after == "-" and (gap or level >= 0):
                name = at
            elif after and (core_of(after) in ("WN", "FN") or after[-1] == ":" and core_of(after) in ("W", "DOT", "CAPS")):
                gap = False  # the host
            elif priority and after in ("W", "DOT", "CAPS"):
                name = at + 1  # host and program, without marks
            elif kind == "DOT" and level >= 0:
                name, odd = at, True
            else:
                return None
        else:
            return None
        at = max(at, name) + 1
    if name < 0:
        return None
    if level == -2 and letter:
        level = -1
    if level == -2:  # a level behind the component, in marks or set off
        at, gap = name + 1, False
        while at < width:
            if varied(at):
                if any(core_of(k) == "KL" or core_of(k) == "L" and (k != "L" or gap) or k == "-" for k in kinds[at]):
                    return at
                break
            core = core_of(only(at))
            if core == "KL" or core == "L" and (only(at) != "L" or gap):
                level = at
                break
            if only(at) != "-" and not (keyed and only(at) == "W"):
                break
            gap, at = only(at) == "-", at + 1
    if early and level == -2:
        return None
    return time_from, time_to, name, level, odd or early


def partition(rows: list[tuple[tuple[str, ...], int]], least: bool = True) -> list[list[tuple[tuple[str, ...], int]]]:
    """Split sequences of one length into leaves.

    First at the position with the fewest classes (if ``least``), then at two positions whose
    classes go one to one, at last where the header is not settled yet. A part whose header the
    leading constant positions settle is a leaf at any step.
    """
    leaves, parts = [], [(rows, "least" if least else "bijection")]
    while parts:
        part, step = parts.pop()
        kinds = [set(c) for c in zip(*(r[0] for r in part))]
        varied = [i for i, k in enumerate(kinds) if len(k) > 1]
        at = slots(kinds)
        if not varied or not isinstance(at, int):
            leaves.append(part)
            continue
        if step == "least":
            at, step = min(varied, key=lambda i: len(kinds[i])), "bijection"
        elif step == "bijection":
            at, step = next((i for n, i in enumerate(varied) for j in varied[n + 1 :] if len(kinds[i]) == len(kinds[j]) == len({(r[0][i], r[0][j]) for r in part})), at), "header"
        groups = defaultdict(list)
        for r in part:
            groups[r[0][at]].append(r)
        parts.extend((g, step) for g in groups.values())
    return leaves


def _split(counted: DataFrame) -> DataFrame:
    """``shape``, ``n``, ``node``: parts of one length each; those above ``NODE`` sequences are split at their least variable position by joins."""
    done, open_ = None, counted.withColumn("node", F.size(F.split("shape", " ")).cast("string"))
    while True:
        open_ = cut(open_)
        sizes = open_.groupBy("node").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > NODE)
        if not large.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        fits = open_.join(large.select("node"), "node", "left_anti")
        over = open_.join(large.select("node"), "node", "left_semi")
        kinds = over.select("node", F.posexplode(F.split("shape", " ")).alias("at", "kind")).groupBy("node", "at", "kind").count()
        kinds = kinds.groupBy("node", "at").agg(F.count("*").alias("many")).where("many > 1")
        pick = kinds.groupBy("node").agg(F.min(F.struct("many", "at"))["at"].alias("at"))
        done = fits if done is None else done.unionByName(fits)
        open_ = over.join(pick, "node").select("shape", "n", F.concat_ws("/", "node", "at", F.get(F.split("shape", " "), F.col("at"))).alias("node"))


def templates(shaped: DataFrame) -> DataFrame:
    """``shape``, ``template``, ``support`` and the slots (``time_from``, ``time_to``, ``name_at``, ``level_at``) of each class sequence."""
    names = ("time_from", "time_to", "name_at", "level_at")

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for leaf in partition([(tuple(s.split(" ")), int(n)) for s, n in zip(pdf["shape"], pdf["n"])]):
            kinds = [set(c) for c in zip(*(r[0] for r in leaf))]
            template = [next(iter(k)) if len(k) == 1 else "*" for k in kinds]
            support, found = sum(n for _, n in leaf), slots(kinds)
            places, header = ((), None) if found is None or isinstance(found, int) else (found[:4], " ".join(template[: max(found[1:4]) + 1]) if found[4] else None)
            for i, (sequence, _) in enumerate(leaf):
                out.append((" ".join(sequence), " ".join(template), support, *(places or (None,) * 4), header, 0 if i else support))
        return pd.DataFrame(out, columns=["shape", "template", "support", *names, "header", "own"]).astype(dict.fromkeys(names, "Int32"))

    counted = shaped.where("head is not null").groupBy("shape").agg(F.count("*").alias("n"))
    found = _split(counted).groupBy("node").applyInPandas(lambda pdf: leaves(pdf), f"shape string, template string, support bigint, {', '.join(f'{c} int' for c in names)}, header string, own bigint")
    # leaves of any length that share an unusual header support it together
    enough = F.col("header").isNull() | (F.sum("own").over(Window.partitionBy("header")) >= SUPPORT)
    return found.withColumn("enough", enough).select("shape", "template", "support", *[F.when(F.col("enough"), F.col(c)).alias(c) for c in names])


def _level(word):
    word, out = F.lower(word), F.lit("")
    for level, words in LEVELS.items():
        out = F.when(word.isin(*words), level).otherwise(out)
    return out


def entries(lines: DataFrame) -> DataFrame:
    """``first_line_id``, ``last_line_id``, ``component``, ``log_level``: one row an entry."""
    return _found(lines).select("first_line_id", "last_line_id", "component", "log_level")


def _latest(rows: DataFrame, column: str, upto: int) -> DataFrame:
    """``rows`` with the last known ``column`` at or (``upto`` -1) before each, by ``log_file``, ``line_no``, ``line_id``.

    Chunks of a file are scanned apart; what a chunk takes from earlier ones comes by one row a chunk.
    """
    order = Window.partitionBy("log_file", "chunk").orderBy("line_no", "line_id").rowsBetween(Window.unboundedPreceding, upto)
    chunks = rows.where(F.col(column).isNotNull()).groupBy("log_file", "chunk").agg(F.max_by(column, F.struct("line_no", "line_id")).alias("_own"))
    every = rows.select("log_file", "chunk").distinct().join(chunks, ["log_file", "chunk"], "left")
    before = Window.partitionBy("log_file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("log_file", "chunk", F.last("_own", ignorenulls=True).over(before).alias("_carried"))
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(order)).join(every, ["log_file", "chunk"]).withColumn(column, F.coalesce(column, "_carried")).drop("_carried")


def _found(lines: DataFrame) -> DataFrame:
    """The entries with ``log_file``, ``start``, ``last`` (line number and id) and ``slot`` (places of the header's fields)."""
    shaped = cut(shapes(lines.where("line_id is not null")))
    places = ("time_from", "time_to", "name_at", "level_at")
    known = small(cut(templates(shaped).where("name_at is not null").select("shape", *places)))
    x = shaped.join(known, "shape", "left")
    head, headed = F.split("head", " "), F.col("name_at").isNotNull()
    name = F.regexp_replace(F.get(head, F.col("name_at")), r"^(?:\w+=)?[\[({<\"'|~#*]*", "")
    name = F.regexp_replace(name, r"\[\d+\]:?$|:\d+[\])}>|:]*$|[\])}>\"'|~#*:,;]+$", "")
    word = F.regexp_replace(F.get(head, F.when(F.col("level_at") >= 0, F.col("level_at"))), r"^\w+=|[^A-Za-z]", "")
    severity = F.regexp_extract("head", r"^<(\d+)>", 1)
    by_first = F.when(severity != "", F.get(F.array(*[F.lit(v) for v in _SEVERITY]), F.pmod(severity.cast("int"), F.lit(8)))).otherwise(_level(F.regexp_extract("head", r"^\W*(\w)", 1)))
    level = F.when(F.col("level_at") == -1, by_first).when(F.col("level_at") >= 0, F.coalesce(_level(word), F.lit(""))).otherwise("")
    start = F.when(headed | F.col("shape").isin("{", "{}"), F.struct("line_no", "line_id"))
    x = x.select(
        "line_id", "log_file", "line_no", F.floor(F.col("line_no") / CHUNK).alias("chunk"), start.alias("start"), F.when(headed, name).otherwise(F.col("jname")).alias("name"),
        F.when(headed, level).otherwise(F.col("jlevel")).alias("level"), (F.col("shape") == "{").alias("opens"), "jtime", F.when(headed, F.struct(*places)).alias("slot"),
    )
    upto = Window.partitionBy("log_file", "chunk").orderBy("line_no", "line_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("start", F.last("start", ignorenulls=True).over(upto))
    at_start = F.col("line_id") == F.col("start.line_id")
    first_named = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    part = x.groupBy("log_file", "chunk", "start").agg(
        F.max(F.struct("line_no", "line_id")).alias("last"), first_named("name").alias("name"), F.min(F.when(F.col("name").isNotNull(), F.col("line_no"))).alias("name_no"),
        first_named("level").alias("level"), F.min(F.when(F.col("level").isNotNull(), F.col("line_no"))).alias("level_no"),
        F.bool_or(at_start & F.col("opens")).alias("opens"), F.bool_or("jtime").alias("timed"), F.max("slot").alias("slot"),
    )
    # a chunk's lines before its first record belong to the last record of an earlier chunk
    chunks = part.groupBy("log_file", "chunk").agg(F.max("start").alias("open"))
    before = Window.partitionBy("log_file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("log_file", "chunk", F.last("open", ignorenulls=True).over(before).alias("carried"))
    heads = part.where("start is null").drop("start").join(chunks, ["log_file", "chunk"]).withColumnRenamed("carried", "start")
    whole = part.where("start is not null").unionByName(heads.where("start is not null"))
    whole = whole.groupBy("log_file", "start").agg(
        F.max("last").alias("last"), F.min_by("name", "name_no").alias("name"), F.min_by("level", "level_no").alias("level"), F.bool_or("opens").alias("opens"), F.bool_or("timed").alias("timed"), F.max("slot").alias("slot"),
    )
    # an object over several lines that names no time or no component starts no record: its lines belong to the entry before
    valid = ~F.coalesce("opens", F.lit(False)) | (F.col("name").isNotNull() & F.coalesce("timed", F.lit(False)))
    whole = cut(whole.select("log_file", "start", "last", "name", "level", "slot", valid.alias("valid")))
    if whole.where("not valid").limit(1).count():
        own = whole.select("log_file", F.floor(F.col("start.line_no") / CHUNK).alias("chunk"), "start.line_no", "start.line_id", F.when(F.col("valid"), F.col("start")).alias("start"), "last", "name", "level", "slot", "valid")
        pick = lambda c: F.max(F.when(F.col("valid"), F.col(c))).alias(c)
        whole = _latest(own, "start", 0).where("start is not null").groupBy("log_file", "start").agg(F.max("last").alias("last"), pick("name"), pick("level"), pick("slot"))
    return whole.select(F.col("start.line_id").alias("first_line_id"), F.col("last.line_id").alias("last_line_id"), F.col("name").alias("component"), F.coalesce("level", F.lit("")).alias("log_level"), "log_file", "start", "last", "slot")


_TOKEN, _JSON_MESSAGE = re.compile(r"\S+"), ("msg", "message", "text", "event")
#: Process, message id and structured data behind the program of a record with a priority.
_STRUCTURED = re.compile(r"\s+\S+\s+\S+\s+(?:-|(?:\[(?:[^\]\\]|\\.)*\])+)(?=\s|$)")


def _member(low: dict, keys) -> str | None:
    value = next((low[k] for k in keys if low.get(k) not in (None, "")), None)
    return value if value is None or isinstance(value, str) else json.dumps(value)


def read_entry(lines: list[str | None], slot: dict | None) -> tuple[str | None, str]:
    """Time text and message of an entry: what the header leaves of the first line, and the lines that follow."""
    lines = [v or "" for v in lines]
    if slot is None:  # an object on one line or several, maybe with lines behind it
        text = "\n".join(lines)
        try:
            got, end = json.JSONDecoder().raw_decode(text)
        except ValueError:
            got, end = {}, 0
            for line in lines:
                if m := _MEMBER.match(line):
                    got.setdefault(m[1], m[2])
        low = {str(k).lower(): v for k, v in got.items()}
        message, more = _member(low, _JSON_MESSAGE), text[end:].strip("\r\n") if end else ""
        if message is None:  # none of its keys is a message: the whole text is
            return _member(low, sorted(_TIME_KEYS)), text
        return _member(low, sorted(_TIME_KEYS)), f"{message}\n{more}" if more else message
    first, spans = lines[0], [m.span() for m in _TOKEN.finditer(lines[0])]
    end = spans[max(slot["time_to"], slot["name_at"], slot["level_at"])][1]
    time = first[spans[slot["time_from"]][0] : spans[slot["time_to"]][1]]
    if m := _PRIORITY.match(first):
        time = time.removeprefix(m[0])
        if m := _STRUCTURED.match(first, end):
            end = m.end()
    if core_of(classify(time.split()[0])) == "LD":
        time = re.sub(r"^\W*[A-Z]", "", time)
    time = re.sub(r"^\w+=", "", time).strip(_LEAD + _TRAIL)
    rest = re.sub(r"^\s*(?:- )?\s*", "", first[end:]).removeprefix("- ")
    if m := re.fullmatch(r'(?:msg|message)="((?:[^"\\]|\\.)*)"\s*', rest):
        rest = m[1]
    return time, "\n".join([rest, *lines[1:]])


def records(lines: DataFrame) -> DataFrame:
    """The entries with ``time_text`` and ``message`` (lines that follow are joined by line breaks, in their order)."""
    found = cut(_found(lines))
    one = lines.where("line_id is not null").select(F.col("line_id").cast("bigint").alias("line_id"), F.coalesce("log_file", F.lit("")).alias("log_file"), F.col("line_no").cast("bigint").alias("line_no"), "value")
    chunk = F.floor(F.col("line_no") / CHUNK)
    # each chunk that an entry reaches into gets a mark from which its lines take the entry
    span = F.explode(F.sequence(F.floor(F.col("start.line_no") / CHUNK), F.floor(F.col("last.line_no") / CHUNK)))
    marks = found.select("log_file", span.alias("chunk"), F.col("start").alias("entry"))
    at = F.when(F.floor(F.col("entry.line_no") / CHUNK) == F.col("chunk"), F.col("entry.line_no")).otherwise(F.col("chunk") * CHUNK - 1)
    marks = marks.select("log_file", "chunk", at.alias("line_no"), F.col("entry.line_id").alias("line_id"), F.lit(0).alias("kind"), "entry", F.lit(None).cast("string").alias("value"))
    every = marks.unionByName(one.select("log_file", chunk.alias("chunk"), "line_no", "line_id", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["entry"].dataType).alias("entry"), "value"))
    upto = Window.partitionBy("log_file", "chunk").orderBy("line_no", "line_id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = every.withColumn("entry", F.last("entry", ignorenulls=True).over(upto)).where("kind = 1 and entry is not null")
    text = owned.groupBy("log_file", F.col("entry.line_id").alias("first_line_id")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "value"))).alias("lines"))

    def run(batches):
        for b in batches:
            out = []
            for slot, rows in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                once = {r["line_id"]: r["value"] for r in reversed(rows)}  # a repeated id counts once
                out.append(read_entry(list(reversed(once.values())), slot))
            times, messages = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(times, pa.string()), pa.array(messages, pa.string())], ["first_line_id", "last_line_id", "component", "log_level", "time_text", "message"])

    whole = found.join(text, ["log_file", "first_line_id"]).select("first_line_id", "last_line_id", "component", "log_level", "slot", "lines")
    return whole.mapInArrow(run, "first_line_id bigint, last_line_id bigint, component string, log_level string, time_text string, message string")
