"""Queries of the general data problems (log entries, time texts, bad rows)."""

from __future__ import annotations

from siftline.operators.bad_rows import bad_records, loaded
from siftline.operators.log_entries import entries, records, shapes, templates
from siftline.operators.timestamps import instants
from siftline.runtime import table


def p3_found(spark, d):
    return entries(table(spark, d, "syslog"))


def p3_entries(spark, d):
    return records(table(spark, d, "syslog"))


def p3_templates(spark, d):
    t = templates(shapes(table(spark, d, "syslog")))
    return t.groupBy("template").agg({"support": "max"}).withColumnRenamed("max(support)", "support")


def p6_found(spark, d):
    return instants(*(table(spark, d, t) for t in ("syslog", "log_hosts", "mdl_data", "mdl_feeds")))


def p7_found(spark, d):
    return bad_records(table(spark, d, "mdl_raw"))


def p7_loaded(spark, d):
    return loaded(table(spark, d, "mdl_raw"))


QUERIES = {f.__name__: f for f in (p3_found, p3_entries, p3_templates, p6_found, p7_found, p7_loaded)}

_F = '(?:"(?:[^"]|"")*"|(?:[^",][^",]*)?)'
_IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_FIELDS = ("date", "domain", "ip", "reverse", "description", "registrant", "asn", "inactive", "country")
_P7 = rf"""
with raw as (select distinct raw_id, feed_id, received_at, coalesce(value, '') as v from mdl_raw),
cut as (
  select *, regexp_full_match(v, '{_F}(,{_F})*') as quoted, regexp_full_match(v, '{_F}(,{_F}){{8}}') as nine,
    regexp_extract(v, '^{",".join([f"({_F})"] * 9)}$', [{", ".join(f"'{f}'" for f in _FIELDS)}]) as g from raw),
f as (select *, {", ".join(f"case when g.{x} like '" + chr(34) + f"%' then replace(substr(g.{x}, 2, length(g.{x}) - 2), '" + chr(34) * 2 + "', '" + chr(34) + f"') else g.{x} end as f_{x}" for x in _FIELDS)} from cut),
h as (select *, regexp_replace(f_domain, '[/?#].*$', '', 's') as head from f),
p as (select *, case when contains(head, ':') then substr(head, instr(head, ':') + 1) end as port, lower(regexp_replace(head, ':.*$', '', 's')) as host from h),
r as (
  select *, case
    when not quoted then 'quoting'
    when not nine then 'column_count'
    when f_domain <> '-' and not (
      (port is null or (regexp_full_match(port, '[0-9]{{1,19}}') and try_cast(port as hugeint) between 1 and 65535))
      and (regexp_full_match(host, '{_IP}') or (
        regexp_full_match(host, '{_LABEL}(\.{_LABEL})+') and regexp_matches(regexp_extract(host, '[^.]*$'), '[a-z]')))) then 'bad_domain'
    when f_ip <> '-' and not regexp_full_match(f_ip, '{_IP}') then 'bad_ip'
    when f_registrant <> '-' and (regexp_matches(f_registrant, '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}\x{{fffd}}]') or not regexp_matches(f_registrant, '\pL')) then 'bad_registrant'
  end as reason from p)
"""
ORACLES = {
    "p7_found": _P7 + "select distinct raw_id, reason from r where reason is not null",
    "p7_loaded": _P7 + "select raw_id as row_id, feed_id, received_at at time zone 'UTC' as received_at, " + ", ".join(f"f_{x} as {x}" for x in _FIELDS[:7]) + ", " + ", ".join(f"try_cast(f_{x} as int) as {x}" for x in _FIELDS[7:]) + f" from r where reason is null qualify row_number() over (partition by raw_id order by feed_id, received_at, {', '.join(f'f_{x}' for x in _FIELDS)}) = 1",
}
