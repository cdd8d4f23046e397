"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from siftline.llm import bpe, components, cooccur, mixing, mixture, reading, set_join
from siftline.runtime import table


def p1_found(spark, d):
    return set_join.alike_records(*(table(spark, d, t) for t in ("syslog", "pe_features", "known_packers")))


def _classes(spark, d):
    return set_join.alike_classes(*(table(spark, d, t) for t in ("syslog", "pe_features", "known_packers")))


def p1_class_pairs(spark, d):
    return _classes(spark, d)[0]


def p1_members(spark, d):
    return _classes(spark, d)[1]


def p2_found(spark, d):
    return mixture.neighbour_groups(table(spark, d, "pe_features"))


def p2_clusters(spark, d):
    return mixture.clusters(table(spark, d, "pe_features"))


def p2_groups(spark, d):
    return mixture.described_groups(table(spark, d, "pe_features"))


def p4_found(spark, d):
    return cooccur.pairs(cooccur.mdl_items(table(spark, d, "mdl_data"))).select("item_a", "item_b")


def p4_lift(spark, d):
    return cooccur.pairs(cooccur.mdl_items(table(spark, d, "mdl_data")))


def p5_found(spark, d):
    return components.sim_groups(table(spark, d, "sims"))


def p8_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_refs")).select("doc_id", "grade")


QUERIES = {f.__name__: f for f in (p1_found, p1_class_pairs, p1_members, p2_found, p2_clusters, p2_groups, p4_found, p4_lift, p5_found, p8_ids, p9_mix, p9_shares, p10_found)}

_VALUES = "list_sort(list_distinct(list_filter(list_transform({0}, lambda x: lower(trim(x))), lambda x: x is not null and x <> '')))"
_P4 = r"""
with x as (
  select regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '[/?#].*$', ''), ':[^:]*$', ''), '\.+$', '') host,
         trim(regexp_replace(lower(description), '\s+', ' ', 'g')) d, regexp_extract(asn, '(\d+)', 1) a
  from mdl_data where domain is not null),
i as (
  select distinct host, 'desc:' || d item from x where host not in ('', '-') and d not in ('', '-')
  union select distinct host, 'asn:' || a from x where host not in ('', '-') and a <> ''),
total as (select count(distinct host) as baskets from i),
c as (select item, count(*) as n from i group by item),
p as (select l.item as item_a, r.item as item_b, count(*) as n_ab from i l join i r on l.host = r.host and l.item < r.item group by all having count(*) >= 4)
"""
ORACLES = {
    "p1_found": f"""
with f as (select distinct line_id id, {_VALUES.format("features")} v from syslog),
p as (select distinct sample_id id, {_VALUES.format("imported_symbols")} v, {_VALUES.format("section_names")} w from pe_features),
k as (select distinct packer_id id, {_VALUES.format("section_names")} v from known_packers)
select 'features' as field_name, a.id as id_a, b.id as id_b from f a join f b on a.id < b.id and len(a.v) >= 10 and len(b.v) >= 10
  and least(len(a.v), len(b.v)) * 10 >= 8 * greatest(len(a.v), len(b.v)) and len(list_intersect(a.v, b.v)) * 10 >= 8 * greatest(len(a.v), len(b.v))
union all
select 'imported_symbols', a.id, b.id from p a join p b on a.id < b.id and len(a.v) >= 8 and len(b.v) >= 8
  and least(len(a.v), len(b.v)) * 10 >= 7 * greatest(len(a.v), len(b.v)) and len(list_intersect(a.v, b.v)) * 10 >= 7 * greatest(len(a.v), len(b.v))
union all
select 'section_names', a.id, b.id from k a join p b on len(a.v) > 0 and len(b.w) > 0 and len(list_intersect(a.v, b.w)) * 10 >= 6 * greatest(len(a.v), len(b.w))
""",
    "p2_found": """
with recursive s as (
  select distinct sample_id id, number_of_sections n, sec_entropy_text e, size_code z, number_of_import_symbols m from pe_features
  where number_of_sections <> -99 and sec_entropy_text <> -99 and size_code <> -99 and number_of_import_symbols <> -99),
links as (select a.id a, b.id b from s a join s b on a.n = b.n and abs(a.e - b.e) <= 0.05 + 1e-9 and 100 * abs(a.z - b.z) <= 3 * greatest(a.z, b.z) and abs(a.m - b.m) <= 2),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select * from (select min(b) over (partition by a) as group_id, a as sample_id, count(*) over (partition by a) as k from reach where true) where k >= 5
group by all
""".replace("select * from", "select distinct group_id, sample_id from").replace("\ngroup by all", ""),
    "p4_found": _P4 + "select item_a, item_b from p join c a on a.item = item_a join c b on b.item = item_b, total where n_ab * baskets >= 3 * a.n * b.n",
    "p4_lift": _P4 + "select item_a, item_b, n_ab, a.n as n_a, b.n as n_b, baskets as n_baskets from p join c a on a.item = item_a join c b on b.item = item_b, total where n_ab * baskets >= 3 * a.n * b.n",
    "p5_found": """
with recursive e as (select source a, target b from sims where source <> target and sim >= 0.5 and sim <= 1 and not isnan(sim)),
l as (select a, b from e union select b, a from e),
r as (select a as node, a as label from l union select l.b, r.label from r join l on l.a = r.node where r.label < l.b)
select min(label) as group_id, node as record_id from r group by node
""",
}
