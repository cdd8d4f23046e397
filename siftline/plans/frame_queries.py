"""Queries of cleaning, counting, association, features, clustering and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import clean, dga, ml, stats, yara
from siftline.runtime import cut, table
from siftline.streaming import headers

MONTH_KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]
ADJECTIVES, NOUNS = ("brisk", "calm", "dusty", "eager", "faint", "grand", "hollow", "icy"), ("anvil", "badger", "cinder", "dune", "ember", "falcon", "grove", "harbor")
CENTRES = [[5.0, 950.0], [25.0, 1000.0], [45.0, 1100.0]]


def _mdl(spark, d):
    return table(spark, d, "mdl_data")



def value_counts(spark, d):
    return stats.value_counts(_mdl(spark, d), "asn")


def describe_categorical(spark, d):
    return stats.describe_categorical(_mdl(spark, d), ["ip", "description", "asn", "feed_id"])


def top_k_categories(spark, d):
    return stats.top_values(table(spark, d, "syslog"), "type", 7)


def _seg(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))


def contingency(spark, d):
    return stats.contingency(_seg(spark, d), "nation", "c_mktsegment")


def contingency_conditional(spark, d):
    return stats.gtest(_seg(spark, d), "nation", "c_mktsegment").select("a", "b", F.round("cd", 6).alias("cd"), "total")


def _g(df):
    return df.select("a", "b", "n", "total", F.round("cd", 6).alias("cd"), F.round("exp", 6).alias("exp"), F.round("g", 6).alias("g"))


def gtest_scores(spark, d):
    return _g(stats.gtest(_seg(spark, d), "nation", "c_mktsegment"))


def gtest_topn_matches(spark, d):
    return _g(stats.gtest(_seg(spark, d), "nation", "c_mktsegment", n=10, matches=2))


def gtest_min_volume(spark, d):
    return _g(stats.gtest(_seg(spark, d), "nation", "c_mktsegment", min_volume=60))


def gtest_descriptions(spark, d):
    m = _mdl(spark, d).select(F.lower(F.trim("description")).alias("x"), F.regexp_extract("asn", r"(\d+)", 1).alias("y")).where("x <> '' and x <> '-' and y <> ''")
    return _g(stats.gtest(m, "x", "y", n=20, absent=False))


def unpivot_contingency(spark, d):
    w = stats.wide(stats.contingency(_seg(spark, d), "nation", "c_mktsegment"), "n", ["AUTOMOBILE", "BUILDING"])
    return w.unpivot("a", ["AUTOMOBILE", "BUILDING"], "b", "n")


def pivot_monthly(spark, d):
    p = stats.presence_pivot(table(spark, d, "orders"), "o_orderdate", "o_orderpriority", MONTH_KINDS)
    return stats.period_sums(p, [F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")], MONTH_KINDS)


def pivot_hourly_fill(spark, d):
    e = table(spark, d, "events")
    kinds = ["click", "purchase"]
    p = stats.presence_pivot(e, "ts", "event_type", kinds, 0.01)
    return stats.period_sums(p, [F.hour("ts").alias("h")], kinds).select("h", *[F.round(k, 4).alias(k) for k in kinds])


def volume_by_month(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


def corr_pair(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"))


def corr_matrix_topk(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), NUMERIC).select("x", "y", F.round("corr", 6).alias("corr"))


def corr_top_descriptions(spark, d):
    m = _mdl(spark, d).select("row_id", F.date_trunc("day", "received_at").alias("day"), F.lower(F.trim("description")).alias("kind")).distinct()
    return stats.volume_correlations(m.where("kind not in ('', '-')"), F.col("day"), "kind").select("x", "y", F.round("corr", 6).alias("corr"))


def clean_nulls_dash(spark, d):
    return clean.complete_rows(clean.dash_to_null(_mdl(spark, d).select("row_id", "ip", "reverse", "registrant", "asn")))


def normalise_text(spark, d):
    return clean.normalise_text(_mdl(spark, d).select("row_id", "reverse", "description", "asn"))


def dedup_rows(spark, d):
    return _mdl(spark, d).select("row_id", "domain", "ip", "asn").dropDuplicates()


def conditional_relabel(spark, d):
    x = _mdl(spark, d).select("row_id", F.lit("legit").alias("class"), F.length("domain").alias("n"), F.lit(1).alias("count"))
    return clean.relabel(x, "class", F.col("n") > 25, "weird")


def isin_topk(spark, d):
    return stats.isin_top(_mdl(spark, d).select("row_id", "ip"), "ip", 20)


def union_labelled(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("class"))
    return a.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("class"), F.col("c_name").alias("name")))


def hash_split(spark, d):
    return clean.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def url_netloc(spark, d):
    return _mdl(spark, d).select("row_id", text.netloc(F.col("domain")).alias("host")).distinct()


def domain_2ld(spark, d):
    return _mdl(spark, d).select("row_id", text.registered_label(F.col("domain")).alias("label")).distinct()


def domain_2ld_lenient(spark, d):
    return _mdl(spark, d).select("row_id", text.registered_label(F.col("domain"), ("test", "invalid"), True).alias("label")).distinct()


def timestamp_normalise(spark, d):
    x = _mdl(spark, d).select("row_id", text.feed_timestamp(F.col("date")).alias("ts")).distinct().where("ts is not null")
    return x.select("row_id", F.unix_seconds("ts").alias("epoch_s"), F.year("ts").alias("y"), F.month("ts").alias("m"))


def raw_domain_clean(spark, d):
    return _mdl(spark, d).where("domain is not null").select("row_id", text.first_label(F.col("domain")).alias("label")).distinct()


def _labels(spark, d):
    """Distinct registered labels; generated if they have digits."""
    x = _mdl(spark, d).select(text.registered_label(F.col("domain")).alias("domain")).where("domain is not null").distinct()
    return x.select(F.col("domain").alias("id"), "domain", F.when(F.col("domain").rlike(r"\d"), "dga").otherwise("legit").alias("class"))


def char_entropy(spark, d):
    return _labels(spark, d).select("domain", F.length("domain").alias("length"), F.round(text.entropy(F.col("domain")), 6).alias("entropy"))


def char_ngrams(spark, d):
    return _labels(spark, d).select("domain", F.array_join(text.char_ngrams(F.col("domain")), " ").alias("grams"))


def ngram_counts(spark, d):
    return dga.ngram_counts(_labels(spark, d), "domain").select("gram", "cf", "df", F.round("weight", 6).alias("weight"))


def ngram_scores(spark, d):
    x = cut(_labels(spark, d))
    return dga.ngram_score(x, "id", "domain", dga.ngram_counts(x.where("class = 'legit'"), "domain"), "score").select("domain", F.round("score", 6).alias("score"))


def _features(spark, d):
    x = cut(_labels(spark, d))
    words = table(spark, d, "reading_refs").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) > 2").distinct()
    return dga.features(x, dga.ngram_counts(x.where("class = 'legit'"), "domain", 1e-4), dga.ngram_counts(words, "w", 1e-5))


def ngram_diff_top(spark, d):
    return _features(spark, d).select("domain", F.round("diff", 6).alias("diff")).orderBy(F.desc("diff"), "domain").limit(10)


def dga_forest_predict(spark, d):
    x = cut(clean.hash_split(dga.mark_weird(_features(spark, d)), "domain"))
    scored = dga.evaluate(dga.train(x.where("part = 'train'")), x.where("part = 'test' and class <> 'weird'"))
    return stats.confusion(scored, "class", "prediction")


def dga_importances(spark, d):
    model = dga.train(cut(dga.mark_weird(_features(spark, d))))
    return ml.importances(model.stages[2], dga.FEATURES, spark)


def confusion_matrix(spark, d):
    return stats.confusion(table(spark, d, "pe_features"), "pe_dll", "pe_exe").withColumn("pct", F.round("pct", 6))


def _part(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *PART)


def scale_features(spark, d):
    return ml.scale(_part(spark, d), PART).select("id", *[F.round(c, 5).alias(c) for c in PART])


def covariance(spark, d):
    return ml.covariance(_part(spark, d), PART).select("x", "y", F.round("cov", 4).alias("cov"))


def pca_project(spark, d):
    return ml.pca(ml.scale(_part(spark, d), PART), PART, 2)


def kmeans_assign(spark, d):
    return ml.kmeans(ml.scale(_part(spark, d), PART), PART, 5)


def kmeans_elbow(spark, d):
    return ml.elbow(ml.scale(_part(spark, d), PART), PART)


def kmeans_fixed_centroids(spark, d):
    return ml.assign(_part(spark, d), PART, CENTRES).select("id", "cluster", F.round("distance", 5).alias("distance"))


def dbscan_core(spark, d):
    return ml.dbscan(_part(spark, d), PART, 1.5, 3).select("id", "is_core", (F.col("cluster") == -1).alias("noise"))


def dbscan_labels(spark, d):
    return ml.dbscan(_part(spark, d), PART, 1.5, 3)


def cluster_sizes(spark, d):
    return ml.cluster_sizes(table(spark, d, "embeddings").select(F.col("label").alias("cluster")))


def meanshift_labels(spark, d):
    return ml.mean_shift(ml.scale(_part(spark, d), PART), PART)


def cluster_member_join(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("label").alias("cluster"))
    return ml.members(labels, table(spark, d, "part"), "p_partkey").select("p_partkey", "cluster", "p_name")


def cluster_constants(spark, d):
    return stats.constant_columns(table(spark, d, "pe_features"), "number_of_sections", ["pe_exe", "pe_dll", "pe_driver", "pe_i386", "number_of_rva_and_sizes"])


def nibble_mask(spark, d):
    x = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.lower(F.lpad(F.hex((F.col("p_size") * 65536).cast("bigint")), 8, "0"))).alias("v"))
    return x.select("p_brand", text.nibble_mask(F.col("v")).alias("mask"))


def hex_pack_le(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.hex_le(F.col("o_orderkey")).alias("hex"))


def rule_names(spark, d):
    return table(spark, d, "pe_features").where("filename is not null").select("filename", text.rule_name(F.col("filename")).alias("rule")).distinct()


def yara_text(spark, d):
    x = table(spark, d, "known_packers").select(F.col("packer_name").alias("name"), F.filter("section_names", lambda s: s.isNotNull()).alias("strings"))
    return yara.rule_texts(x)


def vsn_names(spark, d):
    return table(spark, d, "pe_features").where("filename is not null").select("filename", text.friendly_name(F.md5("filename"), ADJECTIVES, NOUNS).alias("name")).distinct()


def sha256_names(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


def heap_top_n(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def sort_head(spark, d):
    return table(spark, d, "part").orderBy("p_retailprice", "p_partkey").limit(10).select("p_partkey", "p_retailprice")


def version_major_minor(spark, d):
    v = F.concat_ws(".", F.col("major_version").cast("string"), F.col("minor_version").cast("string"), F.lit("7"))
    return table(spark, d, "pe_features").where("major_version >= 0 and minor_version >= 0").select("sample_id", text.major_minor(v).alias("v")).distinct()


def distinct_sets(spark, d):
    x = table(spark, d, "pe_features").select("origin", F.explode("imported_symbols").alias("s"))
    return x.groupBy("origin").agg(F.count_distinct("s").alias("symbols"))


def json_header_events(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("value")))).alias("h"))
    pairs = F.transform("h", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return e.select("user_id", headers.headers_json(pairs).alias("json"))


def header_agent_pick(spark, d):
    """Log entries of a host as header events: a batch run of the stream operator."""
    e = table(spark, d, "events")
    event = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").otherwise("header")
    x = e.select(F.col("user_id").alias("conn"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.lit(True).alias("is_orig"), event.alias("event"), F.when(F.col("event_type") == "click", "USER-AGENT").otherwise("ACCEPT").alias("name"), F.col("props").alias("value"))
    return headers.batch(x)



QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_SEG = "s as (select c_nationkey::varchar a, c_mktsegment b from customer where c_nationkey is not null and c_mktsegment is not null)"


def _gsql(n=0, matches=0, volume=0):
    top = f", s2 as (select * from s where a in (select a from s group by a order by count(*) desc, a limit {n}))" if n else ", s2 as (select * from s)"
    kept = f" where b in (select b from (select b, row_number() over (partition by a order by n desc, b) r from grid) where r between 2 and {matches})" if matches else ""
    return f"""with {_SEG}{top}, c as (select a, b, count(*) n from s2 group by all), ra as (select a, count(*) t from s2 group by a), rb as (select b, count(*) u from s2 group by b),
grid as (select ra.a, rb.b, coalesce(c.n, 0) n, t, u from ra cross join rb left join c on c.a = ra.a and c.b = rb.b), k as (select *, case when t > {volume} then t end tt, (select count(*) from s2) w from grid{kept})
select a, b, n, tt as total, round(n / tt::double, 6) as cd, round(tt * u / w::double, 6) as exp, round(case when n = 0 then case when tt is not null then 0.0 end else 2 * n * ln(n / (tt * u / w::double)) end, 6) as g from k"""


_PRESENT = "select o_orderdate, {0} from orders group by o_orderdate"
_KNOWN = "|".join(x.replace(".", r"\.") for x in sorted(text.SUFFIXES, key=lambda x: (-x.count("."), -len(x), x)))
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(domain, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
_LAB = rf"nullif(regexp_extract({_HOST}, '(?:^|\.)([^.]+)\.(?:{_KNOWN})$', 1), '')"
_DOM = f"x as (select distinct {_LAB} as domain from mdl_data where {_LAB} is not null)"
_GRAMS = "g as (select domain, unnest(list_concat(list_transform(range(1, greatest(length(domain) - 1, 1)), lambda i: domain[i:i + 2]), list_transform(range(1, greatest(length(domain) - 2, 1)), lambda i: domain[i:i + 3]), list_transform(range(1, greatest(length(domain) - 3, 1)), lambda i: domain[i:i + 4]))) as gram from x)"
ORACLES = {
    "value_counts": "select asn, count(*) as n from mdl_data group by asn",
    "describe_categorical": " union all ".join(f"select '{c}' as \"column\", sum(n)::bigint as count, count(*) as \"unique\", min_by(v, (-n, v)) as top, max(n) as freq from (select {c}::varchar v, count(*) n from mdl_data where {c} is not null group by 1)" for c in ("ip", "description", "asn", "feed_id")),
    "top_k_categories": "select type, count(*) as n from syslog where type is not null group by type order by n desc, type limit 7",
    "contingency": f"select a, b, n from ({_gsql()})",
    "contingency_conditional": f"select a, b, cd, total from ({_gsql()})",
    "gtest_scores": _gsql(),
    "gtest_topn_matches": _gsql(10, 2),
    "gtest_min_volume": _gsql(volume=60),
    "unpivot_contingency": f"select a, b, n from ({_gsql()}) where b in ('AUTOMOBILE', 'BUILDING')",
    "pivot_monthly": "select year(o_orderdate)::int as y, month(o_orderdate)::int as m, " + ", ".join(f"count(distinct case when o_orderpriority = '{k}' then o_orderdate end)::double as \"{k}\"" for k in MONTH_KINDS) + " from orders group by 1, 2",
    "pivot_hourly_fill": "select h, round(sum(c), 4) as click, round(sum(p), 4) as purchase from (select ts, hour(ts)::int as h, case when bool_or(event_type = 'click') then 1 else 0.01 end::double c, case when bool_or(event_type = 'purchase') then 1 else 0.01 end::double p from events group by ts) group by h",
    "volume_by_month": "select year(o_orderdate)::int as y, month(o_orderdate)::int as m, count(*) as n from orders group by 1, 2",
    "corr_pair": "select round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem",
    "yara_text": r"""
with p as (select packer_name as name, list_filter(section_names, lambda v: v is not null and v <> '') as l from known_packers),
q as (select name, list_filter(list_filter(l, lambda v, i: list_position(l, v) = i), lambda v: length(v) < 1000) as l from p)
select name, 'rule ' || left(regexp_replace(regexp_replace(coalesce(name, ''), '^[0-9]', ''), '[^A-Za-z0-9_]', '_', 'g'), 128) || chr(10) || '{' || chr(10) ||
  case when len(l) > 0 then chr(10) || 'strings:' || chr(10) || '    ' || array_to_string(list_transform(l, lambda v, i: '$string' || i::varchar || ' = "' || v || '"'), chr(10) || '    ') || chr(10) else '' end ||
  chr(10) || 'condition:' || chr(10) || '    ' || case when len(l) > 0 then 'all of ($string*)' else 'true' end || chr(10) || '}' as text from q
""",
    "gtest_descriptions": r"""
with m as (select lower(trim(description)) as x, regexp_extract(asn, '(\d+)', 1) as y from mdl_data where lower(trim(description)) not in ('', '-') and regexp_extract(asn, '(\d+)', 1) <> ''),
r as (select * from m semi join (select x, count(*) as n from m group by x order by n desc, x limit 20) using (x)),
c as (select x as a, y as b, count(*) as n, sum(count(*)) over (partition by x) as total, sum(count(*)) over (partition by y) as col_total, sum(count(*)) over () as grand from r group by x, y),
e as (select a, b, n, total, n / total as cd, total * col_total / grand as exp from c)
select a, b, n, total::bigint as total, round(cd, 6) as cd, round(exp, 6) as exp, round(2 * n * ln(n / exp), 6) as g from e
""",
    "corr_top_descriptions": """
with m as (select distinct row_id, date_trunc('day', received_at at time zone 'UTC') as day, lower(trim(description)) as kind from mdl_data where lower(trim(description)) not in ('', '-')),
top as (select kind, count(*) as n from m group by kind order by n desc, kind limit 20),
t as (select day, kind, count(*) as n from m semi join top using (kind) group by all),
g as (select day, kind, coalesce(n, 0) as n from (select distinct day from t) cross join (select kind from top) left join t using (day, kind))
select a.kind as x, b.kind as y, round(corr(a.n, b.n), 6) as corr from g a join g b on a.day = b.day and a.kind <= b.kind group by all
""",
    "json_header_events": """
select user_id, '[' || string_agg('{"' || event_type || '":"' || json_extract_string(props, '$.k') || '"}', ',' order by event_id) || ']' as json from events group by user_id
""",
    "header_agent_pick": """
with e as (select *, sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events),
r as (select * from e where run > 0 and event_type is not null),
h as (
  select user_id, run, max(ts) filter (event_type = 'purchase') as ts, count(*) filter (event_type = 'purchase') as dones,
    string_agg('{"' || case when event_type = 'click' then 'USER-AGENT' else 'ACCEPT' end || '":' || to_json(props)::varchar || '}', ',' order by ts, event_id) filter (event_type not in ('view', 'purchase')) as headers,
    last(props order by ts, event_id) filter (event_type = 'click') as agent
  from r group by user_id, run)
select ts, 'client' as origin, coalesce(agent, 'unknown') as useragent, coalesce('[' || headers || ']', '[]') as header_events_json from h where dones > 0
""",
    "corr_matrix_topk": " union all ".join(f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as corr from lineitem" for i, x in enumerate(NUMERIC) for y in NUMERIC[i:]),
    "clean_nulls_dash": "select row_id, ip, reverse, registrant, asn from mdl_data where row_id is not null and nullif(ip, '-') is not null and nullif(reverse, '-') is not null and nullif(registrant, '-') is not null and nullif(asn, '-') is not null",
    "normalise_text": "select row_id, " + ", ".join(rf"lower(regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')) as {c}" for c in ("reverse", "description", "asn")) + " from mdl_data",
    "dedup_rows": "select distinct row_id, domain, ip, asn from mdl_data",
    "conditional_relabel": "select row_id, case when length(domain) > 25 then 'weird' else 'legit' end as class, length(domain)::int as n, 1 as count from mdl_data",
    "isin_topk": "select row_id, ip from mdl_data where ip in (select ip from mdl_data where ip is not null group by ip order by count(*) desc, ip limit 20)",
    "union_labelled": "select s_name as name, 'supplier' as class from supplier union all select c_name, 'customer' from customer",
    "hash_split": "select o_orderkey, case when ('0x' || md5(o_orderkey::varchar)[1:8])::bigint % 100 < 80 then 'train' else 'test' end as part from orders",
    "url_netloc": "select distinct row_id, regexp_extract(domain, '^([^/?#]*)', 1) as host from mdl_data",
    "domain_2ld": f"select distinct row_id, {_LAB} as label from mdl_data",
    "domain_2ld_lenient": rf"select distinct row_id, case when regexp_extract(h, '(?:^|\.)([^.]+)\.(?:invalid|test)$', 1) <> '' then regexp_extract(h, '(?:^|\.)([^.]+)\.(?:invalid|test)$', 1) when h <> '' then string_split(h, '.')[-1] end as label from (select row_id, {_HOST} as h from mdl_data)",
    "timestamp_normalise": "select distinct row_id, epoch(ts)::bigint as epoch_s, year(ts)::int as y, month(ts)::int as m from (select row_id, try_strptime(replace(trim(date), '_', ' '), '%Y/%m/%d %H:%M') ts from mdl_data where regexp_full_match(trim(date), '\\d{4}/\\d{2}/\\d{2}_\\d{2}:\\d{2}')) where ts is not null".replace("\\\\", "\\"),
    "raw_domain_clean": "select distinct row_id, lower(trim(string_split(domain, '.')[1])) as label from mdl_data where domain is not null",
    "char_entropy": f"with {_DOM}, c as (select domain, ch, count(*) n from (select domain, unnest(string_split(domain, '')) ch from x) group by all) select domain, length(domain)::int as length, round(-sum(n / length(domain)::double * log2(n / length(domain)::double)), 6) as entropy from c group by domain",
    "char_ngrams": f"with {_DOM} select domain, coalesce(array_to_string(list_concat(list_transform(range(1, greatest(length(domain) - 1, 1)), lambda i: domain[i:i + 2]), list_transform(range(1, greatest(length(domain) - 2, 1)), lambda i: domain[i:i + 3]), list_transform(range(1, greatest(length(domain) - 3, 1)), lambda i: domain[i:i + 4])), ' '), '') as grams from x",
    "ngram_counts": f"with {_DOM}, {_GRAMS} select gram, count(*) as cf, count(distinct domain) as df, round(log10(count(*)), 6) as weight from g group by gram",
    "ngram_scores": rf"with {_DOM}, {_GRAMS}, w as (select gram, log10(count(*)) v from g where not regexp_matches(domain, '\d') group by gram) select x.domain, round(coalesce(sum(v), 0), 6) as score from x left join g on g.domain = x.domain left join w on w.gram = g.gram group by x.domain",
    "confusion_matrix": "select pe_dll as label, pe_exe as predicted, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by pe_dll), 6)::double as pct from pe_features group by pe_dll, pe_exe",
    "scale_features": "select p_partkey as id, " + ", ".join(f"round((p.{c} - s.m_{c}) / s.s_{c}, 5) as {c}" for c in PART) + " from part p, (select " + ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in PART) + " from part) s",
    "covariance": " union all ".join(f"select '{x}' as x, '{y}' as y, round(covar_pop({x}, {y}), 4) as cov from part" for i, x in enumerate(PART) for y in PART[i:]),
    "kmeans_fixed_centroids": "select id, k as cluster, round(sqrt(dd), 5) as distance from (select p_partkey as id, k::int k, dd, row_number() over (partition by p_partkey order by dd, k) r from (" + " union all ".join(f"select p_partkey, {i} k, (p_size - {c[0]}) ** 2 + (p_retailprice - {c[1]}) ** 2 dd from part" for i, c in enumerate(CENTRES)) + ")) where r = 1",
    "dbscan_core": "with n as (select a.p_partkey a, b.p_partkey b from part a join part b on abs(a.p_size - b.p_size) <= 1 and (a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2 <= 2.25), c as (select a from n group by a having count(*) >= 3) select p_partkey as id, p_partkey in (select a from c) as is_core, p_partkey not in (select n.a from n join c on c.a = n.b) as noise from part",
    "cluster_sizes": "select count(distinct label) as clusters, count(*) filter (label <> -1) as labelled, count(*) filter (label = -1) as unlabelled from embeddings",
    "cluster_member_join": "select p_partkey, label as cluster, p_name from embeddings join part on vec_id = p_partkey",
    "cluster_constants": " union all ".join(f"select number_of_sections as cluster, '{c}' as \"column\", count(distinct {c}) as n_values, case when count(distinct {c}) = 1 then min({c}::varchar) end as value from pe_features where {c} is not null group by number_of_sections" for c in ("pe_exe", "pe_dll", "pe_driver", "pe_i386", "number_of_rva_and_sizes")),
    "nibble_mask": "with v as (select distinct p_brand, lower(lpad(to_hex(p_size::bigint * 65536), 8, '0')) h from part) select p_brand, nullif(" + " || ".join(f"case when count(distinct h[{i}:{i}]) = 1 then min(h[{i}:{i}]) else '?' end" for i in range(1, 9)) + ", '????????') as mask from v group by p_brand",
    "hex_pack_le": "with h as (select o_orderkey, lower(lpad(to_hex(o_orderkey), 8, '0')) b from orders) select o_orderkey, b[7:8] || b[5:6] || b[3:4] || b[1:2] as hex from h",
    "rule_names": "select distinct filename, regexp_replace(regexp_replace(filename, '^[0-9]', ''), '[^A-Za-z0-9_]', '_', 'g')[1:128] as rule from pe_features where filename is not null",
    "vsn_names": "select distinct filename, [" + ", ".join(f"'{a}'" for a in ADJECTIVES) + "][1 + (('0x' || md5(md5(filename))[1:8])::bigint % 8)] || ' ' || [" + ", ".join(f"'{a}'" for a in NOUNS) + "][1 + (('0x' || md5(md5(filename))[9:16])::bigint % 8)] || ' ' || md5(filename)[1:4] as name from pe_features where filename is not null",
    "sha256_names": "select doc_id, sha256(text) as sha from documents where text is not null",
    "heap_top_n": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "sort_head": "select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 10",
    "version_major_minor": "select distinct sample_id, (major_version::varchar || '.' || minor_version::varchar)::double as v from pe_features where major_version >= 0 and minor_version >= 0",
    "distinct_sets": "select origin, count(distinct s) as symbols from (select origin, unnest(imported_symbols) s from pe_features) group by origin",
}
