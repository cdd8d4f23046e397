import math
import re
import struct

import pytest
from pyspark.sql import functions as F

from siftline.functions import similarity, text
from siftline.operators import clean, dga, file_rules, graph, lsh, ml, morph, stats, yara
from siftline.sources import binary, text_feeds
from siftline.streaming import headers, incremental

RECORDS = ["a b c d", "a b c e", "z b c d", "a b e d", "w x y z", "x y z", "w x q z y", "r s t", "u s t"]
PAIRS = {  # src, dst: jaccard, distance, tapered distance
    (0, 1): (0.75, 1, 0.25), (0, 2): (0.75, 1, 1.0), (0, 3): (0.75, 1, 0.5), (1, 2): (0.5, 2, 1.25), (1, 3): (0.75, 2, 0.75), (2, 4): (0.25, 4, 2.5), (4, 6): (0.8, 2, 1.0), (5, 6): (0.6, 3, 2.4), (7, 8): (2 / 3, 1, 1.0),
}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, r.split()) for i, r in enumerate(RECORDS)], "id bigint, tokens array<string>").cache()


def test_metrics(spark, records):
    pairs = spark.createDataFrame(list(PAIRS), "src bigint, dst bigint")
    for metric, at in (("jaccard", 0), ("levenshtein_D", 1), ("levenshtein_tapered", 2)):
        got = {(r["src"], r["dst"]): r["sim"] for r in lsh.similarities(records, pairs, metric, -1 if at == 0 else 99).collect()}
        assert got == {k: pytest.approx(v[at]) for k, v in PAIRS.items()}
    with pytest.raises(NotImplementedError):
        lsh.similarities(records, pairs, "other")


def test_search(spark, records):
    p = lsh.MinHash(bands=20, rows=1)
    found = {(r["src"], r["dst"]) for r in lsh.batch(records, p, "jaccard", 0.0).collect()}
    assert (0, 1) in found and (7, 8) in found and all(set(RECORDS[a].split()) & set(RECORDS[b].split()) for a, b in found)
    with pytest.raises(ValueError):
        lsh.MinHash(bands=3, rows=4)
    dirty = records.union(spark.createDataFrame([(90, None), (91, []), (92, RECORDS[0].split())], records.schema))
    assert {r["id"]: r["rep_id"] for r in lsh.memberships(dirty).collect()}[92] == 0
    assert lsh.batch(dirty.limit(0)).count() == 0


def test_model_and_incremental_index(spark, records, tmp_path):
    p = lsh.MinHash(bands=20, rows=1)
    sigs = lsh.signatures(records, p)
    buckets = lsh.bands(sigs, p)
    lsh.save(str(tmp_path / "m"), buckets, sigs, lsh.candidate_pairs(buckets), p)
    salts, tables = lsh.load(spark, str(tmp_path / "m"))
    assert salts == p.salt_list() and tables["sigs"].count() == 9
    path = str(tmp_path / "index")
    incremental.add(records, path, p, "e1")
    incremental.add(records, path, p, "e1")  # again: replaces
    assert spark.read.parquet(f"{path}/records").count() == records.count()
    assert incremental.lookup(records, path, p, without="e1").count() == 0
    query = spark.createDataFrame([(1000, ["x", "y", "z", "h"])], records.schema)
    best = [(r["id"], round(r["sim"], 2)) for r in lsh.top_n(incremental.lookup(query, path, p)).orderBy("rank").collect()]
    assert best and set(best) <= {(2, 0.25), (4, 0.75), (5, 0.75), (6, 0.6)} and best == sorted(best, key=lambda x: (-x[1], -x[0]))


def test_incremental_stream(spark, records, tmp_path):
    source = str(tmp_path / "in")
    records.write.parquet(source)
    stream = spark.readStream.schema(records.schema).parquet(source)
    q = incremental.follow(stream, str(tmp_path / "ix"), str(tmp_path / "out"), str(tmp_path / "cp"), lsh.MinHash(bands=20, rows=1))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "ix/records")).count() == 9


def test_trees(spark, records):
    sims = lsh.batch(records, lsh.MinHash(bands=20, rows=1), "jaccard", 0.2)
    tree = graph.trees(sims, records, 0.0)
    rows = tree.collect()
    leaves = {r["child"] for r in rows if not r["is_meta"]}
    assert leaves == {str(x) for r in sims.collect() for x in (r["src"], r["dst"])}
    roots = [r for r in rows if r["parent"] is None]
    assert len(rows) - len(roots) == len({r["child"] for r in rows}) - len(roots)
    assert graph.exemplars(tree).count() == len(roots)
    assert '"children"' in graph.to_json(tree, roots[0]["component"])
    assert graph.trees(sims.limit(0), records).count() == 0


def test_gtest(spark):
    df = spark.createDataFrame([("x", "p")] * 3 + [("x", "q"), ("y", "p")] + [("y", "q")] * 3 + [(None, "p")], "a string, b string")
    got = {(r["a"], r["b"]): r for r in stats.gtest(df, "a", "b").collect()}
    assert got["x", "p"]["g"] == pytest.approx(2.432790648649) and got["x", "q"]["g"] == pytest.approx(-1.386294361120) and got["x", "p"]["cd"] == 0.75
    assert stats.contingency(df, "a", "b", matches=10).count() == 4 and stats.gtest(df.limit(0), "a", "b").count() == 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for word, value in (("google", 1.918295834054), ("facebook", 2.75), ("", 0.0)):
        assert one(text.entropy(F.lit(word))) == pytest.approx(value)
    assert one(text.registered_label(F.lit("http://u@www.a.co.uk:80/x"))) == "a" and one(text.registered_label(F.lit("a.zz"))) is None and one(text.registered_label(F.lit("a.zz"), lenient=True)) == "zz"
    assert one(text.hex_le(F.lit(0x1234))) == "34120000" and one(text.nibble_mask(F.array(F.lit("00010000"), F.lit("00020000")))) == "000?0000"
    assert one(text.alpha_word(F.lit("Ab"))) == "ab" and one(text.alpha_word(F.lit(" ab"))) is None
    assert one(text.major_minor(F.lit("10.7.5"))) == 10.7 and one(text.rule_name(F.lit("1a-b"))) == "a_b"
    assert one(text.char_ngrams(F.lit("abcd"))) == ["abc", "bcd", "abcd"] and one(text.char_ngrams(F.lit(None).cast("string"))) is None
    assert one(text.printable_runs(F.lit(b"\x00abcdefgh\x00short\x00").cast("binary"))) == ["abcdefgh"]
    assert one(similarity.token_hash(F.lit("a"), "5")) == 3253129010


def test_clean(spark):
    df = spark.createDataFrame([("-", " A ", None), ("x", "b", 1.0)], "a string, b string, LC_n double")
    assert clean.complete_rows(clean.dash_to_null(df)).count() == 1
    assert clean.normalise_text(df).first()["b"] == "a"
    assert clean.fill_by_prefix(df, {"LC_": 0}).first()["LC_n"] == 0 and clean.without(df, "LC").columns == ["a", "b"]


def test_learning(spark):
    data = [(i, float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3) * 10 + (i % 5) * 0.1) for i in range(90)] + [(99, 500.0, 500.0), (100, None, 1.0)]
    df = spark.createDataFrame(data, "id bigint, x double, y double")
    labels = {r["id"]: r["cluster"] for r in ml.dbscan(df, ["x", "y"], 1.0, 3).collect()}
    assert labels[99] == -1 and len({labels[i] for i in range(90)}) == 3 and 100 not in labels
    assert len({r["cluster"] for r in ml.mean_shift(df.where("id < 90"), ["x", "y"], 3.0).collect()}) == 3
    assert len(ml.pca(df, ["x", "y"]).columns) in (2, 3) and ml.kmeans(df, ["x", "y"], 3).count() == 91


def test_domains(spark):
    names = spark.createDataFrame([(i, f"{w}{v}", "legit") for i, (w, v) in enumerate((w, v) for w in ("garden", "market", "window") for v in ("shop", "house", "line", "world"))] + [(100 + i, f"x{i}q{i * 7}zk{i}", "dga") for i in range(12)], "id bigint, domain string, class string")
    grams = dga.ngram_counts(names.where("class = 'legit'"), "domain")
    x = dga.mark_weird(dga.features(names, grams, grams), 0, 0)
    scored = dga.evaluate(dga.train(x), x)
    assert scored.where("class = prediction").count() >= 22


def test_morpher(spark):
    m = morph.Morpher()
    seqs = ["HOST CONNECTION ACCEPT USER_AGENT", "HOST CONNECTION AUTHORIZATION ACCEPT USER_AGENT", "HOST ACCEPT USER_AGENT", "HOST ACCEPT BLAH-BLAH"]
    for s in seqs:
        m.add(s.split())
    assert all(m.matches(s.split()) for s in seqs) and not m.matches(["ACCEPT", "HOST"])
    df = spark.createDataFrame([("k", i, s.split()) for i, s in enumerate(seqs)], "key string, seq_no int, tokens array<string>")
    assert all(re.match(morph.learn(df).first()["pattern"], "".join(s.split())) for s in seqs)


def test_rules(spark, tmp_path):
    rule = yara.Rule("1a b", {"author": "me"}, "tag")
    rule.group("s", ["one", "two", "one"])
    rule.offset("h", "4d5a", 0)
    rule.part("p", "0102", count=2)
    rule.size = 9
    made = rule.text()
    assert made.startswith("rule a_b : tag\n{\nmeta:\n") and '$s2 = "two"' in made and "all of ($s*) and\n    $h at 0 and\n    #p == 2 and\n    filesize == 9" in made and "{ 4d 5a }" in made
    cluster = yara.cluster_rule("c", 128, 0x10B, {"machine": 0x14C, "magic": 0x10B}, {"checksum": "000?0000"}).text()
    assert "{ 4c 01 }" in cluster and "at 152" in cluster and "0?" in cluster or "0? " in cluster
    df = spark.createDataFrame([("r1", ["a", None]), ("r2", None)], "name string, strings array<string>")
    yara.write_rules(yara.rule_texts(df), str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).count() > 2


def pe_image():
    optional = bytearray(224)
    struct.pack_into("<HBBIII", optional, 0, 0x10B, 9, 1, 512, 512, 0)
    struct.pack_into("<I", optional, 92, 16)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 2, 77, 0, 0, 224, 0x2002)
    table = b"".join(struct.pack("<8sIIII16x", n, size, va, size, ptr) for n, va, ptr, size in ((b".text", 0x1000, 512, 256), (b".odd", 0x2000, 768, 256)))
    return (head + bytes(optional) + table).ljust(512, b"\0") + bytes(range(256)) + bytes(256)


def test_binaries(spark, tmp_path):
    (tmp_path / "pe.bin").write_bytes(pe_image())
    (tmp_path / "bad.bin").write_bytes(b"nothing")
    files = binary.files(spark, str(tmp_path))
    got = {r["filename"].rsplit("/", 1)[1]: r for r in binary.extract(files).collect()}
    f = got["pe.bin"]["features"]
    assert f["number_of_sections"] == 2 and f["pe_dll"] == 1 and f["std_section_names"] == 0 and f["sec_entropy_text"] == 8.0 and f["sec_entropy_odd"] == 0.0 and f["compile_date"] == 77 and f["size_code"] == 512
    assert got["bad.bin"]["error"] and got["pe.bin"]["section_names"] == [".text", ".odd"]
    assert binary.as_columns(binary.extract(files, "pe_cluster"), ["machine"], -1).where("machine = 332").count() == 1
    macho = struct.pack("<IIIIIIII", 0xFEEDFACF, 7, 3, 2, 2, 48, 0, 0) + struct.pack("<IIIIII", 2, 24, 100, 5, 200, 50) + struct.pack("<IIII", 0x24, 16, (10 << 16) | (7 << 8), 0)
    (rows,) = binary.macho(macho)
    assert rows["LC_SYMTAB"] == 1 and rows["lc_symtab_nsyms"] == 5 and rows["lc_version_min"] == pytest.approx(10.7)


def test_file_rules(spark, tmp_path):
    text_ = file_rules.pe_rule(pe_image() + b"printable text", "x").text()
    assert "{ 50 45 00 00 }" in text_ and "$pe_signature at 64" in text_ and "{ 2e 74 65 78 74 00 00 00 }" in text_ and b"printable text".hex(" ") in text_
    assert file_rules.pe_rule(b"zz", "x").text() == "rule x\n{\n\ncondition:\n    filesize == 2\n}"
    macho = struct.pack("<IIIIIIII", 0xFEEDFACF, 7, 3, 2, 2, 48, 0, 0) + struct.pack("<IIIIII", 2, 24, 100, 5, 200, 50) + struct.pack("<IIII", 0x24, 16, (10 << 16) | (7 << 8), 0)
    made = file_rules.macho_rule(macho, "m").text()
    assert "{ cf fa ed fe }" in made and "#LC_SYMTAB_count == 1" in made and "{ 24 00 00 00 10 00 00 00 ?? 07 0a 00 }" in made
    cluster = file_rules.macho_cluster_rule("c", {"lc_symtab_nsyms": 5, "LC_UUID": 1, "lc_segment_64_vmsize": 4096}).text()
    assert "{ 02 00 00 00 ?? ?? ?? ?? ?? ?? ?? ?? 05 00 00 00 }" in cluster and "{ 1b 00 00 00 ?? 00 00 00 }" in cluster and "LC_SEGMENT_64" in cluster
    (tmp_path / "a").write_bytes(pe_image())
    assert file_rules.file_rules(binary.files(spark, str(tmp_path))).first()["text"].startswith("rule f")


def test_feeds(spark, tmp_path):
    (tmp_path / "z.log").write_text("#separator \\x09\n#fields\tts\torigin\tn\ttags\n#types\ttime\tstring\tcount\tset[string]\n1.5\tclient\t3\ta,b\n2\t-\t-\t(empty)\nshort\n#close\tx\n")
    rows = text_feeds.zeek(spark, str(tmp_path / "z.log")).orderBy("ts").collect()
    assert [(r["origin"], r["n"], r["tags"]) for r in rows] == [("client", 3, ["a", "b"]), (None, None, [])]
    lines = spark.createDataFrame([("Jan  2 00:52:29 h a[1]: x",), ("nonsense",), ("Jan 2",), (None,)], "value string")
    got = text_feeds.syslog_tokens(lines, 2024).collect()
    assert len(got) == 1 and got[0]["type"] == "a" and got[0]["label"] == "a[1]::x"
    (tmp_path / "clean").mkdir()
    (tmp_path / "clean" / f"{'a' * 64}.results").write_text('{\n "positives": 2,\n "scans": {"E X": {"detected": true}}\n}')
    doc = text_feeds.json_documents(spark, str(tmp_path / "clean"), text_feeds.ENGINE_SCANS)
    row = doc.first()
    assert row["label"] == "clean" and row["file_sha256"] == "a" * 64 and row["scans"]["E X"]["detected"]
    hashes = spark.createDataFrame([("A" * 64,)], "value string")
    assert text_feeds.listed(doc, hashes).count() == 1 and text_feeds.listed(doc, hashes, keep=False).count() == 0


EVENTS = [
    ("c", 1, 1, True, "header", "LOST", "x"), ("c", 2, 2, True, "start", None, None), ("c", 3, 3, True, "header", "user-agent", "ua1"), ("c", 4, 4, True, "header", "COOKIE", "s"), ("c", 5, 5, True, "done", None, None),
    ("d", 1, 6, False, "start", None, None), ("d", 2, 7, False, "done", None, None), ("d", 3, 8, False, "start", None, None), ("d", 4, 9, False, "header", "SERVER", "n"), ("d", 5, 10, False, "done", None, None), ("e", 1, 11, True, "done", None, None),
]


def test_headers_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "conn string, t bigint, seq bigint, is_orig boolean, event string, name string, value string").selectExpr("*", "timestamp_seconds(t) as ts").drop("t")
    want = sorted([("client", "ua1", '[{"USER-AGENT":"ua1"},{"COOKIE":"-"}]'), ("server", "unknown", "[]"), ("server", "n", '[{"SERVER":"n"}]')])
    assert sorted(tuple(r)[1:] for r in headers.batch(df).collect()) == want
    source = str(tmp_path / "ev")
    df.repartition(1).write.parquet(source)
    q = headers.stream(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName("hdr").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("hdr").collect()) == want


def test_small_helpers():
    assert binary.byte_entropy(b"") == 0.0 and math.isclose(binary.byte_entropy(b"ab"), 1.0)


def rich_image(stamp=77):
    """A PE image with imports (one bound), exports, a bound library and two resources."""
    optional = bytearray(224)
    struct.pack_into("<HBBIII", optional, 0, 0x10B, 9, 1, 512, 512, 0)
    struct.pack_into("<I", optional, 92, 16)
    for i, rva, size in ((0, 0x1000, 40), (1, 0x1080, 40), (2, 0x1200, 200), (11, 0x1C0, 16)):
        struct.pack_into("<II", optional, 96 + 8 * i, rva, size)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, stamp, 0, 0, 224, 0x102)
    table = struct.pack("<8sIIII16x", b".rodata", 2048, 0x1000, 2048, 512)
    body = bytearray(2048)
    struct.pack_into("<IIIIII", body, 16, 5, 2, 1, 0x1030, 0x1038, 0x103C)  # one name, one ordinal
    struct.pack_into("<IIIH", body, 0x30, 0x1111, 0x2222, 0x1040, 0)
    body[0x40:0x46] = b"DoIt\0\0"
    struct.pack_into("<IIIII", body, 0x80, 0x10B0, 0, 0, 0x10D0, 0x10C0)
    struct.pack_into("<III", body, 0xB0, 0x10E0, 0x80000007, 0)
    struct.pack_into("<III", body, 0xC0, 0x7777, 0x80000007, 0)
    body[0xD0:0xD7] = b"My.DLL\0"
    body[0xE2:0xE8] = b"Call\0\0"

    def node(key, value=b"", children=b""):
        name = key.encode("utf-16-le") + b"\0\0"
        pad = lambda x: x + bytes(-len(x) % 4)
        text = pad(pad(bytes(6) + name) + value) + children
        return pad(struct.pack("<HHH", len(text), len(value), 1) + text[6:])

    string = node("CompanyName", "Öst AG\0".encode("utf-16-le"))
    version = node("VS_VERSION_INFO", bytes(52), node("StringFileInfo", b"", node("040904b0", b"", string)))
    directory = lambda *entries: struct.pack("<12xHH", 0, len(entries)) + b"".join(struct.pack("<II", *e) for e in entries)
    sub = 1 << 31
    tree = directory((3, 32 | sub), (16, 56 | sub)) + directory((1, 80 | sub)) + directory((1, 104 | sub)) + directory((0x409, 128)) + directory((0x407, 144))
    tree += struct.pack("<IIII", 0x1700, 8, 0, 0) + struct.pack("<IIII", 0x1400, len(version), 0, 0)
    body[0x200 : 0x200 + len(tree)] = tree
    body[0x400 : 0x400 + len(version)] = version
    data = bytearray((head + bytes(optional) + table).ljust(512, b"\0") + bytes(body))
    struct.pack_into("<IHH8x", data, 0x1C0, 9, 16, 1)
    return bytes(data)


def test_whole_pe_features():
    pe = binary.Pe(rich_image())
    f = pe.dense()
    assert f["iat_rva"] == 0x1080 and f["std_section_names"] == 1 and f["datadir_image_directory_entry_export_size"] == 40
    assert (f["number_of_bound_imports"], f["number_of_bound_import_symbols"], f["number_of_export_symbols"], f["number_of_import_symbols"]) == (1, 1, 2, 2)
    assert sorted(pe.imports) == [f"my.dll:name=call bound={0x7777}", "my.dll:ordinal=7"] and pe.exported == {"name=doit", "ordinal=6"}
    c = pe.clustering()
    assert (c["resource 0 rva"], c["resource 0 size"], c["resource 0 lang"], c["resource 1 rva"], c["resource 1 lang"], c["lfanew"]) == (0x1700, 8, 9, 0x1400, 7, 64)
    assert pe.version_strings() == [("CompanyName", "Öst AG")] and not pe.warnings
    data = bytearray(rich_image() + b"x")
    words = [int.from_bytes(bytes(data)[i : i + 2], "little") for i in range(0, len(data), 2) if i not in (152, 154)]
    total = sum(words)
    while total > 0xFFFF:
        total = (total & 0xFFFF) + (total >> 16)
    assert binary.Pe(bytes(data)).dense()["generated_check_sum"] == total + len(data)
    cut = binary.Pe(rich_image()[:900])
    assert cut.dense()["pe_warnings"] == 1 and "beyond the end" in cut.warnings[0]
    assert "Öst AG".encode("utf-16-le").hex(" ") in file_rules.pe_rule(rich_image(), "x").text()


def test_macho_strings_and_cluster_rules(spark):
    pool, names = b"literal_one\0ab\0with space\0", b"\0_symbol_a\0_b\0"
    segment = struct.pack("<II16sQQQQIIII", 0x19, 152, b"__TEXT", 0, 0, 0, 0, 7, 7, 1, 0) + struct.pack("<16s16sQQIIIIIIII", b"__cstring", b"__TEXT", 0, len(pool), 208, 0, 0, 0, 2, 0, 0, 0)
    symtab = struct.pack("<IIIIII", 2, 24, 0, 2, 208 + len(pool), len(names))
    data = struct.pack("<IIIIIIII", 0xFEEDFACF, 7, 3, 2, 2, 176, 0, 0) + segment + symtab + pool + names
    assert file_rules.macho_strings(data) == (["_symbol_a"], ["literal_one"])
    made = file_rules.macho_rule(data, "m").text()
    assert '"literal_one"' in made and '"_symbol_a"' in made and "all of ($constant_pool*)" in made
    rows = [(f"f{i}", bytearray(rich_image(0x1234 + (i << 16)))) for i in range(3)]
    files = spark.createDataFrame(rows + [("g", bytearray(rich_image(5)))], "path string, content binary")
    labels = spark.createDataFrame([(f"f{i}", 1) for i in range(3)] + [("g", None)], "filename string, cluster int")
    (got,) = file_rules.cluster_rules(labels, binary.extract(files, "pe_cluster")).collect()
    assert got["cluster"] == 1 and "$file_header at 68" in got["text"] and "{ 4c 01 01 00 34 12 0? 00" in got["text"]
    assert file_rules.cluster_rules(labels.limit(0), binary.extract(files, "pe_cluster")).count() == 0


def test_exemplars_are_wired_into_one_tree(spark):
    from siftline.functions.similarity import jaccard

    rows = [(1, "1_2", "1", 0.9, "a:b", False), (1, "1_2", "2", 0.9, "a:b", False), (1, None, "1_2", None, "a:b", True), (3, "3_4", "3", 0.8, "a:c", False), (3, None, "3_4", None, "a:c", True), (5, None, "5", None, "z", False)]
    tree = spark.createDataFrame(rows, "component bigint, parent string, child string, weight double, label string, is_meta boolean")
    got = {(r["parent"], r["child"]) for r in graph.one_tree(tree, jaccard).collect()}
    assert got == {("1_2", "1"), ("1_2", "2"), ("3_4", "3"), ("1_2_3_4", "1_2"), ("1_2_3_4", "3_4"), ("Root", "1_2"), ("Root", "5")}
    assert graph.one_tree(tree.limit(0), jaccard).count() == 0


def test_cells_that_occur_score_the_same_without_a_grid(spark):
    rng = __import__("random").Random(1)
    df = spark.createDataFrame([(rng.choice("abc"), rng.choice("wxyz")) for _ in range(60)] + [(None, "w"), ("d", None)], "p string, q string")
    cells = lambda **k: sorted(map(repr, stats.gtest(df, "p", "q", **k).where("n > 0").collect()))
    assert cells() == cells(absent=False)
