import gzip
import lzma
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow import cli
from cladeflow.config import ProfileConfig
from cladeflow.plans import ambiguity, assign, em, parse, profile, taxa
from cladeflow.sources import sam, tables

# two references, five reads; expected values computed by hand from the formulas
REFS = [("A|11|101|a1|10000", 10_000), ("B|12|102|b1|10000", 10_000)]
READS = [("r1", 0, 1), ("r2", 0, 51), ("r3", 0, 501), ("r3", 1, 501), ("r4", 1, 2001), ("r5", None, 0)]


def sam_text():
    lines = ["@HD\tVN:1.6", *[f"@SQ\tSN:{n}\tLN:{size}" for n, size in REFS]]
    for name, ref, pos in READS:
        mapped = ref is not None
        lines.append("\t".join([name, "0" if mapped else "4", REFS[ref][0] if mapped else "*", str(pos), "60", "100=" if mapped else "*", "*", "0", "0", "A" * 100, "*"]))
    return "\n".join(lines) + "\n\n"


def bam_bytes():
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(REFS))
    for name, size in REFS:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\x00" + struct.pack("<i", size)
    for name, ref, pos in READS:
        ops = [(100 << 4) | 7] if ref is not None else []
        body = struct.pack("<iiBBHHHiiii", -1 if ref is None else ref, pos - 1, len(name) + 1, 60, 0, len(ops), 4 if ref is None else 0, 100, -1, -1, 0)
        body += name.encode() + b"\x00" + struct.pack(f"<{len(ops)}I", *ops) + b"\x11" * 50 + b"\xff" * 100
        out += struct.pack("<i", len(body)) + body
    blocks = b""
    for k in range(0, len(out), 150):  # records run across blocks
        data = out[k : k + 150]
        c = zlib.compressobj(wbits=-15)
        packed = c.compress(data) + c.flush()
        blocks += b"\x1f\x8b\x08\x04" + b"\x00" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))
    return blocks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "tiny.sam").write_text(sam_text())
    half = len(sam_text()) // 2
    (d / "tiny.sam.gz").write_bytes(gzip.compress(sam_text()[:half].encode()) + gzip.compress(sam_text()[half:].encode()))
    (d / "tiny.sam.xz").write_bytes(lzma.compress(sam_text().encode()))
    (d / "unnamed").write_bytes(gzip.compress(sam_text().encode()))
    (d / "tiny.bam").write_bytes(bam_bytes())
    (d / "x.cram").write_bytes(b"CRAM123")
    dmp = d / "taxdump"
    dmp.mkdir()
    rows = lambda *r: "".join("\t|\t".join(x) + "\t|\n" for x in r)
    (dmp / "nodes.dmp").write_text(rows(("1", "1", "no rank"), ("5", "1", "genus"), ("101", "5", "species"), ("102", "5", "species"), ("11", "101", "strain"), ("12", "102", "strain"), ("900", "901", "species"), ("910", "1", "species")))
    (dmp / "names.dmp").write_text(rows(("1", "root", "", "scientific name"), ("5", "Genus", "", "scientific name"), ("101", "First", "", "scientific name"), ("101", "Other", "", "synonym"), ("102", "Second", "", "scientific name"), ("11", "First s", "", "scientific name"), ("12", "Second s", "", "scientific name"), ("910", "Gone", "", "scientific name")))
    (dmp / "merged.dmp").write_text(rows(("77", "101"), ("78", "77")))
    (dmp / "delnodes.dmp").write_text("910\t|\nnonsense\t|\n")
    (d / "hosts.tsv").write_text("taxid\thosts\tnames\tdiseases\n101\t12;11\tb;a;b\tflu\n102\tunknown\tunknown\tunknown\nshort\n")
    return d


@pytest.mark.parametrize("name", ["tiny.sam", "tiny.sam.gz", "tiny.sam.xz", "unnamed", "tiny.bam"])
def test_sources_give_the_same_records(spark, files, name):
    lines = sam.read_lines(spark, str(files / name))
    assert {tuple(r)[:2] for r in parse.reference_lines(sam.header_lines(lines)).collect()} == set(REFS)
    got = [tuple(r) for r in parse.split_records(sam.record_lines(lines)).orderBy("ordinal").select("read_name", "ref_name", "pos", "cigar", "seq_len").collect()]
    want = [(n, REFS[r][0] if r is not None else "*", max(p, 1), "100=" if r is not None else "*", 100) for n, r, p in READS]
    assert got == want


def test_cram_is_refused(spark, files):
    with pytest.raises(ValueError):
        sam.read_lines(spark, str(files / "x.cram"))


@pytest.fixture(scope="module")
def tax(spark, files):
    return tables.read_dmp(spark, str(files / "taxdump"))


def test_taxonomy(spark, tax):
    line = taxa.lineages(tax)
    paths = {r["taxid"]: r["path"] for r in line.collect()}
    assert paths[11] == [1, 5, 101, 11] and paths[900] == [900] and paths[1] == [1]
    ids = spark.createDataFrame([(11,), (77,), (78,), (910,), (12345,)], "taxid long")
    genus = {r["taxid"]: r["g"] for r in taxa.of_ids(ids, "taxid", tax, taxa.rank_ancestors(line, tax, "genus"), "g").collect()}
    assert genus == {11: 5, 77: 5, 78: None, 910: None, 12345: None}  # one replacement a hop
    names = {r["taxid"]: (r["name"], r["rank"]) for r in taxa.labels(ids, "taxid", tax).collect()}
    assert names == {11: ("First s", "strain"), 77: ("First", "species"), 78: (None, None), 910: (None, None), 12345: (None, None)}
    members = spark.createDataFrame([("x", 11), ("x", 12), ("y", 11), ("y", 101), ("y", 12345), ("z", 12345)], "class_id string, taxid long")
    got = {r["class_id"]: r["lca"] for r in taxa.majority_lca(members, line, tax).collect()}
    assert got == {"x": 5}  # of y only 2 of 3 members have a lineage: under 0.7 * 3


def test_worked_example(spark, files):
    cfg = ProfileConfig(min_cbreadth=0.0)
    p = cli.profile_file(spark, str(files / "tiny.sam"), str(files / "taxdump"), cfg)
    assert (p.totals.reads, p.totals.aligned_reads, p.totals.alignments) == (5, 4, 5)
    raw = {r["taxid"]: r for r in p.raw.collect()}
    a, b = raw[101], raw[102]
    assert (a["breadth"], a["fixed_chunk"], a["flex_chunk"]) == pytest.approx((0.025, 0.26, 0.04))
    assert (b["breadth"], b["fixed_chunk"], b["flex_chunk"]) == pytest.approx((0.02, 0.41, 0.04))
    assert (a["reads"], a["depth"], b["reads"], b["depth"]) == pytest.approx((8 / 3, 0.08 / 3, 4 / 3, 0.04 / 3), abs=1e-5)
    assert (a["abundance"], b["abundance"]) == pytest.approx((200 / 3, 100 / 3), abs=1e-3)
    assert (a["expected_breadth"], a["expected_flex"]) == pytest.approx((0.02644, 0.05245), abs=1e-5)
    assert a["cov_prob"] == 1 and a["chunk_prob"] == pytest.approx(0.10587, abs=1e-5)
    final = p.final.collect()
    assert [r["taxid"] for r in final] == [101] and final[0]["abundance"] == 100.0
    assert {tuple(r) for r in p.classified.collect()} == {("r1", 101, "species", "101", "1"), ("r2", 101, "species", "101", "1"), ("r4", 102, "species", "102", "1"), ("r3", 101, "species", "101;102", "0.66667;0.33333")}


def test_command_line(spark, files, tmp_path):
    out = str(tmp_path / "s")
    cli.main(["profile", "--dmp-dir", str(files / "taxdump"), "--reuse-sam", str(files / "tiny.bam"), "-o", out, "--min-cbreadth", "0", "-k", "--host", "11", "--pathogen-host", str(files / "hosts.tsv")])
    read = lambda p: [line.split("\t") for line in open(p).read().splitlines()]
    rows = read(out + ".pathogen.rprofile.txt")
    assert [r[:3] for r in rows] == [["First", "101", "species"]] and float(rows[0][3]) == pytest.approx(8 / 3, abs=1e-4)
    assert rows[0][13:] == ["a;b", "11;12", "flu"]  # 102 is listed but hosted by nobody known: dropped
    assert len(read(out + ".classify.txt")) == 4


def test_strain_profile(spark, files):
    cfg = ProfileConfig(strain=True, min_cbreadth=0.0)
    p = cli.profile_file(spark, str(files / "tiny.sam"), str(files / "taxdump"), cfg, None)
    raw = {r["taxid"]: r for r in p.raw.collect()}
    assert set(raw) == {11, 12}
    assert raw[11]["breadth"] == pytest.approx(0.025) and raw[11]["reads"] + raw[12]["reads"] == pytest.approx(4)
    assert raw[11]["reads"] == pytest.approx(8 / 3, abs=1e-4)


def test_strain_classification(spark, files, tax):
    p = cli.profile_file(spark, str(files / "tiny.sam"), str(files / "taxdump"), ProfileConfig(strain=True, min_cbreadth=0.0), None)
    assert p.classified.columns == ["read_name", "name", "taxid", "rank", "names", "taxids", "fractions"]
    got = {r["read_name"]: tuple(r)[1:] for r in p.classified.collect()}
    assert got["r1"] == ("First s", 11, "strain", "First s", "11", "1") and got["r4"] == ("Second s", 12, "strain", "Second s", "12", "1")
    assert got["r3"] == ("First s", 11, "strain", "First s;Second s", "11;12", "0.66667;0.33333") and len(got) == 4


def test_strain_classification_of_species_and_ancestors(spark, tax):
    row = lambda read, taxid, c: (read, taxid, "strain", 0.1, 10.0, c)
    classed = spark.createDataFrame([row("a", 101, [101]), row("b", 11, [11, 12]), row("b", 12, [11, 12]), row("c", 11, [11, 101]), row("c", 101, [11, 101])], "read_name string, taxid long, rank string, depth double, maplen double, class array<long>")
    shares = spark.createDataFrame([([11, 101], 101, 1.0)], em.FRACTIONS)
    ancestors = spark.createDataFrame([([11, 12], 5)], "class array<long>, lca long")
    got = {tuple(r) for r in profile.strain_classification(classed, em.EmResult(None, shares, 1, True), ancestors, tax).collect()}
    assert got == {("a", "First", 101, "species", "First", "101", "1"), ("b", "Genus", 5, "genus", "First s;Second s", "11;12", "1"), ("c", "First", 101, "species", "First", "101", "1.00000")}


def test_strain_hosts(spark, files, tax):
    rows = spark.createDataFrame([(101,), (102,), (11,)], "taxid long")
    hosts = tables.read_hosts(spark, str(files / "hosts.tsv"))
    line = taxa.lineages(tax)
    show = lambda host, strain: {r["taxid"]: tuple(r)[1:] for r in profile.annotate_hosts(rows, hosts, host, line, tax, strain).collect()}
    none = ("unknown",) * 3
    assert show(5, False) == {101: ("a;b", "11;12", "flu"), 11: none}  # 5 is an ancestor of a host
    assert show(5, True) == {101: ("b;a;b", "12;11", "flu"), 102: none, 11: none}
    assert show(900, False) == {11: none} and show(900, True) == {101: none, 102: none, 11: none}


def test_paired_rules(spark, tax):
    refs = spark.createDataFrame([("A|11|101|a1|10000", 10_000, 0)], "ref_name string, ref_len long, ord long")
    line = lambda name, flag, rnext="=", pos=300, pnext=100, seq="A" * 50: "\t".join([name, str(flag), "A|11|101|a1|10000", str(pos), "9", "50=", rnext, str(pnext), "0", seq, "*"])
    rows = [line("x/1", 99), line("x/2", 147), line("q/1", 99 + 512), line("d/1", 99, rnext="B"), line("u/1", 99 + 4), line("e/1", 99, seq=""), "bad\t1", line("f/9", "zz")]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, ordinal long")
    cfg = ProfileConfig(is_paired=True)
    dim = parse.reference_dim(refs, tax, taxa.lineages(tax))
    got = parse.parse_alignments(parse.split_records(df, True), dim, cfg)
    flags = {r["ordinal"]: (r["read_name"], r["counted"], r["kept"]) for r in got.collect()}
    assert flags == {0: ("x", True, True), 1: ("x", True, False), 3: ("d", False, False), 4: ("u", False, True), 5: ("e", False, False), 7: ("f", True, False)}
    first = got.where("ordinal = 0").first()
    assert tuple(first["span"]) == (100, 150) and tuple(first["fixed"]) == (1, 1150) and tuple(first["flex"]) == (25, 225)
    assert tuple(parse.run_totals(got).first()) == (5, 2, 3)


def test_genus_fallback(spark):
    cfg = ProfileConfig(identity=0.95, mapped_len=50, fraction=0.6)
    rows = [("a", 1, 60, 0.96, 1.0, 101, 5001), ("a", 2, 60, 0.85, 1.0, 102, 5002), ("b", 3, 60, 0.80, 0.60, 103, 5001), ("c", 4, 49, 0.90, 1.0, 103, 5001), ("d", 5, 60, 0.79, 1.0, 103, 5001), ("e", 6, 60, 0.90, 0.59, 103, 5001), ("f", 7, 60, 0.90, 1.0, 104, None)]
    df = spark.createDataFrame(rows, "read_name string, ordinal long, mapped_len long, identity double, fraction double, species_taxid long, genus_taxid long")
    got = {(r["read_name"], r["taxid"], r["rank"]) for r in assign.candidates(df, cfg, True).collect()}
    assert got == {("a", 101, "species"), ("b", 5001, "genus")}
    assert assign.candidates(df, cfg, False).count() == 1


def test_touching_intervals_stay_apart(spark):
    df = spark.createDataFrame([("k", (1, 5)), ("k", (5, 9)), ("k", (8, 12)), ("k", (20, 21))], "k string, span struct<s:long,e:long>")
    assert {tuple(r) for r in assign.merged_islands(df, ["k"]).collect()} == {("k", 1, 5), ("k", 5, 12), ("k", 20, 21)}


def test_pruning_and_ancestors(spark, tax):
    line = taxa.lineages(tax)
    known = spark.createDataFrame([(1, 5.0, 0.5, 50.0), (2, 4.0, 0.4, 40.0)], "taxid long, n double, depth double, maplen double")
    m = [([1, 2], 1, 3.0, 0.1, 10.0), ([1, 2], 2, 3.0, 0.2, 20.0), ([1, 9], 1, 2.0, 0.3, 30.0), ([1, 9], 9, 2.0, 0.4, 40.0), ([1, 2, 9], 1, 7.0, 0.5, 50.0), ([1, 2, 9], 2, 7.0, 0.6, 60.0), ([1, 2, 9], 9, 7.0, 0.7, 70.0), ([101, 102], 101, 4.0, 0.8, 80.0), ([101, 102], 102, 4.0, 0.2, 20.0), ([900, 12345], 900, 1.0, 1.0, 1.0), ([900, 12345], 12345, 1.0, 1.0, 1.0)]
    members = spark.createDataFrame(m, "class array<bigint>, taxid long, n double, depth double, maplen double")
    cov = spark.createDataFrame([(101, 0.1, 0.5, 0.2), (102, 0.3, 0.4, 0.1), (5, 0.9, 0.9, 0.9)], "taxid long, breadth double, fixed_chunk double, flex_chunk double")
    r = ambiguity.resolve(known, members, cov, line, tax)
    got = {x["taxid"]: tuple(x)[1:] for x in r.known.collect()}
    assert got == {1: pytest.approx((7.0, 0.8, 80.0)), 2: (4.0, 0.4, 40.0), 5: pytest.approx((4.0, 0.5, 50.0))}
    left = {(tuple(x["class"]), x["taxid"]): (x["n"], x["depth"]) for x in r.members.collect()}
    assert left == {((1, 2), 1): pytest.approx((10.0, 0.6)), ((1, 2), 2): pytest.approx((10.0, 0.8))}
    assert {x["taxid"]: tuple(x)[1:] for x in r.coverage.collect()}[5] == (0.3, 0.5, 0.2)


@pytest.mark.parametrize("strain", [False, True])
def test_em_kernel_equals_distributed_steps(spark, strain):
    r = np.random.default_rng(1)
    known = pd.DataFrame({"taxid": range(1, 9), "n": r.integers(1, 99, 8) * 1.0, "depth": r.random(8), "maplen": r.integers(50, 5000, 8) * 1.0})
    rows = []
    for c in ([1, 2], [2, 3, 4], [5, 6], [1, 8], [7, 8], *([[6, 20], [21, 22]] if strain else [])):
        n = float(r.integers(1, 50))
        rows += [(c, t, n, float(r.random()), float(r.integers(50, 900))) for t in c]
    known.loc[6, "depth"] = 1e-9  # 8 takes the class of 7 and 8 whole
    k = spark.createDataFrame(known, em.STATE)
    m = spark.createDataFrame(rows, "class array<bigint>, taxid long, n double, depth double, maplen double")
    start = k.unionByName(m.join(k, "taxid", "left_anti").select("taxid").distinct().select("taxid", *[F.lit(v).alias(c) for v, c in zip(em.PSEUDO, ("n", "depth", "maplen"))])) if strain else k
    one = em.share_out(k, m, strain, start, max_iter=6, tol=-1.0)
    two = em.run_distributed(k, m, start, strain, 6, -1.0)
    table = lambda df, keys: {tuple(tuple(x[c]) if c == "class" else x[c] for c in keys): tuple(x[c] for c in df.columns if c not in keys) for x in df.collect()}
    for a, b, keys in ((one.state, two.state, ["taxid"]), (one.fractions, two.fractions, ["class", "taxid"])):
        x, y = table(a, keys), table(b, keys)
        assert x.keys() == y.keys() and all(x[i] == pytest.approx(y[i], rel=1e-9) for i in x)
    assert ((7, 8), 8) in table(one.fractions, ["class", "taxid"]) and ((7, 8), 7) not in table(one.fractions, ["class", "taxid"])
    if not strain:  # nothing gets lost: every class's reads are given out once
        given = sum(x["n"] for x in one.state.collect())
        assert given == pytest.approx(known["n"].sum() + sum({tuple(c): n for c, _, n, *_ in rows}.values()))


def test_filters(spark):
    cut = 1e-5
    rows = [("species", a, b) for a in (None, cut / 2, cut, 1.0) for b in (None, cut / 2, cut, 1.0)] + [("genus", None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, rank string, cov_prob double, chunk_prob double")
    ok = {r["i"]: (r["d"], r["s"]) for r in df.select("i", profile.pvalue_ok(ProfileConfig()).alias("d"), profile.pvalue_ok(ProfileConfig(strict=True)).alias("s")).collect()}
    for i, (rank, a, b) in enumerate(rows):
        both = a is not None and b is not None
        assert ok[i] == (not (both and a < cut and b < cut), (both and a >= cut and b >= cut) or (rank == "genus" and a is None and b is None))
    ratios = spark.createDataFrame([("genus", 0.66, 1.0), ("species", 0.66, 1.0), ("species", 1.5, 1.0), ("species", 1.51, 1.0), ("species", 1.0, 0.0), ("species", float("nan"), 1.0), ("species", 0.75, 1.0), ("species", 1.0, float("nan"))], "rank string, o double, e double")
    at = lambda cfg, least=None: [r["x"] for r in ratios.select(profile.ratio_ok(cfg, "o", "e", least).alias("x")).collect()]
    assert at(ProfileConfig()) == [True, False, True, False, False, False, True, False]
    assert at(ProfileConfig(strain=True))[6] is False and at(ProfileConfig(), 0.5)[1] is True


def test_scaling(spark):
    refs = spark.createDataFrame([("A|11|101|a|1000|100", 2), ("B|11|102|a|1000|500", 1), ("C|13|103|a|10|20", 3), ("D|14|104|a|10", 0)], "ref_name string, ord long")
    assert {r["taxid"]: r["scale"] for r in parse.scaling(refs).collect()} == {11: 2.0, 101: 10.0, 102: 2.0}
    assert not parse.database_is_subsampled(refs) and parse.database_is_subsampled(refs.where("ord > 0"))


def test_files_and_command_line(spark, tmp_path):
    from cladeflow import cli
    from cladeflow.sources import tables

    out = str(tmp_path / "x.profile.txt")
    df = spark.range(1000, numPartitions=7).selectExpr("id", "concat('n', id) AS name", "cast(null AS string) AS nothing")
    for _ in range(2):  # again over the same file
        tables.write_tsv(df.orderBy("id"), out)
        with open(out) as f:
            assert f.read().splitlines() == [f"{i}\tn{i}\t" for i in range(1000)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.profile.txt"]
    assert cli.command_line(["profile", "-o", "a b", "--strain"]) == "cladeflow profile -o 'a b' --strain"
    a = cli.parser().parse_args(["profile", "-o", "x", "--reuse-sam", "y.sam"])
    assert a.dmp_dir == cli.DMP_DIR
