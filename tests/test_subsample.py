import numpy as np

from cladeflow.plans import subsample as sb
from cladeflow.sources import tables

P = sb.SubsampleParams(0.3, segment_length=100, min_length=30)


def contigs(spark):
    r = np.random.default_rng(2)
    rows = [("big", i, int(r.integers(1, 900))) for i in range(40)] + [("small", 0, 400), ("small", 1, 0), ("short", 0, 99), ("short", 1, 60), *[("short", k, 50) for k in range(2, 200)], ("none", 0, 0)]
    size = {g: sum(n for x, _, n in rows if x == g) for g in ("big", "small", "short", "none")}
    return rows, size, spark.createDataFrame([(g, size[g], i, n) for g, i, n in rows], "genome_id string, genome_size long, contig_idx long, len long")


def test_segments_keep_the_rules(spark):
    rows, size, df = contigs(spark)
    length = {(g, i): n for g, i, n in rows}
    out = sorted(map(tuple, sb.segments(df, P, small=1000).collect()))
    by = {}
    for g, _, i, start, stop in out:
        assert 1 <= start <= stop <= length[(g, i)]
        by.setdefault((g, i), []).append((start, stop))
    for v in by.values():
        assert all(a[1] < b[0] for a, b in zip(v, v[1:]))  # never overlapping
    total = lambda g: sum(b - a + 1 for k, v in by.items() if k[0] == g for a, b in v)
    assert by[("small", 0)] == [(1, 400)] and ("small", 1) not in by
    want = -(-size["big"] * 3 // 10)
    assert want <= total("big") < want + 100 and all(b - a == 99 for k, v in by.items() if k[0] == "big" for a, b in v)
    assert total("short") >= -(-size["short"] * 3 // 10) - 30
    assert out == sorted(map(tuple, sb.segments(df.repartition(7), P, small=1000).collect()))
    other = sb.SubsampleParams(0.3, seed=1, segment_length=100, min_length=30)
    assert out != sorted(map(tuple, sb.segments(df, other, small=1000).collect()))


def test_even_picks_by_the_rule(spark):
    for slots in (1, 5, 12):
        df = spark.createDataFrame([("g", 10**6, 0, slots * 100)], "genome_id string, genome_size long, contig_idx long, len long")
        cands = sb.candidates(df, P, small=1)
        number = {r["start"]: r["slot"] for r in cands.collect()}
        for quota in range(1, slots + 1):
            q = spark.createDataFrame([("g", 0, slots, quota, True)], "genome_id string, contig_idx long, slots long, quota long, enough boolean")
            got = sorted(number[r["start"]] for r in sb.even_picks(cands, q, P).collect())
            assert got == [(j + 1) * slots // quota - 1 for j in range(quota)], (slots, quota)


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text(">g1|1|2|acc1|999|x\nACGT\nAC\n>g2|3|4|acc2|5\nTTTTT\n>g1|1|2|acc3|8\nGG\n")
    rows = {(r["genome_id"], r["contig_idx"]): (r["genome_size"], r["seq"]) for r in tables.read_fasta(spark, str(path)).collect()}
    assert rows == {("g1", 0): (8, "ACGTAC"), ("g2", 0): (5, "TTTTT"), ("g1", 1): (8, "GG")}
    out = sb.subsample(tables.read_fasta(spark, str(path)), P)
    assert {r["header"] for r in out.collect()} == {"g1|1|2|acc1:1-6|8|8", "g1|1|2|acc3:1-2|8|8", "g2|3|4|acc2:1-5|5|5"}
    text = {r["t"] for r in out.select(tables.fasta_text(out, width=4).alias("t")).collect()}
    assert ">g1|1|2|acc1:1-6|8|8\nACGT\nAC" in text


def test_gzip(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("x")
    assert tables.gzip_file(str(f)) == str(f) + ".gz" and not f.exists()
    assert tables.gzip_file(str(f)) is None and tables.gzip_file(str(f) + ".gz") is None
