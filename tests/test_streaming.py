from cladeflow.config import ProfileConfig
from cladeflow.plans import parse
from cladeflow.streaming import drops


def test_new_files_are_parsed_once(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    line = "\t".join(["{}", "0", "A|11|101|a1|1000", "5", "9", "50=", "*", "0", "0", "A" * 50, "*"])
    refs = parse.reference_dim(spark.createDataFrame([("A|11|101|a1|1000", 1000, 0)], "ref_name string, ref_len long, ord long"))
    for k in range(2):
        (inbox / f"{k}.sam").write_text("@SQ\tSN:x\tLN:1\n" + line.format(f"r{k}") + "\n\n")
        query = drops.start(spark, str(inbox), refs, out, ProfileConfig())
        query.awaitTermination()
        assert query.exception() is None
    rows = spark.read.parquet(out + "/alignments").collect()
    assert sorted(r["read_name"] for r in rows) == ["r0", "r1"] and all(r["kept"] for r in rows)
