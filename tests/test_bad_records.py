import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cladeflow.operators import bad_records as br

GOOD = "A.1|11|12|ACC.1|500"
CASES = [
    ("fasta", f">{GOOD}", None),
    ("fasta", f">{GOOD}|500", None),
    ("fasta", f"  >{GOOD}|0500 \t\r\n", None),
    ("fasta", '>"A|1"|11|12|"AC""C"|500', None),
    ("fasta", '> " A.1 " | 11 |12| ACC.1|500', None),
    ("fasta", '>A"1|11|12|ACC|500', "quoting"),
    ("fasta", '>"A|11|12|ACC|500', "quoting"),
    ("fasta", '>"A"x|11|12|ACC|500', "quoting"),
    ("fasta", '>A|11|12|"ACC|500|1|2', "quoting"),
    ("fasta", ">A|11|12|ACC", "columns"),
    ("fasta", ">A|11|12|ACC|5|4|3", "columns"),
    ("fasta", GOOD, "columns"),
    ("fasta", ">", "columns"),
    ("fasta", ">|11|12|ACC|5", "value"),
    ("fasta", '>""|11|12|ACC|5', "value"),
    ("fasta", ">A B|11|12|ACC|5", "value"),
    ("fasta", ">A B|11|12|ACC|5", None),
    ("fasta", ">A|0|12|ACC|5", "value"),
    ("fasta", ">A|4294967295|1|ACC|5", None),
    ("fasta", ">A|4294967296|1|ACC|5", "value"),
    ("fasta", ">A|-1|1|ACC|5", "value"),
    ("fasta", ">A|1|١|ACC|5", "value"),
    ("fasta", ">A|1|1|ACC|9223372036854775807", None),
    ("fasta", ">A|1|1|ACC|9223372036854775808", "value"),
    ("fasta", ">A|1|1|ACC|5|6", "value"),
    ("fasta", ">A|1|1|ACC|5|", "value"),
    ("fasta", ">A|1|1|ACC|1e3", "value"),
    ("sq", f"@SQ\tSN:{GOOD}\tLN:7", None),
    ("sq", f"@SQ\tLN:7\tSN:{GOOD}\tM5:ab", None),
    ("sq", f"@SQ\tSN:{GOOD}\tLN:7\tM5:ab\tUR:x y", None),
    ("sq", f"@SQ\tSN:{GOOD}", "columns"),
    ("sq", f"@SQ\tSN:{GOOD}\tLN:7\tLN:7", "columns"),
    ("sq", f"@SQ\tSN:{GOOD}\tSN:{GOOD}\tLN:7", "columns"),
    ("sq", f'@SQ\tSN:{GOOD}\tSN:"x\tLN:7', "quoting"),
    ("sq", "@SQ\tLN:7", "columns"),
    ("sq", f"@SQ\tSN:{GOOD}\tLN:0", "value"),
    ("sq", f"@SQ\tSN:{GOOD}\tLN:", "value"),
    ("other", f">{GOOD}", "columns"),
    (None, f">{GOOD}", "columns"),
]


@pytest.mark.parametrize(("kind", "line", "reason"), CASES)
def test_diagnosis(kind, line, reason):
    got, values = br.diagnose(kind, line)
    assert got == reason and (values is None) == (reason is not None)


def test_whole_table_in_any_mixture(spark):
    rows = [(i, k, x) for i, (k, x, _) in enumerate(CASES * 40 + [("fasta", f">{GOOD}", None)] * 9000)]
    rows += [(-1, "fasta", None), (-2, "sq", ""), (-3, "sq", " \t\r\n")]
    df = spark.createDataFrame(rows, "raw_id long, kind string, line string")
    want = {i: r for i, (_, _, r) in enumerate(CASES * 40 + [("fasta", f">{GOOD}", None)] * 9000)}
    out = br.parse_headers(df).collect()
    assert {r["raw_id"]: r["reason"] for r in out} == want
    for r in out:
        reason, values = br.diagnose(r["kind"], r["line"])
        assert (tuple(r["parsed"]) if r["parsed"] else None) == values and r["reason"] == reason


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "fasta", f">{GOOD}", "x", "y")], "raw_id long, kind string, line string, parsed string, asm string")
    row = br.valid(df).first()
    assert row["asm"] == "y" and row["parsed"]["asm"] == "A.1"
    assert br.parse_headers(df.limit(0)).count() == 0


text = st.text(alphabet='A1|" \t.09-', max_size=24)


@given(st.lists(st.tuples(text, st.booleans()), min_size=1, max_size=30))
def test_fast_path_agrees_with_the_strict_parser(items):
    lines = [f">{GOOD[:k]}{t}" if plain else f">{t}|11|12|B.2|77" for k, (t, plain) in enumerate(items)]
    lines = [x.strip(br.SPACE) for x in lines]
    for line in lines:
        fast = br.parse_block("fasta", pa.array([line]))
        if fast is not None:
            reason, values = br.diagnose("fasta", line)
            assert reason is None
            assert tuple(fast[n][0].as_py() for n in ("asm", "taxid", "species_taxid", "acc", "size", "sampled", "length")) == values
