import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm import segmentation as sg


def random_bases(n, seed, weights=None):
    return np.random.default_rng(seed).choice(np.frombuffer(b"ACGT", np.uint8), n, p=weights)


def check_pieces(units, pieces, limit, overlap):
    text = units.tobytes()
    rebuilt, before = b"", None
    for start, stop, _ in pieces:
        assert 0 < stop - start <= limit
        assert before is None or start == before - overlap
        rebuilt += text[start if before is None else before : stop]
        before = stop
    assert rebuilt == text


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ACGTN", max_size=900), st.integers(40, 200))
def test_pieces_rebuild_the_item(text, limit):
    units = sg.letters(text)
    pieces = sg.split_item(units, limit, limit // 5)
    check_pieces(units, pieces, limit, limit // 5)
    assert (len(pieces) > 1) == (len(units) > limit)


def test_long_item_in_stretches_is_the_same_as_in_one(monkeypatch):
    units = random_bases(400_000, 1)
    at, depth = sg.depths(units)
    monkeypatch.setattr(sg, "CHUNK", 100)
    at2, depth2 = sg.depths(units)
    assert (at == at2).all() and np.allclose(depth, depth2, atol=1e-4)
    check_pieces(units, sg.split_item(units), sg.LIMIT, sg.OVERLAP)


def test_runs_of_n_come_first():
    units = random_bases(15_000, 2)
    units[7000:7040] = ord("N")
    start, stop, kind = sg.split_item(units)[0]
    assert kind == "n_run" and stop == 7020


@pytest.mark.parametrize(
    ("runs", "cuts"),
    [
        ([(2840, 2860), (2970, 2990)], [2980]),  # only before the window: the last of them
        ([(9990, 10_050)], [10_000]),  # straddles the limit, its middle beyond
        ([(4000, 5400)], [5400]),  # reaches into the window, its middle before
        ([(300, 320), (7000, 7002)], [7001]),  # the window goes first
        ([(0, 14_000)], [7000, 14_000]),
        ([(0, 15_000)], [7500, 15_000]),
        ([(0, 150)], []),  # nothing beyond the overlap
    ],
)
def test_runs_of_n_outside_the_window_come_before_valleys(runs, cuts):
    units = random_bases(20_100, 5)
    for a, b in runs:
        units[a:b] = ord("N")
    pieces = sg.split_item(units)
    check_pieces(units, pieces, sg.LIMIT, sg.OVERLAP)
    assert [stop for _, stop, kind in pieces if kind == "n_run"] == cuts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ACGTN", max_size=900), st.integers(40, 200))
def test_no_valley_is_taken_where_a_run_fits(text, limit):
    units, before = sg.letters(text), 0
    lo, hi = sg.n_runs(units)
    for start, stop, kind in sg.split_item(units, limit, limit // 5):
        if kind in ("valley", "limit"):
            fits = (lo >= before) & (hi > start + limit // 5) & (lo <= start + limit)
            assert not fits.any()
        before = stop


def test_valley_lies_where_the_vocabulary_changes():
    units = np.concatenate([random_bases(8000, 3, [0.7, 0.1, 0.1, 0.1]), random_bases(8000, 4, [0.1, 0.1, 0.1, 0.7])])
    _, stop, kind = sg.split_item(units)[0]
    assert kind == "valley" and abs(stop - 8000) <= 2 * sg.STEP


def test_letters_alone_count():
    assert sg.letters(" 1 acgT\r\n2 nNéX*-\t").tobytes() == b"ACGTNNX"
    assert len(sg.letters(None)) == len(sg.letters("")) == 0


def test_tables(spark):
    limit, overlap = 100, 20
    rows = [("g1", 0, "A" * 60), ("g1", 1, "C" * 60), ("g1", 2, "G" * 250), ("g1", 3, "T" * 10), ("g2", 0, "A" * 100), ("g3", 0, None), ("g3", 1, ""), (None, None, "A" * 5), ("g4", 0, "A" * 50), ("g4", 1, "A" * 51)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "genome_id string, contig_idx int, seq string, _k int").drop("_k")
    split = sg.split_items(df, "seq", limit, overlap, with_text=True)
    by = {(r["genome_id"], r["contig_idx"]): r for r in split.collect()}
    assert by[("g3", 0)]["_segments"] == [] and by[("g3", 1)]["_size"] == 0
    for g, i, seq in rows:
        pieces, texts = by[(g, i)]["_segments"], by[(g, i)]["_texts"]
        assert all(len(t) == p["stop"] - p["start"] <= limit for p, t in zip(pieces, texts))
        assert "".join(t if k == 0 else t[overlap:] for k, t in enumerate(texts)) == (seq or "")
    found = {tuple(r) for r in sg.oversized(split, "genome_id", "contig_idx", limit).collect()}
    assert found == {("g1", 2), ("g1", -1), ("g4", -1)}
    pieces = {}
    for r in sg.group_pieces(split.select("genome_id", "contig_idx", "_size", "_segments"), "genome_id", "contig_idx", limit).collect():
        pieces.setdefault((r["genome_id"], r["piece_block"], r["piece"]), []).append((r["contig_idx"], r["start"], r["stop"]))
    assert all(sum(b - a for _, a, b in v) <= limit for v in pieces.values())
    assert len([k for k in pieces if k[0] == "g2"]) == 1 and len([k for k in pieces if k[0] == "g4"]) == 2
    empty = sg.split_items(df.limit(0), "seq", limit, overlap)
    assert sg.oversized(empty, "genome_id", "contig_idx", limit).count() == 0
    with pytest.raises(ValueError):
        sg.split_items(df, "seq", 100, 50)
