import math

import pytest

from cladeflow import config
from cladeflow.config import ProfileConfig, RunTotals
from cladeflow.sources import aligner


@pytest.mark.parametrize(
    ("sequencer", "mode", "strain", "want"),
    [
        ("Illumina", "default", False, (0.97, 50, 0.7)),
        ("illumina", "recall", False, (0.95, 50, 0.6)),
        ("ILLUMINA", "precision", False, (0.98, 50, 0.8)),
        ("Illumina", "default", True, (0.98, 50, 0.8)),
        ("Illumina", "recall", True, (0.90, 40, 0.5)),
        ("Nanopore", "recall", False, (0.85, 250, 0.5)),
        ("PacBio", "precision", False, (0.90, 250, 0.6)),
        ("Nanopore", "recall", True, (0.84, 200, 0.55)),
        ("PacBio", "recall", True, (0.85, 200, 0.55)),
        ("assembly", "precision", False, (0.95, 300, 0.7)),
        ("unheard", "default", True, (0.86, 250, 0.6)),
    ],
)
def test_presets(sequencer, mode, strain, want):
    c = ProfileConfig(sequencer=sequencer, mode=mode, strain=strain)
    assert (c.identity, c.mapped_len, c.fraction) == want
    assert ProfileConfig(sequencer=sequencer, mode=mode, identity=0.5).identity == 0.5


def test_bad_settings():
    for bad in ({"identity": 0.0}, {"fraction": 1.2}, {"mapped_len": 0}, {"mode": "x"}, {"min_oebr": -1}, {"host": 0}):
        with pytest.raises(ValueError):
            ProfileConfig(**bad)
    for value in ("nan", "inf", "-1", "x"):
        with pytest.raises(ValueError):
            config.non_negative(value)


def test_low_map_gate():
    c = ProfileConfig()
    assert [config.low_map(c, r) for r in (0, 0.29, 0.2999999, 0.30, 0.5, 1, math.nan)] == [True, True, True, False, False, False, False]
    assert not config.low_map(ProfileConfig(host=9606), 0.1) and not config.low_map(ProfileConfig(sequencer="Nanopore"), 0.1)
    assert config.fallback_mode(c, 0.1, False) and not config.fallback_mode(c, 0.1, True)
    assert config.fallback_mode(ProfileConfig(genus_fallback=True), 0.9, True)


def test_chunk_basis():
    low, high = RunTotals(100_000, 10_000, 1), RunTotals(100_000, 90_000, 1)
    assert config.chunk_basis(ProfileConfig(), high, False) == 100_000
    assert config.chunk_basis(ProfileConfig(), low, False) == 15_000
    assert config.chunk_basis(ProfileConfig(), low, True) == 10_000
    assert config.chunk_basis(ProfileConfig(by_aligned=True), low, False) == 10_000
    assert config.chunk_basis(ProfileConfig(by_aligned=True), high, False) == 90_000
    assert config.chunk_basis(ProfileConfig(genus_fallback=True), low, True) == 100_000
    assert config.chunk_basis(ProfileConfig(genus_fallback=True, by_aligned=True), low, True) == 10_000
    assert [config.round_half_away(1.5 * n) for n in (0, 1, 2, 3, 10, 100, 100_000)] == [0, 2, 3, 5, 15, 150, 150_000]


@pytest.mark.parametrize(("reads", "want"), [(5000, 0.005), (100_000, 0.1), (100_001, 0.10100011), (500_000, 0.145), (1_000_000, 0.2), (2_000_000, 0.3149935), (100_000_000, 0.95)])
def test_chunk_threshold(reads, want):
    assert config.chunk_threshold(reads, True) == pytest.approx(want, abs=1e-7)
    assert config.chunk_threshold(reads, True, lowbiomass=True) == 0
    assert config.chunk_threshold(reads, False) == (0.0 if reads <= 5000 else 0.3 if reads <= 1_000_000 else 0.5)


def test_aligner_arguments():
    assert aligner.mode_arguments("Illumina", "precision")["-N"] == "16"
    assert aligner.mode_arguments("nanopore", "precision")["-N"] == "12" and aligner.mode_arguments("x", "precision")["-N"] == "18"
    assert aligner.mode_arguments("Illumina", "default", ["-l", "9", "--new", "1", "odd"]) | {} == {**aligner.mode_arguments("Illumina", "default"), "-l": "9", "--new": "1"}
    assert aligner.input_preset("Illumina", ["a", "b"], True) == ("Illumina_Paired", ["-i", "a", "-m", "b"])
    assert aligner.input_preset("PacBio", ["a", "b"], False) == ("PacBio", ["-i", "a,b"])
    with pytest.raises(ValueError):
        aligner.input_preset("Illumina", ["a"], True)
    with pytest.raises(aligner.AlignerError):
        aligner.run(["/no/such/binary"])
    with pytest.raises(aligner.AlignerError, match="code 3.*oops"):
        aligner.run(["sh", "-c", "echo oops >&2; exit 3"])
