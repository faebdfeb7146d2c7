"""The external read aligner: its arguments, and running it as a process on the driver."""

from __future__ import annotations

import os
import subprocess

DEFAULT_BINARY = "maCMD"

# What the aligner is called with, by kind of sequencer and mode.
MODE_ARGUMENTS = {
    ("illumina", "default"): {"-s": "maxSpan", "--Minimal_Alignment_Score": "55", "-l": "17", "-M": "3", "-N": "12"},
    ("illumina", "recall"): {"-s": "maxSpan", "--Minimal_Alignment_Score": "50", "-M": "5"},
    ("illumina", "precision"): {"-s": "maxSpan", "--Minimal_Alignment_Score": "60", "-l": "18", "-M": "2", "-N": "16"},
    ("long", "default"): {"-s": "maxSpan", "-l": "17", "-M": "3", "-N": "15"},
    ("long", "recall"): {"-s": "maxSpan", "-M": "5"},
    ("long", "precision"): {"-s": "maxSpan", "-l": "18", "-M": "2", "-N": "12"},
    ("other", "default"): {"-s": "maxSpan", "-l": "17", "-M": "3", "-N": "15"},
    ("other", "recall"): {"-s": "maxSpan", "-M": "5"},
    ("other", "precision"): {"-s": "maxSpan", "-l": "19", "-M": "2", "-N": "18"},
}


class AlignerError(RuntimeError):
    pass


def input_preset(sequencer: str, files: list[str], paired: bool) -> tuple[str, list[str]]:
    """(the aligner's preset, its input arguments). Paired reads need exactly two files."""
    name = sequencer.lower()
    if paired:
        if name != "illumina":
            raise ValueError("only Illumina reads are taken in pairs")
        if len(files) != 2:
            raise ValueError("paired reads need exactly two files")
        return "Illumina_Paired", ["-i", files[0], "-m", files[1]]
    return {"illumina": "Illumina", "nanopore": "Nanopore", "pacbio": "PacBio"}.get(name, "Default"), ["-i", ",".join(files)]


def mode_arguments(sequencer: str, mode: str, extra: list[str] | None = None) -> dict[str, str]:
    """Arguments by mode; ``extra`` pairs replace those of the same name or are added, a last single one is ignored."""
    name = sequencer.lower()
    kind = "illumina" if name == "illumina" else "long" if name in ("nanopore", "pacbio") else "other"
    out = dict(MODE_ARGUMENTS[(kind, mode)]) | {"--Use_M_in_CIGAR": "false"}
    extra = extra or []
    return out | dict(zip(extra[0::2], extra[1::2]))


def run(command: list[str]) -> None:
    """Run to the end, its messages passed through; a failure carries its code or signal and its last messages."""
    try:
        p = subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True)
    except FileNotFoundError as e:
        raise AlignerError(f"{command[0]} isn't installed") from e
    tail: list[str] = []
    for line in p.stderr:
        tail = [*tail[-50:], line]
    code = p.wait()
    if code:
        raise AlignerError(f"{command[0]} ended with {'signal ' + str(-code) if code < 0 else 'code ' + str(code)}: {''.join(tail)}")


def align(db: str, files: list[str], out_sam: str, sequencer: str = "Illumina", mode: str = "default", paired: bool = False, threads: int = 20, extra: list[str] | None = None, binary: str = DEFAULT_BINARY) -> str:
    name, inputs = input_preset(sequencer, files, paired)
    arguments = [x for pair in mode_arguments(sequencer, mode, extra).items() for x in pair]
    run([binary, "-p", name, "-x", db, *inputs, "-o", out_sam, "-t", str(threads), *arguments])
    return out_sam


def build_index(fasta: str, out_dir: str, name: str = "index_db", binary: str = DEFAULT_BINARY) -> None:
    os.makedirs(out_dir, exist_ok=True)
    run([binary, "--Create_Index", f"{fasta},{out_dir},{name}"])
