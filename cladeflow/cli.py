"""Command line: ``profile`` and ``index``."""

from __future__ import annotations

import argparse
import logging
import os
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladeflow.config import MODES, ProfileConfig, non_negative, probability
from cladeflow.plans import parse, profile, subsample, taxa
from cladeflow.session import cut_lineage
from cladeflow.sources import aligner, sam, tables

log = logging.getLogger("cladeflow")
#: Where a taxonomy dump lies that no option names.
DMP_DIR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeflow")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("profile", help="profile reads or an alignment file")
    a.add_argument("--db", help="aligner database")
    a.add_argument("--dmp-dir", default=DMP_DIR, help="folder of nodes.dmp, names.dmp, merged.dmp and, if there is one, delnodes.dmp; by default the package's folder data")
    a.add_argument("-i", "--in-seq", nargs="+", default=[])
    a.add_argument("-o", "--outprefix", required=True)
    a.add_argument("-t", "--threads", type=int, default=20)
    a.add_argument("-r", "--resume", action="store_true", help="use <outprefix>.sam or .sam.gz if it is there")
    a.add_argument("--reuse-sam")
    a.add_argument("--sequencer", default="Illumina")
    a.add_argument("-p", "--is-paired", action="store_true")
    a.add_argument("--strain", action="store_true")
    a.add_argument("--mode", choices=MODES, default="default")
    a.add_argument("--batch-size", type=int, default=5000, help="taken for compatibility; Spark sizes its own batches")
    a.add_argument("--identity", type=probability)
    a.add_argument("-m", "--mapped-len", type=int)
    a.add_argument("-f", "--fraction", type=probability)
    a.add_argument("-b", "--min-breadth", type=probability, default=0.0)
    a.add_argument("--min-cbreadth", type=non_negative)
    a.add_argument("--min-reads", type=int)
    a.add_argument("--min-oebr", type=non_negative)
    a.add_argument("--min-coebr", type=non_negative)
    a.add_argument("-l", "--lowbiomass", action="store_true")
    a.add_argument("--strict", action="store_true")
    a.add_argument("-k", "--keep-raw", action="store_true")
    a.add_argument("--by-aligned", action="store_true")
    a.add_argument("--genus-identity", type=probability, default=0.80)
    a.add_argument("--low-map-rate-threshold", type=probability, default=0.30)
    a.add_argument("--genus-fallback", action="store_true")
    a.add_argument("-z", "--compress-sam", action="store_true")
    a.add_argument("--pathogen-host", help="table of pathogens and their hosts")
    a.add_argument("--host", type=int, help="taxid of the host")
    a.add_argument("--verbose", action="store_true")
    a.add_argument("--very-verbose", action="store_true")
    a.add_argument("extra", nargs="*", help="after --: passed to the aligner")
    i = sub.add_parser("index", help="build an aligner index, of a fraction of the genomes if asked for")
    i.add_argument("-f", "--fraction", type=float)
    i.add_argument("-s", "--seed", type=int, default=42)
    i.add_argument("-t", "--threads", type=int, default=20)
    i.add_argument("-l", "--segment-length", type=int, default=50_000)
    i.add_argument("-m", "--min-length", type=int, default=3_000)
    i.add_argument("-z", "--compress", action="store_true")
    i.add_argument("fasta")
    i.add_argument("-o", "--outdir", required=True)
    return p


def config_of(a: argparse.Namespace) -> ProfileConfig:
    names = ProfileConfig.__dataclass_fields__
    return ProfileConfig(**{k: v for k, v in vars(a).items() if k in names})


def alignment_file(a: argparse.Namespace) -> tuple[str, bool]:
    """(path, was it made just now)."""
    there = sam.choose_alignment(a.outprefix, a.reuse_sam, a.resume)
    if there:
        return there, False
    if not (a.db and a.in_seq):
        raise SystemExit("without an alignment to reuse, --db and --in-seq are needed")
    return aligner.align(a.db, a.in_seq, f"{a.outprefix}.sam", a.sequencer, a.mode, a.is_paired, a.threads, a.extra), True


def profile_file(spark: SparkSession, path: str, dmp_dir: str, cfg: ProfileConfig, hosts: str | None = None) -> profile.Profile:
    """The whole analysis of one alignment file."""
    tax = tables.read_dmp(spark, dmp_dir)
    lineage = cut_lineage(taxa.lineages(tax))
    lines = sam.read_lines(spark, path)
    refs = cut_lineage(parse.reference_dim(parse.reference_lines(sam.header_lines(lines)), tax, lineage, truncated_flank=cfg.strain))
    parsed = parse.parse_alignments(parse.split_records(sam.record_lines(lines), cfg.is_paired), refs, cfg)
    return profile.run_profile(parsed, refs, tax, cfg, tables.read_hosts(spark, hosts) if hosts else None, lineage)


def run_profile(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = config_of(a)
    log.info("%s", cfg)
    detailed = a.verbose or a.very_verbose
    path, made = alignment_file(a)
    p = profile_file(spark, path, a.dmp_dir, cfg, a.pathogen_host)
    log.info("reads %s, aligned %s, alignments %s", p.totals.reads, p.totals.aligned_reads, p.totals.alignments)
    if detailed:
        log.info("alignments: %s", parse.filter_stats(p.parsed, cfg).first().asDict() | parse.skipped_references(p.parsed).first().asDict())
        log.info("shares of ambiguous reads: %s iterations, converged: %s", p.em.iterations, p.em.converged)
    infix = ".pathogen" if cfg.host is not None else ""
    tables.write_tsv(profile.rendered(p.final), f"{a.outprefix}{infix}.profile.txt")
    if cfg.keep_raw:
        tables.write_tsv(profile.rendered(p.raw), f"{a.outprefix}{infix}.rprofile.txt")
    if p.classified is not None:
        tables.write_tsv(p.classified, f"{a.outprefix}.classify.txt")
    if a.compress_sam and made:
        tables.gzip_file(path)


def run_index(spark: SparkSession, a: argparse.Namespace) -> None:
    fasta = a.fasta
    if a.fraction is not None:
        params = subsample.SubsampleParams(a.fraction, a.seed, a.segment_length, a.min_length)
        chosen = subsample.subsample(tables.read_fasta(spark, a.fasta).drop("ordinal"), params)
        ordered = chosen.orderBy("genome_id", "contig_idx", "start")
        fasta = os.path.join(a.outdir, "fraction.fa")
        ordered.select(tables.fasta_text(ordered).alias("value")).coalesce(1).write.mode("overwrite").text(fasta)
        fasta = next(os.path.join(fasta, f) for f in sorted(os.listdir(fasta)) if f.startswith("part-"))
    aligner.build_index(fasta, a.outdir)
    if a.compress:
        tables.gzip_file(fasta)


def command_line(argv: list[str]) -> str:
    """What a shell would take to run the same again."""
    return shlex.join(["cladeflow", *argv])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    level = logging.DEBUG if getattr(a, "very_verbose", False) else logging.INFO
    logging.basicConfig(level=level, format="%(asctime)s %(name)s %(levelname)s %(message)s", stream=sys.stdout)
    if hasattr(a, "outprefix"):
        logging.getLogger().addHandler(logging.FileHandler(f"{a.outprefix}.log"))
    log.info("%s", command_line(sys.argv[1:] if argv is None else argv))
    spark = SparkSession.builder.appName("cladeflow").getOrCreate()
    (run_profile if a.command == "profile" else run_index)(spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
