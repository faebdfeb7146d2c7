"""Loading raw header lines while separating those that don't parse (problem 3).

*Fast path*: the lines of a block are parsed column-wise in C++ - one extraction of all fields, one cast
a numeric column, a few comparisons. They leave a running count of what didn't fit, so whether any part of the block
fails is a difference of two counts. A failing block is *bisected* on those counts, without parsing a line again, until each
failing line stands alone. Those are *diagnosed strictly* by a character-wise parser which either accepts the line
(quoted fields, white space, other tags) or names the first reason that fits:

``quoting``  a header breaks the quoting rule,
``columns``  not exactly one SN and one LN tag, or a header of other than 5 or 6 fields,
``value``    an empty asm or accession or one with white space, a number out of its range, a sampled
             size above the size.

The fast path accepts a subset of what the strict parser accepts, with equal values (tested).

Defined results: null lines and lines of white space only are no records and come out in neither part;
a line that lacks its ``>`` or ``@SQ``, or whose kind is unknown, fails with ``columns``; lines delivered
twice are two records; no column of the input gets lost or renamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that the fast path takes at once.
BLOCK = 4096
#: Digits that fit a long whatever they are; longer numbers are left to the strict parser.
DIGITS = 18
MAX_TAXID = 2**32 - 1
MAX_SIZE = 2**63 - 1
SPACE = " \t\r\n"

_HEADER = r'(?P<asm>[^|" \t\r\n]+)\|(?P<taxid>[0-9]+)\|(?P<species_taxid>[0-9]+)\|(?P<acc>[^|" \t\r\n]+)\|(?P<size>[0-9]+)(?:\|(?P<sampled>[0-9]+))?'
FAST_PATTERN = {"fasta": rf"^>{_HEADER}$", "sq": rf"^@SQ\tSN:{_HEADER}\tLN:(?P<length>[0-9]+)(?:\t(?:AH|AN|AS|DS|M5|SP|TP|UR):[^\t]*)*$"}
TEXT = ("asm", "acc")
NUMBERS = ("taxid", "species_taxid", "size", "sampled", "length")

FIELDS = T.StructType(
    [
        T.StructField("asm", T.StringType()),
        T.StructField("taxid", T.LongType()),
        T.StructField("species_taxid", T.LongType()),
        T.StructField("acc", T.StringType()),
        T.StructField("genome_size", T.LongType()),
        T.StructField("sampled_size", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def split_header(header: str) -> list[str] | None:
    """The fields of a header without white space around them, or None if it breaks the quoting rule."""
    fields, at, n = [], 0, len(header)
    while True:
        while at < n and header[at] in SPACE:
            at += 1
        if at < n and header[at] == '"':
            at, text = at + 1, []
            while True:
                close = header.find('"', at)
                if close < 0:
                    return None
                text.append(header[at:close])
                at = close + 1
                if at < n and header[at] == '"':
                    text.append('"')
                    at += 1
                else:
                    break
            while at < n and header[at] in SPACE:
                at += 1
            if at < n and header[at] != "|":
                return None
            fields.append("".join(text).strip(SPACE))
        else:
            bar = header.find("|", at)
            bar = n if bar < 0 else bar
            plain = header[at:bar]
            if '"' in plain:
                return None
            fields.append(plain.strip(SPACE))
            at = bar
        if at >= n:
            return fields
        at += 1  # the bar


def whole(text: str, most: int) -> int | None:
    """A whole number from 1 to ``most`` in the digits 0-9."""
    if not re.fullmatch("[0-9]+", text) or len(text.lstrip("0")) > 19:
        return None
    value = int(text)
    return value if 1 <= value <= most else None


def diagnose(kind: str | None, line: str) -> tuple[str | None, tuple | None]:
    """(reason, None) or (None, values of FIELDS)."""
    line = line.strip(SPACE)
    length = None
    if kind == "fasta" and line.startswith(">"):
        headers, lengths = [line[1:]], None
    elif kind == "sq" and line.split("\t")[0].strip(SPACE) == "@SQ":
        tags = [t.strip(SPACE) for t in line.split("\t")[1:]]
        headers = [t[3:] for t in tags if t.startswith("SN:")]
        lengths = [t[3:].strip(SPACE) for t in tags if t.startswith("LN:")]
    else:
        return "columns", None
    parsed = [split_header(h) for h in headers]
    if any(p is None for p in parsed):
        return "quoting", None
    if len(parsed) != 1 or (lengths is not None and len(lengths) != 1) or len(parsed[0]) not in (5, 6):
        return "columns", None
    asm, taxid, species, acc, size, *sampled = parsed[0]
    if any(not x or any(c in SPACE for c in x) for x in (asm, acc)):
        return "value", None
    numbers = [whole(taxid, MAX_TAXID), whole(species, MAX_TAXID), whole(size, MAX_SIZE)]
    given = whole(sampled[0], MAX_SIZE) if sampled else None
    if lengths is not None:
        length = whole(lengths[0], MAX_SIZE)
    if None in numbers or (sampled and given is None) or (lengths is not None and length is None) or (sampled and given > numbers[2]):
        return "value", None
    return None, (asm, numbers[0], numbers[1], acc, numbers[2], given, length)


def parse_lines(kind: str, lines: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(all fields of all lines, which lines don't fit the plain form); the fields of those mean nothing."""
    got = pc.extract_regex(lines, FAST_PATTERN[kind])
    fits = pc.is_valid(got)
    out: dict[str, pa.Array] = {n: got.field(n) for n in TEXT}
    for n in NUMBERS:
        if n == "length" and kind != "sq":
            out[n] = pa.nulls(len(lines), pa.int64())
            continue
        text = got.field(n)
        given = pc.and_(fits, pc.not_equal(text, "")) if n == "sampled" else fits  # an optional group that didn't take part comes as an empty string
        short = pc.less_equal(pc.binary_length(text), DIGITS)
        out[n] = pc.cast(pc.if_else(pc.and_(given, short), text, None), pa.int64())
        good = pc.fill_null(pc.and_(pc.greater_equal(out[n], 1), pc.less_equal(out[n], MAX_TAXID if n in ("taxid", "species_taxid") else MAX_SIZE)), False)
        fits = pc.and_(fits, pc.or_(good, pc.invert(given)))
    fits = pc.and_(fits, pc.invert(pc.fill_null(pc.greater(out["sampled"], out["size"]), False)))
    return out, ~fits.to_numpy(zero_copy_only=False)


def parse_block(kind: str, lines: pa.Array) -> dict[str, pa.Array] | None:
    """All fields of all lines, or None if one doesn't fit the plain form."""
    values, fails = parse_lines(kind, lines)
    return None if fails.any() else values


def bisect(failing: np.ndarray) -> list[int]:
    """The places of the failing lines, found by halving the block as long as a part of it fails."""
    before = np.concatenate(([0], np.cumsum(failing))).tolist()
    todo, alone = [(0, len(failing))], []
    while todo:
        a, b = todo.pop()
        if before[a] == before[b]:
            continue
        if before[b] - before[a] == b - a:
            alone.extend(range(a, b))
            continue
        half = (a + b) // 2
        todo += [(half, b), (a, half)]
    return alone


def _parse(names: list[str], kind_col: str, line_col: str):
    order = ["asm", "taxid", "species_taxid", "acc", "size", "sampled", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            kinds = batch.column(names.index(kind_col))
            lines = batch.column(names.index(line_col))
            lines = pc.utf8_trim(lines, SPACE)
            is_record = pc.fill_null(pc.greater(pc.utf8_length(lines), 0), False)
            strict: list[int] = []
            done: list[tuple[np.ndarray, dict]] = []
            known = np.zeros(n, bool)
            for kind in FAST_PATTERN:
                mask = pc.and_(pc.fill_null(pc.equal(kinds, kind), False), is_record).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(mask)
                known |= mask
                for k in range(0, len(at), BLOCK):
                    block = at[k : k + BLOCK]
                    values, fails = parse_lines(kind, lines.take(pa.array(block)))
                    alone = bisect(fails)
                    strict += block[alone].tolist()
                    kept = ~fails
                    done.append((block[kept], {n: v.filter(pa.array(kept)) for n, v in values.items()}))
            records = is_record.to_numpy(zero_copy_only=False)
            strict += [int(i) for i in np.flatnonzero(records & ~known)]
            fields: list[tuple | None] = [None] * n
            reasons: list[str | None] = [None] * n
            for i in strict:
                reasons[i], fields[i] = diagnose(kinds[i].as_py(), lines[i].as_py())
            slow = pa.array(fields, pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in FIELDS.fields]))
            rows = np.concatenate([np.asarray(x[0]) for x in done]) if done else np.empty(0, np.int64)
            where = np.full(n, -1)
            where[rows] = np.arange(len(rows))
            take = pa.array(where, mask=where < 0)
            strictly, columns = slow.flatten(), []
            for k, name in enumerate(order):
                fast = pa.concat_arrays([x[1][name].cast(slow.type.field(k).type) for x in done]) if done else pa.nulls(0, slow.type.field(k).type)
                columns.append(pc.coalesce(fast.take(take), strictly[k]))
            keep = pa.array(records)
            out = pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(reasons, pa.string())], [*names, *[f"_p_{f.name}" for f in FIELDS.fields], "_reason"])
            yield out.filter(keep)

    return run


def parse_headers(lines: DataFrame, kind: str = "kind", line: str = "line") -> DataFrame:
    """Every record of ``lines`` with the struct ``parsed`` (null where it failed) and ``reason`` (null where
    it parsed). Columns of the input stay as they are; ``parsed`` and ``reason`` replace such columns."""
    plain = lines.drop("parsed", "reason")
    renamed = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])  # any names, clashes included
    at = {c: f"c{i}" for i, c in enumerate(plain.columns)}
    schema = T.StructType([*renamed.schema.fields, *[T.StructField(f"_p_{f.name}", f.dataType) for f in FIELDS.fields], T.StructField("_reason", T.StringType())])
    out = renamed.mapInArrow(_parse(renamed.columns, at[kind], at[line]), schema)
    parsed = F.when(F.col("_reason").isNull(), F.struct(*[F.col(f"_p_{f.name}").alias(f.name) for f in FIELDS.fields]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(plain.columns)], parsed.alias("parsed"), F.col("_reason").alias("reason"))


def failing(lines: DataFrame, kind: str = "kind", line: str = "line") -> DataFrame:
    return parse_headers(lines, kind, line).where(F.col("reason").isNotNull()).drop("parsed")


def valid(lines: DataFrame, kind: str = "kind", line: str = "line") -> DataFrame:
    return parse_headers(lines, kind, line).where(F.col("reason").isNull()).drop("reason")
