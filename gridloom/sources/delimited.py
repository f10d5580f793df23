"""Delimited files as records: one row per record with its file, split, order and raw text.

Lines come from Spark's text source, which splits every file. Records are parsed with ``from_csv``
in the JVM, so the raw text stays at hand for the quarantine and rows of blank cells are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.functions.text import decode_bytes, is_blank, strip

SOURCE, BLOCK, ROW, RAW = "_source_file", "_block_start", "_row_id", "_raw"
LEAD, ERROR = "_lead", "_error"
HEADER_LINE, PREAMBLE_LINE, FILE_PROBLEM = 1, 2, 3

# Spark holds no longer string; a quoted cell beyond it is an error that names its file.
MAX_RECORD_BYTES = 1 << 30


@dataclass(frozen=True)
class Dialect:
    """How a file is written. ``header`` holds the source column names, as found or generated."""

    header: tuple[str, ...]
    delimiter: str = ","
    encoding: str = "utf-8"
    has_header: bool = True
    header_line: str | None = None
    has_preamble: bool = False
    trailing_empty: int = 0
    quoted_newlines: bool = False

    @classmethod
    def named(cls, *header: str, delimiter: str = ",", **settings) -> "Dialect":
        """A dialect whose files start with just these names."""
        return cls(header, delimiter, header_line=delimiter.join(header), **settings)

    @property
    def width(self) -> int:
        return len(self.header) + self.trailing_empty


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "utf-8",
    quoted_newlines: bool = False,
    glob: str | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Physical lines of files, and of all files below a folder.

    Where cells hold line breaks, a carriage return may belong to the cell, so it is kept. A file in
    UTF-16 cannot be split at line ends and is read as a whole, up to the 2 GB of Spark's binary files.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if is_utf16(encoding):
        files = reader.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
        lines = F.split(F.decode("content", "UTF-16"), "\n" if quoted_newlines else "\r\n|\r|\n")
        return files.select(
            F.col("_metadata.file_path").alias(SOURCE), F.lit(0).cast("long").alias(BLOCK), F.explode(lines).alias(RAW))
    if quoted_newlines:
        reader = reader.option("lineSep", "\n")
    text = reader.text(paths if isinstance(paths, str) else list(paths))
    return with_origin(text if where is None else text.where(where), encoding)


def is_utf16(encoding: str) -> bool:
    return encoding.lower().replace("_", "-").startswith("utf-16")


class FileIndex:
    """The files that a scan of some paths reads, empty ones too, as the driver has listed them for it.

    Spark's scans pass over files of no bytes, so the list is compared with what a scan has shown, by
    number; only if they differ does it leave the JVM.
    """

    def __init__(self, spark: SparkSession, paths: str | Sequence[str], glob: str | None = None):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        self.spark = spark
        self._listed = reader.load(paths if isinstance(paths, str) else list(paths))._jdf.inputFiles()

    def __len__(self) -> int:
        return len(self._listed)

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame([(metadata_path(path),) for path in self._listed], f"{SOURCE} string")


def metadata_path(location: str) -> str:
    """A file's location as the ``_metadata`` column spells it: without a host, with one slash."""
    return re.sub(r"^(\w+):///", r"\1:/", location)


def literal_path(location: str) -> str:
    """A file's location, as the ``_metadata`` column spells it, in the form a reader takes."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(location))


def with_origin(text: DataFrame, encoding: str = "utf-8") -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        decode_bytes(F.col("value"), encoding).alias(RAW),
    )


def to_records(lines: DataFrame, quoted_newlines: bool = False, delimiter: str = ",") -> DataFrame:
    """Records with ids that count up by one inside each split of a file. Blank lines are skipped."""
    if quoted_newlines:
        return _stitch(lines, delimiter)
    return lines.where(F.length(RAW) > 0).withColumn(ROW, F.monotonically_increasing_id())


def read_records(spark: SparkSession, paths: str | Sequence[str], dialect: Dialect, glob: str | None = None) -> DataFrame:
    return to_records(
        read_lines(spark, paths, dialect.encoding, dialect.quoted_newlines, glob), dialect.quoted_newlines, dialect.delimiter)


# A line either leaves the text inside a quoted cell or not, by where it starts: two answers, in two bits.
# Bit 0 answers for a line that starts outside, bit 1 for one that starts inside a quoted cell.
KEEPS, SWAPS = 0b10, 0b01


def open_quote_patterns(delimiter: str) -> tuple[str, str]:
    """Patterns of lines that end inside a quoted cell, for a start outside and inside of one.

    A quote opens a cell only at the cell's start. Doubled quotes stay inside, and what follows a
    closing quote up to the delimiter is text, as are quotes in cells that do not start with one.
    """
    mark, other = re.escape(delimiter), f"[^{re.escape(delimiter)}]"
    inside = r'(?:[^"]++|"")*+'
    cell = f'(?:"{inside}"{other}*+|(?!"){other}*+)'
    outside = f'(?:{cell}{mark})*+"{inside}$'
    return f"(?s)^{outside}", f'(?s)^{inside}(?:$|"{other}*+{mark}{outside})'


def quote_code(raw: Column, delimiter: str) -> Column:
    from_outside, from_inside = open_quote_patterns(delimiter)
    return F.when(~raw.contains('"'), F.lit(KEEPS)).otherwise(
        raw.rlike(from_outside).cast("int") + raw.rlike(from_inside).cast("int") * 2).cast("tinyint")


def ends_inside_quotes(raw: Column, delimiter: str) -> Column:
    """Whether a line that starts a record leaves a quoted cell open."""
    return raw.contains('"') & raw.rlike(open_quote_patterns(delimiter)[0])


def _folded(codes: np.ndarray) -> int:
    """What a run of lines does to the state, as one code."""
    fixed = np.flatnonzero((codes == 0) | (codes == 3))
    start = fixed[-1] + 1 if len(fixed) else 0
    odd = int((codes[start:] == SWAPS).sum()) % 2
    if not len(fixed):
        return SWAPS if odd else KEEPS
    return 3 * ((int(codes[fixed[-1]]) & 1) ^ odd)


def _runs(keys: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of the splits that follow each other in a batch."""
    edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])


def _stitch(lines: DataFrame, delimiter: str) -> DataFrame:
    """Records that may span lines, without reading a file in one task and without a shuffle of its text.

    A first pass asks every split what it does to the state of being inside a quoted cell, and answers
    with one row per split. Folded in the order of each file they give the state that each split starts
    in; the driver holds these few bytes for each split that it has planned. A second pass cuts records
    inside its tasks. Only records that cross a split are exchanged. Were files cut differently
    in the second pass, a split would have no state, which is an error.
    """
    coded = lines.select(
        SOURCE, BLOCK, F.xxhash64(SOURCE, BLOCK).alias("_split"), quote_code(F.col(RAW), delimiter).alias("_code"),
        F.col(RAW).cast("binary").alias(RAW))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, code = None, None, KEEPS
        for batch in batches:
            files, keys, blocks, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for start, stop in _runs(keys, blocks):
                if split is not None and split != keys[start]:
                    yield _one_row(split, place, code)
                    code = KEEPS
                split, place = keys[start], (files[start], blocks[start])
                code = _folded(np.concatenate([[code], codes[start:stop]]))
        if split is not None:
            yield _one_row(split, place, code)

    answers = coded.select(F.xxhash64(SOURCE), "_split", BLOCK, "_code").mapInArrow(
        fold, "split long, file long, block long, code int").collect()
    starts: dict[int, int] = {}
    file, state = None, 0
    for answer in sorted(answers, key=lambda a: (a["file"], a["block"])):
        state = 0 if answer["file"] != file else state
        file, starts[answer["split"]] = answer["file"], state
        state = answer["code"] >> state & 1
    known = lines.sparkSession.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(known.value, TaskContext.get().partitionId() << 33)
        for batch in batches:
            yield from cutter.take(batch)
        yield from cutter.finish()

    cells = coded.mapInArrow(cut, _CUT_SCHEMA)
    text = F.regexp_replace(F.col(RAW).cast("string"), "\r$", "").alias(RAW)
    whole = cells.where("_piece = 0").select(SOURCE, BLOCK, ROW, text)
    earlier = Window.partitionBy(SOURCE).orderBy(BLOCK, ROW)
    opened = F.when(F.col("_piece") == _OPENED, F.struct(BLOCK, ROW))
    pieces = cells.where("_piece <> 0").withColumn("_owner", F.last(opened, ignorenulls=True).over(earlier))
    part = F.struct(F.col(BLOCK).alias("b"), F.col(ROW).alias("r"), F.col(RAW).alias("t"))
    size = F.sum(F.length(RAW) + 1)
    too_long = F.raise_error(F.concat(F.lit("A quoted cell is too long for a row in "), F.col(SOURCE)))
    crossing = pieces.groupBy(SOURCE, "_owner").agg(
        F.when(size > MAX_RECORD_BYTES, too_long.cast("string")).otherwise(F.array_join(F.transform(
            F.array_sort(F.collect_list(part)), lambda p: p["t"].cast("string")), "\n")).alias(RAW))
    return whole.unionByName(crossing.select(SOURCE, "_owner." + BLOCK, "_owner." + ROW, text))


_OPENED, _CARRIED = 1, 2
_CUT_SCHEMA = f"{SOURCE} string, {BLOCK} long, {ROW} long, {RAW} binary, _piece int"


def _one_row(split: int, place: tuple[int, int], code: int) -> pa.RecordBatch:
    values = (int(split), int(place[0]), int(place[1]))
    return pa.RecordBatch.from_arrays(
        [*(pa.array([v], pa.int64()) for v in values), pa.array([code], pa.int32())], names=["split", "file", "block", "code"])


def _states(codes: np.ndarray, start: int) -> np.ndarray:
    """Whether each line starts inside a quoted cell, and whether the last one leaves one open: one value more than lines.

    The effect of lines composes: what counts is the last line with a fixed outcome, and how often later ones swap.
    """
    places = np.arange(len(codes))
    fixed = np.maximum.accumulate(np.where((codes == 0) | (codes == 3), places, -1))
    swaps = np.concatenate([[0], np.cumsum(codes == SWAPS)])
    base = np.where(fixed >= 0, codes[np.maximum(fixed, 0)] & 1, start)
    after = base ^ ((swaps[1:] - swaps[fixed + 1]) & 1)
    return np.concatenate([[start], after]).astype(np.int8)


class _Cutter:
    """Lines of a task as records; the ends of a split that belong to records of two splits as pieces.

    Records of one line are taken from the batch as they are; only lines that are joined become Python objects.
    """

    def __init__(self, starts: dict[int, int], first_id: int):
        self.starts, self.next_id = starts, first_id
        self.split, self.place, self.inside, self.piece, self.open = None, None, 0, 0, []

    def _rows(self, texts: pa.Array, pieces: np.ndarray) -> pa.RecordBatch:
        count = len(texts)
        file, block = self.place if self.place else (None, None)
        ids = np.arange(self.next_id, self.next_id + count, dtype=np.int64)
        self.next_id += count
        same = pa.array(np.zeros(count, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.string()).take(same), pa.array([block], pa.int64()).take(same), pa.array(ids), texts,
             pa.array(pieces.astype(np.int32))], names=[SOURCE, BLOCK, ROW, RAW, "_piece"])

    def _leave(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            text = b"\n".join(self.open)
            self.open = []
            yield self._rows(pa.array([text], pa.binary()), np.array([self.piece or _OPENED]))

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files, blocks, splits, codes, texts = batch.columns
        keys, codes = splits.to_numpy(), codes.to_numpy(zero_copy_only=False)
        for start, stop in _runs(keys, blocks.to_numpy()):
            if keys[start] != self.split:
                yield from self._leave()
                split = int(keys[start])
                if split not in self.starts:
                    raise RuntimeError(f"'{files[start].as_py()}' was cut differently in the second pass.")
                self.split, self.place, self.inside = split, (files[start].as_py(), blocks[start].as_py()), self.starts[split]
                self.piece = _CARRIED if self.inside else 0
            yield self._records(codes[start:stop], texts.slice(start, stop - start))

    def _records(self, codes: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        """The records that end in these lines of a split; the rest waits."""
        states = _states(codes, self.inside)
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        blank = lengths == 0
        for i in np.flatnonzero(pc.starts_with(texts, pattern=b"\r").to_numpy(zero_copy_only=False)).tolist():
            blank[i] = not texts[i].as_py().rstrip(b"\r")
        blank &= states[:-1] == 0
        ends = np.flatnonzero((states[1:] == 0) & ~blank)
        # blank lines stand between records only, so a record that spans lines has none before its first
        opens = np.flatnonzero((states[:-1] == 0) & ~blank)
        if states[0]:
            # the first lines go on with what is held, or with the split before
            opens = np.concatenate([[-1], opens])
        firsts = opens[:len(ends)]
        joined = np.flatnonzero(firsts != ends)
        spans = []
        for k in joined.tolist():
            lines = texts.slice(max(firsts[k], 0), ends[k] + 1 - max(firsts[k], 0)).to_pylist()
            spans.append(b"\n".join([*self.open, *lines] if firsts[k] < 0 else lines))
        if len(opens) > len(ends):
            rest = texts.slice(max(opens[len(ends)], 0)).to_pylist()
            self.open = [*self.open, *rest] if opens[len(ends)] < 0 else rest
        else:
            self.open = []
        self.inside = int(states[-1])
        whole = texts.take(pa.array(ends))
        if spans:
            place = np.arange(len(ends))
            place[joined] = len(ends) + np.arange(len(joined))
            whole = pa.concat_arrays([whole, pa.array(spans, whole.type)]).take(pa.array(place))
        pieces = np.zeros(len(ends))
        if len(ends):
            pieces[0], self.piece = self.piece, 0
        return self._rows(whole, pieces)

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._leave()


def _cells_of(raw: Column, delimiter: str) -> Column:
    """The fields of a raw record as an array, quoted ones reduced to a mark unless blank."""
    mark = re.escape(delimiter)
    single_quotes = F.replace(raw, F.lit('""'), F.lit(""))
    blank_cut = F.regexp_replace(single_quotes, f'(^|{mark})"\\s*+"(?={mark}|$)', "$1")
    closed = F.regexp_replace(blank_cut, f'(^|{mark})"[^"]*+"', "$1x")
    return F.split(closed, mark, -1)


def parse_records(records: DataFrame, dialect: Dialect) -> DataFrame:
    """Add ``_cells`` (a struct c0..cn of text), ``_lead`` and, for ragged rows, ``_error``."""
    expected, spare = len(dialect.header), dialect.trailing_empty
    cells = [f"c{i}" for i in range(dialect.width)]
    options = {
        "sep": dialect.delimiter,
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_bad",
        "maxColumns": str(max(20480, 2 * dialect.width)),
    }
    schema = ", ".join(f"{c} string" for c in cells) + ", _bad string"
    if dialect.width == 1:
        parsed = records.withColumn("_cells", F.from_csv(F.col(RAW), schema, options)).withColumn("_nothing", F.col("_cells").isNull())
    else:
        # most records have no quote: they are cut at the delimiter, several times as fast as by the CSV parser
        plain = ~F.col(RAW).contains('"')
        both = records.select("*", F.split(F.when(plain, F.col(RAW)), re.escape(dialect.delimiter), -1).alias("_parts"),
                              F.from_csv(F.when(~plain, F.col(RAW)), schema, options).alias("_parsed"))
        short = F.size("_parts") != dialect.width
        parsed = both.select(*records.columns, (F.col("_parts").isNull() & F.col("_parsed").isNull()).alias("_nothing"), F.struct(
            *(F.coalesce(F.get("_parts", F.lit(i)), F.col(f"_parsed.{c}")).alias(c) for i, c in enumerate(cells)),
            F.coalesce(F.when(F.col("_parts").isNotNull() & short, F.col(RAW)), F.col("_parsed._bad")).alias("_bad")).alias("_cells"))

    ragged = F.col("_nothing") | F.col("_cells._bad").isNotNull()
    shape = _cells_of(F.col(RAW), dialect.delimiter)
    found = F.size(shape)
    if spare:
        tail = F.slice(shape, -spare, spare)
        blank_tail = (found > spare) & F.forall(tail, is_blank)
        found = F.when(blank_tail, found - spare).otherwise(found)
        full_ok = F.lit(True)
        for cell in cells[expected:]:
            full_ok = full_ok & is_blank(F.col(f"_cells.{cell}"))
        bad = F.when(ragged, found != expected).otherwise(~full_ok)
    else:
        bad = ragged
    # Fixed text: it is a value of the result.
    message = F.concat(F.lit(f"Expected {expected} fields, found "), found.cast("string"), F.lit("."))

    lead = F.lit(0)
    if dialect.has_preamble:
        lead = F.when(F.col(RAW).contains(":") & (F.size(shape) == 1), PREAMBLE_LINE).otherwise(lead)
    if dialect.has_header:
        lead = F.when(_is_header(dialect), HEADER_LINE).otherwise(lead)
    if dialect.has_header or dialect.has_preamble:
        lead = F.when(F.col(BLOCK) == 0, lead).otherwise(0)
    return parsed.withColumn(LEAD, lead.cast("tinyint")).withColumn(ERROR, F.when(bad, message)).drop("_nothing")


def _is_header(dialect: Dialect) -> Column:
    """Whether the cells of a record are the column names, whatever their quotes and padding."""
    same = F.lit(True)
    for i, name in enumerate(dialect.header):
        cell = F.coalesce(F.col(f"_cells.c{i}"), F.lit(""))
        wanted = name.replace("\r\n", "\n")
        cell = F.replace(cell, F.lit("\r\n"), F.lit("\n")) if "\n" in wanted else cell
        same = same & (strip(cell) == F.lit(wanted.strip()))
    for i in range(len(dialect.header), dialect.width):
        same = same & is_blank(F.col(f"_cells.c{i}"))
    return same
