"""Records that span lines, cut from batches of lines, against a loop over single lines; heads of many files."""

import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import rows
from gridloom.sources import delimited, dialect
from gridloom.sources.delimited import KEEPS, SWAPS, Dialect, parse_records, read_records


def line_by_line(split_lines, starts):
    """(block, raw, piece) of every record: the state machine, a line at a time."""
    found = []
    for block, lines in split_lines:
        inside = starts[block]
        piece, held = (2 if inside else 0), []
        for line, code in lines:
            if not inside and not line.rstrip(b"\r"):
                continue
            held.append(line)
            inside = code >> inside & 1
            if not inside:
                found.append((block, b"\n".join(held), piece))
                held, piece = [], 0
        if held:
            found.append((block, b"\n".join(held), piece or 1))
    return found


@pytest.mark.parametrize("seed", range(40))
def test_cutting_by_array_equals_a_loop(seed):
    chance = random.Random(seed)
    odd = chance.choice([0.02, 0.3, 0.7])
    splits, starts, state = [], {}, 0
    for block in range(chance.randint(1, 5)):
        starts[block] = state
        lines = []
        for _ in range(chance.randint(0, 30)):
            text = chance.choice([b"", b"\r", b"\r\r", b"a;b", b"\rx", b"long line\r"])
            # a line without a quote changes nothing
            code = chance.choice([0, 3, SWAPS]) if text.strip(b"\r") and chance.random() < odd else KEEPS
            lines.append((text, code))
            state = code >> state & 1
        splits.append((block, lines))
    flat = [(block, text, code) for block, lines in splits for text, code in lines]
    cutter = delimited._Cutter(starts, 100)
    found = []
    size = chance.randint(1, 12)
    for at in range(0, len(flat), size):
        part = flat[at:at + size]
        batch = pa.RecordBatch.from_arrays([
            pa.array(["f"] * len(part)), pa.array([b for b, _, _ in part], pa.int64()), pa.array([b for b, _, _ in part], pa.int64()),
            pa.array([c for _, _, c in part], pa.int8()), pa.array([t for _, t, _ in part], pa.binary())],
            names=["file", "block", "split", "code", "raw"])
        found += [r for b in cutter.take(batch) for r in b.to_pylist()]
    found += [r for b in cutter.finish() for r in b.to_pylist()]
    want = line_by_line([(b, ls) for b, ls in splits if ls], starts)
    assert [(r["_block_start"], r["_raw"], r["_piece"]) for r in found] == want
    assert [r["_row_id"] for r in found] == list(range(100, 100 + len(found)))


def test_states_compose():
    chance = np.random.default_rng(1)
    for _ in range(200):
        codes = chance.choice([0, 1, 2, 2, 2, 3], size=chance.integers(0, 20)).astype(np.int8)
        for start in (0, 1):
            want = [start]
            for code in codes.tolist():
                want.append(code >> want[-1] & 1)
            assert delimited._states(codes, start).tolist() == want


def test_heads_of_many_files_in_one_partition():
    lines = [("a", b""), ("a", b"h;\"x"), ("a", b""), ("a", b"y\""), ("a", b"1;2"), ("a", b"3;4"), ("b", b"only"), ("c", b""), ("d", b"p"), ("d", b"q"), ("d", b"r")]
    want = [("a", 1, b'h;"x'), ("a", 2, b""), ("a", 3, b'y"'), ("b", 1, b"only"), ("d", 1, b"p"), ("d", 2, b"q"), ("d", 3, b"r")]
    for size in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array([f for f, _ in part]), pa.array([t for _, t in part], pa.binary())], names=["f", "raw"])
                   for part in (lines[i:i + size] for i in range(0, len(lines), size))]
        assert [tuple(r.values()) for b in dialect._tops_of_files(iter(batches), 3) for r in b.to_pylist()] == want


def test_heads_exchange_no_more_than_their_lines(spark, folder):
    for n in range(6):
        folder(f"in/f{n}.csv", "a;b\n" + f"{n};x\n" * 3000)
    heads = dialect._head_lines(spark, folder.new("in"), None, 16)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "MapInArrow" in below and "Window" not in plan and "Sort [" not in plan
    assert [len(r._lines) for r in heads.collect()] == [16] * 6


@pytest.mark.parametrize("line", ["1;2", "1;", ";", ";;", "1", "", " ; ", '"1";2', '1;"a;b"', '1;"a""b"', '1;2"', '"x"y;2', '"1', "1;2;3", " 1;2 ", "\t;x", "ä;ö", '"";""', '" ";'])
def test_both_ways_of_cutting_cells_agree(spark, line):
    shape = Dialect.named("a", "b", delimiter=";", has_header=False)
    table = spark.createDataFrame([("f", 0, line, 0)], "_source_file string, _block_start long, _raw string, _row_id long")
    own = parse_records(table, shape).select("_cells.c0", "_cells.c1", "_error").first()
    # a further quoted cell sends the record through the CSV parser
    wide = Dialect.named("a", "b", "c", delimiter=";", has_header=False)
    other = parse_records(spark.createDataFrame([("f", 0, line + ';"q"', 0)], table.schema), wide).select("_cells.c0", "_cells.c1", "_error").first()
    if '"' not in line and line.count(";") == 1:
        assert (own.c0 or "", own.c1 or "", own._error) == (other.c0 or "", other.c1 or "", None)
    assert (own._error is None) == (other._error is None)


def test_quoted_line_breaks_over_many_splits(spark, folder):
    chance = random.Random(3)
    want = [(str(n), "x\ny" * chance.randint(0, 4) + chance.choice(["", 'q"q', ";"])) for n in range(4000)]
    text = "a;b\n" + "".join(f'{a};"{b.replace(chr(34), chr(34) * 2)}"\n' for a, b in want)
    path = folder("q.csv", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        shape = Dialect.named("a", "b", delimiter=";", quoted_newlines=True)
        parsed = parse_records(read_records(spark, path, shape), shape).where("_lead = 0")
        assert rows(parsed.selectExpr("_cells.c0", "coalesce(_cells.c1, '')")) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
