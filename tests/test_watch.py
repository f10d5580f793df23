"""Watched tables: versions, changed files, the register of files, and compaction while others read."""

import os
import threading

import pytest

from conftest import rows
from gridloom.operators.ingest import ColumnMapping, Staged, ingest
from gridloom.operators.versions import GENERATIONS, Version, commit, current
from gridloom.sinks.materialize import compact
from gridloom.sources.delimited import Dialect
from gridloom.sources.dialect import EMPTY_FILE
from gridloom.streaming import watch
from gridloom.streaming.watch import watch_any, watch_folder, watched, watched_layouts

PLANTS = Dialect.named("Beet", "Sorte", delimiter=";")


@pytest.fixture
def garden(spark, folder):
    """A function that puts files into the inbox and lets the watch run once."""
    def grow(dialect=PLANTS, **files):
        for name, text in files.items():
            folder(f"in/{name}.csv", text)
        watch_folder(spark, folder.new("in"), folder.new("t"), folder.new("c"), dialect, once=True).awaitTermination()
        return watched(spark, folder.new("t"))
    return grow


def facts(staged):
    return sorted((r.source_file.rsplit("/", 1)[-1], r.row_count, r.rejected_count, r.imported_at, r.problem) for r in staged.manifest().collect())


def test_compaction_keeps_leads_problems_and_times(spark, folder, garden):
    garden(a="Beet;Sorte\n1;Kohl\n", b="bed;kind\n2;Lauch\n3\n", c="")
    garden(d="Beet;Sorte\n4;Rettich\n")
    before = garden(e="bed;kind\n5;Dill\n")
    data, bad, known = rows(before.accepted()), rows(before.rejected()), facts(before)
    assert data == [("1", "Kohl"), ("2", "Lauch"), ("4", "Rettich"), ("5", "Dill")] and len(bad) == 2
    result = compact(spark, folder.new("t")).first()
    assert result.same_rows and result.files_after < result.files_before
    after = watched(spark, folder.new("t"))
    assert (rows(after.accepted()), rows(after.rejected()), facts(after)) == (data, bad, known)
    # what was planned before still runs, until the next compaction
    assert rows(before.accepted()) == data
    grown = garden(f="Beet;Sorte\n6;Minze\n", b="bed;kind\n7;Salbei\n")
    want = sorted([*(r for r in data if r[0] != "2"), ("6", "Minze"), ("7", "Salbei")])
    assert rows(grown.accepted()) == want
    compact(spark, folder.new("t"))
    assert rows(watched(spark, folder.new("t")).accepted()) == want
    garden(g="Beet;Sorte\n8;Anis\n")
    compact(spark, folder.new("t"))
    assert rows(watched(spark, folder.new("t")).accepted()) == sorted([*want, ("8", "Anis")])
    # a generation and the newest parts are all that is left beside what the last compaction replaced
    assert len(os.listdir(folder.new(f"t/{GENERATIONS}"))) == 2


def test_reading_while_compacting(spark, folder, garden):
    for n in range(4):
        garden(**{f"w{n}": f"Beet;Sorte\n{n};x\n{n};y\n"})
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(watched(spark, folder.new("t")).accepted().count())

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(4, 6):
            compact(spark, folder.new("t"))
            garden(**{f"w{n}": f"Beet;Sorte\n{n};x\n{n};y\n"})
    finally:
        done.set()
        reader.join()
    assert set(seen) <= {8, 10, 12} and seen == sorted(seen) and len(seen) > 2


def test_changed_files_are_taken_again(spark, folder, garden):
    garden(a="Beet;Sorte\n1;alt\n2;alt\n", b="Beet;Sorte\n3;bleibt\n")
    staged = garden(a="Beet;Sorte\n1;neu\nx\n")
    assert rows(staged.accepted()) == [("1", "neu"), ("3", "bleibt")]
    assert [(r.row_number, r.raw_row) for r in staged.rejected().collect()] == [(3, "x")]
    assert sorted((r.source_file[-5:], r.row_count) for r in staged.manifest().collect()) == [("a.csv", 1), ("b.csv", 1)]
    assert rows(garden(c="Beet;Sorte\n4;dazu\n").accepted()) == [("1", "neu"), ("3", "bleibt"), ("4", "dazu")]
    # emptied, then filled again
    assert rows(garden(a="").accepted()) == [("3", "bleibt"), ("4", "dazu")]
    assert rows(watched(spark, folder.new("t")).rejected().select("message")) == [(EMPTY_FILE,)]
    assert rows(garden(a="Beet;Sorte\n9;voll\n").accepted()) == [("3", "bleibt"), ("4", "dazu"), ("9", "voll")]
    assert watched(spark, folder.new("t")).rejected().count() == 0


def test_a_changed_file_may_change_its_layout(spark, folder):
    where = dict(folder=folder.new("in"), tables=folder.new("tables"), checkpoint=folder.new("check"), once=True)
    folder("in/a.csv", "Beet;Sorte\n1;Kohl\n")
    folder("in/b.csv", "Beet;Sorte\n2;Lauch\n")
    watch_any(spark, **where).awaitTermination()
    folder("in/a.csv", "Beet,Tag\n1,Montag\n")
    watch_any(spark, **where).awaitTermination()
    layouts = watched_layouts(spark, where["tables"])
    assert sorted((tuple(s.columns), rows(s.accepted())) for s in layouts.values()) == [
        (("Beet", "Sorte"), [("2", "Lauch")]), (("Beet", "Tag"), [("1", "Montag")])]


def test_the_register_is_read_once_a_batch_and_no_data(spark, folder, monkeypatch):
    calls = []
    register = watch._Inbox.register
    monkeypatch.setattr(watch._Inbox, "register", lambda self: calls.append("register") or register(self))
    monkeypatch.setattr(Staged, "open", lambda *a, **b: calls.append("data"))
    for n in range(5):
        folder(f"in/empty{n}.csv", "")
    folder("in/a.csv", "Beet;Sorte\n1;Kohl\n")
    for _ in range(2):
        watch_folder(spark, folder.new("in"), folder.new("t"), folder.new("c"), PLANTS, once=True).awaitTermination()
    # at the two starts, and with the one batch that there is
    assert calls == ["register"] * 3
    monkeypatch.undo()
    found = watched(spark, folder.new("t"))
    assert found.rejected().count() == 5 and rows(found.accepted()) == [("1", "Kohl")]


def test_staged_tables_without_versions_are_compacted_too(spark, folder):
    folder("in/a.csv", "bed;kind\n1;Kohl\n")
    folder("in/b.csv", "Beet;Sorte\n2;Lauch\nrest\n")
    staged = ingest(spark, folder.new("in"), folder.new("t"), PLANTS, [ColumnMapping(0, "bed", "Integer")])
    data, bad, known = rows(staged.accepted()), rows(staged.rejected()), facts(staged)
    compact(spark, folder.new("t"))
    after = Staged.open(spark, folder.new("t"))
    assert (rows(after.accepted()), rows(after.rejected()), facts(after)) == (data, bad, known)
    assert data == [(1,), (2,)]


def test_versions(spark, folder):
    place = folder.new("v")
    assert current(spark, place) is None
    commit(spark, place, lambda v: v.with_parts(["0-a"]))
    commit(spark, place, lambda v: v.with_parts(["1-b-0", "1-b-1"]))
    # a repeated batch replaces its parts
    assert commit(spark, place, lambda v: v.with_parts(["1-c-0"])).parts == ("0-a", "1-c-0")
    with open(f"{place}/_state/0000000004.json", "w") as half:
        half.write('{"number": 4, "gen')
    assert current(spark, place).number == 3
    os.remove(f"{place}/_state/0000000004.json")
    for n in range(30):
        commit(spark, place, lambda v: v.with_parts([f"{n + 2}-x"]))
    assert len(current(spark, place).parts) == 32 and len(os.listdir(f"{place}/_state")) < 30
    assert Version(parts=("0-a", "again1-b", "1-c", "again2-d")).foldable() == ("0-a", "again1-b")
    assert Version(parts=("again1-b",)).foldable() == ("again1-b",)


def test_two_writers_lose_no_part(spark, folder):
    place = folder.new("v")
    writers = [threading.Thread(target=lambda k=k: [commit(spark, place, lambda v: v.with_parts([f"w{k}n{n}-x"])) for n in range(5)]) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(current(spark, place).parts) == sorted(f"w{k}n{n}-x" for k in range(3) for n in range(5))
