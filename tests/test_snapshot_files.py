import gzip
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vacantia.plans.curate import standardised
from vacantia.sources import file_ledger, snapshot_format, snapshots
from vacantia.streaming import ingest

WEEKS = [f"vacancies_2024-12-{day:02d}.txt.gz" for day in (6, 13, 20)]


def dated(n, word="x"):
    return [f"{i} {word} Fecha de Publicación 01/12/2024" for i in range(n)]


def put(folder, name, lines, parts=1):
    size = -(-len(lines) // parts) or 1
    members = [lines[i : i + size] for i in range(0, len(lines), size)] or [[]]
    data = b"".join(gzip.compress("".join(f"{x}\n" for x in m).encode()) for m in members)
    (folder / name).write_bytes(data)
    return data


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    return folder


def found(table):
    return sorted((r.source_file, r.line_no, r.raw) for r in table.collect())


def numbered(name, lines):
    return [(name, i, line) for i, line in enumerate(lines, 1)]


@pytest.mark.parametrize("batch", [3, 8192])
def test_lines_of_files_with_many_members(spark, drop, monkeypatch, batch):
    monkeypatch.setattr(snapshot_format, "BATCH_LINES", batch)
    monkeypatch.setattr(snapshot_format, "TASK_BYTES", 300)
    lines = dated(50, "é") + ["", "last"]
    put(drop, WEEKS[0], lines, parts=7)
    put(drop, WEEKS[1], dated(4))
    put(drop, WEEKS[2], [])
    put(drop, "other.txt.gz", ["no snapshot"])
    (drop / "vacancies_folder.txt.gz").mkdir()
    expected = numbered(WEEKS[0], lines) + numbered(WEEKS[1], dated(4))
    assert found(snapshot_format.read_snapshot_files(spark, str(drop))) == sorted(expected)
    only = snapshot_format.read_snapshot_files(spark, str(drop), glob="*-13.txt.gz")
    assert found(only) == numbered(WEEKS[1], dated(4))


def test_same_as_the_text_reader(spark, drop):
    put(drop, WEEKS[0], dated(30) + ["with\rreturn", "two\r"], parts=2)
    assert found(snapshot_format.read_snapshot_files(spark, str(drop))) == found(
        snapshots.scan_snapshots(spark, str(drop))
    )


@pytest.mark.parametrize("kind", ["cut", "flipped", "text", "second member cut"])
def test_damaged_files_are_an_error_or_left_out_whole(spark, drop, kind):
    put(drop, WEEKS[0], dated(20))
    data = put(drop, WEEKS[1], dated(5000), parts=1 + (kind == "second member cut"))
    broken = {
        "cut": data[: len(data) // 2],
        "flipped": data[:-6] + bytes([data[-6] ^ 1]) + data[-5:],
        "text": b"not gzip",
        "second member cut": data[:-9],
    }[kind]
    (drop / WEEKS[1]).write_bytes(broken)
    whole = snapshot_format.read_snapshot_files(spark, str(drop), skip_damaged=True)
    assert found(whole) == numbered(WEEKS[0], dated(20))
    with pytest.raises(Exception):
        snapshot_format.read_snapshot_files(spark, str(drop)).collect()


def test_an_empty_folder(spark, drop):
    assert snapshot_format.read_snapshot_files(spark, str(drop)).count() == 0


def test_written_files_are_read_back(spark, drop, make_lines):
    files = {WEEKS[0]: ["a\nb", "c"], WEEKS[1]: dated(200)}
    snapshot_format.write_snapshot_files(make_lines(files, partitions=6), str(drop))
    flat = numbered(WEEKS[0], ["a b", "c"]) + numbered(WEEKS[1], dated(200))
    assert found(snapshot_format.read_snapshot_files(spark, str(drop))) == flat
    assert sorted(os.listdir(drop)) == WEEKS[:2]
    with pytest.raises(Exception):
        snapshot_format.write_snapshot_files(make_lines({WEEKS[0]: ["new"]}), str(drop))
    assert found(snapshot_format.read_snapshot_files(spark, str(drop))) == flat
    snapshot_format.write_snapshot_files(make_lines({WEEKS[2]: ["new"]}), str(drop), mode="overwrite")
    assert sorted(os.listdir(drop)) == WEEKS[2:]


def test_stream_takes_each_file_once_whenever_it_was_changed(spark, drop, tmp_path):
    target, checkpoint = str(tmp_path / "target"), str(tmp_path / "checkpoint")

    def run():
        ingest.stream_ingest_files(spark, str(drop), target, checkpoint).awaitTermination()

    put(drop, WEEKS[1], dated(12))
    put(drop, WEEKS[2], dated(3))
    run()
    data = put(drop, WEEKS[0], dated(15))
    os.utime(drop / WEEKS[0], (1, 1))  # arrives late, with an old time
    (drop / "vacancies_cut.txt.gz").write_bytes(data[:-20])
    run()
    run()
    lines = snapshot_format.read_snapshot_files(spark, str(drop), skip_damaged=True)
    valid = snapshots.valid_lines(lines, snapshots.raw_gate(lines))
    columns = ("source_file", "line_no", "text")
    expected = sorted(tuple(r) for r in standardised(valid).select(*columns).collect())
    stored = ingest.read_ingested(spark, target).select(*columns).collect()
    assert sorted(tuple(r) for r in stored) == expected
    assert len(expected) == 27


def test_the_source_needs_no_package_where_it_is_planned(tmp_path):
    with snapshot_format.by_value():
        sent = cloudpickle.dumps(snapshot_format.SnapshotSource)
    code = (
        "import sys; from pyspark import cloudpickle; kind = cloudpickle.loads(sys.stdin.buffer.read()); "
        "kind({'path': '/', 'seen': '/tmp'}).streamReader(None); assert 'vacantia' not in sys.modules"
    )
    subprocess.run([sys.executable, "-c", code], input=sent, cwd=tmp_path, check=True)


# --- the ledger ---


def manifest(spark, drop, ledger):
    rows = file_ledger.read_ledger(spark, ledger)
    table = snapshots.snapshot_manifest(
        file_ledger.listed_files(spark, str(drop)), file_ledger.ledger_gate(rows),
        damaged=rows.filter("damaged"),
    )
    return {r.source_file: (r.status, r.reason) for r in table.collect()}


def changes(table):
    return {r.source_file: r.change for r in table.collect()}


def test_a_second_run_opens_only_what_changed(spark, drop, tmp_path):
    ledger = str(tmp_path / "ledger")
    data = put(drop, WEEKS[0], dated(12))
    put(drop, WEEKS[1], dated(3))
    (drop / WEEKS[2]).write_bytes(data[:-5])
    put(drop, "vacancies_empty.txt.gz", [])
    first = file_ledger.update_ledger(spark, str(drop), ledger)
    assert set(changes(first).values()) == {"new"} and first.count() == 4
    assert manifest(spark, drop, ledger) == {
        WEEKS[0]: ("valid", None),
        WEEKS[1]: ("discarded", "too few lines"),
        WEEKS[2]: ("discarded", "damaged"),
        "vacancies_empty.txt.gz": ("discarded", "no readable line"),
    }
    # Content of the same length and time: if a file were opened, its row would change.
    for path in drop.iterdir():
        times = os.stat(path)
        path.write_bytes(b"?" * times.st_size)
        os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert file_ledger.update_ledger(spark, str(drop), ledger).count() == 0
    assert manifest(spark, drop, ledger)[WEEKS[0]] == ("valid", None)


def test_changed_and_touched_files(spark, drop, tmp_path):
    ledger = str(tmp_path / "ledger")
    for name in WEEKS:
        put(drop, name, dated(12))
    file_ledger.update_ledger(spark, str(drop), ledger)
    put(drop, WEEKS[0], dated(12) + ["no date"])
    os.utime(drop / WEEKS[1], (5, 5))
    put(drop, "vacancies_new.txt.gz", ["no date"] * 10)
    (drop / WEEKS[2]).unlink()
    again = file_ledger.update_ledger(spark, str(drop), ledger)
    assert changes(again) == {
        WEEKS[0]: "changed", WEEKS[1]: "touched", "vacancies_new.txt.gz": "new"
    }
    assert manifest(spark, drop, ledger) == {
        WEEKS[0]: ("valid", None), WEEKS[1]: ("valid", None),
        "vacancies_new.txt.gz": ("discarded", "line without date"),
    }
    lines = {r.source_file: r.lines for r in file_ledger.read_ledger(spark, ledger).collect()}
    assert lines[WEEKS[0]] == 13 and lines[WEEKS[2]] == 12
    old = {r.source_file: r.lines for r in file_ledger.read_ledger(spark, ledger, version=1).collect()}
    assert old[WEEKS[0]] == 12 and len(old) == 3


def test_gate_of_the_ledger_is_the_gate_of_the_lines(spark, drop, tmp_path):
    put(drop, WEEKS[0], dated(9) + ["01/02/2024 \x85", *dated(3)])
    put(drop, WEEKS[1], dated(9))
    put(drop, WEEKS[2], dated(5) + ["no"] + dated(9))
    file_ledger.update_ledger(spark, str(drop), str(tmp_path / "ledger"))
    gate = file_ledger.ledger_gate(file_ledger.read_ledger(spark, str(tmp_path / "ledger")))
    lines = snapshot_format.read_snapshot_files(spark, str(drop))
    assert sorted(map(tuple, gate.collect())) == sorted(map(tuple, snapshots.raw_gate(lines).collect()))


def test_dates_of_valid_files(spark):
    rows = [(WEEKS[0], "valid"), (WEEKS[1], "discarded"), ("vacancies_a.txt.gz", "valid")]
    table = spark.createDataFrame(rows, "source_file string, status string")
    assert [str(r[0]) for r in file_ledger.processed_dates(table).collect()] == ["2024-12-06"]


def test_an_empty_folder_has_an_empty_ledger(spark, drop, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert file_ledger.update_ledger(spark, str(drop), ledger).count() == 0
    assert file_ledger.read_ledger(spark, ledger).count() == 0
    assert manifest(spark, drop, ledger) == {}
    assert file_ledger.ledger_gate(file_ledger.read_ledger(spark, ledger)).agg(F.count("*")).first()[0] == 0
