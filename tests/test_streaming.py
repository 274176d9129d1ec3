import gzip
import os

import pytest

from vacantia import scratch
from vacantia.operators.calendar import listings_per_date, with_publication_date
from vacantia.operators.dedup import first_per_code, with_code
from vacantia.plans.curate import standardised
from vacantia.sources import snapshots
from vacantia.streaming import ingest

FILES = {
    f"vacancies_2024-12-{day:02d}.txt.gz": [
        f"{100 + (i * step) % 40} $1.000 - $2.000 texto {day} {i} Fecha de Publicación {i % 9 + 1:02d}/12/2024"
        for i in range(size)
    ]
    for day, step, size in ((6, 1, 30), (13, 3, 25), (20, 7, 40), (27, 5, 9))
}
ORDERS = [sorted(FILES), sorted(FILES, reverse=True)]


def write(folder, name):
    (folder / name).write_bytes(gzip.compress("".join(f"{x}\n" for x in FILES[name]).encode()))


@pytest.fixture
def paths(tmp_path):
    (tmp_path / "drop").mkdir()
    return tmp_path / "drop", str(tmp_path / "target"), str(tmp_path / "checkpoint")


def run(spark, start, paths, **layout):
    drop, target, checkpoint = paths
    start(spark, str(drop), target, checkpoint, **layout).awaitTermination()


def valid_batch_lines(spark, drop):
    lines = snapshots.scan_snapshots(spark, str(drop))
    return snapshots.valid_lines(lines, snapshots.raw_gate(lines))


def rows(table, *columns):
    return sorted(tuple(r) for r in table.select(*columns).collect())


def test_file_at_a_time_equals_the_batch(spark, paths):
    for name in ORDERS[0]:
        write(paths[0], name)
        run(spark, ingest.stream_ingest, paths)
    run(spark, ingest.stream_ingest, paths)  # nothing new
    columns = ("source_file", "line_no", "wage_info", "text")
    expected = rows(standardised(valid_batch_lines(spark, paths[0])), *columns)
    assert rows(ingest.read_ingested(spark, paths[1]), *columns) == expected
    assert len(expected) == 95


def test_a_repeated_batch_adds_nothing(spark, paths):
    for name in FILES:
        write(paths[0], name)
    run(spark, ingest.stream_ingest, paths)
    before = ingest.read_ingested(spark, paths[1]).count()
    part_lines = snapshots.with_part_lines(
        snapshots._snapshot_files(spark.read, str(paths[0]), partitioned=False)
    )
    ingest.ingest_batch(part_lines, 0, paths[1])
    assert ingest.read_ingested(spark, paths[1]).count() == before


@pytest.mark.parametrize("order", ORDERS, ids=["in order", "late files"])
def test_dedup_over_batches_equals_the_batch_result(spark, paths, order):
    for name in order:
        write(paths[0], name)
        run(spark, ingest.stream_dedup, paths, files_per_batch=1)
    curated = ingest.curated(spark, paths[1])
    expected = with_publication_date(first_per_code(with_code(valid_batch_lines(spark, paths[0]))))
    columns = ("code", "source_file", "line_no", "raw", "pub_date")
    assert rows(curated, *columns) == rows(expected, *columns)
    assert listings_per_date(curated).collect() == listings_per_date(expected).collect()


def test_a_restart_adds_nothing(spark, paths):
    for name in FILES:
        write(paths[0], name)
    run(spark, ingest.stream_dedup, paths)
    stored = rows(spark.read.parquet(paths[1]), "code", "source_file", "line_no", "batch_id")
    run(spark, ingest.stream_dedup, paths)
    assert rows(spark.read.parquet(paths[1]), "code", "source_file", "line_no", "batch_id") == stored
    part_lines = snapshots.with_part_lines(
        snapshots._snapshot_files(spark.read, str(paths[0]), partitioned=False)
    )
    ingest.dedup_batch(part_lines, 0, paths[1])
    assert rows(spark.read.parquet(paths[1]), "code", "source_file", "line_no", "batch_id") == stored


def test_a_batch_reads_only_the_blocks_of_its_codes(spark, paths):
    for name in ORDERS[0][:2]:
        write(paths[0], name)
        run(spark, ingest.stream_dedup, paths, files_per_batch=1, block_digits=1)
    new = spark.createDataFrame([("101",), ("123",), ("1234",), ("7",)], "code string")
    blocks = new.select(ingest.code_block(new["code"], 1).alias("block"))
    seen = ingest.stored_positions(spark, paths[1], 5, ingest._blocks_of(blocks))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "block" in scan.split("PartitionFilters")[1]
    assert "raw" not in scan.split("ReadSchema")[1]
    files = {row[0] for row in seen.select("_metadata.file_path").distinct().collect()}
    assert {path.split("block=")[1].split("/")[0] for path in files} == {"3-10", "3-12"}
    assert {row.code[:2] for row in seen.collect()} == {"10", "12"}


def test_many_blocks_are_given_as_a_range(spark, paths, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_BLOCKS", 2)
    for name in ORDERS[1]:
        write(paths[0], name)
        run(spark, ingest.stream_dedup, paths, files_per_batch=1, block_digits=1)
    expected = first_per_code(with_code(valid_batch_lines(spark, paths[0])))
    columns = ("code", "source_file", "line_no", "raw")
    assert rows(ingest.curated(spark, paths[1]), *columns) == rows(expected, *columns)


def test_codes_of_any_length_have_a_block(spark):
    codes = ["1", "999999", "1000000", "0001234567", "9" * 40]
    table = spark.createDataFrame([(c,) for c in codes], "code string")
    found = [r[0] for r in table.select(ingest.code_block(table["code"])).collect()]
    assert found == ["1-", "6-", "7-1", "10-0001", f"40-{'9' * 34}"]


def test_batches_leave_no_intermediate_table(spark, paths):
    before = set(os.listdir(scratch._own_folder(spark)))
    for start in (ingest.stream_ingest, ingest.stream_dedup):
        for name in ORDERS[0][:2]:
            write(paths[0], name)
        run(spark, start, (paths[0], f"{paths[1]}-{start.__name__}", f"{paths[2]}-{start.__name__}"))
    assert set(os.listdir(scratch._own_folder(spark))) == before


def test_scopes_nest_and_free_after_errors(spark):
    def folders():
        return set(os.listdir(scratch._own_folder(spark)))

    before = folders()
    outer = None
    with pytest.raises(RuntimeError), scratch.scope(spark):
        outer = scratch.stage(spark.range(3), "outer")
        with scratch.scope(spark):
            assert scratch.stage(spark.range(2), "inner").count() == 2
        assert outer.count() == 3 and len(folders() - before) == 1
        raise RuntimeError
    assert folders() == before
    kept = scratch.stage(spark.range(4), "kept")
    assert kept.count() == 4 and len(folders() - before) == 1


def test_a_batch_without_a_valid_file_stores_nothing(spark, paths):
    (paths[0] / "vacancies_2024-12-06.txt.gz").write_bytes(gzip.compress(b"1 no date\n" * 20))
    run(spark, ingest.stream_dedup, paths)
    assert spark.read.schema(ingest.STORED).parquet(paths[1]).count() == 0
    write(paths[0], "vacancies_2024-12-13.txt.gz")
    run(spark, ingest.stream_dedup, paths)
    assert ingest.curated(spark, paths[1]).count() == 25
