import gzip

import pytest

from vacantia.sources import cards, snapshots

DATED = [f"{i} texto Fecha de Publicación 0{i % 9 + 1}/12/2024" for i in range(30)]


def write_gzip(folder, name, lines, cut=None):
    data = gzip.compress("".join(f"{line}\n" for line in lines).encode())
    (folder / name).write_bytes(data[:cut] if cut else data)


@pytest.fixture
def drop_folder(tmp_path):
    write_gzip(tmp_path, "vacancies_2024-12-06.txt.gz", DATED)
    write_gzip(tmp_path, "vacancies_ten.txt.gz", DATED[:10])
    write_gzip(tmp_path, "vacancies_nine.txt.gz", DATED[:9])
    write_gzip(tmp_path, "vacancies_padded.txt.gz", [f"  {line} \t" for line in DATED[:12]])
    write_gzip(tmp_path, "vacancies_late.txt.gz", [*DATED[:10], "sin fecha"])
    write_gzip(tmp_path, "vacancies_bad.txt.gz", [*DATED[:5], "sin fecha", *DATED[5:]])
    write_gzip(tmp_path, "vacancies_empty.txt.gz", [])
    write_gzip(tmp_path, "other_2024.txt.gz", DATED)
    (tmp_path / "vacancies_broken.txt.gz").write_bytes(b"not a gzip file")
    return tmp_path


def test_scan_numbers_the_lines_of_each_file(spark, drop_folder):
    rows = snapshots.scan_snapshots(spark, str(drop_folder), skip_damaged=True).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.source_file, {})[r.line_no] = r.raw
    assert by_file["vacancies_2024-12-06.txt.gz"] == dict(enumerate(DATED, 1))
    assert by_file["vacancies_nine.txt.gz"] == dict(enumerate(DATED[:9], 1))
    assert "other_2024.txt.gz" not in by_file


def test_line_numbers_survive_filters_and_files_sharing_a_task(spark, tmp_path):
    for k in range(25):
        write_gzip(tmp_path, f"vacancies_{k:02d}.txt.gz", [f"{k}-{i}" for i in range(1, 8 + k)])
    lines = snapshots.scan_snapshots(spark, str(tmp_path)).filter("raw like '%-5'")
    assert {(r.line_no, r.raw) for r in lines.collect()} == {(5, f"{k}-5") for k in range(25)}


def test_damaged_file_is_an_error_unless_skipped(spark, drop_folder):
    with pytest.raises(Exception):
        snapshots.scan_snapshots(spark, str(drop_folder)).collect()


def test_truncated_file_yields_no_line(spark, tmp_path):
    lines = [f"{i * 7919} {hash((i, 'x'))} Fecha de Publicación 01/12/2024" for i in range(20000)]
    size = len(gzip.compress("".join(f"{x}\n" for x in lines).encode()))
    write_gzip(tmp_path, "vacancies_cut.txt.gz", lines, cut=size // 2)
    assert snapshots.scan_snapshots(spark, str(tmp_path), skip_damaged=True).count() == 0
    write_gzip(tmp_path, "vacancies_whole.txt.gz", lines)
    two_members = gzip.compress(b"a\n") + gzip.compress(b"b\n" * 300_000)
    (tmp_path / "vacancies_two.txt.gz").write_bytes(two_members)
    with pytest.raises(Exception):
        snapshots.scan_snapshots(spark, str(tmp_path)).collect()
    scanned = snapshots.scan_snapshots(spark, str(tmp_path), skip_damaged=True)
    found = {r.source_file: r["count"] for r in scanned.groupBy("source_file").count().collect()}
    assert found == {"vacancies_whole.txt.gz": 20000, "vacancies_two.txt.gz": 300_001}
    damaged = snapshots.damaged_snapshots(spark, str(tmp_path))
    assert [r.source_file for r in damaged.collect()] == ["vacancies_cut.txt.gz"]


def test_damaged_part_discards_its_whole_snapshot(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / f"source_file=vacancies_{name}.txt.gz"
        folder.mkdir()
        write_gzip(folder, "part-0.txt.gz", DATED)
        write_gzip(folder, "part-1.txt.gz", DATED, cut=60 if name == "b" else None)
    with pytest.raises(Exception):
        snapshots.scan_snapshots(spark, str(tmp_path), partitioned=True).collect()
    scanned = snapshots.scan_snapshots(spark, str(tmp_path), partitioned=True, skip_damaged=True)
    assert {(r.source_file, r.line_no) for r in scanned.collect()} == {
        ("vacancies_a.txt.gz", i) for i in range(1, 61)
    }


def test_parts_of_a_snapshot_stay_in_one_batch(spark, tmp_path):
    with pytest.raises(ValueError, match="split snapshots"):
        snapshots.stream_snapshots(spark, str(tmp_path), partitioned=True, files_per_batch=1)


def test_nested_cards_are_whole(spark):
    start = '<div class="results-card-container">'
    page = (
        f"<body>{start}<div>Dev</div><div><div>$1</div> x</div> Fecha 1</div><p>between</p>"
        f"{start}plain</div>{start}<divider>open</divider> to the end"
    )
    table = spark.createDataFrame([(1, page), (2, "none"), (3, None)], "page_id int, html string")
    found = {(r.page_id, r.position): r.card for r in cards.page_cards(table).collect()}
    assert found == {(1, 0): "Dev$1 x Fecha 1", (1, 1): "plain", (1, 2): "open to the end"}


def test_manifest_says_why(spark, drop_folder):
    lines = snapshots.scan_snapshots(spark, str(drop_folder), skip_damaged=True)
    manifest = snapshots.snapshot_manifest(
        snapshots.list_snapshots(spark, str(drop_folder)),
        snapshots.raw_gate(lines),
        damaged=snapshots.damaged_snapshots(spark, str(drop_folder)),
    )
    found = {r.source_file[10:-7]: (r.status, r.reason) for r in manifest.collect()}
    assert found == {
        "2024-12-06": ("valid", None),
        "ten": ("valid", None),
        "padded": ("valid", None),
        "late": ("valid", None),
        "nine": ("discarded", "too few lines"),
        "bad": ("discarded", "line without date"),
        "empty": ("discarded", "no readable line"),
        "broken": ("discarded", "damaged"),
    }


def test_only_lines_of_valid_files_stay(make_lines):
    lines = make_lines({"good": DATED, "short": DATED[:9]})
    kept = snapshots.valid_lines(lines, snapshots.raw_gate(lines))
    assert kept.count() == 30 and {r.source_file for r in kept.collect()} == {"good"}


def test_empty_folder_gives_no_lines(spark, tmp_path):
    (tmp_path / "readme.md").write_text("x")
    assert snapshots.scan_snapshots(spark, str(tmp_path)).count() == 0


def test_written_snapshots_read_back_the_same(make_lines, spark, tmp_path):
    files = {"hot": [f"línea {i}" for i in range(500)], "b": ["una", "dos\nlíneas\r"], "c": ["x"]}
    lines = make_lines(files, partitions=7)
    snapshots.write_snapshots(lines, str(tmp_path / "out"), partitions=6)
    assert len(list((tmp_path / "out" / "source_file=hot").glob("*.txt.gz"))) > 1
    found = snapshots.scan_snapshots(spark, str(tmp_path / "out"), partitioned=True)
    expected = {
        (name, i, raw.replace("\n", " ").replace("\r", " "))
        for name, raws in files.items()
        for i, raw in enumerate(raws, 1)
    }
    assert {tuple(r) for r in found.collect()} == expected


def test_small_batches_are_skipped(make_lines):
    lines = make_lines({"large": ["x"] * 12, "exact": ["x"] * 10, "small": ["x"] * 9})
    kept = snapshots.batch_size_gate(lines, 10)
    assert {r.source_file for r in kept.collect()} == {"large", "exact"} and kept.count() == 22


HTML = """<div class="results-card-container"><b>Uno</b>
dos</div><p>no</p><div class="results-card-container">tres</div>
<div class="results-card-container">tres</div>"""


def test_cards_of_pages(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "nada")], "page_id bigint, html string")
    found = cards.page_cards(pages)
    assert [tuple(r) for r in found.orderBy("position").collect()] == [
        (1, 0, "Uno\ndos"), (1, 1, "tres"), (1, 2, "tres"),
    ]
    assert cards.flatten_cards(found).filter("position = 0").first().card == "Uno dos"
    assert tuple(cards.card_report(found).first()) == (3, 2)
    assert cards.distinct_cards(found).count() == 2


def test_coverage_of_printed_totals(spark):
    rows = [(50, "12,345"), (5, None), (5, "many"), (5, "0")]
    runs = spark.createDataFrame(rows, "scraped bigint, total_text string")
    found = [r.percent for r in cards.scrape_coverage(runs).collect()]
    assert found == [0.405, None, None, None]
