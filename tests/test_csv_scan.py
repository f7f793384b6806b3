import random

import pytest

from ticketflow.sources import cells, csv_scan


def scanned(spark, path, size=None):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size or "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return sorted((r.line_no, r.cells) for r in csv_scan.scan(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(400))
def test_states_agree_with_the_sequential_parser(seed):
    """Lines that end a record are the ones after which the parser has one row more."""
    rng = random.Random(seed)
    text = "".join(rng.choice(['"', '""', "\\", ",", "\n", "\n", "a", "b ", '"x"', '\\"']) for _ in range(rng.randrange(30)))
    lines = [x.removesuffix("\n") for x in cells._lines(text)]
    state, ends = csv_scan.RECORD, []
    for x in lines:
        state = csv_scan.after(x, state)
        ends.append(state == csv_scan.RECORD)
    at, records = 0, []
    for i, e in enumerate(ends):
        if e or i + 1 == len(ends):
            records.append("\n".join(lines[at : i + 1]))
            at = i + 1
    want = [c for _, c in cells.csv_cells(text)]
    assert [next(csv_scan.csv.reader([r], escapechar="\\"), None) or [""] for r in records] == want


@pytest.mark.parametrize("seed, size", [(1, 7), (2, 16), (3, 64), (4, 1000)])
def test_any_blocks_equal_the_sequential_parser(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    pick = ['"', '""', "\\", ",", ",", "\n", "\n", "\r\n", "\r", "a", "é", '"x, y"', '"two\nlines"', '\\"', "\n\n", '"a\\\nb"', "z" * 20]
    for k in range(4):
        text = "﻿" * (k == 0) + "".join(rng.choice(pick) for _ in range(rng.randrange(5, 12 * size if size < 100 else 900)))
        p = tmp_path / f"{k}.csv"
        p.write_bytes(text.encode())
        assert scanned(spark, str(p), str(max(size, len(text.encode()) // 40))) == list(cells.csv_cells(text.removeprefix("﻿")))


def test_long_cells_and_long_records(spark, tmp_path):
    long = "x" * 200_000
    wide = "line\n" * 1_000_000  # one quoted cell of 5 MB in a million lines
    text = f'a,b\n{long},1\n"{wide}",2\nlast,"{long}\n"\n'
    p = tmp_path / "a.csv"
    p.write_text(text)
    want = [["a", "b"], [long, "1"], [wide, "2"], ["last", long + "\n"]]
    assert [c for _, c in cells.csv_cells(text)] == want
    assert scanned(spark, str(p), "300000") == list(enumerate(want, 1))
    assert [c for _, c in sorted((r.line_no, r.cells) for r in cells.read_cells(spark, str(p), large=1_000).collect())] == want


def test_several_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("é,1\nb,2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('x,"1\n2"\n'.encode())
    (tmp_path / "c.csv").write_bytes("k,é\n".encode("utf-16"))
    (tmp_path / "d.tsv").write_bytes(b"t\tu\n")
    (tmp_path / "e.csv").write_bytes(b"")
    got = {(r.path.rsplit("/", 1)[1], r.line_no, tuple(r.cells)) for r in cells.read_cells(spark, str(tmp_path), large=1).collect()}
    assert got == {("a.csv", 1, ("é", "1")), ("a.csv", 2, ("b", "2")), ("b.csv", 1, ("x", "1\n2")), ("c.csv", 1, ("k", "é")), ("d.tsv", 1, ("t", "u"))}
    assert got == {(r.path.rsplit("/", 1)[1], r.line_no, tuple(r.cells)) for r in cells.read_cells(spark, str(tmp_path)).collect()}


def test_the_plan_reads_one_file_in_many_tasks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("".join(f"{i},v\n" for i in range(5_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert csv_scan.scan(spark, str(p)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert scanned(spark, str(p), "4000") == [(i + 1, [str(i), "v"]) for i in range(5_000)]
