import json
import random

import pytest

from ticketflow.sources import cells, json_scan


def scanned(spark, path, size=None):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size or "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return sorted((r.line_no, r.cells) for r in json_scan.scan(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, deep=0):
    kind = rng.randrange(9 if deep < 4 else 6)
    if kind < 4:
        return "".join(rng.choice(['"', "\\", "{", "}", "}}", "[", ",", ":", "é", "\n", "a", "\\\\"]) for _ in range(rng.randrange(8)))
    if kind < 6:
        return rng.choice([None, True, 0, -1.5, 10**20])
    if kind == 6:
        return [value(rng, deep + 1) for _ in range(rng.randrange(3))]
    return {rng.choice("abc}{") + str(k): value(rng, deep + 1) for k in range(rng.randrange(3))}


def made(rng, n):
    rows = [{k: value(rng) for k in rng.sample(["id", "te}xt", 'q"', "k\\"], rng.randrange(1, 5))} for _ in range(n)]
    shown = [json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for r in rows]
    return rng.choice(["[", " [\n", ""]) + "".join(x + rng.choice([",", ",\n", "\n", "", "\r\n , "]) for x in shown) + rng.choice(["]", "]\n", "", "\n"])


@pytest.mark.parametrize("seed", range(60))
def test_what_runs_tell_joins_at_every_byte_behind_a_brace(seed):
    rng = random.Random(seed)
    signs = made(rng, rng.randrange(1, 6)).encode()
    cuts = [i + 1 for i, b in enumerate(signs) if b == ord("}")]
    whole = json_scan._told(json_scan._braces(signs), 0)
    for cut in cuts:
        a = json_scan._told(json_scan._braces(signs[:cut]), 0)
        b = json_scan._told(json_scan._braces(signs[cut:]), a[0])
        assert json_scan.joined(a, b) == whole
    assert whole[:3] == (0, 0, 0) and whole[3] == max(n for n, _ in cells.json_cells(signs.decode()))


@pytest.mark.parametrize("size", [1, 7, 40])
def test_any_blocks_equal_the_sequential_parser(spark, tmp_path, size):
    rng = random.Random(size)
    for k in range(2):
        text = "﻿" * (k == 0) + made(rng, 3 if size == 1 else 12)
        data = text.encode()
        p = tmp_path / f"{k}.json"
        p.write_bytes(data)
        assert scanned(spark, str(p), str(max(size, len(data) // 24))) == list(cells.json_cells(text.removeprefix("﻿")))


def test_long_values_and_objects_over_many_blocks(spark, tmp_path):
    rows = [{"a": 1}, {"a": "x" * 400_000}, {"a": "}" * 50_000}, {"a": [{"b": i} for i in range(20_000)]}, {"a": "last"}]
    text = json.dumps(rows, separators=(",", ":"))
    p = tmp_path / "a.json"
    p.write_text(text)
    assert scanned(spark, str(p), "30000") == list(cells.json_cells(text))
    assert sorted((r.line_no, r.cells) for r in cells.read_cells(spark, str(p), large=1_000).collect()) == list(cells.json_cells(text))


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2', '[{"a":1}, }, {"a":2}]', '{"a":1} 5 {"a":2}', '{"a":1}{"a":"x}', '[{"a":1},{"a":"\\}"}]', '{"a":1}]x', '{"a":1} "}" ', "[1]", '{"a":1}}', '{"a":1}}}{{'])
@pytest.mark.parametrize("size", ["4", "1000"])
def test_errors_of_the_sequential_parser_are_errors(spark, tmp_path, text, size):
    with pytest.raises(ValueError):
        list(cells.json_cells(text))
    p = tmp_path / "a.json"
    p.write_text(text)
    with pytest.raises(Exception, match="Error"):
        scanned(spark, str(p), size)


def test_files_without_objects_several_files_and_encodings(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('[{"é":"ü}"},{"é":null}]'.encode("latin-1"))
    (tmp_path / "b.json").write_bytes(b"[]\n")
    (tmp_path / "c.json").write_bytes('{"k":{"z":[1,2]}}'.encode("utf-16"))
    (tmp_path / "d.json").write_bytes(b"")
    (tmp_path / "e.json").write_bytes(b'{}{"a":1}')
    (tmp_path / "f.csv").write_bytes(b"x,y\n")
    want = {("a.json", 0, ("é",)), ("a.json", 1, ("ü}",)), ("a.json", 2, ("",)), ("c.json", 0, ("k",)), ("c.json", 1, ('{"z":[1,2]}',)), ("e.json", 0, ()), ("e.json", 1, ()), ("e.json", 2, ()), ("f.csv", 1, ("x", "y"))}
    for large in (1, 1 << 20):
        got = [(r.path.rsplit("/", 1)[1], r.line_no, tuple(r.cells)) for r in cells.read_cells(spark, str(tmp_path), large=large).collect()]
        assert len(got) == len(want) and set(got) == want
