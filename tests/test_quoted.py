"""Records cut block by block against Spark's own reader, which gives a file to one task."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burnish.sources import delimited, quoted
from workload import files

ODD = [
    'plain,x,y', '5" disc,"two\nlines","say ""hi"""', '"",,""', ',,', '"a ""b""\n\n"",c",2,"x"', 'short', '"""",q"q,""""""',
    '"late"tail,1,2', '"a,""\n""",b"",c"', 'é,"ü\né",z', 'x,"y"" z\r\nw",1', "it's,5'2\",6\"", '""" x\ny",2,3',
]


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks that files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        for name, value in zip(names, (str(size), "1"), strict=True):
            spark.conf.set(name, value)

    yield put
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def tables(spark, path, blocks, size, sep=",", encoding="UTF-8"):
    blocks(1 << 30)
    whole = delimited.read_delimited(spark, path, sep, encoding, multi_line=True, by_blocks=False, null_tokens=None, on_long_rows="cut")
    want = sorted(map(tuple, whole.collect()), key=str)
    blocks(size)
    cut = delimited.read_delimited(spark, path, sep, encoding, multi_line=True, by_blocks=True, null_tokens=None, on_long_rows="cut")
    return want, sorted(map(tuple, cut.collect()), key=str), cut


@pytest.mark.parametrize("size", [25, 150, 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_are_those_of_one_task(spark, tmp_path, blocks, size, end):
    draw = random.Random(size)
    rows = [draw.choice(ODD) for _ in range(60)] + ["", "", "last,one,row"]
    (tmp_path / "a.csv").write_bytes(end.join(["a,b,c", *rows]).encode())
    (tmp_path / "b.csv").write_bytes(end.join(["a,b,c", *ODD, ""]).encode())
    want, got, _ = tables(spark, str(tmp_path), blocks, size)
    assert got == want and len(got) > 60


def test_many_tasks_despite_a_stray_quote(spark, tmp_path, blocks):
    lines = ["id,size,note"] + [f'{i},12" wide,"n{i}' + ('\nmore"' if i % 7 == 0 else '"') for i in range(4000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    want, got, cut = tables(spark, str(tmp_path / "a.csv"), blocks, 5000)
    assert got == want and len(got) == 4000
    parts = cut.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 1000


def test_encodings_marks_and_headers(spark, tmp_path, blocks):
    (tmp_path / "latin.csv").write_bytes('a;b;c\n"Jörg\né";2;3\n'.encode("latin1") * 1)
    want, got, _ = tables(spark, str(tmp_path / "latin.csv"), blocks, 9, ";", "ISO-8859-1")
    assert got == want == [("Jörg\né", "2", "3")]
    (tmp_path / "bom.csv").write_bytes(b'\xef\xbb\xbf\n"a\nb",,b\n1,"2\n2",3\n')
    blocks(6)
    table = delimited.read_delimited(spark, str(tmp_path / "bom.csv"), ",", "UTF-8", multi_line=True, by_blocks=True)
    assert table.columns == ["a\nb", "Unnamed: 1", "b"] and [tuple(r) for r in table.collect()] == [("1", "2\n2", "3")]


def test_headers_in_two_orders(spark, tmp_path, blocks):
    (tmp_path / "a.csv").write_text('x,,y\n1,2,"3\n"\n')
    (tmp_path / "b.csv").write_text('y,,x\n"30\n",20,10\n')
    blocks(5)
    rows = delimited.read_delimited(spark, str(tmp_path), ",", "UTF-8", multi_line=True, by_blocks=True).select("x", "y").collect()
    assert sorted(map(tuple, rows)) == [("1", "3\n"), ("10", "30\n")]


def test_long_rows_and_open_fields(spark, tmp_path, blocks):
    (tmp_path / "long.csv").write_text('a,b\n1,"2\n3"\n1,2,3\n')
    blocks(6)
    with pytest.raises(Exception, match="more than 2 cells"):
        delimited.read_delimited(spark, str(tmp_path / "long.csv"), ",", "UTF-8", multi_line=True, by_blocks=True).collect()
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"never\nclosed\n4,5\n')
    want, got, _ = tables(spark, str(tmp_path / "open.csv"), blocks, 6)
    assert [r[0] for r in got] == [r[0] for r in want] == ["1", "3"] and got[1][1].startswith("never\nclosed\n4,5")
    (tmp_path / "none.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path / "none.csv"), ",", "UTF-8", multi_line=True, by_blocks=True).columns == []


def test_states_along_a_file(spark):
    """Blocks that settle, keep and turn the state, against a walk from the start."""
    draw = random.Random(4)
    ends = [(f, s, draw.random() < 0.5, draw.random() < 0.5, f == 2 and s == 0) for f in range(6) for s in range(0, 400, 10)]
    want, inside = {}, False
    for f, s, out, within, _ in ends:
        inside = inside if s else False
        want[f, s] = inside
        inside = within if inside else out
    frame = spark.createDataFrame(ends, "file long, start long, after_out boolean, after_in boolean, returns boolean")
    assert {r.file for r in quoted.block_starts(frame).collect() if r.returns} == {2}
    assert {(r.file, r.start): r.inside for r in quoted.block_starts(frame).collect()} == want


def test_larger_than_a_split(spark, tmp_path, blocks):
    (tmp_path / "a.csv").write_text("x" * 3000)
    for size, larger in (("2kb", True), ("3k", False), ("2999", True), ("1m", False)):
        blocks(size)
        assert quoted.larger_than_a_split(spark, str(tmp_path)) is larger


def test_few_lines_at_a_time_in_python(spark):
    """A batch of 10,000 lines of 3 KB: what a task holds as Python objects goes by bytes, not by rows."""
    n, line = 10_000, '1,"' + "x" * 3000 + '"'
    lines = {"file": [7] * n, "start": [0] * n, "value": [line] * n, "inside": [False] * n}
    batch = pa.RecordBatch.from_pydict(lines | {"value": [*lines["value"][:-1], "y" * 3_000_000]})
    sizes, made = [], 0
    tracemalloc.start()
    for out in quoted._cut_records(",", True)(iter([batch])):
        made += len(out)
        sizes.append(out.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == n and max(sizes) < 5_000_000 and peak < 12_000_000
    pieces = list(quoted._pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 3)])))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch, batch.slice(5, 3)])) and len(pieces) > 30
    (told,) = quoted._block_ends(",")(iter([batch, batch]))
    assert told.to_pylist() == [{"file": 7, "start": 0, "after_out": False, "after_in": False, "returns": False}]


def test_lines_are_written_without_python(spark, tmp_path, monkeypatch):
    """Every file starts with the header, and the texts do not pass through Python to get it."""
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(spark.range(1)), name, None)
    rows = spark.range(0, 50, 1, 6).where("id > 20").select("id", F.concat(F.lit("n"), "id").alias("name"))
    for table, n in ((rows, 29), (rows.where("id < 0"), 0)):
        path = str(tmp_path / str(n))
        files._write_lines(table, ["name", "id"], "name,,", path)
        found = [p.read_text() for p in (tmp_path / str(n)).glob("part-*")]
        assert all(t.startswith("name,,\n") and t.count("name,,") == 1 for t in found) and found
        assert sorted(x for t in found for x in t.split("\n")[1:] if x) == sorted(f"n{i},{i}" for i in range(21, 50))[:n]
