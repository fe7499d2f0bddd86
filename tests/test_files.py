import pytest

from burnish.sources import delimited

FILES = {
    "comma.csv": b'id,name,note\n1,"Ann, B",x\n2,Bob,"say ""hi"""\n3,C\n',
    "semicolon.csv": "id;name;note\n4;José;1,5\n".encode("latin1"),
    "tab.csv": b"\xef\xbb\xbfid\tname\tnote\n5\tT\tNA\n",
    "bar.csv": b'id|name|note\n6|P|"two\nlines"\n\n7|  pad |\n',
    "prose.csv": 'id;name;note\n8;Q;"one, two,\nthree, ""four"", five\nsix, é"\n'.encode(),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return path


def test_inspect(spark, folder):
    found = {r.file.rsplit("/", 1)[1]: r for r in delimited.inspect_files(spark, str(folder)).collect()}
    kinds = {n: (r.delimiter, r.encoding, r.multi_line) for n, r in found.items()}
    assert kinds == {
        "comma.csv": (",", "UTF-8", False),
        "semicolon.csv": (";", "ISO-8859-1", False),
        "tab.csv": ("\t", "UTF-8", False),
        "bar.csv": ("|", "UTF-8", True),
        "prose.csv": (";", "UTF-8", True),
    }


def test_read_mixed_files_as_one_table(spark, folder):
    table = delimited.read_delimited(spark, str(folder)).orderBy("id")
    assert [tuple(r) for r in table.collect()] == [
        ("1", "Ann, B", "x"),
        ("2", "Bob", 'say "hi"'),
        ("3", "C", None),
        ("4", "José", "1,5"),
        ("5", "T", None),
        ("6", "P", "two\nlines"),
        ("7", "  pad ", None),
        ("8", "Q", 'one, two,\nthree, "four", five\nsix, é'),
    ]


def write(tmp_path, content):
    path = tmp_path / "one.csv"
    path.write_bytes(content)
    return str(path)


def test_no_delimiter_means_comma(spark, tmp_path):
    row = delimited.inspect_files(spark, write(tmp_path, b"word\none\ntwo\n")).first()
    assert (row.delimiter, row.lines) == (",", 3)


def test_header_names():
    assert delimited.file_column_names(["a", "a", "", "A", "a.1"]) == ["a", "a.1", "Unnamed: 2", "A", "a.1.1"]
    assert delimited.file_column_names(["a", "A"], case_sensitive=False) == ["a", "A.1"]


def test_repeated_and_blank_headers(spark, tmp_path):
    table = delimited.read_delimited(spark, write(tmp_path, b"a,a,,A\n1,2,3,4\n"))
    assert table.columns == ["a", "a.1", "Unnamed: 2", "A.2"]
    assert tuple(table.first()) == ("1", "2", "3", "4")


@pytest.mark.parametrize("content", [b"a,b\n1,2\n5,6,7\n", b'a,b\n1,"2\n3"\n8,9,"x\ny"\n'])
def test_long_rows(spark, tmp_path, content):
    path = write(tmp_path, content)
    with pytest.raises(Exception, match="more than 2 cells"):
        delimited.read_delimited(spark, path).collect()
    assert delimited.read_delimited(spark, path, on_long_rows="cut").count() == 2


def test_other_header_in_the_same_group_fails(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "two.csv").write_bytes(b"b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        delimited.read_delimited(spark, str(tmp_path)).collect()


def test_types(spark, tmp_path):
    content = (
        b"i,f,b,bn,t,e,big,inf,d\n"
        b" 1 ,1,True,true,x,,9223372036854775808,-inf,2020-01-01\n"
        b",2.5e1,FALSE,NA,1,NaN,1,Infinity,2020-01-02\n"
    )
    table = delimited.read_delimited(spark, write(tmp_path, content), infer=True)
    assert [f.dataType.simpleString() for f in table.schema.fields] == [
        "bigint", "double", "boolean", "string", "string", "double", "double", "double", "string"
    ]
    first = table.orderBy("d").first()
    assert (first.i, first.f, first.b, first.e, first.inf) == (1, 1.0, True, None, float("-inf"))


def test_sample_file_scores_94(spark, tmp_path):
    from burnish import quality_score

    content = (
        b"id,name,join_date,status\n1,  John Doe  ,2023-01-01, ACTIVE\n2,Jane ,01/02/2023,inactive\n"
        b"3,Bob Builder,Feb 3rd 2023, PENDING\n4,Alice,2023-04-01,active"
    )
    table = delimited.read_delimited(spark, write(tmp_path, content), infer=True)
    assert table.schema["id"].dataType.simpleString() == "bigint"
    assert quality_score(table).first().quality_score == 94


def test_round_trip(spark, tmp_path):
    rows = [(None, "x,y", 1.5), (" a ", 'say "hi"', None), ("#c", "two\nlines", -2.0), ("z\\", "é\t|", float("nan"))]
    table = spark.createDataFrame(rows, "v string, w string, d double")
    path = f"{tmp_path}/out"
    delimited.write_delimited(table, path)
    back = delimited.read_delimited(spark, path, infer=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([*rows[:3], ("z\\", "é\t|", None)], key=repr)
    empty = f"{tmp_path}/empty"
    delimited.write_delimited(table.where("false"), empty)
    assert delimited.read_delimited(spark, empty).columns == ["v", "w", "d"]


def test_single_column_keeps_empty_rows(spark, tmp_path):
    table = spark.createDataFrame([(None,), ("",), ("a",)], "v string").coalesce(1)
    delimited.write_delimited(table, f"{tmp_path}/out")
    assert delimited.read_delimited(spark, f"{tmp_path}/out").count() == 3
