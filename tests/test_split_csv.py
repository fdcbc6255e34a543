"""CSV files cut at every place, against Python's reader."""

import csv
import io
import random

import pytest

from fieldweave.sources.split_csv import ranges, read_split_csv


@pytest.fixture
def cut(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(n_bytes):
        spark.conf.set(names[0], str(n_bytes))
        spark.conf.set(names[1], "0")

    yield of
    for name, value in before.items():
        spark.conf.set(name, value)


def plain(text):
    read = [r for r in csv.reader(io.StringIO(text)) if r]
    width = len(read[0])
    return sorted([tuple([v or None for v in r] + [None] * (width - len(r))) for r in read[1:]], key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def made(rng, n, end="\n"):
    cell = lambda: rng.choice(["", "plain", "two\nlines", 'a "word"', "x,y", "\n\n", '"', "ünï\r\ncode", " spaces ", '",\n"', "long " * rng.randrange(30) + "\n" + "lines\n" * rng.randrange(20)])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "A note", "other"])
    writer.writerows([i, cell(), cell()] for i in range(n))
    return out.getvalue()


@pytest.mark.parametrize("size", [40, 97, 500, 4000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_ranges_give_the_records(spark, tmp_path, cut, size, end):
    text = made(random.Random(size), 60 if size < 100 else 300, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    cut(size)
    frame = read_split_csv(spark, str(tmp_path / "a.csv"))
    assert frame.columns == ["id", "A note", "other"] and got(frame) == plain(text)
    assert ranges(spark, str(tmp_path / "a.csv")).count() >= min(8, len(text.encode()) // (size + 600))


def test_sixteen_ranges_like_duckdb(spark, tmp_path, cut):
    import duckdb

    text = made(random.Random(1), 2000)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    cut(-(-len(text.encode()) // 16))
    assert ranges(spark, str(path)).count() == 16
    wanted = duckdb.sql(f"SELECT * FROM read_csv('{path}', all_varchar = true, header = true, quote = '\"', escape = '\"', delim = ',', new_line = '\\n', parallel = false)").fetchall()
    assert got(read_split_csv(spark, str(path))) == sorted(wanted, key=repr)
    assert "multiLine" not in read_split_csv(spark, str(path))._jdf.queryExecution().toString()


def test_several_files_short_rows_blank_lines_and_no_rows(spark, tmp_path, cut):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text('x,y,z\n1,"a\nb",c\n\n2\n')
    (tmp_path / "f" / "b.csv").write_text('x,y,z\n3,,"last\n\nrecord"')
    (tmp_path / "f" / "c.csv").write_text("x,y,z\n")
    for size in (3, 1000):
        cut(size)
        assert got(read_split_csv(spark, str(tmp_path / "f"))) == sorted([("1", "a\nb", "c"), ("2", None, None), ("3", None, "last\n\nrecord")], key=repr)
        assert got(read_split_csv(spark, str(tmp_path / "f" / "c.csv"))) == []


def test_a_record_over_many_ranges(spark, tmp_path, cut):
    field = "\n".join(f"line {i} of one field" for i in range(400))
    (tmp_path / "a.csv").write_text(f'id,note\n1,x\n2,"{field}"\n3,y\n')
    cut(100)
    assert got(read_split_csv(spark, str(tmp_path / "a.csv"))) == sorted([("1", "x"), ("2", field), ("3", "y")], key=repr)
