import random

import pytest
from conftest import rows

from areapanel.sources import csv_files, csv_records
from areapanel.sources.csv_records import quoted_records


def direct(text):
    """Records of one text, character by character, and whether it ends inside quotes."""
    records, begin, at, state = [], 0, 0, "field"
    while at < len(text):
        c = text[at]
        if state == "quoted":
            if c == '"' and text[at + 1 : at + 2] == '"':
                at += 1
            elif c == '"':
                state = "plain"
        elif c == "\n":
            records.append(text[begin:at].rstrip("\r"))
            begin, state = at + 1, "field"
        elif c == ",":
            state = "field"
        elif state == "field" and c == '"':
            state = "quoted"
        elif c > " ":
            state = "plain"
        at += 1
    if begin < len(text):
        records.append(text[begin:].rstrip("\r"))
    return records, state == "quoted"


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["file"], tuple(r["line"]))):
        out.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["record"], r["torn"]))
    return out


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "200")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_records_of_odd_texts(spark, tmp_path, small_splits, chunk):
    draw, texts = random.Random(chunk), {}
    pieces = ['"', '"', ",", "\n", "\r\n", " ", "a", '""', '"b"', '",\n"', "x" * 70]
    for i in range(24):
        texts[f"{i:02}.csv"] = "".join(draw.choice(pieces) for _ in range(draw.choice([3, 40, 160])))
    texts["empty.csv"], texts["lines.csv"] = "", "\n\n \n"
    texts["long.csv"] = 'a,b\n1,"' + "line of it\n" * 200 + '"\n2,c\n'
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    got, torn_files = found(quoted_records(spark, str(tmp_path), "*.csv", chunk)), 0
    for name, text in texts.items():
        records, torn = direct(text)
        torn_files += torn
        if torn:
            lines = text.split("\n")
            records = [x.rstrip("\r") for x in (lines if lines[-1] else lines[:-1])]
        assert got.get(name, []) == [(r, torn) for r in records], name
    assert 0 < torn_files < len(texts)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    wanted = [(i, f'5" of\x01 it\r\n"{i}",\n\nend') for i in range(400)]
    text = 'k,note,size\n' + "".join('%d,"%s",6" x\r\n' % (i, n.replace('"', '""')) for i, n in wanted)
    (tmp_path / "a.csv").write_text(text, newline="")
    schema = spark.createDataFrame([], "k int, note string, size string").schema
    got = csv_files.read_csv_by_name(spark, str(tmp_path), schema, multi_line=True)
    assert rows(got, "k", "note", "size") == sorted([(i, n, '6" x') for i, n in wanted], key=repr)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_open_quotes_make_a_bad_file(spark, tmp_path):
    (tmp_path / "good.csv").write_text('k,v\n1,"a\nb"\n2,5" pipe\n')
    (tmp_path / "open.csv").write_text('k,v\n3,"a\n4,b\n5,c\n')
    (tmp_path / "head.csv").write_text('k,"v\n6,b\n')
    schema = spark.createDataFrame([], "k int, v string").schema
    load = lambda **more: csv_files.read_csv_by_name(spark, str(tmp_path), schema, **more)
    assert rows(load(multi_line=True)) == [(1, "a\nb"), (2, '5" pipe')]
    assert rows(csv_files.read_csv_by_name(spark, str(tmp_path), multi_line=True)) == [("1", "a\nb"), ("2", '5" pipe')]
    with pytest.raises(Exception, match="bad row in"):
        load(multi_line=True, skip_bad_files=False).collect()
    assert rows(load()) == []
    bad = csv_files.bad_files(spark, str(tmp_path), ["k", "v"], multi_line=True).collect()
    assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"open.csv", "head.csv"}


def test_too_long_a_record_makes_a_bad_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\n' + "2,b\n" * 50 + '3,"\n4,d\n')
    got = found(quoted_records(spark, str(tmp_path), "*.csv", 8, 100))["a.csv"]
    assert got == [("k,v", False), ("", True), ("4,d", False)]
    assert len(found(quoted_records(spark, str(tmp_path), "*.csv", 8, 1000))["a.csv"]) == 3


def test_no_line_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert quoted_records(spark, str(tmp_path), "*.csv").count() == 0


def test_no_path_goes_with_the_lines(spark, tmp_path, monkeypatch):
    """Lines, marks and pieces name their file by a number; the paths come back in the end."""
    kinds, original = {}, csv_records.staged
    monkeypatch.setattr(csv_records, "staged", lambda df, name: kinds.update({name: dict(df.dtypes)}) or original(df, name))
    (tmp_path / "a.csv").write_text('k,"x\ny"\n1,2\n')
    got = quoted_records(spark, str(tmp_path), "*.csv", 2).collect()
    assert sorted(r["record"] for r in got) == ["1,2", 'k,"x\ny"'] and {r["file"][-5:] for r in got} == {"a.csv"}
    assert kinds["pieces"]["file"] == kinds["begins"]["file"] == "bigint"
