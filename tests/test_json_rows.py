import json
import random

import pytest
from conftest import rows

from areapanel.sources import population
from areapanel.sources.json_rows import read_array_rows


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def found(df):
    """Per file the rows in order, or None for a broken document."""
    out, broken = {}, set()
    for r in sorted(df.collect(), key=lambda r: (r["file"], r["block"], r["chunk"], r["part"])):
        name = r["file"].rsplit("/", 1)[1]
        out.setdefault(name, [])
        if r["broken"]:
            broken.add(name)
        if r["cells"] is not None:
            out[name].append(list(r["cells"]))
    return {name: None if name in broken else cells for name, cells in out.items()}


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_rows_of_odd_documents(spark, tmp_path, small_splits, chunk):
    draw, wanted = random.Random(chunk), {}
    pieces = ["]", "[", '"', "\\", "],[", '","', "a", "\n", "ü", " " * 30, "\\]"]

    def cell():
        return draw.choice([None, "1", "".join(draw.choice(pieces) for _ in range(draw.randrange(8)))])

    for i in range(20):
        table = [[cell() for _ in range(draw.randrange(4))] for _ in range(draw.choice([1, 2, 30]))]
        text = json.dumps(table, ensure_ascii=i % 2 == 0, indent=draw.choice([None, 1]))
        (tmp_path / f"{i:02}.json").write_text(text + draw.choice(["", "\n", " \n "]), encoding="utf-8")
        wanted[f"{i:02}.json"] = table
    bad = ['[["a"]', '[["a"]\n', '[["a"]]]', '[["a"]] [["b"]]', '[["a"],5,["b"]]', '[["a"] ["b"]]', "<html>busy</html>", "5",
           '[["a"],["b]]', '["a"]', '[["a"],["b"],]', '[["a",]]', '{"a": [["b"]]}', '[["a"]]x', ',["a"]', "]", "[[", '[["a"]["b"]]']
    for i, text in enumerate(bad):
        (tmp_path / f"bad{i}.json").write_text(text)
        wanted[f"bad{i}.json"] = None
    (tmp_path / "none.json").write_text("[]")
    wanted["none.json"] = None
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf" + b'[["a"]]\n')
    (tmp_path / "nested.json").write_text('[["a",["b",["c"]]],["d"]]')
    got = found(read_array_rows(spark, str(tmp_path), chunk))
    assert got.pop("mark.json") in (None, [["a"]])
    assert got.pop("nested.json") == [["a", '["b",["c"]]'], ["d"]]
    for name, table in wanted.items():
        assert got[name] == table, (name, (tmp_path / name).read_text())


def test_one_document_is_read_by_many_tasks(spark, tmp_path, small_splits):
    table = [["NAME", "B01003_001E", "zip"]] + [[f"ZCTA5 {i:05}", str(i), 'x]["'] for i in range(600)]
    (tmp_path / "acs_2015.json").write_text(json.dumps(table))
    (tmp_path / "acs_2016.json").write_text(json.dumps(table[::-1]))
    (tmp_path / "acs_2017.json").write_text(json.dumps(table)[:-3])
    landed = population.read_response_rows(spark, str(tmp_path))
    assert landed.groupBy("file", "block").count().where("endswith(file, '2015.json')").count() > 20
    people = population.load_population_rows(landed, column="B01003_001E")
    assert rows(people) == [(f"{i:05}", 2015, float(i)) for i in range(1, 600)]
    assert rows(population.response_row_report(landed, "B01003_001E")) == [(2015, 1, 1), (2016, 1, 0), (2017, 1, 0)]
    whole = population.read_responses(spark, str(tmp_path))
    assert rows(population.load_population(whole, column="B01003_001E")) == rows(people)
    assert rows(population.load_population_rows(landed, (2016, 2017), "B01003_001E")) == []


def test_too_long_a_row_breaks_its_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["a"], ["],[" * 100], ["b"]]))
    assert found(read_array_rows(spark, str(tmp_path), 8, 100)) == {"a.json": None}
    assert len(found(read_array_rows(spark, str(tmp_path), 8, 1000))["a.json"]) == 3


def test_nothing_landed(spark, tmp_path):
    (tmp_path / "acs_2015.json").write_text("")
    landed = population.read_response_rows(spark, str(tmp_path))
    assert rows(population.load_population_rows(landed)) == []
