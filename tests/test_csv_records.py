"""Records over line breaks: equal to one task per file, with many tasks to a file."""

from __future__ import annotations

import random

import pytest

from techfolio.sources import csv_records


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(rng):
    r = rng.random()
    if r < 0.3:
        return "".join(rng.choice("abc é") for _ in range(rng.randint(0, 5)))
    if r < 0.4:
        return rng.choice(['x"y', '5" pipe'])
    return '"' + "".join(rng.choice(["a", "b,", "\n", '""', "\r\n", " ", "\n\n", "é"]) for _ in range(rng.randint(0, 12))) + '"'


def values(df):
    return sorted(map(str, df.collect()))


def whole(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


@pytest.mark.parametrize("size", [60, 150, 400, 100_000])
def test_random_files(spark, tmp_path, small_blocks, size):
    rng = random.Random(size)
    for f in range(4):
        rows = [",".join(field(rng) for _ in range(3)) for _ in range(rng.randint(0, 60))]
        rows = [r if r.strip(",") else r + "z" for r in rows]
        (tmp_path / f"{f}.csv").write_bytes(("h1,h 2,h3\n" + "\n".join(rows) + ("\n" if f else "")).encode())
    small_blocks(size)
    got = csv_records.read(spark, str(tmp_path))
    assert got.columns == ["h1", "h 2", "h3"]
    assert values(got) == values(whole(spark, str(tmp_path)))
    if size < 1000:
        assert csv_records.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8


def test_record_over_many_blocks_and_blank_lines(spark, tmp_path, small_blocks):
    text = 'a,b\n\n1,"x\n' + "long line\n" * 60 + '\n, ""y"""\n\n2,z\n3,"q\r\n"\r\n4,5\n'
    (tmp_path / "f.csv").write_bytes(text.encode())
    small_blocks(50)
    got = values(csv_records.read(spark, str(tmp_path)))
    assert len(got) == 4 and got == values(whole(spark, str(tmp_path)))


def test_long_fields_of_quotes(spark, tmp_path, small_blocks):
    (tmp_path / "f.csv").write_text("a,b\n" + '"' + 'say ""so"" ' * 2000 + '\nend",x\n' + ",".join(["1", '"' + "w" * 200_000 + '"']) + "\n")
    small_blocks(4000)
    assert values(csv_records.read(spark, str(tmp_path))) == values(whole(spark, str(tmp_path)))


def test_without_breaks_lines_are_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"x, y"\n2,"say ""so"""\n3,\n')
    assert not csv_records.has_breaks(csv_records.lines(spark, str(tmp_path)))
    assert values(csv_records.read(spark, str(tmp_path))) == values(whole(spark, str(tmp_path)))


def test_header_alone(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,"b\nc"\n')
    got = csv_records.read(spark, str(tmp_path))
    assert got.columns == ["a", "b\nc"] and got.count() == 0
