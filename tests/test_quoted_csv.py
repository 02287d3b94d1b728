import csv
import io
import random

import pytest

from tidepanel.sources import quoted_csv, tickets


@pytest.fixture
def small_splits(spark):
    """Blocks of a few hundred bytes, so that they begin and end anywhere in records."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, n, end="\n"):
    pieces = ["word", 'say ""hi""', "\n", "\n\n", ",", '""', "é漢", " ", "\n\"\"\n", "x" * 40]
    lines = []
    for i in range(n):
        fields = [str(i)]
        for _ in range(2):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
            fields.append(f'"{text}"' if rng.random() < 0.7 else "".join(c for c in text if c not in '",\n'))
        lines.append(",".join(fields))
    return end.join(["id,a,\"long\nname\"", *lines]) + (end if rng.random() < 0.5 else "")


def one_task(spark, path):
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sorted(map(str, (tuple(r) for r in rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).collect())))


def ours(spark, path):
    return sorted(str(tuple(r)) for r in quoted_csv.read(spark, path).drop("_file", "_block", "_place").collect())


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_one_task(spark, tmp_path, small_splits, seed):
    path = tmp_path / "t.csv"
    path.write_text(made(random.Random(seed), 150), newline="")
    assert quoted_csv._lines(spark, str(path)).select("block").distinct().count() > 5
    got = ours(spark, str(path))
    assert got == one_task(spark, str(path)) and len(got) == 150
    own = [r[0] for r in csv.reader(io.StringIO(path.read_text(), newline=""))][1:]
    assert [r["id"] for r in quoted_csv.read(spark, str(path)).orderBy("_file", "_block", "_place").collect()] == own


def test_a_record_over_many_blocks(spark, tmp_path, small_splits):
    long = "line of a long text\n" * 200
    path = tmp_path / "t.csv"
    path.write_text(f'id,text\n1,a\n2,"{long}"\n3,"b\nc"\n4,"{long}",more\n5,"never closed\n6,x\n')
    got = {r["id"]: r["text"] for r in quoted_csv.read(spark, str(path)).collect()}
    assert got["2"] == got["4"] == long and got["1"] == "a" and got["3"] == "b\nc" and len(got) == 5


def test_files_with_other_headers_marks_and_line_ends(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("﻿id,a\r\n1,\"x\ny\"\r\n\r\n2,\r\n", newline="")
    (tmp_path / "b.csv").write_text("a,id,c\n3,4,5\n6\n", newline="")
    (tmp_path / "c.csv").write_text("id,a\n", newline="")
    (tmp_path / "d.csv").write_text("")
    got = {(r["id"], r["a"], r["c"]) for r in quoted_csv.read(spark, str(tmp_path)).collect()}
    assert got == {("1", "x\ny", None), ("2", None, None), ("4", "3", "5"), (None, "6", None)}
    assert quoted_csv.read(spark, str(tmp_path / "d.csv")).count() == 0


def test_tickets_by_many_tasks(spark, tmp_path, small_splits):
    rows = [["Ticket ID", "Created At", "Company ID", "Contacts", "Talk"]]
    rows += [[str(i), str(1704067200 + i), f"{i:024x}", f'{{"contacts": [{{"external_id": "{i}", "email": "a@b.c"}}]}}', "he said\n\"no\"\n" * (i % 5)] for i in range(60)]
    with (tmp_path / "t.csv").open("w", newline="") as f:
        csv.writer(f).writerows(rows)
    got = {r["ticket_id"]: r["external_id"] for r in tickets.load_tickets(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {str(i): str(i) for i in range(60)}


def test_names_of_a_product_are_a_parameter(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,Vendor-ID,other\n" + "".join(f"{i:024x},{i + 1},{i}\n" for i in range(5)))
    got = {r["account_id"] for r in tickets.load_companies(spark, str(tmp_path / "c.csv"), id_names=("vendor id",)).collect()}
    assert got == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        tickets.load_companies(spark, str(tmp_path / "c.csv"))
