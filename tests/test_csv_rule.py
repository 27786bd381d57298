"""One reading of CSV in every encoding."""

import random

import pytest

from saldo.sources.model import typed_csv
from saldo.sources.tables import csv_layouts, quality, read_csv, sniffed

ROWS = [("1", "line one\nline two", "5"), ("2", 'he said "hi" there', "6"), ("3", "back\\slash\\", "7"), ("4", "# no comment", "8"), ("5", "a, b", "9"), ("6", '"', "0"), ("7", "甲乙丙", "1")]
ENCODINGS = ["utf-8", "utf-8-sig", "utf-16", "gb18030"]


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


def body(rows, end="\n"):
    return "#账单导出\n\n编号,备注,数\n" + "".join(",".join(map(quoted, r)) + end for r in rows)


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_breaks_doubled_quotes_and_backslashes(spark, tmp_path, encoding):
    (tmp_path / "a b.csv").write_bytes(body(ROWS).encode(encoding))
    got = sorted((r["编号"], r["备注"], r["数"]) for r in read_csv(spark, str(tmp_path)).collect())
    assert got == ROWS


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_many_splits(spark, tmp_path, encoding):
    rows = [(str(i), f'甲 "{i}" \\ 乙', str(i % 7)) for i in range(20_000)]
    (tmp_path / "a.csv").write_bytes(body(rows).encode(encoding))
    (tmp_path / "b.csv").write_bytes(body([*rows[:3], ("x", "y\nz", "1")], "\r\n").encode(encoding))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        out = read_csv(spark, str(tmp_path))
        assert encoding == "utf-16" or out.rdd.getNumPartitions() > 5
        got = sorted((r["file"], r["编号"], r["备注"], r["数"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sorted([("a.csv", *r) for r in rows] + [("b.csv", *r) for r in [*rows[:3], ("x", "y\nz", "1")]])


def test_layouts_are_told_by_tasks(spark, tmp_path):
    (tmp_path / "whole.csv").write_bytes("a;b\n1;2\n".encode())
    (tmp_path / "broken.csv").write_bytes('a;b\n1;"x\ny"\n'.encode("gb18030") + "甲;乙\n".encode("gb18030"))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {r["uri"].rsplit("/", 1)[-1]: (r["encoding"], r["delimiter"], r["names"], r["broken"]) for r in csv_layouts(spark, str(tmp_path)).collect()}
    assert got == {"whole.csv": ("utf-8-sig", ";", ["a", "b"], False), "broken.csv": ("gb18030", ";", ["a", "b"], True)}


@pytest.mark.parametrize(
    ("text", "encoding"),
    [("联通", "gb18030"), ("订单,金额\n联通,3\n", "gb18030"), ("订单编号,实付金额", "utf-8"), ("訂單編號,實付金額,運費", "big5"), ("déjà,vu", "utf-8"), ("plain", "utf-8"), ("订单", "utf-16"), ("退款,手续费", "gb18030")],
)
def test_encodings_are_told_by_quality(text, encoding):
    told = sniffed(text.encode(encoding))[0]
    assert told == {"utf-8": "utf-8-sig"}.get(encoding, encoding) and quality(text) == 1.0


def test_heads_that_end_inside_a_character(spark):
    text = "订单编号,实付金额\n" * 50
    for encoding in ("utf-8", "gb18030"):
        whole = text.encode(encoding)
        for cut in range(200, 230):
            assert sniffed(whole[:cut])[0] == {"utf-8": "utf-8-sig"}.get(encoding, encoding)


def test_model_tables_by_the_same_rule(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes('﻿raw,major, n \n"运费\n险","fee ""x""", 7 \n'.encode())
    (row,) = typed_csv(spark, str(tmp_path / "d.csv"), {"raw": "string", "major": "string", "n": "int"}).collect()
    assert tuple(row) == ("运费\n险", 'fee "x"', 7)
    with pytest.raises(ValueError, match="lacks"):
        typed_csv(spark, str(tmp_path / "d.csv"), {"other": "string"})


def test_random_cells_in_all_encodings(spark, tmp_path):
    pick = random.Random(3)
    rows = [(str(i), "".join(pick.choice('ab",\\\n#甲 ;') for _ in range(12)) + "z", "x" + "".join(pick.choice('"\n,') for _ in range(4)) + "x") for i in range(300)]
    want = sorted((a, b.strip(), c) for a, b, c in rows)
    for encoding in ENCODINGS:
        (tmp_path / f"{encoding}.csv").write_bytes(body(rows).encode(encoding))
        got = sorted((r["编号"], r["备注"], r["数"]) for r in read_csv(spark, str(tmp_path / f"{encoding}.csv")).collect())
        assert got == want, encoding
