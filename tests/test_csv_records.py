"""CSV files cut anywhere against Python's own reader over each whole file."""

import csv
import io
import random

import pytest

from tablekin.functions.headers import unique_names
from tablekin.functions.values import NA_TOKENS
from tablekin.sources.csv_lake import read_csv_lake
from tablekin.sources.csv_records import ends_inside, split_at_returns
from tests.helpers import rows


def open_at_end(text):
    """Character by character: the states of a reader that allows quotes around fields."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "closing" if c == '"' else state
        elif c in ",\r\n":
            state = "start"
        elif c == '"' and state in ("start", "closing"):
            state = "quoted"
        else:
            state = "plain"
    return state == "quoted"


def plain(text):
    """(names, rows) of a whole file, or None where it cannot be read."""
    if open_at_end(text):
        return None
    records = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if not records:
        return None
    names = unique_names(records[0])
    data = [[*r, *[""] * (len(names) - len(r))] for r in records[1:] if len(r) <= len(names)]
    return names, [[None if v in NA_TOKENS else v for v in r] for r in data]


def read(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cells, meta = read_csv_lake(spark, str(folder), "lake")
        tables = {}
        for table, pos, name in rows(meta, "table_name", "col_pos", "col_name"):
            tables.setdefault(table, ([], {}))[0].append(name)
        for r in cells.collect():
            tables[r["table_name"]][1].setdefault(r["row_id"], {})[r["col_pos"]] = r["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(sorted(found) == list(range(len(found))) for _, found in tables.values())
    return {table: (names, [[found[n][pos] for pos in range(len(names))] for n in range(len(found))])
            for table, (names, found) in tables.items()}


HAND = {
    "header": '"x\ny",b\n1,2\n3,4\n',
    "long_header": '"' + "x\n" * 40 + '",b,"c,\n"\n1,2,"3\n\n3"\n',
    "crlf": 'a,b\r\n"1\r\n2",3\r\n\r\n4,"5"\r\n',
    "cr": 'a,b\r"1\r2",3\r4,5',
    "mixed": 'a,b\r"1\n2",3\r4,"5\n6"\r7,"8\r\n9"\n10,11\n',
    "open": 'a,b\n1,"2\n3,4\n',
    "bare": 'a,b\n1"2,3\n4,5"6"\n"7"8"9,10\n"a""b","""c"\n',
    "wide": "a\n1,2\n3,4\n",
    "some_wide": 'a\n1\n2,2\n"3\n"\n4,4\n5\n"6"\n',
    "bom": '﻿"a\n1",b\n1,2\n',
    "blank": "\n\n\na,b\n\n1,2\n\n",
    "quotes": 'a\n""\n""""\n"",\n',
    "empty": "",
    "name with é, and +": "h\n1\n",
}


@pytest.fixture(scope="module")
def hand(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hand")
    for name, text in HAND.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    (folder / "latin.csv").write_bytes(b"a,b\n" + b"1,2\n" * 50 + b"\xe9,1\n")
    return folder


@pytest.mark.parametrize("split", ["128m", "7", "31"])
def test_awkward_files(spark, hand, split):
    got = read(spark, hand, split)
    expected = {name: plain(text.removeprefix("﻿")) for name, text in HAND.items()}
    assert got == {name: table for name, table in expected.items() if table is not None}


def test_lines_of_blanks_are_no_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text('  \n\t\na\n 1\n  \n"  "\n')
    assert read(spark, tmp_path, "5") == {"t": (["a"], [[" 1"], ["  "]])}


@pytest.mark.parametrize("seed", range(2))
def test_random_files_do_not_depend_on_blocks(spark, tmp_path, seed):
    pick = random.Random(seed)
    texts = {}
    for n in range(15):
        ends = pick.choice(["\n", "\r\n", "\n", "\r"])

        def field(ends=ends):
            plain_text = "".join(pick.choices('abé"', [5, 5, 2, pick.choice([0, 0, 1])], k=pick.randint(0, 4)))
            inner = "".join(pick.choices(["x", '""', ",", "\n", "\r\n", "é"], k=pick.randint(0, 6)))
            return pick.choice([plain_text, plain_text, f'"{inner}"'])

        width = pick.randint(2, 4)
        lines = [",".join(field() for _ in range(width + pick.choice([0, 0, 0, 0, -1, 1]))) for _ in range(pick.randint(0, 25))]
        texts[f"t{n}"] = ends.join([",".join(["a"] * width), *lines]) + pick.choice(["", ends])
        (tmp_path / f"t{n}.csv").write_bytes(texts[f"t{n}"].encode())
    expected = {name: table for name, text in texts.items() if (table := plain(text)) is not None}
    for split in ("128m", "50"):
        assert read(spark, tmp_path, split) == expected


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["n", "te\nxt"])
        writer.writerows([n, f'say "{n}",\nor not' if n % 3 else "z" * (n % 100)] for n in range(20_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    cells, meta = read_csv_lake(spark, str(tmp_path), "lake")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows(meta, "col_name") == [("n",), ("te\nxt",)]
    found = {r["row_id"]: r["value"] for r in cells.filter("col_pos = 0").collect()}
    assert found == {n: str(n) for n in range(20_000)}
    assert cells.filter("col_pos = 1").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize(("line", "inside", "after"), [
    ("a,b", False, False), ('"a', False, True), ('a"', False, False), ('a,"b""', False, True), ('"a"x"', False, False),
    ('x"', True, False), ('x""', True, True), ('",""', True, False), ('","', True, True), ('a\r"b', False, True), ("", True, True)])
def test_where_a_line_leads(line, inside, after):
    assert ends_inside(line, inside) is after
    assert ends_inside(line, False) is open_at_end(line)


def test_returns_inside_quotes_cut_nothing():
    assert split_at_returns('a\r"b\rc",d\re') == ["a", '"b\rc",d', "e"]
    assert split_at_returns('b\rc"\r"d', True) == ['b\rc"', '"d']
