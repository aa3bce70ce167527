"""Quoted multi-line records over splits, against a sequential reader, with the file cut at every place."""

import csv
import io
import random

from recordlake.sources import split_csv


def sequential(text, sep="|"):
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep, doublequote=True) if row]


def cut(spark, size, run):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        return run()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_cut_at_every_place(spark, tmp_path):
    text = 'KEY|NOME|TXT\n1|"a|b"|"x\ny ""q"" z\n\n|"\n2|ação|plain\n3|"only\n\n\nbreaks"|\n4||"é|""|"\n'
    (tmp_path / "f.csv").write_text(text, encoding="utf-8", newline="")
    want = [dict(zip(["KEY", "NOME", "TXT"], row, strict=True)) for row in sequential(text)[1:]]
    size = len(text.encode())
    for at in [*range(3, size, 13), size]:
        got = cut(spark, at, lambda: split_csv.read_quoted(spark, f"file://{tmp_path}/f.csv").orderBy("record").collect())
        assert [r["values"] for r in got] == want, at
        data = text.encode()
        assert all(data[r["bytes_before"] :].startswith(r["values"]["KEY"].encode() + b"|") for r in got)


def test_random_files_of_several_encodings(spark, tmp_path):
    rng = random.Random(5)
    for n, encoding in enumerate(("utf-8", "latin-1")):
        rows = [["id", "a", "b"]] + [[str(i), *("".join(rng.choice('ab|\n"ç é') for _ in range(rng.randint(0, 12))) for _ in range(2))] for i in range(60)]
        out = io.StringIO(newline="")
        csv.writer(out, delimiter="|", lineterminator="\r\n" if n else "\n", quoting=csv.QUOTE_ALL).writerows(rows)
        folder = tmp_path / encoding
        folder.mkdir()
        for part in range(2):
            (folder / f"{part}.csv").write_bytes(out.getvalue().encode(encoding))
        found = cut(spark, 100, lambda f=folder, e=encoding: split_csv.read_quoted(spark, f"file://{f}", encoding=e.upper().replace("LATIN-1", "ISO-8859-1")).orderBy("file", "record").collect())
        assert [[r["values"][c] for c in rows[0]] for r in found] == rows[1:] * 2


def test_scan_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k | v\n1|Alpha\n\n2|beta\n3|"never closed\n4|alpha\n', encoding="utf-8")
    records = split_csv.read_quoted(spark, f"file://{tmp_path}/a.csv")
    assert [(r["record"], r["values"]) for r in records.orderBy("record").collect()] == [(1, {"k": "1", "v": "Alpha"}), (3, {"k": "2", "v": "beta"}), (4, {"k": "3", "v": 'never closed\n4|alpha'})]
    assert [r["record"] for r in split_csv.scan(records, "ALPHA", 10**9).orderBy("record").collect()] == [1, 4]
    assert [r["record"] for r in split_csv.scan(records, "alpha", 20).collect()] == [1]
    (tmp_path / "long.csv").write_text("a|b\n1|" + '"' + 'x""' * 100_000 + '"\n2|"' + "y\n" * 50_000 + '"\n3|un\rquoted\n')
    long = split_csv.read_quoted(spark, f"file://{tmp_path}/long.csv").orderBy("record").collect()
    assert [len(r["values"]["b"]) for r in long] == [200_000, 100_000, 9]
    (tmp_path / "empty.csv").write_text("")
    assert split_csv.read_quoted(spark, f"file://{tmp_path}/empty.csv").count() == 0
