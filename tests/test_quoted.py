"""CSV files cut at any byte against one reader of the whole file."""

import csv
import io
import random

import pytest

from quillspark.sources import quoted, tables


def one_reader(data, columns):
    rows = [r for r in csv.reader(io.StringIO(data, newline="")) if r]
    at = [rows[0].index(c) for c in columns]
    return [tuple((r[i] if i < len(r) else None) or None for i in at) for r in rows[1:]]


def read(spark, path, columns, block):
    df = quoted.read_csv(spark, str(path), columns, block)
    return [tuple(r)[3:] for r in df.orderBy("file", "start", "nth").collect()]


SMALL = 'id,"a ""name""",b\n1,"x\ny","say ""hi"""\n2,,"\n\n""\n"\n\n3,été,"""\n"\n4,"one, two","long ' + "line\n" * 20 + '"\n5,last,'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_each_block_border(spark, tmp_path, end):
    """A block size for each number of bytes puts a border behind each byte of the file, among them those inside quotes, escapes and line ends."""
    data = SMALL.replace("\n", end)
    (tmp_path / "a.csv").write_bytes(data.encode())
    want = one_reader(data, ["id", 'a "name"', "b"])
    size = len(data.encode())
    for block in [1, 2, 3, 7, 50, size - 1, size, 10 * size]:
        assert read(spark, tmp_path / "a.csv", ["id", 'a "name"', "b"], block) == want
    # the borders themselves, each byte of them
    with open(tmp_path / "a.csv", "rb") as f:
        raw = data.encode()
        starts = {0, size}
        inside = False
        for i, c in enumerate(raw):
            inside ^= c == 34
            if c == 10 and not inside:
                starts.add(i + 1)
        for at in range(size + 1):
            assert quoted.border(f, at, size, raw[:at].count(b'"') % 2 == 1) == min(s for s in starts if s >= at)


def test_folder_of_files(spark, tmp_path):
    rng = random.Random(5)
    want = []
    for k in range(3):
        made = [(f"{k}-{i}", "".join(rng.choice('ab,"\n é') for _ in range(rng.randint(0, 60)))) for i in range(200)]
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([("extra", "paperId", "title", "abstract"), *(("z", i, t, "") for i, t in made)])
        want += [(i, t, "") for i, t in made]
    (tmp_path / "_SUCCESS").write_text("")
    assert read(spark, tmp_path, ["paperId"], 512) == [(i,) for i, _, _ in want]
    assert sorted(tuple(r) for r in tables.papers_csv(spark, f"file://{tmp_path}").collect()) == sorted(want)
    (tmp_path / "9.csv").write_text("other,header\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        quoted.read_csv(spark, str(tmp_path), ["paperId"]).collect()


def test_header_alone_and_missing_columns(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert quoted.read_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "e.csv").write_text("")
    assert quoted.read_csv(spark, str(tmp_path / "e.csv"), ["a"]).collect() == []
    with pytest.raises(ValueError):
        quoted.read_csv(spark, str(tmp_path / "h.csv"), ["c"])
