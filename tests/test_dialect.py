"""Files of several dialects with the same rows read alike."""

import os

import pytest

from pingmill.sources import dialect

ROWS = [("a", "1.5", "2", "2024-01-01 00:00:05", "plain"), ("b", "-3", "", "2024-01-02 10:00:00", "x, y; z|t"), ("c", "4e3", "7", "2024-01-03 00:00:00", "it's"), ("d", "0.25", "9", "2024-01-04 00:00:00", "")]
NAMES = ("maid", "latitude", "n", "at", "note")
STYLES = {"comma": (",", '"', True), "semicolon": (";", '"', True), "tab": ("\t", '"', True), "pipe": ("|", '"', True), "single": (",", "'", True), "bare": (",", '"', False)}


def write(path, style, rows=ROWS * 5, leaked=True):
    d, q, header = style
    cell = lambda v: q + v.replace(q, q + q) + q if any(c in v for c in (d, q)) or (q == "'" and v) else v
    line = lambda r: d.join(map(cell, r)) + "\n"
    body = [line(r) for r in rows]
    if leaked:
        body[3:3] = [line(NAMES)]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write((line(NAMES) if header else "") + "".join(body))


def plain(rows):
    return sorted((r[0], float(r[1]), int(r[2]) if r[2] else None, r[3][:19], r[4] or None) for r in rows)


@pytest.mark.parametrize("name", sorted(STYLES))
def test_each_dialect(spark, tmp_path, name):
    if name == "single":
        rows = [r for r in ROWS if "'" not in r[4]] * 5  # Spark knows no doubled single quotes
    else:
        rows = ROWS * 5
    write(f"{tmp_path}/{name}.csv", STYLES[name], rows)
    (r,) = dialect.detect(spark, str(tmp_path)).collect()
    assert (r.delimiter, r.quote, r.header) == STYLES[name] and r.types == ["string", "double", "bigint", "timestamp", "string"]
    df = dialect.read_csv_auto(spark, str(tmp_path), NAMES)
    assert dict(df.dtypes) == {"maid": "string", "latitude": "double", "n": "bigint", "at": "timestamp", "note": "string"}
    got = sorted((x.maid, x.latitude, x.n, str(x["at"]), x.note) for x in df.selectExpr("maid", "latitude", "n", "CAST(at AS STRING) AS at", "note").collect())
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, p)) for p in plain(rows)]


def test_mixed_folder_with_bad_rows(spark, tmp_path):
    for k, name in enumerate(("comma", "semicolon", "tab", "pipe", "bare")):
        write(f"{tmp_path}/d{k}/{name}.csv", STYLES[name])
    with open(f"{tmp_path}/d0/comma.csv", "a") as f:
        f.write("e,north,3,2024-01-01 00:00:00,bad latitude\nf,1,many,2024-01-01 00:00:00,bad n\ng,1,1,someday,bad time\n")
    with open(f"{tmp_path}/wide.csv", "w") as f:
        f.write("maid,latitude,n,at,note\n" + "z,1,2.5,2024-01-01 00:00:00,n is a double here\n" * 3)
    with open(f"{tmp_path}/empty.csv", "w") as f:
        f.write("\n\n")
    df = dialect.read_csv_auto(spark, str(tmp_path), NAMES)
    assert dict(df.dtypes)["n"] == "double" and df.count() == 5 * 5 * len(ROWS) + 3
    assert {r.maid for r in df.select("maid").distinct().collect()} == {"a", "b", "c", "d", "z"}
    assert dialect.detect(spark, str(tmp_path)).filter("delimiter IS NULL").count() == 1


def test_samples():
    assert dialect.sniff("") is None and dialect.sniff("\n\n") is None
    assert dialect.sniff("a,b\n1,2\n3,4\nx")[:3] == (",", '"', True)
    assert dialect.sniff("1,2\n3,4\n")[2:] == (False, [], ["bigint", "bigint"])
    assert dialect.sniff("name,kind\nx,y\nname,kind\nz,w\n")[2] is True  # comes again
    assert dialect.sniff("x,y\nz,w\n")[2] is False
    assert dialect.sniff("a;b\n1,5;2\n2,5;3\n")[0] == ";"
    assert dialect.sniff("a,b\n1,2\n3,4,", cut=True)[4] == ["bigint", "bigint"]
