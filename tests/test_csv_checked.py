"""CSV reading with a quarantine: every data line is kept or set aside."""

from __future__ import annotations

from creditlens.sources import files


def _text(spark, tmp_path, lines):
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    return files.read_csv_checked(spark, str(tmp_path / "x.csv"), "id long, name string, amount double")


def test_short_and_long_lines_are_set_aside(spark, tmp_path):
    good, bad = _text(spark, tmp_path, ["id,name,amount", '1,"a, ""b""",2.5', "2,n/a,x", "3,c", "4,d,1.0,extra", ",,"])
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([(1, 'a, "b"', 2.5), (2, None, None), (None, None, None)], key=repr)
    assert sorted(r["line"] for r in bad.collect()) == ["3,c", "4,d,1.0,extra"]


def test_header_only(spark, tmp_path):
    good, bad = _text(spark, tmp_path, ["id,name,amount"])
    assert good.count() == 0 and bad.count() == 0
