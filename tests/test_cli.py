"""The command line."""

from panelwright import cli


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["cost", "--images", "2400"]) == 0 and "16.8" in capsys.readouterr().out
    (tmp_path / "l.csv").write_text("t,g\n1,1\n1,0\n0,0\n,1\n")
    assert cli.main(["score", "--labels", str(tmp_path / "l.csv"), "--truth", "t", "--guess", "g", "--out", str(tmp_path / "o")], spark) == 0
    row = spark.read.parquet(str(tmp_path / "o/score.parquet")).first()
    assert (row.tp, row.fn, row.tn, row.fp) == (1, 1, 1, 0) and row.precision == 1.0
    (tmp_path / "long.csv").write_text("source,unit_name,year,religion,count,ref\n" + "".join(f"bps,Kota A,2020,{r},{c},bps:1100:1\n" for r, c in (("islam", 90), ("kristen", 50), ("katolik", 60))))
    (tmp_path / "codes.csv").write_text("unit_code,unit_name\n1171,Kota A\n")
    assert cli.main(["harmonise", "--long", str(tmp_path / "long.csv"), "--codes", str(tmp_path / "codes.csv"), "--out", str(tmp_path / "h")], spark) == 0
    row = spark.read.parquet(str(tmp_path / "h/panel.parquet")).first()
    assert (row.unit_code, row.total, row.total_is_sum) == ("1171", 200.0, True)
