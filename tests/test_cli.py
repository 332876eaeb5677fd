"""The command line, in this process."""

from strandloom.cli import main, render_stats

GFA = "H\tVN:Z:1.0\nS\t1\tACGTAC\nS\tx\tGGT\nL\t1\t+\tx\t-\t1M\nP\tp\t1+,x-\t1M\n"


def test_commands(spark, tmp_path, capsys):
    a = tmp_path / "a.gfa"
    a.write_text(GFA)
    assert main(["convert", str(a), "-o", str(tmp_path / "b.vg")]) == 0
    assert main(["convert", str(tmp_path / "b.vg"), "-o", str(tmp_path / "c.gfa")]) == 0
    assert (tmp_path / "c.gfa").read_text() == GFA.replace("\t1M\n", "\t*\n").replace("-\t*\nP", "-\t1M\nP")
    assert main(["dbg", str(a), "-k", "3", "-u", "-o", str(tmp_path / "u.fa")]) == 0
    text = (tmp_path / "u.fa").read_text()
    assert text.startswith(">0\n") and text.count(">") == len(text.splitlines()) // 2
    assert main(["dbg", str(a), "-k", "3", "-c", "-o", str(tmp_path / "k.gfa")]) == 0
    assert "P\tp\t" in (tmp_path / "k.gfa").read_text()
    capsys.readouterr()
    assert main(["info", str(a)]) == 0 and "nodes: 2" in capsys.readouterr().out
    assert main(["stats", str(a)]) == 0 and "length total: 9" in capsys.readouterr().out
    assert main(["formats"]) == 0 and "gfa" in capsys.readouterr().out


def test_exit_codes(spark, tmp_path):
    a = tmp_path / "a.gfa"
    a.write_text("S\t1\n")
    assert main(["info", str(a)]) == 1
    assert main(["convert", str(a), "-o", str(tmp_path / "x.unknown")]) == 1
    assert main(["dbg", str(a), "-o", str(tmp_path / "u.fa")]) == 2
    assert main(["dbg", str(a), "-k", "64", "-o", str(tmp_path / "u.gfa")]) == 1
    assert main(["convert", "-", "-o", "-"]) == 2


def test_histogram_rendering():
    lines = render_stats({"nodes": 1234567, "degree_histogram": [(0, 2), (10, 1), (12, 4)]})
    assert lines == ["nodes: 1,234,567", "degree 0: 2", "degree 10+: 5"]
