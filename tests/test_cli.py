"""The programs from files to files."""

import random

from loomseg import cli


def test_one_and_diff(spark, tmp_path):
    r = random.Random(1)
    rows = {"a": [], "b": []}
    for b in range(800):
        for k, name in enumerate("ab"):
            for _ in range(r.randrange(8, 14) if 200 <= b < 400 and not k else r.randrange(0, 3)):
                s = b * 100 + r.randrange(100)
                rows[name].append(f"c\t{s}\t{s + 1}\tx\t0\t+")
    for name, lines in rows.items():
        (tmp_path / f"{name}.bed").write_text("\n".join(lines) + "\n")
    (tmp_path / "sizes.bed").write_text("c\t0\t80000\n")
    (tmp_path / "conf").write_text("bin-size = 100 # bins\nduplicates = true\n")
    path = lambda n: str(tmp_path / n)
    common = ["-c", path("sizes.bed"), "--bin-step", "100", "--config-file", path("conf"), "-i", "5"]
    assert cli.main(["one", path("a.bed"), "-o", path("d"), *common, "--score", path("s"), "--readcount", path("n"), "--boundary", path("bd"), "--boundary-score", path("bs"), "--param-out", path("m")], spark) == 0
    lines = lambda n: [x.value for x in spark.read.text(path(n)).collect()]
    top = max((x.split("\t") for x in lines("d")), key=lambda x: int(x[2]) - int(x[1]))
    assert abs(int(top[1]) - 20_000) <= 300 and abs(int(top[2]) - 40_000) <= 300 and top[3] == "ENRICHED"
    assert len(lines("s")) == len(lines("n")) == len(lines("bs")) == 800
    assert cli.main(["one", path("a.bed"), "-o", path("d2"), *common, "--param-in", path("m")], spark) == 0
    assert sorted(lines("d2")) == sorted(lines("d"))
    assert cli.main(["diff", path("a.bed"), path("b.bed"), "-o", path("e"), *common, "-m", "3", "-F", "skel", "--bg", "skel"], spark) == 0
    assert any(x.split("\t")[3] == "SAMPLE-I-ENRICHED" for x in lines("e"))


def test_zones(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s\nACGTTGCAAC" + "N" * 60 + "\nACGTTGCATT\n")
    assert cli.main(["zones", str(tmp_path / "x.fa"), "-o", str(tmp_path / "z"), "-k", "8", "-p", "2"], spark) == 0
    zones = [r.value.split("\t")[:3] for r in spark.read.text(str(tmp_path / "z")).collect()]
    assert ["s", "0", "1"] in zones and any(int(a) <= 10 and int(b) >= 70 for _, a, b in zones)
