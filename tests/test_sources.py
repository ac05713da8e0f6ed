"""Sources on small files, against their plain reading."""

import pytest

from ravelin.sources import packets, text


def test_symbols_and_commands(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0x10,main\n20,a,b\nbad\n, x\n")
    assert sorted(map(tuple, text.read_symbols(spark, str(tmp_path / "s.txt")).collect())) == [(16, "main"), (32, "a,b")]
    (tmp_path / "c.csv").write_text("0,ACT,1\n 35, rd ,2\nx,y\n")
    assert sorted(map(tuple, text.read_commands(spark, str(tmp_path / "c.csv")).collect())) == [(0, "ACT", 1), (35, "RD", 2)]


def test_settings(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[General]\n  Test1=BAR  # remark\n Test1+=FOO\n\n[Other]\r\nk = v=w\n; no\n[General]\nTest2=x\nTest2=y\n[Empty]\n")
    got = {(r.section, r.key): r.value for r in text.read_settings(spark, str(tmp_path / "a.ini")).collect()}
    assert got == {("General", "Test1"): "BAR FOO", ("Other", "k"): "v=w", ("General", "Test2"): "y"}


def test_sections_round_trip(spark, tmp_path):
    rows = [("cpu.0", "pid", "7"), ("cpu.0", "regs", "1 2 3"), ("memory", "size", "2"), ("memory", "none", None)]
    df = spark.createDataFrame(rows, "section string, key string, value string")
    text.write_sections(df, str(tmp_path / "cpt"))
    got = {(r.section, r.key, r.value) for r in text.read_settings(spark, str(tmp_path / "cpt")).collect()}
    assert got == {(s, k, v or "") for s, k, v in rows}
    assert text.section_texts(df.limit(0)).count() == 0
    for bad in (("a", "k", "x#y"), ("a", "k+", "1"), ("a", "k\nl", "1"), ("a", "", "1"), ("a\n", "k", "1")):
        with pytest.raises(Exception, match="not a settings entry"):
            text.section_texts(spark.createDataFrame([bad], df.schema)).collect()


def test_statistics(spark, tmp_path):
    (tmp_path / "stats.txt").write_text("junk 1\n---------- Begin Simulation Statistics ----------\nsim_ticks   1000 # ticks\nrate nan # x\n\n---------- End Simulation Statistics   ----------\n---------- Begin Simulation Statistics ----------\nsim_ticks 2.5e3\nlat::mean 4 10.00% 20.00% # share\n")
    got = sorted((r.dump, r.name, str(r.value), r.remark) for r in text.read_statistics(spark, str(tmp_path / "stats.txt")).collect())
    assert got == [(0, "rate", "nan", "x"), (0, "sim_ticks", "1000.0", "ticks"), (1, "lat::mean", "4.0", "share"), (1, "sim_ticks", "2500.0", "")]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_packets_are_decoded(spark, tmp_path):
    record = lambda **f: b"".join(varint(k << 3) + varint(f[n]) for k, n in packets.PACKET.items() if n in f)
    rows = [b"\x0a\x03abc", record(tick=5, cmd=1, addr=1 << 40, size=64), record(tick=900, cmd=4)]
    (tmp_path / "t.bin").write_bytes(b"".join(varint(len(r)) + r for r in rows))
    got = packets.decoded_packets(packets.read_framed(spark, str(tmp_path))).orderBy("record_no").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 5, 1, 1 << 40, 64, None, None, None), (2, 900, 4, None, None, None, None, None)]
    assert packets.fields(rows[0]) == {1: b"abc"}
    with pytest.raises(ValueError):
        list(packets.frames(b"\x05ab"))
