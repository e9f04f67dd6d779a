"""Sources and sinks: acceptance rules, report formats, capture limits."""

import os

from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from flowwarden.sources import files as A
from flowwarden.sources.pcap import normalize_packets, read_packets, write_pcap_files
from flowwarden.sources.tables import read_flows
from flowwarden.streaming.jobs import scratch_path


def test_accepted_inputs(spark):
    m = spark.createDataFrame([("/a/x.csv", 10), ("/a/y.PCAP", 600 * 1024 * 1024), ("/a/z.txt", 1),
                               ("/a/w.pcapng", 500 * 1024 * 1024)], "path string, size_bytes long")
    got = {r.path: r.accepted for r in A.accepted_inputs(m).collect()}
    assert got == {"/a/x.csv": True, "/a/y.PCAP": False, "/a/z.txt": False, "/a/w.pcapng": True}


def test_manifest_matches_files(spark):
    import hashlib
    m = {os.path.basename(r.path): (r.size_bytes, r.md5)
         for r in A.file_manifest(spark, os.path.join(SMALL, "*.parquet")).collect()}
    p = os.path.join(SMALL, "events.parquet")
    assert m["events.parquet"] == (os.path.getsize(p), hashlib.md5(open(p, "rb").read()).hexdigest())


def test_manifest_of_files_in_pieces(spark, tmp_path, monkeypatch):
    """Digests are those of whole files, and no task reads more than a piece (a file was one task's before)."""
    import hashlib
    piece, sizes = 1000, [1, 999, 1000, 1001, 2000, 3077, 64_000]
    for n in sizes:
        (tmp_path / f"{n}.bin").write_bytes(os.urandom(n))
    want = {f"{n}.bin": (n, hashlib.md5((tmp_path / f"{n}.bin").read_bytes()).hexdigest()) for n in sizes}
    m = A.file_manifest(spark, str(tmp_path / "*.bin"), piece_bytes=piece)
    assert {os.path.basename(r.path): (r.size_bytes, r.md5) for r in m.collect()} == want
    read = []
    monkeypatch.setattr(A, "_pieces", lambda path, a, b, f=A._pieces: read.append(b - a) or f(path, a, b))
    f = (str(tmp_path / "3077.bin"), 3077, 0, b"")
    for k in range(1, 5):
        f = A._hashed_on(f, k * piece, A._crypto())
    assert f[3] == want["3077.bin"][1] and A._crypto() and read == [1000, 1000, 1000, 77]
    # where the library is missing in some tasks, the digest is the same
    for libs in ([None] * 4, [A._crypto(), None, None, A._crypto()], [None, A._crypto(), A._crypto(), None]):
        f = (str(tmp_path / "3077.bin"), 3077, 0, b"")
        for k, lib in enumerate(libs, 1):
            f = A._hashed_on(f, k * piece, lib)
        assert f[3] == want["3077.bin"][1]


def test_manifest_of_a_file_over_2_gb(spark, tmp_path):
    import hashlib
    size = (1 << 31) + 12_345
    with open(tmp_path / "big.bin", "wb") as fh:  # takes no room
        fh.truncate(size - 1)
        fh.seek(size - 1)
        fh.write(b"x")
    with open(tmp_path / "big.bin", "rb") as fh:
        want = hashlib.file_digest(fh, "md5").hexdigest()
    assert [(r.size_bytes, r.md5) for r in A.file_manifest(spark, str(tmp_path / "*.bin")).collect()] == [(size, want)]


def test_report_formats_agree(spark):
    rep = read_flows(spark, SMALL).groupBy("protocol_type").agg(F.count(F.lit(1)).alias("n"))
    base = scratch_path(spark, "rep")
    schema = "protocol_type string, n long"
    got = []
    for fmt in ("csv", "json", "parquet"):
        A.export_report(rep, os.path.join(base, fmt), fmt)
        got.append(sorted(tuple(r) for r in A.read_report(spark, os.path.join(base, fmt), fmt, schema=schema).collect()))
    assert got[0] == got[1] == got[2] == sorted(tuple(r) for r in rep.collect())


def test_pcap_max_packets_per_file(spark):
    f = read_flows(spark, SMALL)
    folder = scratch_path(spark, "cap")
    write_pcap_files(f, folder, 2)
    all_rows = read_packets(spark, os.path.join(folder, "*.pcap"))
    capped = read_packets(spark, os.path.join(folder, "*.pcap"), max_packets=10)
    assert all_rows.count() == f.count()
    assert capped.count() == 20 and capped.agg(F.max("packet_index")).first()[0] == 9
    n = normalize_packets(all_rows)
    assert n.where(F.col("protocol_type") == "other").count() == n.where(F.col("src_ip") == "0.0.0.0").count()


def test_headerless_generic_width(spark):
    path = scratch_path(spark, "csv3")
    spark.createDataFrame([(1.0, 2.0, "dos"), (3.0, 4.0, "normal")], "a double, b double, c string") \
         .write.option("header", False).csv(path)
    d = A.read_flows_csv(spark, path, header=False)
    assert d.columns == ["feature_0", "feature_1", "label"] and d.count() == 2


def _frame_bytes(vlan=0):
    import socket
    import struct
    eth = b"\x02" * 12 + b"".join(struct.pack(">HH", 0x8100, 7) for _ in range(vlan)) + b"\x08\x00"
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40, 1, 0x4000, 64, 17, 0, socket.inet_aton("10.1.2.3"), socket.inet_aton("10.4.5.6"))
    return eth + ip + struct.pack(">HHHH", 1234, 53, 20, 0) + b"\0" * 12


def _pcapng(frames, endian="<", resolution=None):
    import struct

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        n = struct.pack(endian + "I", len(body) + 12)
        return struct.pack(endian + "I", kind) + n + body + n
    options = struct.pack(endian + "HHB3x", 9, 1, resolution) + struct.pack(endian + "HH", 0, 0) if resolution is not None else b""
    out = block(0x0A0D0D0A, struct.pack(endian + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(endian + "HHI", 1, 0, 65535) + options)
    for t, f in frames:
        out += block(6, struct.pack(endian + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_capture_formats(spark, tmp_path):
    import pytest
    (tmp_path / "a.pcapng").write_bytes(_pcapng([(1_700_000_000_000_000, _frame_bytes()), (1_700_000_001_500_000, _frame_bytes(1))]))
    (tmp_path / "b.pcapng").write_bytes(_pcapng([(1_700_000_002_000_000_000, _frame_bytes(2))], ">", 9))
    (tmp_path / "c.pcapng").write_bytes(_pcapng([]))
    rows = normalize_packets(read_packets(spark, str(tmp_path / "*.pcapng"))).orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [1.7e9, 1700000001.5, 1700000002.0]
    assert {(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol_type, r.udp_len) for r in rows} == {("10.1.2.3", "10.4.5.6", 1234, 53, "udp", 20)}
    (tmp_path / "d.pcap").write_bytes(b"not a capture at all, whatever its name says")
    with pytest.raises(Exception, match="not a capture file"):
        read_packets(spark, str(tmp_path / "d.pcap")).collect()


def _mixed_captures(folder):
    """Captures whose frames look like records themselves, of both kinds and byte
    orders, with sections and interfaces in the middle, and one long frame."""
    import struct
    frames = [_frame_bytes(i % 3) + bytes(i % 50) for i in range(300)]
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 5, 16, 16) + b"\0" * 16 for _ in range(40))  # a capture within a frame
    frames[50], frames[120] = _frame_bytes() + inner, _frame_bytes() + bytes(9_000)
    for name, e in (("little.pcap", "<"), ("big.pcap", ">")):
        out = struct.pack(e + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for i, f in enumerate(frames):
            out += struct.pack(e + "IIII", 1_700_000_000 + i, i, len(f), len(f)) + f
        (folder / name).write_bytes(out)
    at = [(1_700_000_000_000_000 + i, f) for i, f in enumerate(frames)]
    nested = _frame_bytes() + _pcapng(at[:8])[48:]
    (folder / "sections.pcapng").write_bytes(_pcapng(at[:130]) + _pcapng([(t * 1000, f) for t, f in at[130:200]], ">", 9)
                                             + _pcapng(at[200:] + [(1_800_000_000_000_000, nested)]))
    return 2 * len(frames) + len(frames) + 1


def test_any_range_size_gives_the_same_packets(spark, tmp_path):
    n = _mixed_captures(tmp_path)
    rows = lambda size: sorted(map(str, read_packets(spark, str(tmp_path / "*"), range_bytes=size).collect()))
    whole = rows(1 << 30)
    assert len(whole) == n
    largest = max(f.stat().st_size for f in tmp_path.iterdir())
    for parts in (3, 7):
        assert rows(largest // parts + 1) == whole
    times = {r.timestamp for r in read_packets(spark, str(tmp_path / "sections.pcapng"), range_bytes=2_000).collect()}
    assert times == {(1_700_000_000_000_000 + i) / 1e6 for i in range(300)} | {1.8e9}
    assert read_packets(spark, str(tmp_path / "*"), max_packets=10, range_bytes=8_000).count() == 30


def test_ranges_find_their_first_record_behind_padding(tmp_path):
    """Frames padded with zeros, and frames that carry a capture: a wrong place costs a pass over the file for each range."""
    import struct

    from flowwarden.sources.pcap import _scan
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 5, 64, 64) + b"\1" * 64 for _ in range(15))
    frames = [_frame_bytes() + (inner + b"\1" * 7 if i % 3 == 0 else bytes(i * 31 % 1_400)) for i in range(600)]
    out, starts = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), []
    for i, f in enumerate(frames):
        starts.append(len(out))
        out += struct.pack("<IIII", 1_700_000_000 + i, i, len(f), len(f)) + f
    path = tmp_path / "padded.pcap"
    path.write_bytes(out)
    for start in range(0, len(out), 10_000):
        stop = min(start + 10_000, len(out))
        got = _scan(str(path), len(out), start, stop, None, None)
        held = [s for s in starts if start <= s < stop]
        assert (got["first"], got["packets"]) == (held[0], len(held))


def test_cut_off_captures(spark, tmp_path):
    import pytest
    _mixed_captures(tmp_path)
    (tmp_path / "cut.pcap").write_bytes((tmp_path / "little.pcap").read_bytes()[:-20])
    got = read_packets(spark, str(tmp_path / "cut.pcap"), range_bytes=3_000).orderBy("packet_index").collect()
    assert len(got) == 300 and got[-1].packet_size == len(_frame_bytes(299 % 3)) + 299 % 50 - 20
    (tmp_path / "cut.pcapng").write_bytes((tmp_path / "sections.pcapng").read_bytes()[:-20])
    with pytest.raises(Exception, match="cut.pcapng: cut off in a block"):
        read_packets(spark, str(tmp_path / "cut.pcapng"), range_bytes=3_000).collect()


def test_ipv6_extension_headers():
    import socket
    import struct

    from flowwarden.sources.pcap import _decode
    src, dst = socket.inet_pton(socket.AF_INET6, "2001:db8::1"), socket.inet_pton(socket.AF_INET6, "fe80::2")
    udp = struct.pack(">HHHH", 5353, 53, 8, 0)

    def packet(first, rest):
        return b"\x02" * 12 + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(rest), first, 9) + src + dst + rest

    routing, auth = bytes([51, 1]) + bytes(14), bytes([17, 4]) + bytes(22)
    fragment = lambda at: bytes([17, 0]) + struct.pack(">HI", at << 3, 7)
    for pkt, port in ((packet(17, udp), 5353), (packet(43, routing + auth + udp), 5353), (packet(44, fragment(0) + udp), 5353),
                      (packet(44, fragment(3) + udp), None), (packet(0, bytes([17, 200])), None), (packet(17, b""), None)):
        row = _decode("f", 0, 0.0, len(pkt), pkt)
        assert (row["src_ip"], row["dst_ip"], row["ip_ttl"], row.get("udp_src_port")) == ("2001:db8::1", "fe80::2", 9, port)
