"""Packet-capture files (libpcap and pcapng) as a Spark source.

``read_packets`` decodes byte ranges of the files, so that neither a task nor a
row holds a whole file. A first pass over the ranges looks for the first record
of each (a run of plausible headers) and counts the records that start in it.
A range is right if it starts where the one before ends; the others are scanned
again from there until all are, so the result never rests on a guess. Record
numbers, and byte order and interfaces of next-generation files, are carried
from range to range by windows over the ranges (not the records) of a file. The
second pass decodes. The decoder reads the Ethernet / VLAN / IPv4 / IPv6 /
TCP / UDP headers with ``struct``; missing layers are left null and
``normalize_packets`` applies the defaults as column expressions.

``write_pcap_files`` builds capture files from a flow table (one frame per
flow) and is used to land test inputs derived from the given tables; each
task writes its own file into a shared folder.
"""

from __future__ import annotations

import os
import socket
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import IP_PROTOCOL_NAMES, PACKET_SCHEMA
from ..session import cut_lineage

_GLOBAL = "<IHHiIII"   # 24-byte file header
_REC = "IIII"          # per-record header (endianness prefixed)
_MAGIC_US = 0xA1B2C3D4
_MAGIC_NS = 0xA1B23C4D


_PCAPNG = 0x0A0D0D0A
_VLAN = (0x8100, 0x88A8)
ROWS_PER_BATCH = 20_000
#: Bytes of a file that one row of the work table stands for.
RANGE_BYTES = 64 << 20
PIECE = 4 << 20
#: Plausible frames and blocks have at most so many bytes, and follow each other so many times and for so many bytes. Wrong guesses cost a further scan.
MAX_FRAME, MAX_BLOCK, RUN, VERIFIED = 262_144, 16 << 20, 6, 262_144
_EXTENSIONS = (0, 43, 60, 135)  # IPv6 extension headers whose length is in units of 8 bytes


class CaptureError(ValueError):
    """A file that isn't a readable capture."""


class _File:
    """Bytes of a file by their offset, read forward in pieces; ``span`` is what is wanted in all, about."""

    def __init__(self, path: str, span: int = PIECE):
        self.stream, self.at, self.data, self.piece = _open(path), 0, b"", max(1 << 16, min(span, PIECE))

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``, which never goes back by more than a piece."""
        if at < self.at or at > self.at + len(self.data):
            self.stream.seek(at)
            self.at, self.data = at, b""
        have = self.at + len(self.data) - at
        if have < n:
            keep = max(0, at - self.at - self.piece)
            self.data = self.data[keep:] + self.stream.read(max(n - have, self.piece))
            self.at += keep
        return self.data[at - self.at:at - self.at + n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()


def _open(path: str):
    from pyarrow import fs
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(local_path(path))
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


class _Classic:
    """Records of a libpcap file. ``state`` isn't used: its header tells all."""

    def __init__(self, file: _File, head: bytes, size: int):
        self.file, self.size = file, size
        magic, self.endian = struct.unpack_from("<I", head)[0], "<"
        if magic not in (_MAGIC_US, _MAGIC_NS):
            magic, self.endian = struct.unpack_from(">I", head)[0], ">"
        self.unit, self.rec, self.start = 1e9 if magic == _MAGIC_NS else 1e6, self.endian + _REC, struct.calcsize(_GLOBAL)

    def plausible(self, at: int) -> int | None:
        """End of the record at ``at`` if it looks like one. Padding doesn't: a header has a time."""
        head = self.file.get(at, 16)
        if len(head) < 16 or not any(head):
            return None
        _, sub, incl, size = struct.unpack(self.rec, head)
        return at + 16 + incl if sub < self.unit and incl <= size <= MAX_FRAME and at + 16 + incl <= self.size else None

    def records(self, at: int, end: int, state: dict) -> Iterator[tuple]:
        while at < end and at + 16 <= self.size:
            sec, sub, incl, _ = struct.unpack(self.rec, self.file.get(at, 16))
            length = min(incl, self.size - at - 16)
            yield at + 16 + incl, sec + sub / self.unit, length, b"" if state.get("scan") else self.file.get(at + 16, min(length, MAX_FRAME))
            at += 16 + incl


class _NextGeneration:
    """Enhanced and simple packet blocks of a pcapng file; each interface has its own time
    unit (microseconds unless its if_tsresol option says otherwise). ``state`` holds
    byte order and units of the section."""

    def __init__(self, file: _File, head: bytes, size: int):
        self.file, self.size, self.start, self.endian = file, size, 0, None

    def plausible(self, at: int) -> int | None:
        head = self.file.get(at, 8)
        for endian in (self.endian,) if self.endian else "<>":
            length = struct.unpack(endian + "I", head[4:])[0] if len(head) == 8 else 0
            if length >= 12 and length % 4 == 0 and at + length <= min(self.size, at + MAX_BLOCK) and self.file.get(at + length - 4, 4) == head[4:]:
                return at + length
        return None

    def records(self, at: int, end: int, state: dict) -> Iterator[tuple]:
        while at < end and at + 12 <= self.size:
            kind, head = self.file.get(at, 4), self.file.get(at, 12)
            if kind == _PCAPNG.to_bytes(4, "little"):  # a section: byte order and interfaces start anew
                state.update(endian="<" if struct.unpack_from("<I", head, 8)[0] == 0x1A2B3C4D else ">", units=[], section=True)
            endian = state["endian"]
            kind, length = struct.unpack_from(endian + "II", head)
            if length < 12 or at + length > self.size:
                raise CaptureError(f"cut off in a block at byte {at}")
            then, time, size, frame = at + length, None, 0, b""
            if kind == 1:
                state["units"].append(_time_unit(self.file.get(at + 16, min(length - 20, MAX_FRAME)), endian))
            elif kind == 6:
                interface, high, low, incl, _ = struct.unpack(endian + "IIIII", self.file.get(at + 8, 20))
                unit = state["units"][interface] if interface < len(state["units"]) else None
                if unit is None and not state.get("scan"):
                    raise CaptureError(f"packet of an unknown interface at byte {at}")
                seconds, rest = divmod((high << 32) + low, int(unit or 1))  # whole seconds first: the ticks may pass 53 bits
                time, size, at = seconds + rest / (unit or 1.0), min(incl, length - 32), at + 28
            elif kind == 3:  # has no time
                time, size, at = 0.0, min(struct.unpack(endian + "I", self.file.get(at + 8, 4))[0], length - 16), at + 12
            if size > 0 and not state.get("scan"):
                frame = self.file.get(at, min(size, MAX_FRAME))
            yield then, time, max(size, 0), frame
            at = then


def _capture(name: str, file: _File, size: int) -> _Classic | _NextGeneration:
    head = file.get(0, 24)
    if len(head) >= 4 and struct.unpack_from("<I", head)[0] == _PCAPNG:
        return _NextGeneration(file, head, size)
    if len(head) < 24 or not {struct.unpack_from(e + "I", head)[0] for e in "<>"} & {_MAGIC_US, _MAGIC_NS}:
        raise CaptureError(f"{name}: not a capture file")
    return _Classic(file, head, size)


def _resync(capture: _Classic | _NextGeneration, start: int, end: int) -> int | None:
    """The first place of a range from which ``RUN`` plausible records and ``VERIFIED`` bytes of
    them follow each other (or fewer, up to the file's end); if there is none, the place from
    which they reach farthest. What looks like records within a frame ends with that frame."""
    step = 4 if isinstance(capture, _NextGeneration) else 1
    failed, farthest, best = set(), start, None
    for at in range(start + -start % step, end, step):
        then, n = at, 0
        while (n < RUN or then < at + VERIFIED) and then not in failed and (after := capture.plausible(then)) is not None:
            failed.add(then)  # a chain that comes here ends where this one does
            then, n = after, n + 1
        if n >= RUN and then >= at + VERIFIED or n and then == capture.size:
            return at
        if then > farthest and then not in failed:
            farthest, best = then, at
    return best


_SCAN = ("path string, size long, start long, stop long, first long, last long, packets long, "
         "begin string, endian string, section boolean, units array<double>")


def _scan(path: str, size: int, start: int, stop: int, first: int | None, endian: str | None) -> dict:
    """What a range holds, read from ``first`` (found out if null): the place after its last record, the number
    of packets, and the byte order and interfaces that later ranges go on with."""
    with _File(path, stop - start) as file:
        capture = _capture(path, file, size)
        if first is None:
            first = capture.start if start == 0 else _resync(capture, start, stop)
        state = {"endian": endian or "<", "units": [], "section": False, "scan": True}
        if endian is None and first and isinstance(capture, _NextGeneration):
            for e in "<>":
                capture.endian = e
                if capture.plausible(first) is not None:
                    state["endian"] = e
                    break
        last, packets, begin = first, 0, state["endian"]
        try:
            for last, time, *_ in capture.records(first, stop, state) if first is not None else ():
                packets += time is not None
        except (CaptureError, struct.error):
            last = -1  # decoding tells if this is so, or the place was wrong
    return {"path": path, "size": size, "start": start, "stop": stop, "first": first, "last": last, "packets": packets,
            "begin": begin, "endian": state["endian"], "section": state["section"], "units": state["units"]}


def _time_unit(options: bytes, endian: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(endian + "HH", options, at)
        if code == 9 and size:
            power = options[at + 4]
            return float(2 ** (power & 0x7F) if power & 0x80 else 10 ** power)
        if code == 0:
            break
        at += 4 + size + -size % 4
    return 1e6


def _transport_of_ipv6(pkt: bytes, at: int, proto: int) -> tuple[int, int]:
    """Place and number of the header after the extension headers; place -1 if it
    isn't in this frame (a later fragment, or cut off)."""
    while len(pkt) >= at + 8:
        if proto in _EXTENSIONS:
            size = 8 * (pkt[at + 1] + 1)
        elif proto == 51:
            size = 4 * (pkt[at + 1] + 2)
        elif proto == 44:
            size = 8
            if struct.unpack_from(">H", pkt, at + 2)[0] >> 3:
                return -1, pkt[at]
        else:
            return at, proto
        at, proto = at + size, pkt[at]
    return -1, proto


def _decode(name: str, index: int, timestamp: float, size: int, pkt: bytes) -> dict:
    """Ethernet (with any VLAN tags), IPv4 or IPv6, TCP and UDP headers of a frame of ``size`` bytes."""
    row = {"file": name, "packet_index": index, "packet_size": size, "timestamp": timestamp}
    l3, l4, proto = 14, -1, None
    kind = struct.unpack_from(">H", pkt, 12)[0] if len(pkt) >= 14 else 0
    while kind in _VLAN and len(pkt) >= l3 + 4:
        kind = struct.unpack_from(">H", pkt, l3 + 2)[0]
        l3 += 4
    if kind == 0x0800 and len(pkt) >= l3 + 20:
        total, fragment, ttl, proto = struct.unpack_from(">H2xHBB", pkt, l3 + 2)
        row.update(src_ip=socket.inet_ntoa(pkt[l3 + 12:l3 + 16]), dst_ip=socket.inet_ntoa(pkt[l3 + 16:l3 + 20]), ip_len=total,
                   ip_flags=fragment >> 13, ip_ttl=ttl, protocol=proto)
        l4 = l3 + (pkt[l3] & 0x0F) * 4
    elif kind == 0x86DD and len(pkt) >= l3 + 40:
        payload, proto, hops = struct.unpack_from(">HBB", pkt, l3 + 4)
        l4, proto = _transport_of_ipv6(pkt, l3 + 40, proto)
        row.update(src_ip=socket.inet_ntop(socket.AF_INET6, pkt[l3 + 8:l3 + 24]), dst_ip=socket.inet_ntop(socket.AF_INET6, pkt[l3 + 24:l3 + 40]),
                   ip_len=40 + payload, ip_flags=0, ip_ttl=hops, protocol=proto)
    if l4 >= 0 and proto == 6 and len(pkt) >= l4 + 20:
        sp, dp, seq, ack, _, flags, window = struct.unpack_from(">HHIIBBH", pkt, l4)
        row.update(src_port=sp, dst_port=dp, tcp_seq=seq, tcp_ack=ack, tcp_flags=flags, tcp_window=window)
    elif l4 >= 0 and proto == 17 and len(pkt) >= l4 + 8:
        sp, dp, size = struct.unpack_from(">HHH", pkt, l4)
        row.update(udp_src_port=sp, udp_dst_port=dp, udp_len=size)
    return row


def _spread(ranges: DataFrame, n: int) -> DataFrame:
    """Ranges over tasks by a given number, as the rows are too small for AQE to leave them apart."""
    return ranges.repartition(max(1, min(n, 8 * ranges.sparkSession.sparkContext.defaultParallelism)), "path", "start")


def capture_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length) -> one row per byte range of each file: place of its first
    record (``first``; -1 in a file of one range, which is not scanned before), number of its first packet (``index``), byte order and time units at
    its start. Only counts of ranges reach the driver."""
    size = F.col("length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long")))
    ranges = (files.select("path", size.cast("long").alias("size"), starts.alias("start"))
              .withColumns({"stop": F.least(F.col("size"), F.col("start") + range_bytes), "first": F.lit(None).cast("long"), "endian": F.lit(None).cast("string")}))

    whole = ranges.where(F.col("size") <= range_bytes).select(
        "path", "size", "start", "stop", F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("index"), F.lit("<").alias("endian"),
        F.array().cast("array<double>").alias("units"))
    ranges = cut_lineage(ranges.where(F.col("size") > range_bytes))
    if not (parts := ranges.count()):
        return whole
    spread = lambda d: _spread(d, parts)

    def scan(batches):
        for pdf in batches:
            rows = [_scan(r.path, int(r.size_), int(r.start), int(r.stop), None if pd.isna(r.first) else int(r.first), r.endian)
                    for r in pdf.rename(columns={"size": "size_"}).itertuples()]
            out = pd.DataFrame(rows, columns=_SCAN_COLUMNS)
            yield out.astype({"first": "Int64", "last": "Int64"})

    order = Window.partitionBy("path").orderBy("start")
    scanned = cut_lineage(spread(ranges).mapInPandas(scan, _SCAN))
    while True:
        before = scanned.withColumns({"due": F.lag("last").over(order), "due_endian": F.lag("endian").over(order)})
        wrong = (F.col("due") >= 0) & (F.col("due") < F.col("stop")) & ~(F.col("first").eqNullSafe(F.col("due")) & (F.col("begin") == F.col("due_endian")))
        # a range that lies within one record holds none, and passes on where that ends
        inside = (F.col("due") >= F.col("stop")) & ~(F.col("last").eqNullSafe(F.col("due")) & (F.col("packets") == 0))
        judged = before.withColumns({"wrong": F.coalesce(wrong, F.lit(False)), "inside": F.coalesce(inside, F.lit(False))})
        n = judged.agg(F.count_if(F.col("wrong") | F.col("inside"))).first()[0]
        if not n:
            break
        kept = judged.where(~F.col("wrong") & ~F.col("inside")).select(*scanned.columns)
        within = (judged.where("inside").withColumns({"first": F.col("due"), "last": F.col("due"), "packets": F.lit(0).cast("long"), "begin": F.col("due_endian"), "endian": F.col("due_endian"),
                                                      "section": F.lit(False), "units": F.array().cast("array<double>")}).select(*scanned.columns))
        again = judged.where("wrong").select("path", "size", "start", "stop", F.col("due").alias("first"), F.col("due_endian").alias("endian"))
        scanned = cut_lineage(kept.unionByName(within).unionByName(spread(again).mapInPandas(scan, _SCAN)))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    section = scanned.withColumns({"part": F.sum(F.col("section").cast("int")).over(order), "index": F.coalesce(F.sum("packets").over(earlier), F.lit(0))})
    seen = Window.partitionBy("path", "part").orderBy("start")  # the interfaces of a section, so far
    return whole.unionByName(section.withColumn("so_far", F.flatten(F.collect_list(F.when(F.size("units") > 0, F.col("units"))).over(seen)))
            .select("path", "size", "start", "stop", "first", "index", F.coalesce(F.lag("endian").over(order), F.lit("<")).alias("endian"),
                    F.coalesce(F.lag("so_far").over(order), F.array().cast("array<double>")).alias("units")))


_SCAN_COLUMNS = [c.split()[0] for c in _SCAN.split(", ")]


def read_packets(spark: SparkSession, path_glob: str, max_packets: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Decoded packet rows (raw: null where a layer is absent), the first
    ``max_packets`` of each file when given. Files are read in ranges of ``range_bytes`` (any
    size gives the same rows), by tasks, from a mounted path or a file system that
    Arrow knows. Rows leave a task in batches; a file that isn't a capture, or is
    cut off in a block, fails the job by its name; an empty frame is a row."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "length")
    ranges = cut_lineage(capture_ranges(files, range_bytes))
    if max_packets is not None:
        ranges = ranges.where(F.col("index") < max_packets)
    cols = PACKET_SCHEMA.fieldNames()

    def packets(r):
        with _File(r.path, int(r.stop) - int(r.start)) as file:
            capture = _capture(r.path, file, int(r.size_))
            state = {"endian": r.endian, "units": [float(u) for u in r.units]}
            try:
                found = ((t, n, p) for _, t, n, p in capture.records(capture.start if r.first < 0 else int(r.first), int(r.stop), state) if t is not None)
                yield from (_decode(r.path, i, t, n, p) for i, (t, n, p) in enumerate(found, int(r.index_)) if max_packets is None or i < max_packets)
            except (CaptureError, struct.error) as e:
                raise CaptureError(f"{r.path}: {e}") from e

    def decode(batches):
        for pdf in batches:
            for r in pdf.rename(columns={"size": "size_", "index": "index_"}).itertuples():
                rows = iter(()) if pd.isna(r.first) else packets(r)
                while part := list(islice(rows, ROWS_PER_BATCH)):
                    yield pd.DataFrame(part, columns=cols)

    return _spread(ranges, ranges.count()).mapInPandas(decode, PACKET_SCHEMA)


def normalize_packets(df: DataFrame) -> DataFrame:
    """Defaults for missing layers (0.0.0.0 / 0), UDP ports replace TCP ones,
    udp_len 0 when absent, protocol number -> icmp / tcp / udp / other, and
    label 0."""
    pmap = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in IP_PROTOCOL_NAMES.items()))
    z = F.lit(0)
    proto = F.coalesce(F.col("protocol"), z)
    return df.select(
        "file", "packet_index", "packet_size", "timestamp",
        F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("dst_ip", F.lit("0.0.0.0")).alias("dst_ip"),
        F.coalesce("ip_len", z).alias("ip_len"), F.coalesce("ip_flags", z).alias("ip_flags"),
        F.coalesce("ip_ttl", z).alias("ip_ttl"), proto.alias("protocol"),
        F.coalesce("udp_src_port", "src_port", z).alias("src_port"),
        F.coalesce("udp_dst_port", "dst_port", z).alias("dst_port"),
        F.coalesce("tcp_flags", z).alias("tcp_flags"), F.coalesce("tcp_window", z).alias("tcp_window"),
        F.coalesce("tcp_seq", z.cast("long")).alias("tcp_seq"), F.coalesce("tcp_ack", z.cast("long")).alias("tcp_ack"),
        F.coalesce("udp_len", z).alias("udp_len"),
        F.coalesce(F.try_element_at(pmap, proto), F.lit("other")).alias("protocol_type"),
        F.lit(0).alias("label"))


def _frame(r) -> bytes:
    size = int(r["packet_size"])
    proto = {"tcp": 6, "udp": 17, "icmp": 1}[r["protocol_type"]]
    eth = b"\x02\x00\x00\x00\x00\x01" + b"\x02\x00\x00\x00\x00\x02"
    if r["arp"]:
        body = eth + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + b"\x00" * 20
        return body + b"\x00" * max(0, size - len(body))
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, size - 14, int(r["flow_id"]) & 0xFFFF, 0x4000, 64, proto, 0,
                     socket.inet_aton(r["src_ip"]), socket.inet_aton(r["dst_ip"]))
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", int(r["src_port"]), int(r["dst_port"]), int(r["flow_id"]) * 1000 % (1 << 32),
                         int(r["flow_id"]), 0x50, int(r["tcp_flags"]), 1024 + int(r["flow_id"]) % 60000, 0, 0)
    elif proto == 17:
        l4 = struct.pack(">HHHH", int(r["src_port"]), int(r["dst_port"]), size - 34, 0)
    else:
        l4 = struct.pack(">BBHHH", 8, 0, 0, 0, 0)
    body = eth + b"\x08\x00" + ip + l4
    if r["v6"]:  # the same addresses, mapped, behind a hop-by-hop header
        size = max(size, 70)
        v4 = b"\x00" * 10 + b"\xff\xff"
        body = (eth + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, size - 54, 0, 64) + v4 + socket.inet_aton(r["src_ip"]) + v4 + socket.inet_aton(r["dst_ip"])
                + bytes([proto, 0, 1, 4, 0, 0, 0, 0]) + struct.pack(">HHHH", int(r["src_port"]), int(r["dst_port"]), size - 62, 0))
    return body + b"\x00" * max(0, size - len(body))


def _block(kind: int, body: bytes) -> bytes:
    body += b"\x00" * (-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def local_path(uri: str) -> str:
    """A ``file:`` URI (or plain path) as a POSIX path; task-side Python
    writes need a POSIX-mounted shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"task-side file writes need a mounted path, not {uri}")
    return uri


def write_pcap_files(flows: DataFrame, folder: str, n_files: int, mixed: bool = False) -> None:
    """One capture file per task, frames in (ts, flow_id) order; icmp flows
    with rf_score >= 0.9 become non-IP (ARP) frames. ``mixed``: every second file is
    a next-generation one, and udp flows whose id is a multiple of 3 are IPv6."""
    folder = local_path(folder)
    cols = ["flow_id", "ts", "src_ip", "dst_ip", "protocol_type", "src_port", "dst_port", "packet_size", "tcp_flags"]
    src = (flows.select(*cols, ((F.col("protocol_type") == "icmp") & (F.col("rf_score") >= 0.9)).alias("arp"),
                        ((F.col("protocol_type") == "udp") & (F.col("flow_id") % 3 == 0) & F.lit(mixed)).alias("v6"),
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
                .repartitionByRange(n_files, "ts", "flow_id").sortWithinPartitions("ts", "flow_id"))
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        # named by the partition, and moved there when whole: a task that runs again replaces its file
        name = os.path.join(folder, f"capture-{TaskContext.get().partitionId():06d}.pcap")
        part = f"{name}.{uuid.uuid4().hex[:12]}.part"
        n = 0
        with open(part, "wb") as fh:
            blocks = mixed and TaskContext.get().partitionId() % 2 == 1
            fh.write(_block(_PCAPNG, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + _block(1, struct.pack("<HHI", 1, 0, 65535)) if blocks
                     else struct.pack(_GLOBAL, _MAGIC_US, 2, 4, 0, 0, 65535, 1))
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    fr = _frame(r)
                    us = int(r["us"])
                    fh.write(_block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(fr), len(fr)) + fr) if blocks
                             else struct.pack("<" + _REC, us // 1_000_000, us % 1_000_000, len(fr), len(fr)) + fr)
                    n += 1
        os.replace(part, name)
        yield pd.DataFrame({"file": [name], "packets": [n]})

    src.mapInPandas(write, "file string, packets long").collect()
