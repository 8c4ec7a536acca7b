import io
import random

import pytest

from barlake.llm import warc as w


def archive(n=40, gz=True, seed=1):
    rng = random.Random(seed)
    records = [w.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>")], rng.randbytes(rng.randint(0, 4000)))
               for i in range(n)]
    return [w.gzip_member(r) if gz else r for r in records]


def read(raw, step=None):
    step = step or len(raw) or 1
    return [x for lo in range(0, len(raw), step) for x in w.salvage(io.BytesIO(raw), len(raw), lo, lo + step)]


@pytest.mark.parametrize("gz", [True, False])
def test_whole_archive(gz):
    parts = archive(gz=gz)
    got = read(b"".join(parts))
    assert [x.headers["warc-record-id"] for x in got] == [f"<urn:page:{i}>" for i in range(40)]


@pytest.mark.parametrize("step", [None, 700, 5_000])
@pytest.mark.parametrize("hurt", ["flip", "cut", "junk", "zero", "version"])
def test_damage_is_quarantined_and_later_records_come_back(step, hurt):
    parts = archive()
    lost = {7, 8, 20}
    for i in lost:
        p = bytearray(parts[i])
        if hurt == "flip":
            p[len(p) // 2] ^= 0x55
        elif hurt == "cut":
            p = p[:len(p) // 2]
        elif hurt == "junk":
            p = bytearray(random.Random(i).randbytes(len(p)))
        elif hurt == "zero":
            p = bytearray(len(p))
        else:
            p = bytearray(w.gzip_member(b"HTTP/1.1 200 OK\r\n\r\n"))
        parts[i] = bytes(p)
    raw = b"".join(parts)
    got = read(raw, step)
    records = [x for x in got if isinstance(x, w.Record)]
    assert sorted(x.headers["warc-record-id"] for x in records) == sorted(f"<urn:page:{i}>" for i in range(40) if i not in lost)
    gaps = sorted((g.offset, g.length) for g in got if isinstance(g, w.Gap))
    at = [sum(map(len, parts[:i])) for i in range(41)]
    assert gaps == [(at[7], at[9] - at[7]), (at[20], at[21] - at[20])]
    covered = sorted([(x.offset, x.length) for x in got])
    assert covered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:])) and sum(covered[-1]) == len(raw)


def test_gap_at_both_ends():
    parts = [b"not an archive at all", *archive(3), b"\x1f\x8b\x08 broken tail"]
    got = read(b"".join(parts), 64)
    assert sum(isinstance(x, w.Record) for x in got) == 3
    assert sorted(g.length for g in got if isinstance(g, w.Gap)) == sorted([len(parts[0]), len(parts[-1])])


def test_round_trip_matches_brute_force(spark):
    import hashlib
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2", None), (3, None, ""), (9, "u\n9", big), (5, "u5", "é" * 600), (6, "u6", "é" * 600),
            (7, "u7", "small"), (8, "u8", "small"), (4, "u4", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "x")
    got = {r["page_id"]: tuple(r)[1:] for r in w.round_trip(df.repartition(4)).collect()}
    want = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        top = max(p for p, _, h in rows if (h or "").encode() == raw)
        revisit = len(raw) >= 1000 and top != page
        want[page] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)
    assert got == want


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "u", "y" * 2000), (3, "u", "y" * 2000), (3, "u", "y" * 2000)], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in w.round_trip(df).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("None", "revisit", 3)]
    assert w.round_trip(df.limit(0)).count() == 0


def test_small_ranges_on_spark(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 90)) for i in range(300)], "page_id long, url string, html string")
    manifest = w.write_archives(df.repartition(3), str(tmp_path / "a"))
    got = w.read_archives(manifest, range_bytes=2_000)
    assert got.filter("kind = 'gap'").count() == 0
    assert sorted(r["page_id"] for r in got.collect()) == list(range(300))


def test_foreign_records_are_read():
    import base64
    import hashlib
    import io

    body = b"hello there"
    sha = hashlib.sha1(body).digest()
    forms = [f"sha1:{base64.b32encode(sha).decode()}", f"SHA1:{sha.hex().upper()}", f"sha1:{base64.b32encode(sha).decode().lower()}",
             f"sha256:{hashlib.sha256(body).hexdigest()}", f"md5:{hashlib.md5(body).hexdigest()}", "blake9:xyz"]
    data = b""
    for version in ("WARC/1.0", "WARC/1.1"):
        for form in forms:
            data += (f"{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1-2-3>\r\nWARC-Block-Digest: {form}\r\n"
                     f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    each = [b"WARC/1." + part for part in data.split(b"WARC/1.")[1:]]
    for raw in (data, b"".join(map(w.gzip_member, each))):
        found = list(w.salvage(io.BytesIO(raw), len(raw)))
        assert len(found) == 12 and all(isinstance(x, w.Record) and x.payload == body for x in found)
    wrong = data.replace(b"blake9:xyz", b"sha1:" + b"A" * 32)
    found = list(w.salvage(io.BytesIO(wrong), len(wrong)))
    assert sum(isinstance(x, w.Record) for x in found) == 10
    assert [x.reason for x in found if isinstance(x, w.Gap)] == ["digest", "digest"]
    assert w._page("<urn:uuid:1-2-3>") is None and w._page(w._urn("null:")) == "null:" and w._page(w._urn(None)) is None


def test_ids_of_other_types_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    rows = [("b/1", "u", "z" * 1500), ("b/2", "u", "z" * 1500), ("null", "u", "s"), (None, "u", "s"), ("", "u", None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    for name in ("digest", "target", "payload", "n", "lead", "kind", "path"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in w.round_trip(df).collect()}
    assert got == {"b/1": ("revisit", "b/2"), "b/2": ("response", None), "null": ("response", None), None: ("response", None), "": ("response", None)}
    ints = spark.createDataFrame([(7, "u", "x")], "page_id int, url string, html string")
    assert w.round_trip(ints).schema["page_id"].dataType.simpleString() == "int"
