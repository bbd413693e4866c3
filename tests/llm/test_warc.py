import gzip
import hashlib

from pyspark.sql import functions as F
from rillgraph.llm import common as C
from rillgraph.llm import warc as W

PAGES = "page_id long, url string, html string"
ROWS = [(i, f"https://h{i % 7}.org/p/{i}?q=ü&x=%41 {i}", "<html>é\r\n\r\nWARC/1.1 " + "x" * (i * 37 % 5000)) for i in range(120)]
ODD = [(None, None, None), (1000, "", ""), (1000, "", ""), (1001, "u", None), (None, "v", "a"), (1002, "http://a/b\nc", "x" * 3_000_000)]


def _made(spark, rows, name):
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    for c in ("file", "offset", "length", "digest", "ok"):
        pages = pages.withColumn(c, F.lit("own"))
    return W.write(pages, f"{C.shared_dir(spark).rstrip('/')}/{name}")


def test_round_trip(spark):
    ix = C.saved(W.index(_made(spark, ROWS + ODD, "trip")))
    got = W.read(ix).collect()
    assert sorted(((x.page_id, x.url, x.html) for x in got), key=str) == sorted(ROWS + ODD, key=str)
    assert all(x.ok and x.digest == (None if x.html is None else "sha1:" + hashlib.sha1(x.html.encode()).hexdigest()) for x in got)


def test_index_gives_the_members(spark):
    for x in W.index(_made(spark, ROWS, "members")).collect():
        with open(x.file.removeprefix("file://"), "rb") as f:
            f.seek(x.offset)
            fields, body = W.parsed(gzip.decompress(f.read(x.length)))
        assert fields["warc-payload-digest"] == x.digest == W.digest(body) and int(fields["x-page-id"]) == x.page_id


def test_selection_and_small_ranges(spark):
    ix = C.saved(W.index(_made(spark, ROWS, "some")))
    some = ix.filter("page_id % 5 = 0")
    for s in (W.Settings(stretch=500, gap=0, most=1), W.Settings(gap=10_000)):
        assert {x.page_id for x in W.read(some, s).collect()} == set(range(0, 120, 5))


def test_ranges_coalesce():
    rows = [(0, 10), (10, 10), (25, 5), (100, 10), (105, 2), (200, 50)]
    assert list(W.ranges(rows, 5, 1000)) == [(0, 30, 0, 3), (100, 110, 3, 5), (200, 250, 5, 6)]
    assert [(a, b) for _, _, a, b in W.ranges(rows, 1000, 60)] == [(0, 3), (3, 5), (5, 6)]


def test_changed_payload_is_told(spark):
    ix = C.saved(W.index(_made(spark, [(1, "u", "abcdef")], "bad")))
    x = ix.first()
    path = x.file.removeprefix("file://")
    data = gzip.decompress(open(path, "rb").read()).replace(b"abcdef", b"abcdeX")
    with open(path, "wb") as f:
        f.write(gzip.compress(data))
    new = ix.withColumn("length", F.lit(len(open(path, "rb").read())).cast("long"))
    assert not W.read(new).first().ok


def test_first_captures(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (1, "a", "z"), (None, "b", "q"), (None, None, "q")]
    got = W.read(W.first_captures(C.saved(W.index(_made(spark, rows, "first"))))).collect()
    first = min(((W.digest(h.encode()), h) for h in ("y", "z")))[1]
    assert {(x.page_id, x.url, x.html) for x in got} == {(1, "a", first), (None, "b", "q")}


def test_empty(spark):
    ix = W.index(_made(spark, [], "none"))
    assert ix.count() == 0 and W.read(ix).count() == 0


def _file(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "file string")


def _all(spark, files):
    ix = C.saved(W.index(files))
    return ix.collect(), sorted(((x.page_id, x.html, x.ok) for x in W.read(ix).collect()), key=str)


def test_damaged_files_lose_nothing_silently(spark, tmp_path):
    """A cut end, bytes after the last member and damage in the middle are rows with ok false; whole records stay."""
    five = [W.record(i, f"u{i}", f"text {i} " * 50) for i in range(5)]
    z = [gzip.compress(r) for r in five]
    whole = [(i, f"text {i} " * 50, True) for i in range(5)]
    lost = (None, None, False)
    broken = bytearray(z[2])
    broken[30:60] = b"\x00" * 30
    for name, data, want in (
        ("cut", b"".join(z)[:-20], [*whole[:4], lost]),
        ("more", b"".join(z) + b"trailing bytes", [*whole, lost]),
        ("middle", z[0] + z[1] + bytes(broken) + z[3] + z[4], [*whole[:2], lost, *whole[3:]]),
        ("noise", b"no archive at all", [lost]),
        ("nothing", b"", []),
        ("short", gzip.compress(five[0][:-40]), [lost]),
    ):
        ix, got = _all(spark, _file(spark, tmp_path, name + ".warc.gz", data))
        assert got == sorted(want, key=str), name
        assert sum(x.length for x in ix) == len(data) and [x.offset for x in ix] == sorted(x.offset for x in ix)


def test_plain_files(spark, tmp_path):
    five = [W.record(i, f"u{i}", f"text {i} WARC/1.1 " * 50) for i in range(5)]
    ix, got = _all(spark, _file(spark, tmp_path, "a.warc", b"".join(five)))
    assert got == [(i, f"text {i} WARC/1.1 " * 50, True) for i in range(5)] and [x.length for x in ix] == [len(r) for r in five]
    _, got = _all(spark, _file(spark, tmp_path, "b.warc", b"".join(five)[:-300]))
    assert [x for x in got if x[2]] == [(i, f"text {i} WARC/1.1 " * 50, True) for i in range(4)] and (None, None, False) in got


def test_records_of_other_writers(spark, tmp_path):
    """Fields in any case, HTTP heads, chunked and compressed bodies, base 32 digests, no digest, other characters."""
    import base64

    def made(kind, block, **more):
        head = ["WARC/1.0", f"warc-type: {kind}", f"content-length:{len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items())]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = "<p>é</p>".encode()
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    chunked = b"3\r\n" + body[:3] + b"\r\n%x\r\n" % len(body[3:]) + body[3:] + b"\r\n0\r\n\r\n"
    data = [
        made("response", http + b"\r\n" + body, WARC_Target_URI="<http://a/1>", Warc_Payload_Digest=sha),
        made("response", http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked, WARC_Target_URI="http://a/2", warc_payload_digest=sha),
        made("response", http + b"content-encoding: gzip\r\n\r\n" + gzip.compress(body), WARC_Target_URI="http://a/3"),
        made("response", http + b"\r\n" + body + b"!", WARC_Target_URI="http://a/4", WARC_Payload_Digest=sha),
        made("resource", b"\xff\xfe", WARC_Target_URI="http://a/5", WARC_Payload_Digest="blake9:00"),
        made("warcinfo", b"software: x"),
    ]
    ix = C.saved(W.index(_file(spark, tmp_path, "o.warc.gz", b"".join(data))))
    got = {x.url: (x.html, x.ok) for x in W.read(ix).collect()}
    assert got == {"http://a/1": ("<p>é</p>", True), "http://a/2": ("<p>é</p>", True), "http://a/3": ("<p>é</p>", True), "http://a/4": ("<p>é</p>!", False), "http://a/5": ("\ufffd\ufffd", True), None: ("software: x", True)}
    assert {x.url for x in W.first_captures(ix).collect()} == {f"http://a/{k}" for k in range(1, 6)}


def test_as_many_tasks_as_stretches(spark):
    ix = C.saved(W.index(_made(spark, ROWS, "tasks")))
    s = W.Settings(stretch=2000)
    stretches = {(x.file, x.offset // 2000) for x in ix.collect()}
    assert W.read(ix, s).rdd.getNumPartitions() == len(stretches) > 20
