import base64
import hashlib
from collections import Counter

from pyspark.sql import functions as F

import pytest

from lexirank.llm import warc
from lexirank.llm.warc import read_warc, warc_round_trip, write_warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 70_000, FAKE, "x" + FAKE * 3, "WARC/1.1\r\n", "\r\n\r\n", "<p>a</p>", "tail\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://x/{i}\r\n", h, "extra") for i, h in enumerate(html)] + [(4, None, "é" * 70_000, "extra"), (None, "u", "only null", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = warc_round_trip(pages.repartition(3)).collect()
    groups = {}
    for i, _, h, _ in rows:
        groups.setdefault(h or "", []).append(i)
    want = Counter()
    for i, _, h, _ in rows:
        body = (h or "").encode()
        win = max((x for x in groups[h or ""] if x is not None), default=None)
        again = win is not None and i != win
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", win if again else None] += 1
    assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got) == want


def test_many_ranges(spark, tmp_path):
    """Records and false magic across the bounds of small byte ranges."""
    rows = [(i, "u", (FAKE if i % 4 == 0 else "p" * (i * 37 % 900)) + f"<{i}>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    write_warc(pages, str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w"), split_bytes=2048)
    assert sorted(x["page_id"] for x in got.collect()) == list(range(300))


def test_small_payloads_may_be_exempt(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    write_warc(pages, str(tmp_path / "w"), min_payload=3)
    got = {x["page_id"]: x["record_type"] for x in read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_digest_is_base32(spark):
    from lexirank.llm.warc import base32

    got = spark.createDataFrame([("abc",)], "t string").select(base32(F.sha1(F.col("t").cast("binary"))).alias("d")).first()["d"]
    assert got == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_long_urls(spark, tmp_path):
    """Headers longer than the first read, than a range, and of a false record that never ends."""
    urls = {3: "http://x/" + "u" * 70_000, 7: "é" * 150_000, 8: "v" * (1 << 16)}
    html = {5: "WARC/1.1\r\nName: " + "x" * 200_000, 6: "WARC/1.1\r\n" * 3 + "y" * 100_000}
    rows = [(i, urls.get(i, f"http://x/{i}"), html.get(i, f"<p>{i}</p>")) for i in range(12)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for split in (4 << 20, 50_000):
        got = {x["page_id"]: x["payload_bytes"] for x in read_warc(spark, str(tmp_path / "w"), split_bytes=split).collect()}
        assert got == {i: len(h.encode()) for i, _, h in rows}


def test_long_url_across_ranges(spark, tmp_path):
    """A url of a megabyte spans many ranges; no record after it is lost."""
    rows = [(i, "http://x/" + "u" * (1_000_000 if i in (2, 9) else 20), f"<p>{i}</p>" * (i % 5)) for i in range(20)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for split in (4 << 20, 100_000):
        got = {x["page_id"]: x["payload_bytes"] for x in read_warc(spark, str(tmp_path / "w"), split_bytes=split).collect()}
        assert got == {i: len(h) for i, _, h in rows}


def test_damage_is_an_error(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>") for i in range(50)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*"))
    whole = file.read_bytes()
    for cut in (whole[:-3], whole.replace(b"<p>9</p>", b"<p>9</p"), b"x" + whole):
        file.write_bytes(cut)
        (tmp_path / "w" / f".{file.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match="do not reach"):
            read_warc(spark, str(tmp_path / "w"))
    file.write_bytes(whole[:-3])
    assert read_warc(spark, str(tmp_path / "w"), strict=False).count() == 49


@pytest.mark.parametrize("most", [0, 100_000])
def test_many_groups_of_copies(spark, tmp_path, monkeypatch, most):
    """Beyond the bound for broadcasting, hot payloads are still told apart, and the result is the same."""
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", most)
    rows = [(i, "u", "" if i % 3 == 0 else f"<{i % 40}>" if i % 3 == 1 else f"<<{i}>>") for i in range(600)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    last = {h: i for i, _, h in rows}
    assert {x["page_id"]: x["refers_to"] for x in read_warc(spark, str(tmp_path / "w")).collect()} == {i: None if last[h] == i else last[h] for i, _, h in rows}
