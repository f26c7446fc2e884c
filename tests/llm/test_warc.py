"""WARC archives: read back, the same bytes twice, interrupted commits, damage."""

import gzip
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lattica.llm import warc

from .test_audit import sql_rows

BODY = "<p>" + "body " * 30


def pages(n=160):
    out = [(i * 7 - 300, f"http://h{i % 3}.example/{i}?q=é \r\nX: y", f"<html>{'text %d ' % (i % 40) * (i % 40)}</html>") for i in range(n)]
    out += [(None, "http://null.example/", BODY), (None, None, None), (90_000, None, BODY), (90_001, "", BODY), (90_001, "u", BODY), (90_002, "http://x/", ""), (90_003, "http://x/", None), (90_004, "x", "s" * 99), (90_005, "x", "s" * 99), (90_006, "x", "s" * 100), (90_007, "x", "s" * 100)]
    return [*out, out[50], out[50], (5, "http://long.example/", "日" * 400_000)]


def frame(spark, rows=None):
    return spark.createDataFrame(pages() if rows is None else rows, "page_id long, url string, html string")


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        target = first.get(html) if len(body) >= 100 else None
        again = target is not None and (i is None or i > target)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", target if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def archive(spark, folder, df=None, **settings):
    warc.write(frame(spark) if df is None else df, folder, **settings)
    warc.commit(spark, folder)
    return {name: open(f"{folder}/{name}", "rb").read() for name in os.listdir(folder) if name.endswith(".warc.gz")}


def test_every_page_is_read_back(spark):
    got = warc.archived(frame(spark))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(got) == plain(pages()) == sorted(sql_rows(warc.SQL, pages=frame(spark)), key=str)
    clash = frame(spark).withColumns({c: F.lit("x") for c in ("key", "range", "digest", "payload", "refers_to", "size", "first", "place")})
    assert rows_of(warc.archived(clash)) == plain(pages())
    assert rows_of(warc.archived(frame(spark, []))) == []
    assert rows_of(warc.archived(frame(spark, [(None, None, None), (None, "u", BODY)]))) == plain([(None, None, None), (None, "u", BODY)])


def test_the_same_table_gives_the_same_files(spark, tmp_path):
    own = {r[0]: r for r in pages() if r[0] is not None}
    rows = [*own.values()]
    one = archive(spark, str(tmp_path / "a"), frame(spark, rows), least_ranges=30, file_bytes=3000)
    two = archive(spark, str(tmp_path / "b"), frame(spark, rows[::-1]).repartition(7, "url"), least_ranges=30, file_bytes=3000)
    assert one == two and len(one) > 8
    assert len({n.split("-")[0] for n in one}) >= 4  # ranges: one record is larger than all others
    listed = warc.manifest(spark, str(tmp_path / "a")).collect()
    assert {r["name"]: (r["bytes"], r["digest"]) for r in listed} == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in one.items()}
    # Files and what is in them follow the ids.
    found = warc.records(spark, str(tmp_path / "a"), payloads=True).collect()
    ends = sorted((name, min(ids), max(ids)) for name in one for ids in [[r["page_id"] for r in found if r["file"] == name]])
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False))
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"}.items() <= {i: h or "" for i, _, h in rows}.items()
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    # Other readers of gzip see all members as one text.
    text = gzip.decompress(next(iter(one.values())))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_a_header_cannot_be_broken_by_a_url(spark, tmp_path):
    archive(spark, str(tmp_path / "a"))
    urls = [r["url"] for r in warc.records(spark, str(tmp_path / "a")).collect()]
    assert "http://h0.example/0?q=%C3%A9%20%0D%0AX:%20y" in urls and None in urls


def test_what_is_cut_off_can_be_run_again(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write(frame(spark), folder, least_ranges=4)
    with pytest.raises(FileNotFoundError):
        warc.records(spark, folder)
    # A file of an attempt that nobody lists, and some that were renamed before the end.
    first = warc.manifest(spark, folder).first()
    shutil.copy(f"{folder}/{first['pending']}", f"{folder}/pending/00000000-00000-of-another-attempt")
    os.rename(f"{folder}/{first['pending']}", f"{folder}/{first['name']}")
    warc.commit(spark, folder)
    warc.commit(spark, folder)
    assert rows_of(warc.records(spark, folder)) == plain(pages())
    assert not os.path.exists(f"{folder}/pending") and len([n for n in os.listdir(folder) if n.endswith("gz")]) == warc.manifest(spark, folder).count()


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "a")
    files = archive(spark, folder, least_ranges=3)
    name, data = next(iter(files.items()))
    for damaged in (data + data[: len(gzip.compress(b""))], data[:-40], gzip.compress(gzip.decompress(data).replace(b"text", b"tent", 1))):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(damaged)
        with pytest.raises(Exception, match="not the file|within a record|doesn't hold|Error|incorrect"):
            warc.records(spark, folder).count()
    whole = warc.record(3, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    assert warc.parsed(whole).payload == b"x" * 200
    with pytest.raises(ValueError):
        warc.parsed(whole.replace(b"xxx", b"xxy", 1))


def test_one_id_for_a_third_of_the_rows(spark, tmp_path):
    """Equal rows are parted over ranges, and so are rows of one id."""
    rows = [(i, "u", "page %d " % i * 30) for i in range(300)] + [(150, "u", "hot " * 40)] * 150 + [(150, f"v{i}", "hot " * 40) for i in range(50)] + [(160, "w", "hot " * 40)] * 50
    files = archive(spark, str(tmp_path / "a"), frame(spark, rows), least_ranges=20)
    assert len(files) > 10
    assert rows_of(warc.records(spark, str(tmp_path / "a"))) == plain(rows)
    most = max(r["records"] for r in warc.manifest(spark, str(tmp_path / "a")).collect())
    assert most < 100
