"""Sources and sinks over small files."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np

from pyspark.sql import functions as F

from foliolake.sources import archives, files, scans, tables


def test_masters_come_in_order(spark, tmp_path):
    for job, names in {"a": ["master-10.png", "master-9.png"], "b": ["master.png"]}.items():
        (tmp_path / job).mkdir()
        for n in names:
            (tmp_path / job / n).write_bytes(b"\x89PNG\r\n\x1a\n" + n.encode())
    found = files.masters(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["master-9.png", "master-10.png", "master.png"]
    assert [r.pages for r in files.probed(files.masters(spark, str(tmp_path))).collect()] == [1, 1, 1]


def test_headers_tell_pages():
    tiff = b"II*\0" + (8).to_bytes(4, "little") + b"\0\0" + (14).to_bytes(4, "little") + b"\0\0" + b"\0" * 4
    assert files.pages_in(tiff) == 2
    assert files.pages_in(b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page ") == 2
    assert files.pages_in(b"junk") is None and files.pages_in(None) is None


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, content in {"p10.png": "x", "p2.png": "y", ".hidden.png": "z", "metadata/page_1.json": '{"page_num": 1, "blocks": [{"block_id": "b", "text": "t"}]}', "n.txt": "n"}.items():
            z.writestr(name, content)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    (tmp_path / "b.zip").write_bytes(b"broken")
    members = archives.archives(spark, str(tmp_path))
    assert members.count() == 6
    assert [r.member for r in archives.archived_images(members).orderBy("place").collect()] == ["p2.png", "p10.png"]
    assert files.layouts(members).first().blocks[0].text == "t"


def test_saved_corrections_tell_their_problem(spark):
    rows = [("a", None), ("b", "{broken"), ("c", '{"corrections": [{"page": 1, "line": "L1", "word": 2, "before": "x", "after": "y"}, {"page": 0, "line": "L1", "word": 1, "after": "z"}]}')]
    found = {r.job_id: r for r in files.saved_corrections(spark.createDataFrame(rows, "job_id string, json string")).collect()}
    assert found["a"].problem is None and found["b"].problem == "unreadable"
    assert found["c"].skipped == 1 and [(c.page, c.word, c.after) for c in found["c"].corrections] == [(1, 2, "y")]


def test_upload_problems(spark):
    rows = [("a.png", "image/png", 5, 1), ("a.exe", "image/png", 5, 1), ("a.pdf", "image/png", 5, 1), ("a.pdf", "application/pdf", 5, 2), ("a.jpg", "image/jpeg", 60 << 20, 1), ("a.jpg", "image/jpeg", 0, 1)]
    table = spark.createDataFrame(rows, "name string, mime string, size long, files int")
    assert [r.p for r in table.select(files.upload_problem(*[F.col(c) for c in table.columns]).alias("p")).collect()] == [None, "extension", "type", "document among images", "size", "empty"]


def test_replies_may_be_wrapped(spark):
    table = spark.createDataFrame([('{"a": 1}',), ('Sure: ```json\n{"a": 2}\n```',), ("none",)], "t string")
    assert [r.x.a if r.x else None for r in table.select(files.model_reply(F.col("t"), "a int").alias("x")).collect()] == [1, 2, None]


def test_partitions_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "job int, v string"), path, "job")
    tables.replace_partitions(spark.createDataFrame([(2, "c")], "job int, v string"), path, "job")
    assert sorted((r.job, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    table = spark.read.parquet(path)
    assert sorted(r.v for r in tables.replace_rows(table, spark.createDataFrame([("d", 1)], "v string, job int"), "job").collect()) == ["c", "d"]


def test_no_archive_ends_the_job(spark, tmp_path):
    def packed(*named, kind=zipfile.ZIP_DEFLATED):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", kind) as z:
            for name, content in named:
                z.writestr(name, content)
        return raw.getvalue()

    good = packed(("a.txt", b"a" * 1000), ("b/.c", b"hidden"), ("d.txt", b"d" * 500))
    damaged = bytearray(packed(("a.txt", bytes(range(256)) * 9), ("d.txt", b"d" * 500)))
    damaged[60:90] = b"\xff" * 30
    locked, odd = bytearray(packed(("x", b"x"))), bytearray(packed(("x", b"xyz")))
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    at = odd.index(b"PK\x01\x02")
    odd[at + 10 : at + 12] = odd[8:10] = b"\x63\0"
    lying = bytearray(packed(("x", b"0" * 5000)))
    at = lying.index(b"PK\x01\x02")
    lying[at + 24 : at + 28] = struct.pack("<I", 10)
    rows = [("good", good), ("damaged", bytes(damaged)), ("locked", bytes(locked)), ("odd", bytes(odd)), ("lying", bytes(lying)), ("cut", good[:80]), ("empty", b""), ("null", None), ("bomb", packed(("0", b"0" * 900), ("1", b"1" * 900)))]
    found = archives.members(spark.createDataFrame(rows, "path string, content binary"), most_files=2, most_bytes=1600).collect()
    told = {(r.path, r.member): (r.problem, r.content and len(r.content)) for r in found}
    assert told == {
        ("good", "a.txt"): (None, 1000), ("good", "b/.c"): (None, None), ("good", "d.txt"): ("files", None), ("damaged", "a.txt"): ("bytes", None), ("damaged", "d.txt"): ("bytes", None),
        ("locked", "x"): ("locked", None), ("odd", "x"): ("packing", None), ("lying", "x"): ("damaged", None), ("cut", None): ("archive", None), ("empty", None): ("archive", None), ("null", None): ("archive", None),
        ("bomb", "0"): (None, 900), ("bomb", "1"): ("bytes", None),
    }
    wide = {(r.path, r.member): r.problem for r in archives.members(spark.createDataFrame(rows[1:2], "path string, content binary")).collect()}
    assert wide == {("damaged", "a.txt"): "damaged", ("damaged", "d.txt"): None}


def test_members_of_replies_have_their_places(spark):
    names = ["manifest.json", "metadata/page_001.json", "out/a.md", "out/b.md", "other.bin"]
    table = spark.createDataFrame([("z", k, n) for k, n in enumerate(names)], "path string, place int, member string")
    assert [r.target for r in archives.kept_as(table, "scan", "md").orderBy("place").collect()] == ["raw/manifest.json", "json/page_001.json", "text/scan.md", "text/scan_2.md", None]


def tiff(pages, order="<", packing=1):
    """A file of grey (or colour) pages, each with its directory after its strips."""
    out, last = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for p in pages:
        samples = 1 if p.ndim == 2 else 3
        half, starts, counts = (p.shape[0] + 1) // 2, [], []
        for strip in (p[:half], p[half:]):
            raw = strip.tobytes()
            raw = raw if packing == 1 else zlib.compress(raw) if packing == 8 else b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100))
            starts.append(len(out))
            counts.append(len(raw))
            out += raw
        tables_at = len(out)
        out += struct.pack(order + "4I", *starts, *counts)
        out[last : last + 4] = struct.pack(order + "I", len(out))
        entries = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (259, 3, 1, packing), (262, 3, 1, 1 if samples == 1 else 2), (273, 4, 2, tables_at), (277, 3, 1, samples), (279, 4, 2, tables_at + 8)]
        out += struct.pack(order + "H", len(entries) + 1)
        for tag, kind, n, value in sorted([*entries, (258, 3, 1, 8)]):
            out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        last = len(out)
        out += b"\0" * 4
    return bytes(out)


def test_scans_are_pages_and_bad_files_are_rows(spark, tmp_path):
    r = np.random.default_rng(2)
    grey = [r.integers(0, 256, (9 + k, 7), np.uint8) for k in range(5)]
    colour = r.integers(0, 256, (4, 6, 3), np.uint8)
    (tmp_path / "in").mkdir()
    whole = tiff(grey)
    files_ = {
        "a.tif": whole, "b.tiff": tiff([grey[0], colour], ">", 8), "c.tif": tiff(grey[:1], "<", 32773), "d.pgm": b"P5\n# x\n7 9\n255\n" + grey[0].tobytes(), "e.ppm": b"P6 6 4 255\n" + colour.tobytes(),
        "f.tif": whole[: len(whole) - 3], "g.tif": b"junk", "h.pgm": b"P5 7 9 255\nshort", "i.tif": tiff(grey[:2]).replace(struct.pack("<HHI", 259, 3, 1) + b"\1", struct.pack("<HHI", 259, 3, 1) + b"\5", 1), "j.tif": b"", "k.txt": b"not a page",
    }
    for name, content in files_.items():
        (tmp_path / "in" / name).write_bytes(content)
    scans.register(spark)
    table = spark.read.format("scans").option("path", str(tmp_path / "in")).option("taskBytes", 300).option("taskPages", 2).load()
    found = {(x.path[-5:].lstrip("/"), x.page): x for x in table.collect()}
    pixels = lambda key: np.frombuffer(found[key].gray, np.uint8).reshape(found[key].height, found[key].width)
    assert all((pixels(("a.tif", k + 1)) == g).all() for k, g in enumerate(grey))
    assert (pixels((".tiff", 1)) == grey[0]).all() and (pixels((".tiff", 2)) == scans.to_gray(colour)).all() and (pixels(("e.ppm", 1)) == scans.to_gray(colour)).all()
    assert all((pixels((n, 1)) == grey[0]).all() for n in ("c.tif", "d.pgm"))
    bad = {k: x.problem for k, x in found.items() if x.problem}
    assert set(bad) == {("f.tif", None), ("g.tif", None), ("h.pgm", None), ("i.tif", 1), ("j.tif", None)} and (pixels(("i.tif", 2)) == grey[1]).all()
    assert len(found) == 5 + 2 + 1 + 1 + 1 + 5 + 1
    # five pages of a large file lie in three tasks
    tasks = table.where("path like '%a.tif'").selectExpr("spark_partition_id() as p").distinct().count()
    assert tasks == 3
