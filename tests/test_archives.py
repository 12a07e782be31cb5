import json
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.plans import dialogue, rewrite, selection, validation
from tessera.sources import layout, lz4block, records
from tessera.sources.catalog import Catalog, extract, listed, read_files, scan, strict_blobs, with_local, write_archives


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.integers(1, 40))
def test_lz4_round_trip(data, times):
    data *= times
    packed = lz4block.encode(data)
    assert lz4block.decode(packed, len(data)) == data
    for wrong in (len(data) - 1, len(data) + 1):
        if wrong >= 0:
            with pytest.raises(ValueError):
                lz4block.decode(packed, wrong)


FILES = [("a/b/x.wem", b"hello" * 1000), ("a/y.bnk", b""), ("z.txt", b"q"), ("a/b/big.bin", random.Random(3).randbytes(70_000) + bytes(90_000))]


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pack")
    toc, blob = layout.pack_archive(FILES, "one.rmdblob", 77, {"a/y.bnk": (7, [1, -2])}, chunk_size=1 << 14)
    (root / "one.rmdtoc").write_bytes(toc)
    (root / "one.rmdblob").write_bytes(blob)
    return root, Catalog.save(scan(spark, str(root)), str(root / "catalog")), toc


def test_scan_and_read(spark, packed):
    root, c, _ = packed
    assert {r.full_name: r.total_size for r in c.file.collect()} == {n: len(b) for n, b in FILES}
    blobs = c.blobs(spark, str(root))
    got = {r.full_name: bytes(r.content) for r in read_files(c, blobs, c.file).collect()}
    assert got == dict(FILES)
    part = {r.full_name: bytes(r.content) for r in read_files(c, blobs, c.file, F.lit(60_000), F.lit(30_000)).collect()}
    assert part == {n: b[60_000:90_000] for n, b in FILES}
    assert c.info().count() == 4 and c.resource([".bnk"]).first().deps == [1, -2]


def test_no_violations_and_accounts(spark, packed):
    root, c, toc = packed
    assert validation.violations(c).collect() == []
    assert sum(r.n_violations for r in validation.report(c).collect()) == 0
    assert validation.summary(c).first().file_bytes == sum(len(b) for _, b in FILES)
    assert sum(r.n_bytes for r in validation.logical_accounting(c).collect()) == len(layout.Toc(toc).image)
    assert [r.gaps for r in validation.physical_accounting(c, c.blobs(spark, str(root))).collect()] == [0]


def test_strict_reports_and_local_tree(spark, packed, tmp_path):
    root, c, toc = packed
    assert [r.problem for r in strict_blobs(c, spark, str(root)).collect()] == [None]
    for k, (name, blob) in enumerate({"short": b"x" * 9, "other": (root / "one.rmdblob").read_bytes()[:8] + b"\1" * 8 + (root / "one.rmdblob").read_bytes()[16:]}.items()):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.rmdtoc").write_bytes(toc)
        (tmp_path / name / "one.rmdblob").write_bytes(blob)
        other = Catalog.save(scan(spark, str(tmp_path / name)), str(tmp_path / f"c{k}"))
        assert [r.problem for r in strict_blobs(other, spark, str(tmp_path / name)).collect()] == [["size", "identity"][k]]
    assert [r.n_passed for r in validation.report(c).collect()] == [1] * len(validation.GROUPS) and len(validation.report_text(c)) == len(validation.GROUPS)
    assert validation.root_mismatches(c).count() == 0 and [r.name for r in validation.type_names(c).collect()] == sorted([layout.FILE_INFO, layout.RESOURCE])
    (tmp_path / "gaps").mkdir()
    (tmp_path / "gaps" / "x.rmdtoc").write_bytes(toc + b"\0\0\0ab")
    assert tuple(validation.toc_accounting(listed(spark, str(tmp_path / "gaps"))).first())[1:] == (len(toc) + 5, len(toc), 3, 2)
    assert scan(spark, [str(root), f"{root}/*.rmdtoc"]).count() == 1
    with pytest.raises(Exception, match="magic"):
        (tmp_path / "gaps" / "y.rmdtoc").write_bytes(b"\1" + toc[1:])
        scan(spark, str(tmp_path / "gaps"), asserting=True).collect()
    shown = {r.full_name: json.loads(r.json) for r in validation.file_json(c).collect()}
    assert shown["a/y.bnk"] == {"fullname": "a/y.bnk", "total_size": 0, "primary_id": 7, "crc32": 0, "nchunks": 0, "sections": [layout.FILE_INFO, layout.RESOURCE]}
    (tmp_path / "tree" / "a").mkdir(parents=True)
    (tmp_path / "tree" / "a" / "y.bnk").write_bytes(b"mine")
    content = spark.createDataFrame([("data/a/y.bnk", b"old"), ("data/b", b"kept")], "full_name string, content binary")
    assert {r.full_name: bytes(r.content) for r in with_local(content, spark, str(tmp_path / "tree")).collect()} == {"data/a/y.bnk": b"mine", "data/b": b"kept"}


def test_extract_guards_names(spark, packed, tmp_path):
    root, c, _ = packed
    content = read_files(c, c.blobs(spark, str(root)), c.file)
    bad = content.limit(1).withColumn("full_name", F.lit("../evil"))
    states = {r.full_name: r.state for r in extract(content.union(bad), str(tmp_path)).collect()}
    assert states.pop("../evil") == "unsafe name" and set(states.values()) == {"written"}
    assert (tmp_path / "a/b/x.wem").read_bytes() == FILES[0][1]
    strict = content.join(c.file.select("file_idx", "total_size"), "file_idx").join(c.info().select("file_idx", "info_crc32"), "file_idx").join(c.meta().select("file_idx", "meta"), "file_idx")
    wrong = strict.withColumn("info_crc32", F.when(F.col("full_name") == "z.txt", F.lit(1)).otherwise(F.col("info_crc32"))).withColumn("total_size", F.when(F.col("full_name") == "a/y.bnk", F.lit(9)).otherwise(F.col("total_size")))
    states = {r.full_name: r.state for r in extract(wrong, str(tmp_path / "strict")).collect()}
    assert states == {"a/b/x.wem": "written", "a/b/big.bin": "written", "z.txt": "checksum differs", "a/y.bnk": "size differs"} and not (tmp_path / "strict/z.txt").exists()
    toc = layout.Toc((root / "one.rmdtoc").read_bytes())
    f = toc.files[[toc.text(int(x["name_off"]), int(x["name_len"])) for x in toc.files].index("x.wem")]
    at = toc.header["metadata_off"] + int(f["meta_rel"])
    assert (tmp_path / "strict/a/b/x.wem.meta").read_bytes() == toc.image[at : at + int(f["meta_size"])]


def test_write_archives_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", bytes([i]) * 1000) for i in range(10)], "name string, content binary").coalesce(1)
    assert sorted(r.n_files for r in write_archives(rows, "name", "content", str(tmp_path / "a"), 3000).collect()) == [1, 3, 3, 3]
    c = Catalog.save(scan(spark, str(tmp_path / "a")), str(tmp_path / "c"))
    got = {r.full_name: bytes(r.content) for r in read_files(c, c.blobs(spark, str(tmp_path / "a")), c.file).collect()}
    assert got == {f"f{i}": bytes([i]) * 1000 for i in range(10)}
    (tmp_path / "a" / "part-00000-0000.rmdblob").unlink()
    assert sum(r.error == "the blob is missing" for r in read_files(c, c.blobs(spark, str(tmp_path / "a")), c.file).collect()) == 3


def test_write_archives_holds_records_only(spark, tmp_path, monkeypatch):
    """Content goes into the blob as it comes, and an archive has a most number of files."""
    import tracemalloc

    import pyarrow as pa
    import pyspark

    class Caught:
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: lambda batches: list(f(batches))  # noqa: E731, N815
        mapInPandas = lambda self, f, _: lambda batches: list(f(b.to_pandas() for b in batches))  # noqa: E731, N815

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    rng = random.Random(4)
    batches = (pa.RecordBatch.from_arrays([pa.array([f"d/{k}"]), pa.array([rng.randbytes(1 << 20)])], ["name", "content"]) for k in range(48))
    run = write_archives(Caught(), "name", "content", str(tmp_path / "big"))
    tracemalloc.start()
    run(batches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    rows = spark.range(25).selectExpr("concat('d', id % 2, '/', id) AS name", "cast(id AS string) AS content").selectExpr("name", "cast(content AS binary) AS content").coalesce(1)
    assert sorted(r.n_files for r in write_archives(rows, "name", "content", str(tmp_path / "a"), most_files=10).collect()) == [5, 10, 10]
    c = Catalog.save(scan(spark, str(tmp_path / "a")), str(tmp_path / "c"))
    assert not validation.violations(c).count()
    got = {r.full_name: bytes(r.content) for r in read_files(c, c.blobs(spark, str(tmp_path / "a")), c.file).collect()}
    assert got == {f"d{k % 2}/{k}": str(k).encode() for k in range(25)}


def test_bank_objects(spark):
    bank = b"HIRC" + struct.pack("<II", 4 + 2 * 9, 2) + (b"\x0a" + struct.pack("<I", 4) + b"abcd") * 2
    df = spark.createDataFrame([("b", bank), ("none", None)], "full_name string, content binary")
    assert [tuple(r) for r in selection.bank_objects(df).collect()] == [("b", 10, 2)]


def _broken(toc, change):
    raw = bytearray(layout.pack_archive(FILES, "one.rmdblob", 77, compress=False)[0])
    change(raw)
    return bytes(raw)


BASE = layout.HEADER_SIZE + 16


def _word(raw, name):
    return struct.unpack_from("<I", raw, 4 * layout.HEADER_WORDS.index(name))[0]


def _set(section, record, field_at, value, size=4):
    def change(raw):
        at = BASE + _word(raw, f"{section}_off") + record + field_at
        raw[at : at + size] = value.to_bytes(size, "little")

    return change


def _header(name, value):
    def change(raw):
        struct.pack_into("<I", raw, 4 * layout.HEADER_WORDS.index(name), value)

    return change


CASES = [
    (_header("magic", 1), "magic"), (_header("version", 4), "version"), (_header("reserved_1", 9), "reserved words are zero"), (_header("table_size", 17), "table is whole descriptors"),
    (_header("files_count", 1 << 20), "files fit the image"), (lambda raw: raw.__setitem__(layout.HEADER_SIZE, 0), "descriptor marks"),
    (_set("paths", 0x1C, 0, 500), "parent exists"), (_set("paths", 0, 0x8, 900), "child range exists"), (_set("paths", 0, 0x10, 900), "file range exists"),
    (_set("paths", 0x1C, 0, 0xFFFFFFFF), "one root"), (_set("files", 0, 0, 8), "whole chunk records"), (_set("files", 0, 8, 77), "path exists"), (_set("files", 0, 8, 1), "file names the path that holds it"),
    (_set("files", 0, 0x14, 12345), "chunks add up to the size"), (_set("files", 0, 0x18, 1 << 20), "metadata range exists"), (_set("files", 0x20, 0, 1 << 20), "chunk range exists"),
    (_set("chunks", 0, 0, 0x10, 1), "flags fit the sizes"), (_set("chunks", 0, 1, 9, 1), "archive exists"), (_set("chunks", 0, 2, 1, 1), "reserved byte is zero"),
    (_set("archives", 0, 0x10, 3), "blob holds its header"), (_set("metadata", 0, 0, 7), "magic"), (_set("files", 0, 12, 1 << 24), "text lies in the pool"),
]


def test_each_rule_is_reported(spark, tmp_path):
    for i, (change, _) in enumerate(CASES):
        (tmp_path / f"{i:03}.rmdtoc").write_bytes(_broken(None, change))
    c = Catalog.save(scan(spark, str(tmp_path)), str(tmp_path / "catalog"))
    found = {}
    for r in validation.violations(c).collect():
        found.setdefault(r.toc_id, set()).add(r.rule)
    for i, (_, rule) in enumerate(CASES):
        assert rule in found.get(i, ()), (i, rule, found.get(i))


def test_garbage_never_raises():
    rng = random.Random(5)
    toc = layout.pack_archive(FILES, "b", 1)[0]
    for _ in range(200):
        raw = bytearray(toc[: rng.randrange(len(toc) + 1)])
        for _ in range(rng.randrange(6)):
            if raw:
                raw[rng.randrange(min(len(raw), 200))] = rng.randrange(256)
        layout.names_of(layout.Toc(bytes(raw)))


def test_records_round_trip():
    table = [("k", "wörld 😀"), ("", "")]
    assert records.string_table(records.write_string_table(table)) == table
    rid = lambda v: records.marker_object(records.KEY_ID, b"\0" * 4 + v.to_bytes(8, "little", signed=True))
    line = b"\x13\0\0\0" + struct.pack("<I", 3) + b"key" + struct.pack("<qq", 11, 5) + bytes([0, 0, 0, 0, 1, 0]) + rid(99) + rid(-1) + struct.pack("<BfB", 1, 0.5, 2)
    raw = bytes(0x20) + struct.pack("<II", 1, 0) + struct.pack("<q", 42) + b"junk" + records.marker_object(records.KEY_LINE, line)
    (got,) = records.dialogue_lines(raw)
    assert (got["line_id"], got["string_key"], got["string_id"], got["type_id"], got["wem_id"], got["anim_id"], got["post"]["pause"]) == (42, "key", 11, 5, 99, -1, 0.5)
    said = struct.pack("<I", 0) + struct.pack("<I", 2) + b"hi" + struct.pack("<I", 3) + b"bob"
    side = bytes(0x10) + struct.pack("<II", 1, 0) + struct.pack("<q", 11) + records.marker_object(records.KEY_TEXT, said)
    assert records.dialogue_texts(side) == [{"ord": 0, "string_id": 11, "text": "hi", "speaker": "bob"}]
    base = struct.pack("<II", 9, 1) + b"n" + struct.pack("<iiiI", 1, 30, 0, 45) + b"\0" + struct.pack("<I", 4) + b"guid"
    event = records.marker_object(0xAAB3C695, records.marker_object(records.KEY_EVENT_BASE, base) + records.marker_object(0x7378CA33, rid(99) + rid(-1)))
    (ev,) = records.timeline(records.marker_object(records.KEY_TRACK, records.marker_object(1, event)))
    assert (ev["cls"], ev["start"], ev["duration"], ev["guid"], ev["track"], ev["refs"]) == ("DialogueTimelineEvent", 30, 45, "guid", 1, [{"kind": "sound_external_source", "id": 99}])
    bank = b"BKHD" + struct.pack("<III", 8, 140, 7) + b"HIRC" + struct.pack("<II", 4 + 2 * 9, 2) + (b"\x0a" + struct.pack("<I", 4) + b"abcd") * 2
    assert records.bank(bank) == {"version": 140, "bank_id": 7, "types": {10: 2}}
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHII", 12, 1, 2, 48000, 96000) + b"data" + struct.pack("<I", 48000)
    assert records.riff(wav)["seconds"] == 0.5
    assert records.printable_strings(b"xx" + struct.pack("<I", 3) + b"abc", 0, 9) == ["abc"]


def test_dialogue_join(spark):
    line = spark.createDataFrame([("d/a.bin", 0, 1, "k", 11, 5, [0], 99, None, None), ("d/a.bin", 1, 2, "none", 12, 6, [0], -1, None, None)], dialogue.LINE)
    text = spark.createDataFrame([("d/a_strings.bin", 0, 11, "old", "x"), ("d/a_strings.bin", 1, 11, "hi", "bob")], dialogue.TEXT)
    string = spark.createDataFrame([("t", 0, "k", "[0-1]sub")], dialogue.STRING)
    kind = spark.createDataFrame([("t", 5, 3, "talk")], dialogue.TYPE)
    event = spark.createDataFrame([("tl", 1, "c", 0, "n", 0, 60, 30, "g", [("s", 99)]), ("tl", 0, "c", 0, "n", 0, 30, 30, "g", [("s", 99)])], dialogue.EVENT)
    joined = dialogue.timed(dialogue.join_lines(line, text, string, kind), event)
    got = {r.line_ord: r for r in joined.collect()}
    assert (got[0].text, got[0].speaker, got[0].subtitle, got[0].type_name, got[0].start_s) == ("hi", "bob", "[0-1]sub", "talk", 1.0)
    assert got[1].text is None and got[1].start_s is None
    assert dialogue.subtitles(joined).first().srt == "1\n00:00:01,000 --> 00:00:02,000\nsub\n\n"
    assert dialogue.documents(joined).first().n_text == 1
    conv = spark.createDataFrame([("con_mq1_s0001_g001",), ("loose",), ("path",)], "conv string")
    entity = spark.createDataFrame([("path", 0, "a/quests/zed/x")], "conv string, ord int, entity_path string")
    fact = spark.createDataFrame([("loose", 0, "quests/a/1"), ("loose", 1, "quests/b/1"), ("loose", 2, "quests/b/2")], "conv string, ord int, fact string")
    assert {r.conv: (r.quest, r.quest_source) for r in dialogue.quests(conv, entity, fact).collect()} == {"con_mq1_s0001_g001": ("mq1", "conversation-id"), "loose": ("b", "facts"), "path": ("zed", "entity-path")}


def test_audio_selection(spark):
    res = spark.createDataFrame([
        ("e/mus_a.sndevent", 0, 100, [200]), ("b/mus_a.bnk", 1, 200, [300, 201]), ("b/other.bnk", 2, 201, [301]), ("b/init.bnk", 3, 202, [302]),
        ("m/1.wem", 4, 300, []), ("m/2.wem", 5, 301, []), ("m/3.wem", 6, 302, []), ("b/amb_x.bnk", 7, 203, [301, 202]),
    ], "full_name string, ord int, primary_id long, deps array<bigint>")
    sizes = spark.createDataFrame([("m/1.wem", 10), ("m/2.wem", 20), ("m/3.wem", 30)], "full_name string, total_size long")
    got = [(r.category, r.label, r.media, r.other_labels) for r in selection.select_audio(res, sizes).collect()]
    assert got == [("music", "mus_a", "m/1.wem", ""), ("music", "mus_a", "m/2.wem", "amb_x")]
    assert [r.media for r in selection.select_audio(res, sizes, min_size=10).collect()] == ["m/2.wem"]
    with pytest.raises(ValueError):
        selection.select_audio(res, sizes, wanted=["nope"])


def test_audio_selection_knows_object_types_and_the_general_bank(spark):
    res = spark.createDataFrame([
        ("e/env_boss.sndevent", 0, 100, [200]), ("b/bankx.bnk", 1, 200, [300]), ("b/init.bnk", 2, 202, [302]), ("m/1.wem", 3, 300, []), ("m/3.wem", 4, 302, []),
    ], "full_name string, ord int, primary_id long, deps array<bigint>")
    sizes = spark.createDataFrame([("m/1.wem", 10), ("m/3.wem", 30)], "full_name string, total_size long")
    types = spark.createDataFrame([("b/bankx.bnk", [10]), ("b/init.bnk", [10])], "full_name string, types array<int>")
    selected = selection.select_audio(res, sizes, types)
    assert [(r.category, r.label, r.media) for r in selected.collect()] == [("music", "env_boss", "m/1.wem")]
    info = spark.createDataFrame([("m/1.wem", 1.5)], "full_name string, seconds double")
    assert [tuple(r) for r in selection.manifest(selected, info).collect()] == [("music", "env_boss", "bankx", "1", 10, "music/env_boss/1.wem", "1.5", "bankx")]


def test_rewrite_keeps_ids_and_dependencies(tmp_path):
    rewrite.rewrite_archive(FILES, {"z.txt": b"new"}, str(tmp_path / "two"), "two.rmdblob", 5, {"a/y.bnk": (7, [1, -2])})
    toc = layout.Toc((tmp_path / "two.rmdtoc").read_bytes())
    bodies = {i: [b for _, _, b in toc.metadata(int(f["meta_rel"]), int(f["meta_size"]))] for i, f in enumerate(toc.files)}
    assert (7, [1, -2]) in [layout.resource(b[1]) for b in bodies.values()]


def test_patch_in_place(spark, tmp_path):
    toc, blob = layout.pack_archive(FILES, "one.rmdblob", 77, {"a/y.bnk": (7, [1, -2])}, chunk_size=1 << 14)
    (tmp_path / "one.rmdtoc").write_bytes(toc)
    (tmp_path / "one.rmdblob").write_bytes(blob)
    names = {r.full_name: r.file_idx for r in Catalog.save(scan(spark, str(tmp_path)), str(tmp_path / "c0")).file.collect()}
    new = {"z.txt": b"longer text", "a/b/big.bin": random.Random(4).randbytes(159_999)}
    got = rewrite.patch_in_place(str(tmp_path / "one.rmdtoc"), str(tmp_path / "one.rmdblob"), {names[n]: b for n, b in new.items()}, 1 << 14)
    assert [c["new_size"] for c in got["changes"]] == [len(new[n]) for n in sorted(new, key=names.get)] and (tmp_path / "one.rmdtoc.bak").read_bytes() == toc
    c = Catalog.save(scan(spark, str(tmp_path)), str(tmp_path / "c1"))
    assert validation.violations(c).collect() == [] and c.resource([".bnk"]).first().deps == [1, -2]
    files = read_files(c, c.blobs(spark, str(tmp_path)), c.file).join(c.info(), ["toc_id", "file_idx"]).collect()
    assert {r.full_name: bytes(r.content) for r in files} == dict(FILES) | new and all(r.crc32 == r.info_crc32 for r in files)
    with pytest.raises(ValueError):
        rewrite.patch_in_place(str(tmp_path / "one.rmdtoc"), str(tmp_path / "one.rmdblob"), {names["z.txt"]: bytes(1 << 15)}, 1 << 14)


def test_sweeps_match_plain_loops():
    rng = random.Random(6)
    for _ in range(60):
        raw = bytes(rng.choice(b"\0\0\0\1\2\3ab ") for _ in range(rng.randrange(120)))
        want, at = [], 3
        while at + 5 <= len(raw):
            size = int.from_bytes(raw[at : at + 4], "little")
            body = raw[at + 4 : at + 4 + size]
            if 1 <= size <= 300 and len(body) == size and all(32 <= x < 127 for x in body):
                want.append(body.decode())
                at += 4 + size
            else:
                at += 1
        assert records.printable_strings(raw, 3, len(raw)) == want
        ids = {int.from_bytes(raw[k : k + 8], "little", signed=True) for k in range(0, max(len(raw) - 7, 0), 5)}
        hits = [(k, v) for k in range(2, len(raw) - 7) if (v := int.from_bytes(raw[k : k + 8], "little", signed=True)) in ids]
        assert records.id_hits(raw, 2, len(raw), np.array(sorted(ids), np.int64)) == hits


def test_u40():
    assert layout.wide(np.frombuffer(b"\1\0\0\0\x80", "u1").reshape(1, 5)).tolist() == [(0x80 << 32) + 1]
