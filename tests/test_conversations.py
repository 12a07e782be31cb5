import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import conversations as c
from tessera.plans import dialogue

A, B = "data/dialogue/lines/con_mq1_s0001_g001/sequence_1.bin", "data/dialogue/lines/con_mq1_s0001_g001/sequence_2.bin"


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame([(A,), (B,), ("data/dialogue/lines/chatter/sequence_10.bin",), ("data/dialogue/lines/sys_dialogue_x.bin",), ("data/dialogue/lines/a/b/sequence_1.bin",), ("a/locale/de/1.wem",), ("x/Y.WEM",)], "full_name string")
    ids = spark.createDataFrame([(1, A), (2, B), (50, "a/locale/en/1.wem"), (51, "a/locale/en/2.wem"), (60, "anim/x")], "id long, name string")
    ref = lambda *pairs: [{"kind": kind, "id": i} for kind, i in pairs]
    event = spark.createDataFrame([
        ("t2", 0, "DialogueTimelineEvent", 0, "n", 0, 90, 30, "g0", ref(("dialogue", 1), ("sound_external_source", 50))),
        ("t1", 3, "DialogueTimelineEvent", 0, "n", 0, 60, 30, "g1", ref(("dialogue", 1), ("dialogue", 1), ("sound_external_source", 50))),
        ("t1", 1, "DialogueTimelineEvent", 0, "n", 0, 30, 30, "g2", ref(("dialogue", 2), ("sound_external_source", 50))),
        ("t1", 0, "SoundTimelineEvent", 0, "n", 0, 0, 30, "g3", ref(("dialogue", 1), ("sound_external_source", 50))),
        ("t3", 0, "DialogueTimelineEvent", 0, "n", 0, 0, 30, "g4", ref(("dialogue", 77))),
    ], dialogue.EVENT)
    return files, ids, c.sequence_events(event, ids)


def test_files_and_types(spark, world):
    files, _, _ = world
    got = {r.full_name: (r.conv, r.number, r.side) for r in c.sequences(files).collect()}
    assert set(got) == {A, B, "data/dialogue/lines/chatter/sequence_10.bin"} and got[A] == ("con_mq1_s0001_g001", "1", "data/dialogue/locale/en/con_mq1_s0001_g001/sequence_1strings.bin")
    assert [r.conv for r in c.sequences(files, "hatt").collect()] == ["chatter"]
    assert [(r.name, r.side) for r in c.systemic(files, lang="de").collect()] == [("sys_dialogue_x", "data/dialogue/locale/de/sys_dialogue_xstrings.bin")]
    assert c.wanted_types(files, ["wem"]).count() == 2 and c.wanted_types(files, [".BIN", "wem"]).count() == 7 and c.wanted_types(files, ["All"]).count() == 7
    with pytest.raises(ValueError):
        c.wanted_types(files, [" "])


def test_sequences_timelines_and_graphs(spark, world):
    files, _, events = world
    assert {r.sequence: r.timelines for r in c.sequence_timelines(events).collect()} == {A: ["t1", "t2"], B: ["t1"]}
    graph = spark.createDataFrame([("b2", 0, "t1"), ("b1", 5, "t2"), ("b1", 4, "t1"), ("b1", 4, "t2"), ("b9", 0, "t3")], "full_name string, instance int, timeline string")
    got = c.conversation_graphs(c.sequences(files), events, graph).orderBy("ord").collect()
    assert [(r.bundle, r.instance) for r in got] == [("b1", 4), ("b2", 0), ("b1", 5)]


def test_lines_index_and_documents(spark, world, tmp_path):
    files, ids, events = world
    line = spark.createDataFrame([(A, 0, 7, "k", 5, "talk", 2, [0], 50, 60, None, "Grüße", "bob", "[0-1]sub"), (A, 1, 8, "k2", 5, None, None, [0], 51, -1, None, None, None, None), (B, 0, 9, "k3", 5, None, None, [0], 50, None, None, "b", None, "")],
        "full_name string, line_ord int, line_id long, string_key string, type_id long, type_name string, type_priority long, flags array<int>, wem_id long, anim_id long, post struct<first:int>, text string, speaker string, subtitle string")
    full = c.timed_in_sequence(c.voiced(line, ids, files, "de"), events)
    got = {(r.full_name, r.line_ord): r for r in full.collect()}
    assert (got[A, 0].timeline, got[A, 0].start_s, got[A, 0].guid, got[A, 0].wem, got[A, 0].animation) == ("t1", 2.0, "g1", "a/locale/de/1.wem", "anim/x")
    assert (got[A, 1].timeline, got[A, 1].wem, got[A, 1].animation) == (None, "a/locale/en/2.wem", None) and got[B, 0].start_s == 1.0
    sequence = c.sequences(files)
    quest = spark.createDataFrame([("con_mq1_s0001_g001", "mq1", "conversation-id"), ("chatter", None, None)], "conv string, quest string, quest_source string")
    graphs = spark.createDataFrame([("con_mq1_s0001_g001", 0), ("con_mq1_s0001_g001", 1)], "conv string, ord int")
    index = c.index(sequence, full, quest, graphs)
    assert {tuple(r) for r in index.collect()} == {("con_mq1_s0001_g001", "mq1", "conversation-id", 2, 3, 3, 2, 2, "quests/mq1/con_mq1_s0001_g001"), ("chatter", None, None, 1, 0, 0, 0, 0, "loose/chatter/chatter")}
    assert tuple(c.totals(index).first()) == (2, 1, 1, 1)
    written = {r.path: r.n_bytes for r in c.write_documents(c.documents(sequence, full, events, quest), str(tmp_path)).collect()}
    assert set(written) == {"quests/mq1/quest.json", "quests/mq1/con_mq1_s0001_g001/conversation.json", "quests/mq1/con_mq1_s0001_g001/sequence_1.srt", "quests/mq1/con_mq1_s0001_g001/sequence_2.srt", "loose/chatter/chatter/conversation.json"}
    doc = json.loads((tmp_path / "quests/mq1/con_mq1_s0001_g001/conversation.json").read_text())
    assert [s["sequence"] for s in doc["sequences"]] == [A, B] and doc["sequences"][0]["timelines"] == ["t1", "t2"] and doc["quest"] == "mq1"
    first, second = doc["sequences"][0]["lines"]
    assert (first["index"], first["line_id"], first["text"], first["start_s"], first["audio_file"]) == (0, "0x0000000000000007", "Grüße", 2.0, "audio/1.wem")
    assert "timeline" not in second and second["text"] is None and second["index"] == 1
    assert json.loads((tmp_path / "quests/mq1/quest.json").read_text()) == {"quest": "mq1", "conversations": ["con_mq1_s0001_g001"]}
    c.write_index(index, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).where(F.col("quest").isNull()).first().conversation == "chatter"
