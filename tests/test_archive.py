"""SQLite archives, timeline items, and byte decoding."""

import sqlite3

import pytest

from evidara.functions import parsing
from evidara.functions import text as T
from evidara.sources.archive import message_tables, read_archive
from evidara.sources.timeline import one_of_each, parse_timeline, with_items


def archive(path):
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "Message_1" ("Talker" TEXT, "Message" TEXT, "ID" INTEGER, "Create_Time" INTEGER, extra TEXT)')
        db.executemany('INSERT INTO "Message_1" VALUES (?, ?, ?, ?, ?)', [(f"room{i % 3}@chatroom", f"hello {i}" if i % 10 else "  ", i, 1_700_000_000 + i, "x") for i in range(2500)])
        db.execute("CREATE TABLE MSG (chat_id TEXT, body BLOB, msg_id TEXT)")
        db.executemany("INSERT INTO MSG VALUES (?, ?, ?)", [("c", "价格1".encode("gb18030"), "1"), ("c", "plain".encode(), "2"), (None, None, "3")])
        db.execute("CREATE TABLE messages_empty (text TEXT)")
        db.execute("CREATE TABLE contacts (text TEXT)")
        db.execute("INSERT INTO contacts VALUES ('no')")


def test_archives_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "a.db")
    archive(path)
    assert message_tables(path) == [("MSG", 1, 3), ("Message_1", 1, 2500)]
    got = read_archive(spark, [path], rows_per_task=300).collect()
    assert len(got) == 2250 + 2
    one = next(r for r in got if r.content == "hello 7")
    assert (one.conversation_id, one.conversation_type, one.local_id, one.shard_id, one.timestamp.timestamp()) == ("room1@chatroom", "group", "7", "Message_1", 1_700_000_007)
    assert {r.content for r in got if r.shard_id == "MSG"} == {"价格1", "plain"}
    assert read_archive(spark, [path], limit=1).count() == 1  # the first of each table; that of Message_1 is blank
    with sqlite3.connect(str(tmp_path / "b.db")) as db:
        db.execute("CREATE TABLE contacts (text TEXT)")
    with pytest.raises(ValueError):
        read_archive(spark, [str(tmp_path / "b.db")])


def test_timeline_items():
    ok = "<a><TimelineObject><id> 7 </id><username>u</username><createTime>12</createTime><contentDesc>two\n words</contentDesc><ContentObject><contentUrl>http://x</contentUrl></ContentObject><feedKey>k1</feedKey><feedKey> </feedKey></TimelineObject></a>"
    assert parse_timeline(ok) == ("parsed", "7", "u", 12, "two words", "http://x", ["k1"])
    assert [parse_timeline(x)[0] for x in (None, " ", "<a", "<a/>", "<!DOCTYPE a><a/>", "<TimelineObject><id>" + "1" * 300_000 + "</id></TimelineObject>")] == ["empty", "empty", "malformed", "unsupported", "rejected", "rejected"]


def test_copies_of_an_item(spark):
    rows = [("1", "a", 5, "long text", None, ["k2", "k1"], 0), ("1", "b", 5, "long textt", None, ["k3"], 1), ("1", "c", 4, "the longest text of all", None, [], 2), ("2", "d", None, None, None, ["k9"], 3)]
    items = spark.createDataFrame(rows, "id string, author string, at long, text string, link string, keys array<string>, o int")
    best = one_of_each(items, "o")
    assert sorted((r.id, r.author, r["keys"], r.copies) for r in best.collect()) == [("1", "b", ["k1", "k2", "k3"], 3), ("2", "d", ["k9"], 1)]
    got = with_items(spark.createDataFrame([(1, "k1"), (2, "zz"), (3, None)], "i int, key string"), best, "key")
    assert {r.i: (r.item_id, r.orphan) for r in got.collect()} == {1: ("1", False), 2: (None, True), 3: (None, True)}


def test_decoding_chain():
    assert [parsing.decode_bytes(b) for b in (None, b"", "é\0".encode(), "hi".encode("utf-16le"), "价格a".encode("gb18030"), b"\xff\xfe\xfd")] == [None, "", "é", "h\0i", "价格a", ""]


def test_chunks_end_with_a_mark_and_a_space():
    text = "a" * 600 + " 3.14 " + "b" * 200 + ". " + "c" * 500
    assert parsing.chunk(text)[0].endswith("b.") and len(parsing.chunk(text)[0]) == 807
    assert parsing.chunk("a" * 850 + "." + "b" * 300)[0] == "a" * 850 + "." + "b" * 49  # no space: cut at the edge
    assert parsing.chunk("价" * 700 + "。" + "格" * 400)[0] == "价" * 700 + "。"
    assert parsing.chunk("x" * 900) == ["x" * 900] and parsing.chunk(" \n ") == parsing.chunk(None) == []


def test_important_terms():
    assert T.important_terms("the price of tokens", ["token", "price"]) == ["token", "price"]
    assert T.important_terms("一二三四五六七八") == ["一二三四", "三四五六", "五六七八"]
    assert T.important_terms("价格 plan alpha beta") == ["价格", "plan", "alpha"]
    assert T.important_terms("a b cd") == ["cd"] and T.important_terms("") == []


def test_redacted_traces():
    out = parsing.redact_trace('{"n": 3, "x": 4, "s": ["a", "/home/u/f", null, true], "deep": {"a": {"b": 1}}}', frozenset({"n", "s", "deep"}), frozenset({"n"}), depth=2)
    assert '"n":3' in out and "redacted-path" in out and "redacted-text" in out and '"redacted-structure"' in out and '"x"' not in out and "/home" not in out
    assert parsing.redact_trace("no json", frozenset(), frozenset()) is None and parsing.redact_trace(None, frozenset(), frozenset()) is None
