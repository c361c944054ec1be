"""Leaves of requests, written by hand."""

from duskloom.sources import wires as W

CHAT = """{"user":"a@b.io","messages":[{"role":"user","name":"ann@x.io","content":[{"type":"text","text":"hi"},{"type":"image_url","image_url":{"url":"https://h.io/a.png"}},{"type":"image_url","image_url":{"url":"data:image/png;base64,aGk="}}]},
{"role":"assistant","content":null,"tool_calls":[{"id":"1","function":{"name":"ls","arguments":"{}"}}]},{"role":"tool","tool_call_id":"t-1","content":"out"},{"role":"user","tool_call_id":"t-2","content":"x"}]}"""
RESPONSES = """{"user":"a@b.io","input":"hello","metadata":{"note":"to c@d.io","n":1,"deep":{"list":["x",{"y":"z"}]}}}"""


def rows(frame):
    return sorted((r.id, r.leaf, r.surface, r.text) for r in frame.collect())


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, body string")


def test_chat(spark):
    assert rows(W.chat_leaves(bodies(spark, CHAT, '{"messages":[]}', "no json", None), "id", "body")) == [
        (0, "/messages/0/content", "user_message", "hi"), (0, "/messages/0/content", "user_message", "https://h.io/a.png"), (0, "/messages/0/name", "user_message", "ann@x.io"), (0, "/messages/1/tool_calls/0", "tool_use_input", "{}"),
        (0, "/messages/1/tool_calls/0/name", "tool_name", "ls"), (0, "/messages/2/content", "tool_result", "out"), (0, "/messages/2/tool_call_id", "tool_result", "t-1"), (0, "/messages/3/content", "user_message", "x"),
    ]


def test_responses(spark):
    assert rows(W.responses_leaves(bodies(spark, RESPONSES, "{}", None, '{"metadata":null}'), "id", "body")) == [
        (0, "/input", "user_message", "hello"), (0, "/metadata.deep.list[0]", "user_message", "x"), (0, "/metadata.deep.list[1].y", "user_message", "z"), (0, "/metadata.note", "user_message", "to c@d.io"),
    ]
