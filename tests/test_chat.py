import json

import pytest
from pyspark.sql import functions as F

from gatelane.functions import chat
from gatelane.plans.routing import with_contents

BODIES = [
    ('{"model":"auto","messages":[{"role":"user","content":"hi"}],"temperature":0.7}', True, "auto", 1),
    ('{"model":"auto"}', True, "auto", 0),
    ('{"messages":null,"model":null}', True, "", 0),
    ("{}", True, "", 0),
    ("null", True, "", 0),
    (' {"model":"m"} \n', True, "m", 0),
    ('{"model":"m","messages":[]}', True, "m", 0),
    ('{"model":"m","messages":[null,{"role":null}]}', True, "m", 2),
    ('{"model":"a","model":"b"}', True, "b", 0),
    ('{"model":"m","messages":[{"role":"user","content":"x","extra":{"role":5}}]}', True, "m", 1),
    ('{"model":5}', False, None, 0),
    ('{"model":"m","messages":{}}', False, None, 0),
    ('{"model":"m","messages":"x"}', False, None, 0),
    ('{"model":"m","messages":[{"role":"user","content":["x"]}]}', False, None, 0),
    ('{"model":"m","messages":[{"role":1}]}', False, None, 0),
    ('{"model":"m","messages":["x"]}', False, None, 0),
    ('[{"model":"m"}]', False, None, 0),
    ('"text"', False, None, 0),
    ('{"model":"m"}}', False, None, 0),
    ('{"model":"m"},{}', False, None, 0),
    ('{"model":"m"},0]', False, None, 0),
    ('{"model":"m"},1]', False, None, 0),
    ('{"model":', False, None, 0),
    ("", False, None, 0),
    (None, False, None, 0),
]


def test_strict_request_parse(spark):
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BODIES)], "i int, body string")
    rows = df.select("i", chat.parse_request(F.col("body")).alias("r")).orderBy("i").collect()
    for row, (body, ok, model, n) in zip(rows, BODIES):
        got = (row.r.ok, row.r.model, len(row.r.messages or []))
        assert got == (ok, model, n), body


def test_usage(spark):
    bodies = [
        ('{"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":9}}', (True, 3, 4, 9)),
        ('{"usage":null,"id":"x"}', (True, 0, 0, 0)),
        ('{"usage":{"prompt_tokens":1.5}}', (False, 0, 0, 0)),
        ('{"usage":[],"id":"x"}', (False, 0, 0, 0)),
        ("oops", (False, 0, 0, 0)),
        (None, (False, 0, 0, 0)),
    ]
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(bodies)], "i int, body string")
    rows = df.select("i", chat.parse_usage(F.col("body")).alias("u")).orderBy("i").collect()
    assert [tuple(r.u) for r in rows] == [b[1] for b in bodies]


@pytest.mark.parametrize("messages,user,others,contents,text", [
    ([("user", "a"), ("system", "s"), ("user", "b")], "b", ["s"], ["b", "s"], "b"),
    ([("", "x"), ("system", ""), ("tool", "t")], "", ["", "t"], ["", "t"], " t"),
    ([("User", "x")], "", ["x"], ["x"], "x"),
    ([("user", "a"), ("user", "")], "", [], [], ""),
    ([], "", [], [], ""),
])
def test_contents(spark, messages, user, others, contents, text):
    df = spark.createDataFrame([(messages,)], "messages array<struct<role:string,content:string>>")
    row = with_contents(df).first()
    assert (row.user_content, row.non_user, row.contents, row.text) == (user, others, contents, text)


def test_rewrite(spark):
    body = '{"model":"auto","messages":[{"role":"user","content":"hé \\"q\\""}],"temperature":0.7,"n":[1,{"a":null}]}'
    df = spark.createDataFrame([(body,)], "body string").withColumn("r", chat.parse_request(F.col("body")))
    row = df.select(
        chat.rewrite_request(F.lit("phi4"), F.col("r.messages")).alias("short"),
        chat.rewrite_request_keeping_fields(F.col("body"), F.lit("phi4")).alias("full"),
    ).first()
    given = json.loads(body)
    assert json.loads(row.short) == {"model": "phi4", "messages": given["messages"]}
    assert json.loads(row.full) == {**given, "model": "phi4"}


def test_replies(spark):
    row = spark.range(1).select(
        chat.pii_reply(F.lit("phi4"), F.array(F.lit("US_SSN"), F.lit("AGE")), F.lit(7)).alias("pii"),
        chat.guard_reply(F.lit("jailbreak"), F.lit(0.98765), F.lit(7)).alias("guard"),
        chat.cache_reply(F.lit("{}")).alias("hit"),
    ).first()
    pii, guard = json.loads(row.pii.body), json.loads(row.guard.body)
    assert row.pii.status == 200 and row.pii.headers["x-pii-violation"] == "true"
    assert "information ([US_SSN AGE]) that is not allowed for the 'phi4' model" in pii["choices"][0]["message"]["content"]
    assert pii["id"] == "chatcmpl-pii-violation-7" and list(pii) == sorted(pii)
    assert pii["usage"] == {"completion_tokens": 0, "prompt_tokens": 0, "total_tokens": 0}
    assert guard["model"] == "security-filter" and "confidence: 0.988" in guard["choices"][0]["message"]["content"]
    assert row.guard.headers == {
        "content-type": "application/json", "x-jailbreak-blocked": "true", "x-jailbreak-type": "jailbreak", "x-jailbreak-confidence": "0.988",
    }
    assert row.hit.body == "{}" and row.hit.headers["x-cache-hit"] == "true"


def test_headers(spark):
    df = spark.createDataFrame([({"X-Request-Id": "r1", "Content-Length": "5"},), ({"a": "b"},)], "h map<string,string>")
    rows = df.select(chat.request_id(F.col("h")).alias("id"), chat.drop_content_length(F.col("h")).alias("kept")).collect()
    assert [(r.id, r.kept) for r in rows] == [("r1", {"X-Request-Id": "r1"}), (None, {"a": "b"})]
