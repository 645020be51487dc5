"""Values that their keys tell about, and text that tags run through."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scrubline.functions import context
from scrubline.operators.redact import INLINE, TAG, Redactor, redact_column, redact_marked_text, redact_nested, redact_table

ALL = Redactor()


def leaf(spark, key, value):
    """A value under a key: as a field, in a map, in a VARIANT."""
    df = spark.createDataFrame([(json.dumps({key: value}),)], "j STRING").select(
        F.from_json("j", f"`{key}` STRING").alias("s"), F.from_json("j", "MAP<STRING, STRING>").alias("m"), F.parse_json("j").alias("v"))
    done = redact_nested(df, ALL)
    assert [f.dataType for f in done.schema] == [f.dataType for f in df.schema]
    row = done.select(F.col("s").getField(key).alias("s"), F.col("m")[key].alias("m"), F.to_json("v").alias("v")).first()
    assert set(json.loads(row.v)) == {key}
    return [row.s, row.m, json.loads(row.v)[key]]


@pytest.mark.parametrize("key, value, want", [
    ("password", "hunter22x", "[PASSWORD]"), ("dbPassword", "correct horse battery", "[PASSWORD]"), ("PWD", "abc", "abc"), ("pass_code", "1234567", "[PASSWORD]"),
    ("authToken", "0123456789abcdef01", "[API_TOKEN]"), ("token", "short one", "[AUTH_TOKEN]"), ("client-secret", "a@example.com!", "[SECRET_OR_KEY]"),
    ("password", "[MONEY]", "[MONEY]"), ("jwt", "eyJhbGciOiJub25lIn0", "[JWT_TOKEN]"), ("phone", "12345678901234567", "[PHONE]"),
    ("Passport No", "X1234567", "[PASSPORT_ID]"), ("employeeId", "E-4711", "[EMPLOYEE_ID]"), ("ssn", "078 05 1120", "[SSN_ID]"), ("dob", "5/6/77", "[DATE_OF_BIRTH]"),
    ("expiry", "03/04/30", "[EXPIRY_DATE]"), ("cardNumber", "9999 8888 7777 6666", "[CREDIT_CARD]"), ("salary", "50000", "[MONEY]"),
    ("mail", "a@example.com", "[EMAIL:example.com]"), ("passwordless", "hunter22x", "hunter22x"), ("note", "hunter22x", "hunter22x")])
def test_a_key_tells(spark, key, value, want):
    assert leaf(spark, key, value) == [want] * 3


def test_keys_of_deeper_values(spark):
    """Nearest key, unless it tells nothing; keys of arrays hold for their elements, also behind an object in them."""
    value = {"passwords": ["first one", {"id": "id of nobody"}, "last one", ["inner one", None]], "login": {"password": {"value": "hunter22x"}, "user": "hunter22x"},
             "secret": {"hash": "abcdefg"}, "n": [1, "plain text"], "x": {"data": {"tokens": ["abc def"]}}, "after": "plain text"}
    df = spark.createDataFrame([(json.dumps(value),), (None,), ('"top level"',), ('{"a\\"}]:": "plain", "pwd": "quoted \\" one"}',)], "j STRING")
    got = [r.v and json.loads(r.v) for r in redact_nested(df.select(F.parse_json("j").alias("v")), ALL).select(F.to_json("v").alias("v")).collect()]
    assert got[0] == {"passwords": ["[PASSWORD]", {"id": "id of nobody"}, "[PASSWORD]", ["[PASSWORD]", None]],
                      "login": {"password": {"value": "[PASSWORD]"}, "user": "hunter22x"}, "secret": {"hash": "abcdefg"}, "n": [1, "plain text"],
                      "x": {"data": {"tokens": ["[AUTH_TOKEN]"]}}, "after": "plain text"}
    assert got[1:] == [None, "top level", {'a"}]:': "plain", "pwd": "[PASSWORD]"}]
    typed = spark.createDataFrame([({"password": ["first one", None], "b": None}, [{"pwd": "hunter22x", "more": {"value": {"k": "hunter22x"}}}, None])],
                                  "m MAP<STRING, ARRAY<STRING>>, secrets ARRAY<STRUCT<pwd: STRING, more: STRUCT<value: MAP<STRING, STRING>>>>")
    row = redact_nested(typed, ALL).first()
    assert row.m == {"password": ["[PASSWORD]", None], "b": None}
    assert row.secrets[0].pwd == "[PASSWORD]" and row.secrets[0].more["value"] == {"k": "hunter22x"} and row.secrets[1] is None
    assert redact_nested(typed, ALL, keys=False).first() == typed.first()


def test_columns_tell(spark):
    df = spark.createDataFrame([("hunter22x", "hunter22x", None, "5/6/77")], "`user password` STRING, name STRING, token STRING, birthDate STRING")
    assert tuple(redact_table(df, ALL).first()) == ("[PASSWORD]", "hunter22x", None, "[DATE_OF_BIRTH]")
    assert tuple(redact_table(df, Redactor(detectors=("dates",))).first()) == ("hunter22x", "hunter22x", None, "[DATE_OF_BIRTH]")
    assert tuple(redact_table(df, ALL, keys=False).first())[0] == "hunter22x"


def test_both_dialects_agree_on_keys(spark):
    keys = ["dbPassword", "DB-PASS__WORD", "x.token", "API Key ID", "mobileNo", "Straße", "élan", "value", "Items", "dateOfBirth", "birth date", "valid_until", "cc", "", "total"]
    detectors = list(ALL.detectors)
    got = spark.createDataFrame([(k,) for k in keys], "k STRING").select("k", F.expr(context.normal_sql("k")).alias("n"), F.expr(
        context.of_key_sql("k", "7", detectors)).alias("c")).collect()
    assert [(r.n, r.c) for r in got] == [(context.normal(k), context.of_key(k, 7, detectors)) for k in keys]


# --- markup ---


def plain_marked(spark, pages):
    """Redacted text of each page without its inline tags, by redacting the stripped text between other tags one by one."""
    inline, other = re.compile(rf"</?(?:{'|'.join(INLINE)})(?:[\s/][^>]*)?>", re.I), re.compile(TAG)
    parts, rows = [], []
    for page in pages:
        bare = inline.sub("", page)
        texts, tags = other.split(bare), other.findall(bare)
        parts.append((len(rows), tags))
        rows += texts
    done = [r.t for r in redact_column(spark.createDataFrame(list(enumerate(rows)), "i LONG, t STRING").repartition(3), "t", ALL).orderBy("i").collect()]
    return ["".join(a + b for a, b in zip(done[begin:begin + len(tags) + 1], [*tags, ""])) for begin, tags in parts]


def test_values_across_tags(spark):
    pages = ["jo<b>hn</b>@mail.example.com", "pay <i>4111 1111</i> 1111 <b>1111</b>!", "<p>call 555</p><p>123 x</p>", "x<br/>10.0.<B CLASS=a>0</B>.7",
             "a@example.com<i></i>b@<u>example.org", "<bold>10.0</bold>.0.1", "", "<b>", "no tags 10.0.0.1", "born <b>1990</b>-01-<i>31</i> on, <a href='x@example.com'>then</a>"]
    want = ["[EMAIL:mail.example.com]<b></b>", "pay <i>[CREDIT_CARD:VISA]</i><b></b>!", "<p>call 555</p><p>123 x</p>", "x<br/>[PRIVATE_IPV4]<B CLASS=a></B>",
            None, "<bold>10.0</bold>.0.1", "", "<b>", "no tags [PRIVATE_IPV4]", "born <b>[DATE_OF_BIRTH]</b><i></i> on, <a href='x@example.com'>then</a>"]
    rows = redact_marked_text(spark.createDataFrame([*enumerate(pages), (99, None)], "i LONG, html STRING"), "html", ALL).orderBy("i").collect()
    for r, w in zip(rows, want):
        assert w is None or r.html == w, pages[r.i]
    assert rows[-1].html == "" and rows[0].n == 1 and rows[1].n == 1


def test_stripped_text_is_the_redacted_stripped_text(spark):
    rng = random.Random(6)
    words = ["a@example.com", "4111 1111 1111 1111", "10.0.0.1", "555-123-4567", "Password: Test_2025!", "plain", "words", "2025-05-14", "[EMAIL:example.com]", "& co", "\n", "born"]
    tags = ["<b>", "</b>", "<i class='x'>", "<em/>", "<a href=\"m@example.com\">", "<p>", "</p>", "<td x=1>", "<br>"]
    pages = []
    for _ in range(120):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 9)))
        for at in sorted((rng.randrange(len(text) + 1) for _ in range(rng.randrange(7))), reverse=True):
            text = text[:at] + rng.choice(tags) + text[at:]
        pages.append(text)
    done = [r.html for r in redact_marked_text(spark.createDataFrame(list(enumerate(pages)), "i LONG, html STRING").repartition(3), "html", ALL).orderBy("i").collect()]
    inline = re.compile(rf"</?(?:{'|'.join(INLINE)})(?:[\s/][^>]*)?>", re.I)
    assert [inline.sub("", x) for x in done] == plain_marked(spark, pages)
    assert [re.findall(TAG, x) for x in done] == [re.findall(TAG, x) for x in pages]
