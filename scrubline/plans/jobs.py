"""The registered jobs: each reads whole tables of a data folder and returns a DataFrame."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators import audit
from scrubline.functions.rules import user_rule
from scrubline.operators.chain import method_chain, redact_blocks_with
from scrubline.operators.dictionary import recognize_dictionary, redact_dictionary
from scrubline.operators.incremental import changes, first_run, merged
from scrubline.operators.findings import (
    apply_findings, entity_stats, findings, label_of, recognize, redact_entities, scored_findings, unite, with_luhn, without_allowed)
from scrubline.operators.redact import (
    INLINE_TAG, TAG, Redactor, assemble_blocks, redact, redact_blocks, redact_column, redact_json_text, redact_lines, redact_long_texts,
    redact_marked_text, redact_markup, redact_nested, redact_table)
from scrubline.sources.files import dealt_out, read_documents, read_lines, read_table, run_metrics, tasks, write_observed, write_table
from scrubline.streaming.redact_stream import (
    first_findings, join_events, join_texts, read_stream, redact_stream, utc, windowed_counts, write_stream, write_with_late)

Job = Callable[[SparkSession, str], DataFrame]

KEYWORDS = ("the", "und", "que", "leur")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that takes far longer than reading it."""
    return dealt_out(table(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def notes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, each with a line on which some of the rules have something to find, and near misses."""
    return _noted(spread(spark, sf_dir, "documents"), *columns)


def _noted(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", F.expr(NOTE_TEXT).alias("text"), *columns)


# Texts for the detectors the documents hold nothing for, built from the star tables.
# The same expressions in the dialect of the comparison are in plans.oracles.

MONEY_TEXT = """concat('order ', o_orderkey, CASE o_orderpriority
    WHEN '1-URGENT' THEN concat(': total $', format_number(o_totalprice, 2), ' due')
    WHEN '2-HIGH' THEN concat(' costs ', format_number(o_totalprice, 2), ' USD')
    WHEN '3-MEDIUM' THEN concat(', € ', format_number(o_totalprice, 2), ' or GBP ', format_number(o_totalprice, 2))
    WHEN '4-NOT SPECIFIED' THEN concat(': NIS ', format_number(o_totalprice, 2), ' and 12 shekels')
    ELSE concat(' has a value of ', format_number(o_totalprice, 2), ' in all') END)"""

DATE_TEXT = """concat(CASE o_orderstatus WHEN 'F' THEN 'born on ' WHEN 'O' THEN 'card expires ' ELSE 'sent ' END,
    CASE o_orderpriority
    WHEN '1-URGENT' THEN date_format(o_orderdate, 'dd/MM/yyyy')
    WHEN '2-HIGH' THEN date_format(o_orderdate, 'yyyy-MM-dd')
    WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'dd MMM yyyy')
    WHEN '4-NOT SPECIFIED' THEN date_format(o_orderdate, 'MMMM dd, yyyy')
    ELSE date_format(o_orderdate, 'dd.MM.yyyy') END, ', version 2.2.15')"""

ID_TEXT = """concat(CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN concat('Employee ID: E-', lpad(c_custkey, 6, '0'))
    WHEN 'BUILDING' THEN concat('passport no. AB', lpad(c_custkey, 7, '0'))
    WHEN 'FURNITURE' THEN concat('TZ: ', lpad(c_custkey, 9, '1'))
    WHEN 'HOUSEHOLD' THEN concat('SSN 123-45-', lpad(c_custkey % 10000, 4, '0'))
    ELSE concat('file KX', lpad(c_custkey, 8, '0')) END, ' of ', c_name)"""

ADDRESS_TEXT = """concat(s_name, CASE
    WHEN s_nationkey < 5 THEN concat(': ship to ', s_suppkey + 1, ' Old Mill Road today')
    WHEN s_nationkey < 10 THEN concat(' sits at ', s_suppkey + 1, ' Evergreen Garden')
    WHEN s_nationkey < 15 THEN concat(', P.O. Box ', s_suppkey + 1)
    WHEN s_nationkey < 20 THEN concat(', office: ', s_suppkey + 1, ' Main St, Springfield, IL 62704-1234')
    ELSE concat(' sold ', s_suppkey + 1, ' parts in 3 March Weeks') END)"""

SECRET_TEXT = """concat(CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN concat('Password: Key_', c_custkey, '!x')
    WHEN 'BUILDING' THEN concat('<token>id-', c_custkey, '-zz</token>')
    WHEN 'FURNITURE' THEN concat('{"secret": "v ', c_custkey, ' abc"}')
    WHEN 'HOUSEHOLD' THEN concat('eyJhbGciOiJub25lIn0.eyJzdWIiOiJ4', lpad(c_custkey, 8, '0'), '.c2lnbmF0dXJl')
    ELSE 'pwd = ab1' END, ' for ', c_mktsegment)"""


# One line for every document: what the twelve detectors look for, by turns, and what only resembles it.
NOTE_LINES = (
    "concat('api_key = \"', lpad(doc_id, 20, 'k'), '\" then AKIA', lpad(doc_id, 16, '0'), ' but not AKIA12')",
    "concat('id A3TX', lpad(doc_id, 12, 'Z'), ' or AIza', lpad(doc_id, 35, 'x'), ' done')",
    "concat(lpad(doc_id, 8, '0'), '-1a2b-3c4d-5e6f-', lpad(doc_id, 12, 'a'), ' and sk_live_', lpad(doc_id, 24, 'q'), ' end')",
    "concat('ghp_', lpad(doc_id, 36, 'w'), ' xoxb-', lpad(doc_id, 12, 'z'), ' EAACEdEose0cBA', lpad(doc_id, 6, 'e'), ' gh_x')",
    "concat('paid with 4111 1111 1111 ', lpad(doc_id % 10000, 4, '0'), ' or 5500-0000-0000-', lpad(doc_id % 10000, 4, '0'), ' each')",
    "concat('was 3782 822463 1', lpad(doc_id % 10000, 4, '0'), ' or 6011 0000 0000 ', lpad(doc_id % 10000, 4, '0'), ' then')",
    "concat('Card number: 1234 5678 9012 ', lpad(doc_id % 10000, 4, '0'), ' there')",
    "concat('for $ ', doc_id, ',500.25 here, 12 dollars there, ₪ ', doc_id, ' and 60 shekels, NIS 70; GBP 80, € 90 or £ 95. price is 10 a day')",
    "concat('call +44 20 7946 ', lpad(doc_id % 10000, 4, '0'), ' or (212) 555-', lpad(doc_id % 10000, 4, '0'), ' now')",
    "concat('mobile 052-555-', lpad(doc_id % 10000, 4, '0'), ' or 03-555-', lpad(doc_id % 10000, 4, '0'), ' or fax: 1 2 3 4 5 ', doc_id % 10, ' x')",
    "concat('TZ: ', lpad(doc_id, 9, '1'), ' then SSN 123-45-', lpad(doc_id % 10000, 4, '0'), ' then passport no. AB', lpad(doc_id, 7, '0'))",
    "concat('file KX', lpad(doc_id, 8, '0'), ' with Employee ID: E-', lpad(doc_id, 6, '0'), ' ok')",
    "concat('from 10.', doc_id % 256, '.0.7 to 8.8.', doc_id % 256, '.8 not 300.1.1.', doc_id % 256, ' or 2001:db8:0:0:0:0:0:', doc_id % 10, ' or fe80::', doc_id % 10)",
    "concat('ship to ', doc_id + 1, ' Old Mill Road today, ', doc_id + 1, ' Evergreen Garden, P.O. Box ', doc_id + 1)",
    "concat('office: ', doc_id + 1, ' Main St, Springfield, IL 62704-1234')",
    "concat('sold ', doc_id % 28 + 1, ' march weeks, version 2.2.15')",
    "concat('born on ', lpad(doc_id % 28 + 1, 2, '0'), '/03/1980')",
    "concat('card expires 2031-05-', lpad(doc_id % 28 + 1, 2, '0'))",
    "concat('sent ', doc_id % 28 + 1, ' Mar 2020')",
    "concat('issued March ', doc_id % 28 + 1, ', 2019')",
    "concat('dob 13.13.', lpad(doc_id % 100, 2, '0'))",
    "concat('Password: Key_', doc_id, '!x and pwd = ab1')",
    "concat('<token>id-', doc_id, '-zz</token>')",
    "concat('{\"secret\": \"v ', doc_id, ' abc\"}')",
    "concat('eyJhbGciOiJub25lIn0.eyJzdWIiOiJ4', lpad(doc_id, 8, '0'), '.c2lnbmF0dXJl')",
    "concat('see www.shop-', doc_id, '.example.com or http://a.b.co.uk/x')",
    "concat('at רחוב הרצל ', doc_id % 90 + 1, ' now')",
    "concat('mail [EMAIL:41111111111111', doc_id % 90 + 10, '] or a.b@mail-', doc_id, '.example.org')",
)


def note_line(key: str) -> str:
    """SQL: the line of a key."""
    cases = " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(NOTE_LINES))
    return f"(CASE {key} % {len(NOTE_LINES)} {cases} END)".replace("doc_id", key)


NOTE_TEXT = f"concat(text, '\\n', {note_line('doc_id')})"


def _redacted(detector: str, name: str, key: str, text: str, text_col: str = "text") -> Job:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spread(spark, sf_dir, name).select(key, F.expr(text).alias(text_col))
        return redact_column(df, text_col, Redactor(detectors=(detector,)))
    return job


def redact_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_column(documents(spark, sf_dir), "text", Redactor(KEYWORDS, ("company_names",)))


def _document(profile: str) -> Job:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = Redactor(KEYWORDS, profile=profile)
        done = r.run_one(documents(spark, sf_dir), F.col("text"))
        return done.select("doc_id", F.col("_done.t").alias("text"),
                           *(r.count(F.col("_done.c"), d).alias(f"n_{d}") for d in r.detectors))
    return job


def every_rule() -> Redactor:
    return Redactor(KEYWORDS)


def stats_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.redaction_stats(notes(spark, sf_dir, "lang", "source"), redactor=every_rule())


def rollup_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rollup_stats(stats_job(spark, sf_dir))


def length_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_change(notes(spark, sf_dir), redactor=every_rule())


def redact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_column(notes(spark, sf_dir), "text", every_rule())


def findings_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir), redactor=every_rule())


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(notes(spark, sf_dir), redactor=every_rule())


def apply_findings_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = notes(spark, sf_dir)
    return apply_findings(docs, findings(docs, redactor=every_rule()))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the tables: all words of ``benchmark`` and pairs of neighbours in it as companies, parts, nations and
    regions as products and places. Pairs overlap their words and each other."""
    words = table(spark, sf_dir, "benchmark").select(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w"))
    single = words.select(F.explode("w").alias("keyword"), F.lit("COMPANY").alias("entity_type"))
    pairs = words.select(F.explode(F.expr("transform(filter(sequence(0, greatest(size(w) - 2, 0)), i -> i + 1 < size(w) AND w[i] <> w[i + 1]), "
                                          "i -> concat(w[i], ' ', w[i + 1]))")).alias("keyword"), F.lit("PERSON").alias("entity_type"))
    parts = table(spark, sf_dir, "part").select(F.lower("p_name").alias("keyword"), F.lit("URL"))
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("keyword"), F.lit("LOCATION"))
    regions = table(spark, sf_dir, "region").select(F.lower("r_name").alias("keyword"), F.lit("LOCATION"))
    return single.union(pairs).union(parts).union(nations).union(regions).distinct()


def dictionary_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize_dictionary(documents(spark, sf_dir), gazetteer(spark, sf_dir))


def entity_stats_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_stats(dictionary_job(spark, sf_dir))


def redact_dictionary_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_dictionary(documents(spark, sf_dir), gazetteer(spark, sf_dir))


def redact_dictionary_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are told apart by two columns."""
    turns_only = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return redact_dictionary(turns_only, gazetteer(spark, sf_dir), ("conv_id", "turn"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer and names with other characters at their ends."""
    odd = spark.createDataFrame([("C++", "COMPANY"), (".NET", "COMPANY"), ("Yahoo!", "COMPANY")], "keyword STRING, entity_type STRING")
    return gazetteer(spark, sf_dir).union(odd)


def redact_dictionary_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry at once, some of them with symbols at their ends, over texts that end with such names."""
    docs = documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" c++, .Net and yahoo! not netc++x yahoo?")))
    return redact_dictionary(docs, symbols(spark, sf_dir))


def redact_many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of names as long as a table: those of all customers, and two with symbols at their ends, found by a join."""
    customers = spread(spark, sf_dir, "customer")
    odd = spark.createDataFrame([("C++",), (".NET",)], "keyword STRING")
    names = customers.select(F.col("c_name").alias("keyword")).union(odd).withColumn("entity_type", F.lit("COMPANY"))
    lines = customers.select("c_custkey", F.concat(
        F.lit("By "), "c_name", F.lit(" with c++ and .NET, not "), "c_name", F.lit("x or NETC++")).alias("text"))
    return redact_dictionary(lines, names, "c_custkey")


def redact_lines_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_lines(notes(spark, sf_dir), redactor=every_rule())


def redact_blocks_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a block table, as a reader of paragraphs or pages would give it."""
    blocks = notes(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    done = redact_blocks(blocks.withColumn("kind", F.lit("body")), every_rule())
    return done.select("doc_id", "block_no", "kind", "redacted", "changed")


def assemble_blocks_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_blocks(redact_blocks_job(spark, sf_dir))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.expr("concat(lower(c_mktsegment), '.', c_custkey, '@mail.example.com')").alias("email"),
        F.expr("concat('10.', c_nationkey, '.0.', c_custkey % 300)").alias("ip"), F.expr(note_line("c_custkey")).alias("note"),
        "c_nationkey", "c_acctbal")


def redact_table_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(contacts(spark, sf_dir), every_rule())


def redact_nested_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = spread(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k INT").alias("props"),
        F.expr("named_struct('type', event_type, 'contacts', array(concat('user', user_id, '@example.org'), NULL, event_type),"
               f" 'hosts', map('from', concat('192.168.', user_id % 256, '.7'), 'to', NULL), 'notes', array(array({note_line('event_id')}), "
               "array(), array(event_type, concat('call +1 ', 2000000000 + event_id))), 'value', value)").alias("body"))
    done = redact_nested(nested, every_rule())
    return done.select("event_id", F.col("props.k").alias("k"), F.col("body.type").alias("type"),
                       F.col("body.contacts")[0].alias("contact"), F.col("body.contacts")[2].alias("kind"),
                       F.col("body.hosts")["from"].alias("host"), F.col("body.hosts")["to"].alias("host_to"),
                       F.col("body.notes")[0][0].alias("note"), F.col("body.notes")[2][1].alias("call"), F.col("body.value").alias("value"))


def redact_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of an event as a VARIANT, with strings at several depths."""
    events = spread(spark, sf_dir, "events").select("event_id", F.expr(
        "parse_json(concat('{\"props\": ', props, ', \"mail@example.org\": [\"user', user_id, '@example.org\", ', user_id, ', null, "
        "{\"note\": \"say \\\\\"hi\\\\\" to 10.0.', user_id % 256, '.7\"}]}'))").alias("v"))
    done = redact_nested(events, every_rule())
    return done.select("event_id", F.expr("variant_get(v, '$[\"mail@example.org\"][0]', 'string')").alias("mail"),
                       F.expr("variant_get(v, '$[\"mail@example.org\"][1]', 'bigint')").alias("number"),
                       F.expr("variant_get(v, '$[\"mail@example.org\"][3].note', 'string')").alias("note"),
                       F.expr("variant_get(v, '$.props.k', 'bigint')").alias("k"))


# Values under keys that tell what they hold: name, phrase the rules know, label of a secret, and the value.
KEYED_CELLS = (
    ("password", "password: ", "[PASSWORD]", "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ab1' ELSE concat('my Key ', c_custkey, '!x') END"),
    ("token", "token: ", "[AUTH_TOKEN]", "concat('id-', c_custkey, '-0123456789ab')"),
    ("mobile", "phone: ", None, "concat('052-555-', CAST(1000 + c_custkey % 9000 AS VARCHAR(9)))"),
    ("owner", "", None, "concat(lower(c_mktsegment), '.', c_custkey, '@mail.example.com')"),
    ("client_secret", "secret_key: ", "[SECRET_OR_KEY]", "concat('v ', c_custkey, ' abc')"),
    ("passport", "passport number: ", None, "concat('AB', CAST(1000000 + c_custkey AS VARCHAR(9)))"),
    ("plain", "", None, "concat('hunter ', c_custkey)"),
    ("first_code", "password: ", "[PASSWORD]", "concat('one two ', c_custkey)"),
    ("second_code", "password: ", "[PASSWORD]", "'x1'"),
    ("login", "password: ", "[PASSWORD]", "concat('pw-', c_custkey, '-zz')"),
    ("hint", "", None, "concat('ask 10.0.0.', CAST(c_custkey % 256 AS VARCHAR(9)))"),
    ("inner_key", "secret_key: ", "[SECRET_OR_KEY]", "concat('k k ', c_custkey)"),
    ("outer_key", "secret_key: ", "[SECRET_OR_KEY]", "concat('k-', c_custkey)"),
    ("born", "date of birth: ", None, "'1980-03-01'"),
    ("salary", "amount : ", None, "CAST(50000 + c_custkey AS VARCHAR(9))"),
)


def redact_nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, numbers and dates that only their keys give away: in a struct, a map, an array and a VARIANT."""
    v = {name: value for name, _, _, value in KEYED_CELLS}
    account = (f"named_struct('password', {v['password']}, 'dbToken', {v['token']}, 'MobileNo', named_struct('value', {v['mobile']}), 'owner', {v['owner']})")
    notes_map = f"map('client-secret', {v['client_secret']}, 'Passport No', {v['passport']}, 'plain', {v['plain']})"
    json = (f"to_json(named_struct('login', named_struct('User Password', {v['login']}), 'hints', array({v['hint']}), 'private_keys', "
            f"array(named_struct('id', 'z', 'value', {v['inner_key']})), 'dob', {v['born']}, 'n', array(named_struct('annualSalary', {v['salary']}))))")
    # a string after an object in the array that the key names
    json = f"replace({json}, '}}],\"dob\"', concat('}},\"', {v['outer_key']}, '\"],\"dob\"'))"
    customers = spread(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"{account} AS account", f"{notes_map} AS notes", f"array({v['first_code']}, {v['second_code']}, NULL) AS passcodes", f"parse_json({json}) AS v")
    done = redact_nested(customers, every_rule())
    paths = {"login": "$.login[\"User Password\"]", "hint": "$.hints[0]", "inner_key": "$.private_keys[0].value", "outer_key": "$.private_keys[1]",
             "born": "$.dob", "salary": "$.n[0].annualSalary"}
    return done.selectExpr(
        "c_custkey", "account.password", "account.dbToken AS token", "account.MobileNo.value AS mobile", "account.owner", "notes['client-secret'] AS client_secret",
        "notes['Passport No'] AS passport", "notes['plain'] AS plain", "passcodes[0] AS first_code", "passcodes[1] AS second_code",
        *(f"variant_get(v, '{path}', 'string') AS {name}" for name, path in paths.items()))


def redact_json_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as printed text: a bare number taken for an id ends its being JSON."""
    printed = spread(spark, sf_dir, "events").select("event_id", F.expr(
        "concat('{\"props\": ', props, ', \"mail\": \"', event_type, user_id, '@example.org\"', "
        "CASE event_type WHEN 'signup' THEN concat(', \"id\": ', 100000000 + event_id) ELSE '' END, '}')").alias("json"))
    return redact_json_text(printed, "json", every_rule())


def _markup(text_nodes_only: bool) -> Job:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = table(spark, sf_dir, "pages").select("page_id", F.expr(
            f"concat('<a title=\"web@example.org\">web@example.org</a>', html, '<p>', {note_line('page_id')})").alias("html"))
        return redact_markup(pages, "html", every_rule(), text_nodes_only)
    return job


# Values that tags of inline elements split, and some that other tags keep apart.
SPLIT_VALUES = ("concat('<p>write to jo<b class=x>hn.', page_id, '</b>@mail.<i>example</i>.com or <a href=\"http://a.example.net\">10.0.<b>0</b>.7</a> and pay <i>4111 1111</i>"
                " 1111 <em/>1111 now</p><td>4111 1111</td><td>1111 1111</td><bold>')")


def redact_markup_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text across inline tags: what is left of it without these tags, and all tags as they stood."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(f"concat(html, {SPLIT_VALUES}, '<p>', {note_line('page_id')})").alias("html"))
    done = redact_marked_text(pages, "html", every_rule())
    tags = F.array_join(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), "")
    return done.select("page_id", F.regexp_replace("html", F.lit(INLINE_TAG), F.lit("")).alias("text"), tags.alias("tags"), "n")


GUARD_TEXT = """concat('"password": "', CASE c_custkey % 5 WHEN 0 THEN '[PASSWORD]' WHEN 1 THEN '[EMAIL:example.com]' WHEN 2 THEN '[any label]'
    WHEN 3 THEN concat('[half ', c_custkey) ELSE concat('secret', c_custkey) END, '" <token>', CASE c_custkey % 2 WHEN 0 THEN '[AUTH_TOKEN]' ELSE 'abcdef' END, '</token>')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(
        f"concat(text, ' ', role, '.', conv_id, '@chat.example.net\\n', {note_line('(conv_id + turn)')})").alias("text"))


def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_column(turns(spark, sf_dir), "text", every_rule())


def conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_conversations(spark, sf_dir).groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum("n").alias("n"))


def _chain(*methods: str) -> Job:
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        return method_chain(notes(spark, sf_dir), methods, redactor=every_rule(), dictionary=gazetteer(spark, sf_dir))
    return job


def load_mail_recognizer():
    """Stands for a model: finds e-mail addresses, with a score."""
    mail = re.compile(r"[\w.+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,6}")
    return lambda text: [(m.start(), m.end(), "EMAIL_ADDRESS", 0.9) for m in mail.finditer(text)]


def recognize_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize(documents(spark, sf_dir), load_mail_recognizer)


def redact_entities_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_entities(documents(spark, sf_dir), load_mail_recognizer)


# Bank, wallet and licence numbers by turns: right ones, ones with a wrong digit, with and without words around.
ACCOUNT_NUMBER = "lpad(CAST(c_custkey AS VARCHAR(18)), 18, '3')"
ROUTING_TEXT = "concat('0210', lpad(CAST(c_custkey % 10000 AS VARCHAR(4)), 4, '0'))"
WALLETS = ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4")
ACCOUNT_LINES = (
    "concat('pay to DE', lpad(CAST(98 - CAST(concat({bban}, '131400') AS {wide}) % 97 AS VARCHAR(2)), 2, '0'), {bban}, ' today')",
    "concat('pay to DE', lpad(CAST((99 - CAST(concat({bban}, '131400') AS {wide}) % 97) % 97 AS VARCHAR(2)), 2, '0'), {bban}, ' today')",
    f"concat('wallet {WALLETS[0]} or {WALLETS[1]}, not {WALLETS[0][:-1]}b, ', c_custkey)",
    f"concat('send {WALLETS[2]} or {WALLETS[2].upper()}, not {WALLETS[2][:-1]}5, ', c_custkey)",
    "concat('routing ', {routing}, ' here')",
    "concat('account 7', lpad(CAST(c_custkey AS VARCHAR(11)), 11, '0'), ' of theirs')",
    "concat('number 7', lpad(CAST(c_custkey AS VARCHAR(11)), 11, '0'), ' of theirs')",
    "concat('invoice account 7', lpad(CAST(c_custkey AS VARCHAR(11)), 11, '0'), ' of theirs')",
    "concat('driving licence D', lpad(CAST(c_custkey AS VARCHAR(7)), 7, '0'), ' shown')",
    "concat('model D', lpad(CAST(c_custkey AS VARCHAR(7)), 7, '0'), ' shown')",
)
# nine digits whose weighted sum is a multiple of ten, or one more for every second customer
ROUTING = ("concat({head}, CAST((CAST((1000 - (3 * CAST(substring({head}, 1, 1) AS INT) + 7 * CAST(substring({head}, 2, 1) AS INT) + CAST(substring({head}, 3, 1) AS INT)"
           " + 3 * CAST(substring({head}, 4, 1) AS INT) + 7 * CAST(substring({head}, 5, 1) AS INT) + CAST(substring({head}, 6, 1) AS INT)"
           " + 3 * CAST(substring({head}, 7, 1) AS INT) + 7 * CAST(substring({head}, 8, 1) AS INT))) AS INT) + CAST({odd} AS INT)) % 10 AS VARCHAR(1)))")


def account_text(wide: str, div: str) -> str:
    """SQL: the line of a customer. ``wide``: a type of 24 digits; ``div``: division of whole numbers, by which lines are chosen."""
    routing = ROUTING.replace("{head}", ROUTING_TEXT).replace("{odd}", f"(c_custkey {div} {len(ACCOUNT_LINES)}) % 2")
    lines = [x.replace("{bban}", ACCOUNT_NUMBER).replace("{wide}", wide).replace("{routing}", routing) for x in ACCOUNT_LINES]
    return f"(CASE c_custkey % {len(lines)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(lines)) + " END)"


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(account_text("DECIMAL(38,0)", "div")).alias("text"))


def scored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers told by their checksums and by the words around them, with scores."""
    return scored_findings(accounts(spark, sf_dir), ("c_custkey",))


def redact_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written into the texts: of overlapping findings the one with the higher score."""
    return apply_findings(accounts(spark, sf_dir), scored_entities(spark, sf_dir), "c_custkey")


def allowed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary findings but for those on an allow list: here the words of seven letters."""
    allowed = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).where(F.length("value") == 7)
    return without_allowed(dictionary_job(spark, sf_dir), allowed)


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_documents(table(spark, sf_dir, "documents"))


def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_documents(table(spark, sf_dir, "pages"), "page_id", "html", F.col("url"))


def audit_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_detectors(notes(spark, sf_dir), redactor=every_rule())


def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_columns(contacts(spark, sf_dir), ("c_name", "email", "ip", "note"), every_rule())


def riskiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.riskiest(notes(spark, sf_dir, "source"), 3, redactor=every_rule())


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distinct_values(notes(spark, sf_dir), redactor=every_rule())


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_values(notes(spark, sf_dir), 20, redactor=every_rule())


def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other detectors still find where only e-mails, cards and amounts have been redacted."""
    once = redact(notes(spark, sf_dir), redactor=Redactor(detectors=("emails", "credit_cards", "money"))).select("doc_id", "text")
    return audit.residual_scan(once, redactor=every_rule()).select("doc_id", "n_total")


def residual_scan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts redacted by all detectors have nothing left but passwords that were too short to be one."""
    once = redact(notes(spark, sf_dir), redactor=every_rule()).select("doc_id", "text")
    return audit.residual_scan(once, redactor=every_rule()).select("doc_id", "n_total")


def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = findings(documents(spark, sf_dir), redactor=Redactor(detectors=("credit_cards",)))
    return with_luhn(cards).select("doc_id", "start", "end", "match", "label", "luhn_valid")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which no detector but that of names finds anything: an anti join with the findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(findings(documents(spark, sf_dir), redactor=Redactor()).select("doc_id").distinct(), "doc_id", "left_anti")


def documents_with_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The others: a semi join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(findings(documents(spark, sf_dir), redactor=Redactor()).select("doc_id").distinct(), "doc_id", "left_semi")


def united_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the rules, of a dictionary and of a model in one table, applied together where the texts are."""
    source = table(spark, sf_dir, "documents")
    docs = _noted(dealt_out(source, "doc_id"))
    rules = findings(docs, redactor=every_rule()).select("doc_id", "start", "end", "score", "label")
    names = recognize_dictionary(docs, gazetteer(spark, sf_dir))
    # Python workers do not say that rows stay where they were, so these few are dealt out once more
    model = recognize(docs, load_mail_recognizer).repartition(tasks(source), "doc_id")
    entities = unite(dictionary=names, model=model).select("doc_id", "start", "end", "score", label_of(F.col("entity_type")).alias("label"))
    return apply_findings(docs, entities.unionByName(rules))


def redact_blocks_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks through the rules, then through a model that finds what the rules were not asked for."""
    blocks = notes(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    done = redact_blocks_with(blocks, load_mail_recognizer, Redactor(detectors=("ips", "credit_cards")))
    return done.select("doc_id", "block_no", "redacted", "changed")


def redact_user_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the user's own: a constant label, and one made from what was found."""
    own = (user_rule("orders", r"\border \d+\b", "[ORDER]"),
           user_rule("totals", r"\$(\d+),", label="concat('[OVER:', length(value), ']')", group=1))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(MONEY_TEXT).alias("text"))
    return redact_column(orders, "text", Redactor(detectors=("orders", "totals"), extra=own))


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written as csv, tsv, json, xml and parquet, each read back and redacted: all give the same."""
    folder, out = _scratch(spark), None
    rows = contacts(spark, sf_dir).select("c_custkey", "c_name", "email", F.concat_ws("\n", "ip", "note").alias("note"))
    for fmt, back in (("csv", "csv"), ("tsv", "tsv"), ("json", "jsonl"), ("xml", "xml"), ("parquet", "parquet")):
        write_table(rows, f"{folder}/{fmt}", fmt)
        schema = "c_custkey BIGINT, c_name STRING, email STRING, note STRING"
        one = redact_table(read_table(spark, f"{folder}/{fmt}", back, schema, "row"), every_rule()).select(F.lit(fmt).alias("format"), "*")
        out = one if out is None else out.union(one)
    return out


def files_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as text files, one for each role and thousand conversations, read back as whole documents."""
    folder = _scratch(spark)
    lines = table(spark, sf_dir, "conversations").select(
        "role", F.expr("conv_id div 1000").alias("stretch"), F.concat_ws(" ", F.lit("turn"), "conv_id", "turn").alias("value"))
    write_table(lines.repartition("role", "stretch").sortWithinPartitions("role", "stretch", "value"), folder, "text", ("role", "stretch"))
    whole = read_documents(spark, folder, "*.txt")
    return whole.select(F.regexp_extract("path", "role=([a-z]+)", 1).alias("role"), F.regexp_extract("path", "stretch=([0-9]+)", 1).cast("bigint").alias("stretch"),
                        "extension", "mime_type", "format", "encoding", "lines", F.length("text").cast("bigint").alias("chars"))


def run_metrics_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metrics(redact(notes(spark, sf_dir), redactor=every_rule()), "run-1", "documents")


LOG_LINE = "concat('user', user_id, '@mail.example.com did ', event_type, ' from 10.0.', user_id % 256, '.', event_id % 300)"


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one all executors share, named by the session; a temporary one only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="scrubline-")
    return f"{shared.rstrip('/')}/scrubline-{uuid.uuid4().hex}"


# Events of these ids come after all others, as a third file.
LATE = "event_id % 50 = 0"


def arriving_events(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The events as a stream of log lines that come in three parts, each in as many files as tasks write: those that are
    late come last. The stream is handed out after each part has arrived."""
    folder, events = _scratch(spark), table(spark, sf_dir, "events")
    for part in ("event_id % 50 > 1", "event_id % 50 = 1", LATE):  # each part meets the watermark of those before it
        events.where(part).write.mode("append").parquet(folder)
        yield read_stream(spark, folder, events.schema).select(utc("ts").alias("ts"), "event_id", F.expr(LOG_LINE).alias("text"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements per detector and day of event time: days that have closed, without what came too late for them."""
    folder = _scratch(spark)
    for lines in arriving_events(spark, sf_dir):
        counts = windowed_counts(lines, "ts", "text", "1 day", "1 hour", every_rule())
        write_stream(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("window_start", F.expr(
        "convert_timezone(current_timezone(), 'UTC', CAST(window_start AS TIMESTAMP_NTZ))"))


def redact_stream_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines redacted as they come, late ones too."""
    folder = _scratch(spark)
    for lines in arriving_events(spark, sf_dir):
        done = redact_stream(lines.select("event_id", "text"), redactor=every_rule())
        write_stream(done, f"{folder}/lines", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/lines")


def _streamed(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming job has written when all parts of the events have arrived."""
    folder = _scratch(spark)
    for lines in arriving_events(spark, sf_dir):
        done = of(lines)
        write_stream(done, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/out")


def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the note of the customer they are about, which lies in a table, redacted as they come."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.expr(note_line("c_custkey")).alias("note"))
    return _streamed(spark, sf_dir, lambda lines: join_texts(lines.select("event_id"), customers, "event_id", "note", every_rule()))


def stream_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with what the same user has viewed in the hour before, two streams in any order of arrival; the address in the
    line is what joins them, redacted afterwards."""
    def of(lines: DataFrame) -> DataFrame:
        parts = lines.select("ts", "event_id", "text", F.regexp_extract("text", "^(user[0-9]+)@", 1).alias("user"))
        views = parts.where("text LIKE '% did view %'").select("user", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
        bought = parts.where("text LIKE '% did purchase %'").select("user", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), "text")
        return redact_stream(join_events(views, bought, ["user"], "seen", "bought", "1 HOUR", "40 days"), redactor=every_rule()).select("view_id", "purchase_id", "text")
    return _streamed(spark, sf_dir, of)


def stream_first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value once, however often and in whatever order it arrives: a state that is remembered for the watermark."""
    found = _streamed(spark, sf_dir, lambda lines: first_findings(lines, "ts", ["event_id"], watermark="40 days", redactor=every_rule()))
    return found.select("detector", "match", "label").distinct()


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events were late: a day or more behind the latest that had arrived before; none is lost."""
    folder = _scratch(spark)
    for lines in arriving_events(spark, sf_dir):
        done = redact_stream(lines, redactor=every_rule())
        write_with_late(done, "ts", "1 DAY", f"{folder}/on_time", f"{folder}/late", f"{folder}/marks", f"{folder}/checkpoint").awaitTermination()
    both = [spark.read.schema(done.schema).parquet(f"{folder}/{name}").withColumn("late", F.lit(name == "late")) for name in ("on_time", "late")]
    return both[0].union(both[1]).select("event_id", "text", "late")


def redact_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, sixty-four ids at a time, as one long text each, redacted in pieces."""
    lines = documents(spark, sf_dir, "source").withColumn("stretch", F.expr("doc_id div 64"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    longs = lines.groupBy("source", "stretch").agg(F.array_join(parts["text"], "\n").alias("text"))
    return redact_long_texts(longs, ("source", "stretch"), redactor=every_rule(), size=4096)


def second_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes a run later: one in a hundred has changed, one in a hundred has gone, and some are new."""
    now = notes(spark, sf_dir).where("doc_id % 100 <> 8").withColumn("text", F.expr("IF(doc_id % 100 = 7, concat('mail to changed@example.org\\n', text), text)"))
    return now.union(notes(spark, sf_dir).where("doc_id % 100 = 9").select(-1 - F.col("doc_id"), F.concat(F.lit("call 10.0.0.1\n"), "text")))


def redact_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run that takes over what has not changed; ``fresh``: what it redacted itself."""
    folder = _scratch(spark)
    first_run(notes(spark, sf_dir), redactor=every_rule()).write.parquet(f"{folder}/first")
    last, docs = spark.read.parquet(f"{folder}/first"), second_corpus(spark, sf_dir)
    changes(docs, last, redactor=every_rule()).write.parquet(f"{folder}/changes")
    fresh = spark.read.parquet(f"{folder}/changes")
    whole = merged(docs, last, fresh, redactor=every_rule()).join(fresh.select("doc_id", F.lit(True).alias("fresh")), "doc_id", "left")
    return whole.select("doc_id", "text", "n", F.coalesce("fresh", F.lit(False)).alias("fresh"))


def recognizer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rules, the dictionary and a model find the same places, and where their labels differ."""
    docs = notes(spark, sf_dir)
    columns = ("doc_id", "start", "end", "label", "recognizer")
    rules = findings(docs, redactor=every_rule()).withColumn("recognizer", F.lit("rules")).select(*columns)
    others = unite(dictionary=recognize_dictionary(docs, gazetteer(spark, sf_dir)), model=recognize(docs, load_mail_recognizer))
    return audit.agreement(rules.union(others.withColumn("label", label_of(F.col("entity_type"))).select(*columns)))


def sketched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values per detector from sketches of each source, merged: the exact number, and whether the sketches are near it."""
    found = findings(notes(spark, sf_dir, "source"), ("doc_id", "source"), redactor=every_rule())
    per_source = audit.value_sketches(found, ("source",))
    read = audit.read_sketches(audit.merge_sketches(per_source), 1)
    exact = found.groupBy("detector", "match").agg(F.count("*").alias("n")).groupBy("detector").agg(F.count("*").alias("exact"), F.max("n").alias("most"))
    near = F.abs(F.col("values") - F.col("exact")) <= F.greatest(F.lit(1), 0.06 * F.col("exact"))
    return read.join(exact, "detector").select("detector", "n", "exact", near.alias("near"), (F.col("top")[0]["count"] == F.col("most")).alias("top_found"))


def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics taken while the redacted notes are written, by the same scan."""
    done = write_observed(redact(notes(spark, sf_dir), redactor=every_rule()), f"{_scratch(spark)}/notes", "run-1", "documents")
    return done.select("run_id", "job", "detector", "n", "docs", "chars", (F.col("seconds") > 0).alias("timed"))


def placeholder_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets that are labels already stay, of whatever kind; others in the same places go."""
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.expr(GUARD_TEXT).alias("text"))
    return redact_column(lines, "text", Redactor(detectors=("passwords",)))


def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as text files, read back line by line and redacted: no task holds a file."""
    folder = _scratch(spark)
    lines = table(spark, sf_dir, "conversations").select(F.concat_ws(" ", F.lit("turn"), "conv_id", "turn", F.expr(note_line("conv_id"))).alias("value"))
    write_table(lines, folder, "text")
    return redact_column(read_lines(spark, folder).select("text"), "text", every_rule())


JOBS: dict[str, Job] = {
    "redact_emails": _redacted("emails", "documents", "doc_id", "text"),
    "redact_keywords": redact_keywords,
    "redact_domains": _redacted("domains", "pages", "page_id", "html", "html"),
    "redact_api_keys": _redacted("api_keys", "documents", "doc_id", "text"),
    "redact_credit_cards": _redacted("credit_cards", "documents", "doc_id", "text"),
    "redact_money": _redacted("money", "orders", "o_orderkey", MONEY_TEXT),
    "redact_phones": _redacted("phones", "documents", "doc_id", "text"),
    "redact_ids": _redacted("ids", "customer", "c_custkey", ID_TEXT),
    "redact_ips": _redacted("ips", "documents", "doc_id", "text"),
    "redact_addresses": _redacted("addresses", "supplier", "s_suppkey", ADDRESS_TEXT),
    "redact_dates": _redacted("dates", "orders", "o_orderkey", DATE_TEXT),
    "redact_passwords": _redacted("passwords", "customer", "c_custkey", SECRET_TEXT),
    "redact_document": _document("fixed"),
    "redact_document_ref": _document("ref"),
    "redact_notes": redact_notes,
    "redaction_stats": stats_job,
    "redaction_stats_cube": rollup_job,
    "length_change": length_change,
    "findings": findings_job,
    "findings_all": findings_all,
    "apply_findings": apply_findings_job,
    "recognize_dictionary": dictionary_job,
    "entity_stats": entity_stats_job,
    "redact_dictionary": redact_dictionary_job,
    "redact_dictionary_joined": redact_dictionary_joined,
    "redact_dictionary_turns": redact_dictionary_turns,
    "redact_many_keywords": redact_many_keywords,
    "recognize_model": recognize_job,
    "redact_entities": redact_entities_job,
    "scored_entities": scored_entities,
    "redact_scored": redact_scored,
    "findings_not_allowed": allowed_job,
    "redact_lines": redact_lines_job,
    "redact_blocks": redact_blocks_job,
    "assemble_blocks": assemble_blocks_job,
    "redact_table": redact_table_job,
    "redact_nested": redact_nested_job,
    "redact_nested_keys": redact_nested_keys,
    "redact_variant": redact_variant,
    "redact_json_text": redact_json_job,
    "redact_markup": _markup(False),
    "redact_markup_text": _markup(True),
    "redact_markup_joined": redact_markup_joined,
    "redact_conversations": redact_conversations,
    "conversation_totals": conversation_totals,
    "method_chain": _chain("regex", "offline_model"),
    "method_chain_model_first": _chain("offline_model", "regex"),
    "profile_documents": profile_documents,
    "profile_pages": profile_pages,
    "audit_detectors": audit_detectors,
    "audit_columns": audit_columns,
    "riskiest_documents": riskiest,
    "distinct_values": distinct_values,
    "top_values": top_values,
    "residual_scan": residual_scan,
    "residual_scan_clean": residual_scan_clean,
    "luhn_valid": luhn,
    "clean_documents": clean_documents,
    "documents_with_pii": documents_with_pii,
    "united_findings": united_findings,
    "redact_blocks_chain": redact_blocks_chain,
    "redact_user_rule": redact_user_rule,
    "files_round_trip": files_round_trip,
    "files_as_documents": files_as_documents,
    "run_metrics": run_metrics_job,
    "stream_counts": stream_counts,
    "redact_stream": redact_stream_job,
    "stream_joined": stream_joined,
    "stream_matched": stream_matched,
    "stream_first_findings": stream_first_findings,
    "stream_late": stream_late,
    "redact_long_texts": redact_long,
    "redact_incremental": redact_incremental,
    "recognizer_agreement": recognizer_agreement,
    "sketched_values": sketched_values,
    "observed_metrics": observed_metrics,
    "placeholder_guard": placeholder_guard,
    "lines_of_files": lines_of_files,
}
