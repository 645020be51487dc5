import re

import pytest
from pyspark.sql import functions as F

from scrubline.functions.labels import ANY_LABEL
from scrubline.functions.rules import DETECTORS, ORDER, rules, user_rule
from scrubline.operators.audit import residual_scan
from scrubline.operators.findings import findings
from scrubline.operators.redact import Redactor, redact, redact_column
from tests.cases import CASES, EDGE, KEYWORDS, REPORT


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(2)


def run(spark, texts, **kwargs):
    done = redact(frame(spark, texts), redactor=Redactor(**kwargs)).orderBy("doc_id").collect()
    return [(r.text, {d: n for d, n in r.counts.items() if n}) for r in done]


def test_all_patterns_are_there():
    for profile in ORDER:
        table = rules(profile, ["x"])
        per = {d: sum(r.detector == d for r in table) for d in DETECTORS}
        assert list(per.values()) == [1, 1, 1, 10, 5, 9, 5, 5, 2, 5, 5, 4]
        assert list(dict.fromkeys(r.detector for r in table)) == list(ORDER[profile])


@pytest.mark.parametrize("profile", ["fixed", "ref"])
@pytest.mark.parametrize("detector", DETECTORS)
def test_cases(spark, detector, profile):
    cases = CASES[detector]
    got = run(spark, [text for text, _, _ in cases], keywords=KEYWORDS, detectors=(detector,), profile=profile)
    expected = [fixed if profile == "fixed" or ref is None else ref for _, fixed, ref in cases]
    assert [text for text, _ in got] == expected
    # one replacement for every label more than there was
    for (text, counts), (before, _, _) in zip(got, cases):
        new = len(re.findall(ANY_LABEL, text)) - len(re.findall(ANY_LABEL, before))
        assert sum(counts.values()) == new or "[EMAIL:[" in text or "[MONEY]" in before


@pytest.mark.parametrize("profile", ["fixed", "ref"])
def test_each_rule_replaces_its_findings(spark, docs, profile):
    """A rule alone writes its labels where its findings stand, and nothing else: over the cases and whole documents."""
    texts = [REPORT, *(t for t in EDGE if t), *(text for cases in CASES.values() for text, _, _ in cases)] + [r.text for r in docs.limit(40).collect()]
    texts = [t for t in texts if not re.search(ANY_LABEL, t)]  # labels are kept by one and read by the other
    df = frame(spark, texts).cache()
    for rule in rules(profile, KEYWORDS):
        alone = Redactor(profile=profile, detectors=())
        alone.rules, alone.detectors = [rule], [rule.detector]
        by_doc = {}
        for r in findings(df, redactor=alone).orderBy("doc_id", "start").collect():
            assert texts[r.doc_id][r.start:r.end] == r.match
            by_doc.setdefault(r.doc_id, []).append(r)
        for r in redact(df, redactor=alone).collect():
            text, at, out = texts[r.doc_id], 0, ""
            for f in by_doc.get(r.doc_id, []):
                out, at = out + text[at:f.start] + f.label, f.end
            assert r.text == out + text[at:] and r.n_total == len(by_doc.get(r.doc_id, []))
            assert r.counts[rule.detector] == r.n_total and (r.len_before, r.len_after) == (len(text), len(r.text))


def test_cases_hold_within_longer_texts(spark):
    """The cases of a detector put together, with words between that no rule knows, give their results put together."""
    gap = "\n~ and so it went on ~\n"
    for detector in DETECTORS:
        for profile, place in (("fixed", 1), ("ref", 2)):
            cases = [c for c in CASES[detector] if c[2] is None and detector != "dates"]
            whole, = run(spark, [gap.join(c[0] for c in cases)], keywords=KEYWORDS, detectors=(detector,), profile=profile)
            assert whole[0] == gap.join(c[1] for c in cases), (detector, profile)


def test_what_only_resembles_a_label_is_no_shield(spark):
    texts = ["pay [EMAIL:4111111111111111] or [EMAIL:192.168.1.20]", "[EMAIL:4111-1111-1111-1111] [DOMAIN:192.168.1.20]", "[EMAIL:example.com]"]
    got = [text for text, _ in run(spark, texts)]
    assert got == ["pay [EMAIL:[CREDIT_CARD:VISA]] or [EMAIL:[PRIVATE_IPV4]]", "[EMAIL:[CREDIT_CARD:VISA]] [DOMAIN:[PRIVATE_IPV4]]", "[EMAIL:example.com]"]
    assert [t for t, _ in run(spark, got)] == got
    residue = residual_scan(frame(spark, ["clean", "left [EMAIL:10.0.0.1]"])).collect()
    assert [(r.doc_id, r.n_total) for r in residue] == [(1, 1)]


def test_keywords_of_any_number_and_kind(spark):
    many = [f"Name {i}" for i in range(5000)] + ["C++", ".NET", "Name 12 Ltd", "a\\Eb", "x\\y"]
    texts = ["name 4999, NAME 7! name 5000 Name 70", "c++ c+ xc++ C++x .net a.net .nets", "Name 12 Ltd", "A\\eB x\\Y"]
    got = [t for t, _ in run(spark, texts, keywords=many, detectors=("company_names",))]
    label = "[COMPANY_NAME]"
    assert got == [f"{label}, {label}! name 5000 {label}", f"{label} c+ xc++ {label}x {label} a{label} .nets", f"{label} Ltd", f"{label} {label}"]
    # the first of the list goes first; word boundaries on both sides in the other profile
    got = [t for t, _ in run(spark, texts, keywords=["Name 12 Ltd", *many], detectors=("company_names",), profile="ref")]
    assert got[2] == label and got[1] == "c++ c+ xc++ [COMPANY_NAME]x .net a[COMPANY_NAME] .nets"


def test_report_under_ref(spark):
    """Counted by hand: what the oddities do to a text shows in the counts."""
    (text, counts), = run(spark, [REPORT], keywords=["acme"], profile="ref")
    assert counts["company_names"] == 3
    # the keyword tears an address apart, and labels of addresses are taken for domains
    assert "[EMAIL:[DOMAIN:.com]]" in text and counts["emails"] == 2
    assert "[NATIONAL_ID:IL]" not in text  # taken for phones before
    assert "Apache [DATE]" in text


def test_report_under_fixed(spark):
    (text, counts), = run(spark, [REPORT], keywords=["acme"], profile="fixed")
    assert counts == {"company_names": 2, "emails": 3, "domains": 1, "api_keys": 2, "passwords": 2, "credit_cards": 3,
                      "ips": 4, "ids": 3, "dates": 3, "addresses": 2, "money": 1, "phones": 4}
    assert "Apache 2.2.15" in text and "[DATE_OF_BIRTH]" in text


def test_redacting_twice_changes_nothing(spark, docs):
    r = Redactor(KEYWORDS)
    texts = frame(spark, [REPORT, *(t for t in EDGE if t)]).union(docs)
    once = redact(texts, redactor=r).select("doc_id", "text")
    assert redact(once, redactor=r).where("n_total > 0").count() == 0


def test_null_and_empty_become_empty(spark):
    assert run(spark, [None, ""]) == [("", {}), ("", {})]


def test_a_label_in_the_text_is_kept_but_brackets_alone_are_not(spark):
    (text, _), = run(spark, ["[EMAIL:example.com] [NOTE: call 555-123-4567]"])
    assert text == "[EMAIL:example.com] [NOTE: call [PHONE:US]]"


def test_long_texts_do_not_overflow_the_stack(spark):
    words = "5 " + "alpha beta " * 10_000 + "street"
    dots = "x@" + "a." * 20_000 + "com"
    texts = [words, dots, "a." * 30_000 + "com", "12 " * 20_000, "address: 1 st " + "st " * 20_000, "4" * 50_000,
             "+/" * 20_000 + "_", "@" * 20_000, "x" * 100_000]
    for profile in ("fixed", "ref"):
        assert len(run(spark, texts, profile=profile)) == len(texts)


def test_many_hits_in_one_text(spark):
    text = " ".join(f"born 1990-01-{i % 28 + 1:02d} x{i}@example.com" for i in range(3000))
    for profile in ("fixed", "ref"):
        (got, counts), = run(spark, [text], detectors=("emails", "dates"), profile=profile)
        assert counts == {"emails": 3000, "dates": 3000}
        # the other profile reads the purpose of a date from the original, where texts have moved on
        assert profile == "ref" or got == " ".join(["born [DATE_OF_BIRTH] [EMAIL:example.com]"] * 3000)


def test_partitioning_does_not_matter(spark, docs):
    r = Redactor(detectors=("emails", "ips", "phones"))
    one = redact_column(docs.repartition(1), "text", r).orderBy("doc_id").collect()
    many = redact_column(docs.repartition(13), "text", r).orderBy("doc_id").collect()
    assert one == many


def test_user_rules(spark):
    extra = [user_rule("tickets", r"TICKET-\d+", "[TICKET]"),
             user_rule("plates", r"\b([A-Z]{2})-(\d{3})\b", label="concat('[PLATE:', value, ']')", group=1)]
    (text, counts), = run(spark, ["TICKET-12 of AB-123, $5"], detectors=("tickets", "plates"), extra=extra)
    assert text == "[TICKET] of [PLATE:AB], $5" and counts == {"tickets": 1, "plates": 1}
    with pytest.raises(ValueError):
        user_rule("x", "y")
    with pytest.raises(ValueError):
        Redactor(detectors=("nothing",))
    with pytest.raises(ValueError):
        Redactor(profile="other")


def test_rules_are_not_evaluated_twice(spark, docs):
    """A filter on the result stays above the generator; below it the rules would run again."""
    plan = redact(docs).where("n_total > 0").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    generate = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert not any("Filter" in line and "AKIA" in line for line in lines[generate:])


def test_no_shuffle(spark, docs):
    plan = redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Python" not in plan


def test_label_of_nothing_is_empty(spark):
    done = redact(frame(spark, ["plain"]), redactor=Redactor(detectors=("company_names",)))
    assert done.select(F.col("counts")["company_names"]).first()[0] == 0
