"""Recognizers with checksums and context words against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scrubline.functions import recognizers as rec
from scrubline.operators.findings import apply_findings, scored_findings


def plain_iban(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def plain_base58(v):
    n = 0
    for c in v:
        n = n * 58 + rec.BASE58.index(c)
    if n >= 1 << 200:
        return False
    raw = n.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def made_base58(rng, kind):
    raw = bytes([kind]) + rng.randbytes(20)
    n, out = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = rec.BASE58[d] + out
    return "1" * (kind == 0) + out


def plain_polymod(values):
    c = 1
    for v in values:
        top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            c ^= g if top >> i & 1 else 0
    return c


def made_bech32(rng, constant, size):
    data = [rng.randrange(32) for _ in range(size)]
    rest = plain_polymod([3, 3, 0, 2, 3, *data, 0, 0, 0, 0, 0, 0]) ^ constant
    return "bc1" + "".join(rec.BECH32[d] for d in [*data, *(rest >> 5 * (5 - i) & 31 for i in range(6))])


def plain_routing(v):
    return sum(w * int(d) for w, d in zip((3, 7, 1) * 3, v)) % 10 == 0 and int(v[:2]) in {*range(1, 13), *range(21, 33), *range(61, 73), 80}


def changed(rng, v, letters, first=1):
    at = rng.randrange(first, len(v))
    return v[:at] + rng.choice([c for c in letters if c != v[at]]) + v[at + 1:]


def test_checksums(spark):
    rng, rows = random.Random(1), []
    for _ in range(60):
        bban = "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.randrange(11, 28)))
        country = rng.choice(["DE", "GB", "XK"])
        check = 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
        iban = f"{country}{check:02d}{bban}"
        assert plain_iban(iban)
        rows += [("iban", x, plain_iban(x)) for x in (iban, changed(rng, iban, "0123456789", 4))]
        address = made_base58(rng, rng.choice((0, 5)))
        rows += [("base58check", x, plain_base58(x)) for x in (address, changed(rng, address, rec.BASE58))]
        for constant in (1, 0x2BC830A3, 7):
            bech = made_bech32(rng, constant, rng.choice((33, 53)))
            for x in (bech, bech.upper(), changed(rng, bech, rec.BECH32, 3)):
                rows.append(("bech32", x, plain_polymod([3, 3, 0, 2, 3, *(rec.BECH32.index(c) for c in x.lower()[3:])]) in (1, 0x2BC830A3)))
        number = f"{rng.choice((1, 12, 13, 21, 32, 61, 72, 80, 81, 99)):02d}{rng.randrange(10 ** 7):07d}"
        rows += [("routing_number", x, plain_routing(x)) for x in (number, *(number[:8] + str(d) for d in range(10)))]
    assert {(k, ok) for k, _, ok in rows} == {(k, ok) for k in ("iban", "base58check", "bech32", "routing_number") for ok in (True, False)}
    df = spark.createDataFrame(rows, "kind STRING, v STRING, ok BOOLEAN")
    cases = " ".join(f"WHEN kind = '{k}' THEN {getattr(rec, k)('v')}" for k in ("iban", "base58check", "bech32", "routing_number"))
    assert df.withColumn("got", F.expr(f"CASE {cases} END")).where("got <> ok OR got IS NULL").collect() == []


VALID_IBAN, WALLET = "GB82 WEST 1234 5698 7654 32", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"


@pytest.mark.parametrize("text, want", [
    (f"to {VALID_IBAN}.", [("IBAN_CODE", VALID_IBAN, 1.0)]), ("to GB82 WEST 1234 5698 7654 33.", []), (f"x{WALLET} {WALLET[:-1]}b {WALLET}!", [("CRYPTO", WALLET, 1.0)]),
    ("021000021", [("US_BANK_NUMBER", "021000021", 0.5)]), ("ABA routing: 0210-0002-1", [("US_BANK_NUMBER", "0210-0002-1", 0.85)]), ("order 021000021", []),
    ("021000022", []), ("my bank account is 123456789012", [("US_BANK_NUMBER", "123456789012", 0.4)]), ("invoice for account 123456789012", []), ("123456789012", []),
    ("driver's license D123-4567", [("US_DRIVER_LICENSE", "D123-4567", 0.65)]), ("D123-4567", []), ("model D123-4567, driving", []),
    ("license 1234567", [("US_DRIVER_LICENSE", "1234567", 0.4)]), ("", []), (None, [])])
def test_scores(spark, text, want):
    got = scored_findings(spark.createDataFrame([(1, text)], "doc_id INT, text STRING")).collect()
    assert [(r.entity_type, r.match, r.score) for r in got] == want
    assert all(text[r.start:r.end] == r.match for r in got)


def test_words_count_only_nearby_and_scores_decide_overlaps(spark):
    far = "bank account " + "x " * 40 + "123456789012"
    texts = [far, "🦆" * 50 + " account 123456789012 🦆", "ABA bank 021000021 " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    found = scored_findings(df)
    by_doc = {i: [r for r in found.collect() if r.doc_id == i] for i in range(3)}
    assert by_doc[0] == [] and [texts[1][r.start:r.end] for r in by_doc[1]] == ["123456789012"]
    # nine digits are an account number as well, with a lower score
    assert {r.score for r in by_doc[2]} == {0.85, 0.4}
    done = {r.doc_id: (r.text, r.n) for r in apply_findings(df, found).collect()}
    assert done[2] == ("ABA bank [BANK_ACCOUNT] " * 400, 400) and done[0] == (far, 0)
