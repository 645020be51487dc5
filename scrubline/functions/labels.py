"""Which label a match gets.

A label is a SQL expression over ``hit`` (the whole match), ``value`` (the text
its deciding group captured, for rules that have one) and, for rules that ask
for it, ``around`` (the match with the text around it). NULL means that the
match is to stay as it is.
"""

from __future__ import annotations

from scrubline.functions.text import let

# Every form a label can take in redacted text.
LABEL_FORMS = (
    r"COMPANY_NAME",
    # only what the rule for e-mails can write: a number or an address in this place is no label
    r"EMAIL:(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?+\.)++[a-zA-Z]{2,6}",
    r"DOMAIN(?::\.[A-Za-z]{2,63})?",
    r"AWS_ACCESS_KEY", r"GOOGLE_API_KEY", r"STRIPE_API_KEY", r"GITHUB_TOKEN", r"SLACK_TOKEN",
    r"FACEBOOK_TOKEN", r"UUID_API_KEY", r"API_SECRET", r"API_TOKEN", r"API_KEY", r"GENERIC_API_KEY",
    r"CREDIT_CARD(?::(?:VISA|MASTERCARD|AMEX|DISCOVER))?",
    r"MONEY",
    r"PHONE(?::(?:\+[0-9]{1,4}|IL_MOBILE|IL_LANDLINE|US|US_LONG))?",
    r"SSN_ID", r"PASSPORT_ID", r"NATIONAL_ID:IL", r"EMPLOYEE_ID", r"ID_NUMBER",
    r"PRIVATE_IPV4", r"PUBLIC_IPV4", r"IPV6_ADDRESS",
    r"ADDRESS",
    r"DATE_OF_BIRTH", r"EXPIRY_DATE", r"ISSUE_DATE", r"DATE",
    r"JWT_TOKEN", r"AUTH_TOKEN", r"SECRET_OR_KEY", r"PASSWORD",
    r"PERSON_NAME", r"EMAIL", r"IP_ADDRESS", r"BANK_ACCOUNT", r"DRIVER_LICENSE", r"CRYPTO_ADDRESS", r"URL",
)
ANY_LABEL = r"\[(?:" + "|".join(LABEL_FORMS) + r")\]"

# Label of each entity type a recognizer may report.
ENTITY_LABELS = {
    "PERSON": "[PERSON_NAME]",
    "EMAIL_ADDRESS": "[EMAIL]",
    "PHONE_NUMBER": "[PHONE]",
    "CREDIT_CARD": "[CREDIT_CARD]",
    "DOMAIN": "[DOMAIN]",
    "DATE_TIME": "[DATE]",
    "LOCATION": "[ADDRESS]",
    "NRP": "[ID_NUMBER]",
    "IP_ADDRESS": "[IP_ADDRESS]",
    "US_SSN": "[SSN_ID]",
    "US_BANK_NUMBER": "[BANK_ACCOUNT]",
    "IBAN_CODE": "[BANK_ACCOUNT]",
    "US_DRIVER_LICENSE": "[DRIVER_LICENSE]",
    "CRYPTO": "[CRYPTO_ADDRESS]",
    "URL": "[URL]",
    "COMPANY": "[COMPANY_NAME]",
    "MONEY": "[MONEY]",
    "PASSWORD": "[PASSWORD]",
    "API_KEY": "[API_KEY]",
}
# Fixed value: the types the entity statistics list, zeros included (API_KEY is replaced but not counted).
COUNTED_ENTITIES = tuple(t for t in ENTITY_LABELS if t != "API_KEY")

# The order of the cases below is fixed by the labels that are to come out.
# Label expressions. ``of`` names the variable that decides: ``value`` for a rule
# with a capturing group, ``hit`` for one without.

_DIGITS = "regexp_replace({of}, '[^\\\\p{{Nd}}]', '')"


def email(of: str) -> str:
    return "concat('[EMAIL:', substring(hit, locate('@', hit) + 1), ']')"


def domain(of: str) -> str:
    # a bare "www.com" has no dotted rest once the prefix is gone, hence no TLD to keep
    host = "regexp_replace(hit, '^(?:https?://)?(?:www[.])?', '')"
    return (f"CASE WHEN contains({host}, '.') THEN concat('[DOMAIN:.', substring_index(hit, '.', -1), ']') "
            "ELSE '[DOMAIN]' END")


def api_key(of: str) -> str:
    # around a captured key there are words that decide what no prefix does
    default = "ELSE '[GENERIC_API_KEY]'" if of == "hit" else """
        WHEN contains(lower(hit), 'secret') THEN '[API_SECRET]'
        WHEN contains(lower(hit), 'token') THEN '[API_TOKEN]'
        ELSE '[API_KEY]'"""
    return f"""CASE
        WHEN contains({of}, 'AKIA') THEN '[AWS_ACCESS_KEY]'
        WHEN contains({of}, 'AIza') THEN '[GOOGLE_API_KEY]'
        WHEN {of} RLIKE '^[sp]k_' THEN '[STRIPE_API_KEY]'
        WHEN startswith({of}, 'gh') THEN '[GITHUB_TOKEN]'
        WHEN startswith({of}, 'xox') THEN '[SLACK_TOKEN]'
        WHEN contains({of}, 'EAACEdEose0cBA') THEN '[FACEBOOK_TOKEN]'
        WHEN contains({of}, '-') AND length({of}) > 20 THEN '[UUID_API_KEY]'
        {default} END"""


def credit_card(of: str) -> str:
    issuer = "try_cast(substring(digits, 1, 6) AS INT)"
    return let("digits", _DIGITS.format(of=of), f"""CASE
        WHEN startswith(digits, '4') AND length(digits) IN (13, 16) THEN '[CREDIT_CARD:VISA]'
        WHEN length(digits) = 16 AND ({issuer} BETWEEN 510000 AND 559999 OR {issuer} BETWEEN 222100 AND 272099)
            THEN '[CREDIT_CARD:MASTERCARD]'
        WHEN length(digits) = 15 AND digits RLIKE '^3[47]' THEN '[CREDIT_CARD:AMEX]'
        WHEN length(digits) = 16 AND (digits RLIKE '^6011|^65' OR {issuer} BETWEEN 622126 AND 622925
                                      OR {issuer} BETWEEN 644000 AND 649999) THEN '[CREDIT_CARD:DISCOVER]'
        ELSE '[CREDIT_CARD]' END""")


def phone(of: str) -> str:
    code = f"regexp_extract({of}, '^([+]\\\\p{{Nd}}{{1,4}})[ -]', 1)"
    return let("digits", _DIGITS.format(of=of), f"""CASE
        WHEN {code} <> '' THEN concat('[PHONE:', {code}, ']')
        WHEN startswith(digits, '05') AND length(digits) IN (9, 10) THEN '[PHONE:IL_MOBILE]'
        WHEN startswith(digits, '0') AND length(digits) IN (9, 10) THEN '[PHONE:IL_LANDLINE]'
        WHEN length(digits) = 10 AND digits RLIKE '^[^01]' THEN '[PHONE:US]'
        WHEN length(digits) = 11 AND startswith(digits, '1') THEN '[PHONE:US_LONG]'
        ELSE '[PHONE]' END""")


def identity_number(of: str) -> str:
    return f"""CASE
        WHEN contains(lower(hit), 'ssn') THEN '[SSN_ID]'
        WHEN length(translate({of}, '- ', '')) = 9 AND length({of}) - length(translate({of}, '-', '')) = 2
            THEN '[SSN_ID]'
        WHEN contains(lower(hit), 'passport') THEN '[PASSPORT_ID]'
        WHEN contains(lower(hit), 'tz') OR contains(lower(hit), 'ת.ז') OR {of} RLIKE '^\\\\p{{Nd}}{{9}}$'
            THEN '[NATIONAL_ID:IL]'
        WHEN contains(lower(hit), 'emp') OR contains(lower(hit), 'staff') THEN '[EMPLOYEE_ID]'
        ELSE '[ID_NUMBER]' END"""


def ipv4(of: str) -> str:
    # a quad with an octet above 255 is most likely a version number and stays
    return let("octets", "CAST(split(hit, '[.]') AS ARRAY<INT>)", """CASE
        WHEN array_max(octets) > 255 THEN NULL
        WHEN octets[0] = 10 OR (octets[0] = 172 AND octets[1] BETWEEN 16 AND 31)
            OR (octets[0] = 192 AND octets[1] = 168) THEN '[PRIVATE_IPV4]'
        ELSE '[PUBLIC_IPV4]' END""")


# The words, in lower case, that tell the purpose of a date near them.
DATE_PURPOSES = {"DATE_OF_BIRTH": "birth|born|dob", "EXPIRY_DATE": "expir|valid until|good through", "ISSUE_DATE": "issue|created on"}


def date(of: str) -> str:
    words = "lower(concat_ws('\\n', hit, around))"
    cases = " ".join(f"WHEN {words} RLIKE '{pattern}' THEN '[{label}]'" for label, pattern in DATE_PURPOSES.items())
    return f"CASE {cases} ELSE '[DATE]' END"


def password(of: str) -> str:
    # a value that is a label already, or too short to be a secret, stays
    return f"""CASE
        WHEN startswith({of}, '[') AND endswith({of}, ']') THEN NULL
        WHEN startswith({of}, 'eyJ') THEN '[JWT_TOKEN]'
        WHEN length({of}) < 6 THEN NULL
        WHEN contains(lower(hit), 'jwt') THEN '[JWT_TOKEN]'
        WHEN contains(lower(hit), 'token') THEN '[AUTH_TOKEN]'
        WHEN contains(lower(hit), 'secret') OR contains(lower(hit), 'key') THEN '[SECRET_OR_KEY]'
        ELSE '[PASSWORD]' END"""
