"""Places at which a text can be cut without any rule noticing.

A line end is such a place if the ``ZONE`` characters on either side of it are plain prose
(letters, blanks and stops, no digit, quote, bracket or sign), and the line ends with a
stop. Of the patterns of ``functions.rules`` only those that go through blanks or through
what is not a quote or an angle bracket can cross a line end at all:

* numbers with words around them need a digit nearer than the zone is long;
* names before a street are parted by blanks alone, so the stop ends them;
* a quoted secret has at most 64 characters, fewer than the two zones together;
* what stands in ``<password>...</password>`` may be of any length: a text with such a tag
  is not cut;
* a word after ``passport no.`` or an employee's ``id`` may be taken for a number, so the
  line must not end with such a word; Hebrew letters are not part of a zone;
* the neighbourhood of a date is 30 characters, and dates have digits.

So what the rules find on one side does not depend on the other. This holds for profile
``fixed``, whose rules look at nothing but the text as it stands, and without rules of the
user's own.
"""

from __future__ import annotations

from scrubline.functions.text import quote

ZONE = 40
_PLAIN = r"[\p{L} ,.;!?()&&[^\p{InHebrew}]]"
# fixed values: words that a value may follow directly, and tags that hold one of any length
_OPEN_WORDS = "passport|number|no|id"
_TAGS = "password|passwd|pwd|passphrase|pass[\\s_]?code|secret|credential|token|auth_key|private_key"
# the line end comes first, or what precedes it would be looked at before every character of a text
CUT = rf"\n(?<=\p{{L}}[.,;!?]\n)(?={_PLAIN}{{{ZONE}}})(?<={_PLAIN}{{{ZONE}}}\n)(?<!\b(?i:{_OPEN_WORDS})[.,;!?]\n)"


def segments(text: str) -> str:
    """SQL: the text, which is not NULL, as an array of segments that were parted by a line end."""
    return f"IF({text} RLIKE {quote(f'(?i)<(?:{_TAGS})>')}, array({text}), split({text}, {quote(CUT)}, -1))"
