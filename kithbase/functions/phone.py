"""Phone numbers: one normal form, in column functions alone; a single value goes through the same functions.

A number is its dialable part, up to the first tone character, and the tones
that follow. Each part is cleaned by itself, and whether a text is a number
at all is one pattern over the whole of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Characters with a meaning in numbers, what tones are written as, and how many digits numbers are matched by.
SEPARATORS = " .-()[]"
TONES = "pPwWxX,;#*"
TONE_FORMS = ("xX,;", "pppw")
SHORT = 8

#: Decimal digits of all scripts, by the code points of their zeros.
_ZEROS = [c for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0]
_SCRIPTS, _LATIN = "".join(chr(z + i) for z in _ZEROS for i in range(10)), "0123456789" * len(_ZEROS)
_SEP, _TONE = re.escape(SEPARATORS), re.escape(TONES)
# A letter is a tone only behind some digit; the other tones are that anywhere.
_LETTERS = "".join(t for t in TONES if t.isalpha())
_MARK = re.escape("".join(t for t in TONES if not t.isalpha()))
_LEAD = rf"[{_SEP}]*\+?[{_SEP}]*"
_DIALLED = rf"[0-9][0-9{_SEP}]*"
# With the tones kept a + may stand among them; where they are cut off, none may follow.
_VALID_TONES = rf"^{_LEAD}(?:{_DIALLED}(?:[{_TONE}][0-9+{_SEP}{_TONE}]*)?|[{_MARK}][+{_SEP}{_MARK}]*(?:[0-9][0-9+{_SEP}{_TONE}]*)?)?$"
_VALID_PLAIN = rf"^{_LEAD}(?:{_DIALLED}(?:[{_TONE}][0-9{_SEP}{_TONE}]*)?|[{_MARK}][0-9{_SEP}{_TONE}]*)?$"
_CALLER_ID = r"[#*]31#"


@dataclass(frozen=True)
class Form:
    """What a normal form keeps: punctuation, the tones (dial_string), '' for what isn't a number (validate); at most so many digits, from the dialable part's end."""

    punctuation: bool = False
    dial_string: bool = False
    validate: bool = False
    most: int | None = None


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _split(s: Column, head: str) -> Column:
    """(head, rest): what matches the pattern at the beginning, and what follows."""
    return _let(F.regexp_extract(s, f"(?s)^{head}", 0), lambda h: F.struct(h.alias("head"), F.substr(s, F.length(h) + 1).alias("rest")))


def _dialable(number: Column, form: Form) -> Column:
    """One + at the beginning, and digits; punctuation where it is kept."""
    keep = _SEP if form.punctuation else ""
    signed = _let(_split(number, r"[^0-9+]*\+?"), lambda p: F.concat(F.regexp_replace(p["head"], f"[^0-9+{keep}]", ""), F.regexp_replace(p["rest"], f"[^0-9{keep}]", "")))
    # A + behind the first digit stands for nothing: the head ends before that digit.
    return signed if form.most is None else F.regexp_replace(signed, rf"(?s)^.*?((?:[0-9][^0-9]*){{{form.most}}})$", "$1")


def _whole(s: Column, form: Form) -> Column:
    keep = _SEP if form.punctuation else ""
    # Letters before the first digit are no tones.
    heard = _let(_split(s, "[^0-9]*"), lambda p: F.concat(F.translate(p["head"], _LETTERS, ""), p["rest"]))

    def joined(p: Column) -> Column:
        number = _dialable(p["head"], form)
        if not form.dial_string:
            return F.trim(number)

        def with_tones(tones: Column) -> Column:
            out = F.trim(F.concat(number, tones))
            # A caller-id code has no place behind an international number.
            return F.when(tones.rlike(_CALLER_ID) & s.rlike(r"^[^0-9]*\+"), "").otherwise(out) if form.validate else out

        return _let(F.translate(F.regexp_replace(p["rest"], f"[^0-9+{_TONE}{keep}]", ""), *TONE_FORMS), with_tones)

    out = _let(heard, lambda h: _let(_split(h, f"[^{_TONE}]*"), joined))
    return F.when(s.rlike(_VALID_TONES if form.dial_string else _VALID_PLAIN), out).otherwise("") if form.validate else out


def formed(c: Column, form: Form) -> Column:
    """The normal form of a column of numbers; NULL stays NULL. Of sips:user@host or :user@host the user counts; digits of any script count as 0 to 9."""
    plain = F.translate(F.regexp_replace(c, r"(?s)^(?:sips)?:([^@]*)@.*$", "$1"), _SCRIPTS, _LATIN)
    return F.when(c.isNotNull(), _let(plain, lambda s: _whole(s, form)))


def normalise(c: Column, dial_string: bool = True, most: int | None = None) -> Column:
    """Digits with a leading +; with dial_string also what follows the first tone character (x and , as p, ; as w)."""
    return formed(c, Form(dial_string=dial_string, most=most))


def minimise(c: Column, most: int = SHORT) -> Column:
    """The form that numbers are matched by: the last digits, and the tones."""
    return normalise(c, True, most)


def minimised(number: str, most: int = SHORT) -> str:
    """minimise() of one number. The optimizer evaluates it on a table of one row; no job runs."""
    return SparkSession.active().sql("SELECT * FROM VALUES (:n) AS t(n)", {"n": number}).select(minimise(F.col("n"), most)).first()[0]
