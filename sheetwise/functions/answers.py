"""Answer texts as column expressions.

An answer set is a subset of {1..5}, carried as a five-bit mask (bit n-1 for
choice n). Masks compare, group and aggregate as plain integers, so a question
is aggregated with min/max instead of collecting arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The circled choice symbols in choice order, the shape-like
# characters that make a low reading worth a reread, the Korean numerals.
CIRCLED = "①②③④⑤"
SHAPES = "①②③④⑤○◯□■◇△▽@©OoDⓞ◎"
NUMERALS = {"한": 1, "두": 2, "세": 3, "네": 4, "다섯": 5}

# Unicode white space written out: the same set as Python's, and much cheaper to
# match than a Unicode-mode class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DIGIT = f"[1-5{CIRCLED}]"


# Every character Python and Unicode treat as white space.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row; a plain repeated
    sub-expression inside CASE branches would run its patterns again each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE[1:]}")


def choice_digits(text: Column) -> Column:
    """Choice digits of a text made of choices and separators only."""
    return F.translate(text, CIRCLED + "().,，" + _SPACES, "12345")


def digits_to_mask(digits: Column, *, reject_repeats: bool) -> Column:
    """Mask of a run of digits 1-5; a repeated digit gives null when
    ``reject_repeats`` is set. No digit at all gives null."""
    mask = F.lit(0)
    for n in range(1, 6):
        mask = mask + F.when(F.contains(digits, F.lit(str(n))), 1 << (n - 1)).otherwise(0)
    valid = F.length(digits) > 0
    if reject_repeats:
        valid = valid & (F.length(digits) == F.bit_count(mask))
    return F.when(valid, mask.cast("int"))


def student_choices(text: Column) -> Column:
    """Mask of a complete answer form; anything else is null."""
    form = (
        rf"^{SPACE}*(?:{DIGIT}|\({DIGIT}\)|{DIGIT}\.|[{CIRCLED}]{{2,}}"
        rf"|{DIGIT}(?:(?:{SPACE}*[,，]{SPACE}*|{SPACE}+){DIGIT})+){SPACE}*\z"
    )
    return F.when(text.rlike(form), digits_to_mask(choice_digits(text), reject_repeats=True))


def key_answer(raw: Column) -> Column:
    """Mask of the leading answer field of a key entry. The list takes all it
    can (possessive), then the field must end at a colon or line end and no
    further choice or comma may follow."""
    lead = (
        rf"^[ \t]*+({DIGIT}(?:{SPACE}*[,，]{SPACE}*{DIGIT})*+)"
        rf"(?=[ \t]*(?::|\r|\n|\z))(?!{SPACE}*[,，{CIRCLED}])"
    )
    field = choice_digits(F.regexp_extract(raw, lead, 1))
    return let(field, lambda digits: digits_to_mask(digits, reject_repeats=True))


def eligible_answer(text: Column, score: Column, route: Column) -> Column:
    """Mask of a strictly numeric student reading at or above .8; repeats count once."""
    numeric = text.rlike(rf"^[{SPACE[1:-1]}{CIRCLED}1-5,，().]+\z")
    return F.when(
        (route == "student_candidate") & score.isNotNull() & ~(score < 0.8) & numeric,
        digits_to_mask(choice_digits(text), reject_repeats=False),
    )


def to_digit(text: Column) -> Column:
    """The single choice number a reading stands for, as an int."""
    lone = text.rlike(rf"^{SPACE}*{DIGIT}{SPACE}*\z")
    return F.when(lone, choice_digits(text).cast("int"))


def should_reread(text: Column, score: Column) -> Column:
    """A lone zero, or a low reading made of shape-like characters only."""
    text = F.coalesce(text, F.lit(""))
    low = F.coalesce(score < 0.8, F.lit(False))
    zero = text.rlike(rf"^{SPACE}*0{SPACE}*\z")
    return zero | (low & text.rlike(rf"^{SPACE}*[{SHAPES}]+{SPACE}*\z"))


def required_answer_count(text: Column) -> Column:
    """Answer count the instruction states outright, else null."""
    end = r"[?？]|(?:고르|선택하)(?:시오|세요)\.?"
    only_count = (
        rf"^{SPACE}*[（(]?{SPACE}*정답{SPACE}*(?:은|[:：])?{SPACE}*(?:[1-5한두세네]|다섯){SPACE}*개{SPACE}*[)）]?{SPACE}*\z"
    )
    token = rf"(?<!\p{{Nd}})(다섯|[1-5한두세네]){SPACE}*개"

    def header(before: Column) -> Column:
        head = F.regexp_extract(before, rf"(?s)^(?:.*?(?:{end}))(?:{SPACE}*[（(]{SPACE}*정답[^)）]*[)）])?", 0)
        return F.when(head != "", head).when(before.rlike(only_count), before)

    def counts(text: Column) -> Column:
        found = F.concat(
            F.regexp_extract_all(text, F.lit(rf"정답{SPACE}*(?:은|[:：])?{SPACE}*{token}"), F.lit(1)),
            F.regexp_extract_all(
                text, F.lit(rf"{token}(?:를|씩)?{SPACE}*(?:모두{SPACE}*)?(?:고르|고른|선택)"), F.lit(1)
            ),
        )
        # Compare numbers, so "2" and "두" are one value.
        return F.array_distinct(
            F.transform(
                found,
                lambda w: F.translate(F.replace(w, F.lit("다섯"), F.lit("5")), "한두세네", "1234"),
            )
        )

    stated = F.when(F.contains(text, F.lit("개")), text)  # no count word, no work
    body = F.regexp_replace(strip(stated), rf"^{SPACE}*\p{{Nd}}+\.", "")
    before = F.element_at(F.split(body, f"[{CIRCLED}•]", 2), 1)
    numbers = let(let(before, header), counts)
    return let(numbers, lambda found: F.when(F.size(found) == 1, F.element_at(found, 1).cast("int")))


def mask_size(mask: Column) -> Column:
    return F.bit_count(mask)


def single_mask(number: Column) -> Column:
    """Mask holding just one choice number."""
    return F.when(number.between(1, 5), F.pow(F.lit(2), number - 1).cast("int"))


def mask_to_array(mask: Column) -> Column:
    """Sorted int array, the nested form of an answer set."""
    values = [F.when(mask.bitwiseAND(1 << (n - 1)) != 0, F.lit(n)) for n in range(1, 6)]
    return F.when(mask.isNotNull(), F.array_compact(F.array(*values)))


def answer_string(mask: Column) -> Column:
    """Choice numbers joined by commas; null stays null."""
    values = [F.when(mask.bitwiseAND(1 << (n - 1)) != 0, F.lit(str(n))) for n in range(1, 6)]
    return F.when(mask.isNotNull(), F.concat_ws(",", *values))


def natural_key(ident: Column) -> Column:
    """Digit runs of an id as an int array, for ordering q2 before q10."""
    runs = F.regexp_extract_all(ident, F.lit(r"(\d+)"), F.lit(1))
    return F.transform(runs, lambda run: run.cast("long"))
