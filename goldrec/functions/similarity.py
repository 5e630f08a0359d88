"""Match scores between two contact records, as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.functions.text import norm_name, norm_phone

# ---- fixed values ---------------------------------------------------------
NICKNAMES = {
    "john": ("jon", "jonny", "johnny", "jack", "jock", "ian"),
    "robert": ("rob", "bob", "bobby", "robbie"),
    "william": ("will", "bill", "billy", "willy"),
    "richard": ("rich", "rick", "ricky", "dick"),
    "michael": ("mike", "mikey", "mick"),
    "joseph": ("joe", "joey"),
    "christopher": ("chris", "topher"),
    "daniel": ("dan", "danny"),
    "matthew": ("matt", "matty"),
    "alexander": ("alex", "al"),
    "nicholas": ("nick", "nicky"),
    "anthony": ("tony", "ant"),
    "elizabeth": ("liz", "beth"),
    "katherine": ("kate", "kathy", "catherine"),
    "jennifer": ("jen", "jenny"),
    "patricia": ("pat",),
    "barbara": ("barb",),
    "margaret": ("maggie",),
    "dorothy": ("dot",),
}
WEIGHT_EMAIL = 0.40
WEIGHT_NAME = 0.25
WEIGHT_PHONE = 0.20
WEIGHT_PHONETIC = 0.15
DUPLICATE_AT = 0.80
POSSIBLE_AT = 0.50
NAME_EDITS = 2
CONTAINED_NAME = 0.7
SAME_NICKNAME = 0.9
SAME_GMAIL = 0.95
SAME_LAST_DIGITS = 0.7
LAST_DIGITS = 7
SOUND_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUND_CODES = "111122222222334556"
# ---------------------------------------------------------------------------


def nickname_table() -> dict[str, str]:
    table = {}
    for canonical, variants in NICKNAMES.items():
        for name in (canonical, *variants):
            table[name] = canonical
    return table


def canonical_name(c: Column) -> Column:
    """The full form of a nickname; other names stand for themselves."""
    name = norm_name(c)
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(nickname_table().items())))
    return F.coalesce(F.try_element_at(table, name), name)


def sound_code(c: Column) -> Column:
    """First letter plus three digits. A letter without a code parts equal codes,
    and a run of one code counts once, the first letter's own code included."""
    name = F.upper(c)
    coded = F.translate(
        F.regexp_replace(name, f"[^{SOUND_LETTERS}]", "0"), SOUND_LETTERS, SOUND_CODES
    )
    runs = F.regexp_replace(coded, r"(\d)\1+", "$1")
    digits = F.regexp_replace(F.substring(runs, 2, 1_000_000), "0", "")
    code = F.concat(F.left(name, F.lit(1)), F.rpad(F.left(digits, F.lit(3)), 3, "0"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(code)


def score_email(a: Column, b: Column) -> Column:
    edits = F.levenshtein(F.lower(a), F.lower(b))
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - edits / longest))
    )


def score_email_gmail(a: Column, b: Column) -> Column:
    def undotted(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), r"\.", "")

    both_gmail = F.lower(a).contains("@gmail.com") & F.lower(b).contains("@gmail.com")
    return F.when(both_gmail & (undotted(a) == undotted(b)), SAME_GMAIL).otherwise(
        score_email(a, b)
    )


def email_score(x: Column, y: Column, key_x: Column, key_y: Column) -> Column:
    """``score_email_gmail`` of two cleaned e-mails; the keys of Gmail ones are without dots."""
    both_gmail = x.contains("@gmail.com") & y.contains("@gmail.com")
    return (
        F.when((key_x == key_y) & both_gmail, SAME_GMAIL)
        .when(x.isNull() | y.isNull(), 0.0)
        .when(x == y, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))
    )


def name_score(x: Column, y: Column) -> Column:
    """Similarity of two cleaned names."""
    edits = F.levenshtein(x, y)
    return (
        F.when(x == y, 1.0)
        .when((x == "") | (y == ""), 0.0)
        .when(edits <= NAME_EDITS, 1.0 - edits / F.greatest(F.length(x), F.length(y)))
        .when(x.contains(y) | y.contains(x), CONTAINED_NAME)
        .otherwise(0.0)
    )


def score_name(a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, name_score(norm_name(a), norm_name(b))).otherwise(0.0)


def sound_score(first_a: Column, first_b: Column, last_a: Column, last_b: Column) -> Column:
    """Mean agreement of the sound codes of first and last names; a null or empty
    code agrees with nothing."""

    def same(x: Column, y: Column) -> Column:
        return F.when((x == y) & (x != ""), 1.0).otherwise(0.0)

    return (same(first_a, first_b) + same(last_a, last_b)) / 2.0


def score_phonetic(first_a: Column, first_b: Column, last_a: Column, last_b: Column) -> Column:
    return sound_score(*(_given_sound(c) for c in (first_a, first_b, last_a, last_b)))


def _given_sound(name: Column) -> Column:
    return F.when(F.length(name) > 0, sound_code(norm_name(name)))


def nickname_score(x: Column, y: Column, canonical_x: Column, canonical_y: Column) -> Column:
    """Agreement of two cleaned names or of their full forms; null agrees with nothing."""
    return F.when(x == y, 1.0).when(canonical_x == canonical_y, SAME_NICKNAME).otherwise(0.0)


def score_nickname(a: Column, b: Column) -> Column:
    known = a.isNotNull() & b.isNotNull()
    score = nickname_score(norm_name(a), norm_name(b), canonical_name(a), canonical_name(b))
    return F.when(known, score).otherwise(0.0)


def last_digits(phone: Column) -> Column:
    """The last seven digits of a cleaned phone, or null when it is shorter."""
    return F.when(F.length(phone) >= LAST_DIGITS, F.right(phone, F.lit(LAST_DIGITS)))


def phone_score(x: Column, y: Column) -> Column:
    """Agreement of two cleaned phones."""
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(last_digits(x) == last_digits(y), SAME_LAST_DIGITS)
        .otherwise(0.0)
    )


def keyed_phone_score(x: Column, y: Column, key_x: Column, key_y: Column) -> Column:
    """``phone_score`` of two cleaned phones; the key of a phone is its last digits, of a
    shorter one the whole, of an empty one null."""
    return F.when(key_x == key_y, F.when(x == y, 1.0).otherwise(SAME_LAST_DIGITS)).otherwise(0.0)


def score_phone(a: Column, b: Column) -> Column:
    return phone_score(norm_phone(a), norm_phone(b))
