import unicodedata

import pytest
from pyspark.sql import functions as F

from goldrec.functions import phones as P
from goldrec.functions import similarity as S
from goldrec.functions import text as T


def values(spark, inputs, column, schema="a string"):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


A, B = "a", "b"
PAIR = "a string, b string"


def test_text_cleaning(spark):
    col = F.col
    assert values(spark, [" \t12-34 a\n", None, "  "], T.norm_national_id(col(A), True)) == ["1234a", None, None]
    assert values(spark, ["---", " "], T.norm_national_id(col(A))) == ["", ""]
    assert values(spark, ["\t crm\x00 ", None], T.norm_source(col(A))) == ["CRM", None]
    assert values(spark, [" A@X.org ", " ", None], T.norm_email(col(A))) == ["a@x.org", None, None]
    assert values(spark, [" ANN ", None], T.norm_name(col(A))) == ["ann", ""]
    phones = ["+1 (555) 123-4567", "5551234567", "25551234567", None]
    assert values(spark, phones, T.norm_phone(col(A))) == ["5551234567", "5551234567", "25551234567", ""]
    assert values(spark, ["123456", "1234", None], T.mask_national_id(col(A))) == ["***3456", "***", "***"]
    assert values(spark, ["123456789", "12345678", None], T.mask_key(col(A))) == ["1234...6789", "***", "***"]
    assert values(spark, ["abcd", "abc", None], T.truncate_text(col(A), 3)) == ["abc...", "abc", None]


def test_truncation_counts_no_more_than_it_may_keep(spark):
    texts = ["a" * 12, "a" * 13, "é" * 4, "𝄞" * 3, "𝄞" * 4, "a𝄞é日b", "日" * 5, "", None, "ab\U0001f600" * 9]
    want = [t if t is None or len(t) <= 3 else t[:3] + "..." for t in texts]
    cut = T.truncate_text(F.col(A), 3)
    assert values(spark, texts, cut) == want
    assert f"length({A})" not in str(cut).replace(f"octet_length({A})", "")


def test_nfc_agrees_with_the_unicode_tables(spark):
    texts = ["plain", "é", "Å", "가", "ñö", "̈́", "日本", None, ""]
    want = [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert values(spark, texts, T.nfc(F.col(A))) == want


def test_names_match(spark):
    pairs = [(" Ann", "ANN "), (None, None), ("Ann", None), ("Ann", "Anna")]
    assert values(spark, pairs, T.names_match(F.col(A), F.col(B)), PAIR) == [True, True, False, False]


def test_deterministic_key_ignores_form(spark):
    key = T.det_key(F.col(A), F.col(B))
    keys = values(spark, [("12-34-ab", " crm "), ("1234AB", "CRM"), ("1234AB", "WEB"), (None, "WEB")], key, PAIR)
    assert keys[0] == keys[1] != keys[2] and keys[3] is None and len(keys[0]) == 64


def test_phone_lists(spark):
    texts = ["+1", ' ["a","b"] ', "[oops", "[]", " ", None]
    assert values(spark, texts, P.parse_phones(F.col(A))) == [["+1"], ["a", "b"], ["[oops"], [], [], []]
    out = values(spark, ['["a","b"]', None], P.serialize_phones(P.parse_phones(F.col(A))))
    assert out == ['["a","b"]', None]


def test_sound_codes(spark):
    want = {
        "Robert": "R163",
        "Rupert": "R163",
        "Ashcraft": "A226",
        "Wachs": "W220",
        "Tymczak": "T522",
        "Lee": "L000",
        "": "",
    }
    assert values(spark, list(want), S.sound_code(F.col(A))) == list(want.values())
    same = [("Smith", "Smyth"), ("Johnson", "Jonson"), ("John", "Mary")]
    equal = S.sound_code(F.col(A)) == S.sound_code(F.col(B))
    assert values(spark, same, equal, PAIR) == [True, True, False]


SCORES = [
    (S.score_email, [("a@x", "a@x", 1.0), ("a@x", None, 0.0), ("abcd", "abcf", 0.75), ("a", "xyz", 0.0)]),
    (
        S.score_email_gmail,
        [("j.d@gmail.com", "jd@gmail.com", 0.95), ("a@gmail.com", "a@gmail.com", 0.95), ("a@x", "a@x", 1.0)],
    ),
    (
        S.score_name,
        [("Ann", " ann", 1.0), ("", "ann", 0.0), ("anna", "ann", 0.75), ("jo", "jonathan", 0.7), ("amy", "zoltan", 0.0), (None, "a", 0.0)],
    ),
    (
        S.score_nickname,
        [("Jack", "john", 0.9), ("Bob", "Robert", 0.9), ("Liz", "Elizabeth", 0.9), ("Ann", "ann", 1.0), ("Ann", "Eve", 0.0)],
    ),
    (
        S.score_phone,
        [("+1-555-123-4567", "(555) 123-4567", 1.0), ("2125551234", "9175551234", 0.7), ("5551234567", "5559876543", 0.0), ("", "1", 0.0), (None, "1", 0.0)],
    ),
]


@pytest.mark.parametrize("score,cases", SCORES, ids=lambda x: getattr(x, "__name__", ""))
def test_scores(spark, score, cases):
    got = values(spark, [c[:2] for c in cases], F.round(score(F.col(A), F.col(B)), 6), PAIR)
    assert got == [c[2] for c in cases]


def test_phonetic_score_is_the_mean_of_both_names(spark):
    cases = [("Robert", "Rupert", "Smith", "Smyth"), ("Ann", "Bob", "Smith", "Smyth"), ("Ann", "Ann", None, "X"), ("", "", "", "")]
    schema = "a string, b string, c string, d string"
    got = values(spark, cases, S.score_phonetic(*map(F.col, "abcd")), schema)
    assert got == [1.0, 0.5, 0.5, 0.0]


def test_nickname_table_has_all_names():
    assert len(S.nickname_table()) == 65
