import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests import rules
from vacantia.functions import text as T

ALPHABET = (
    "abcXYZ019 \t\n\r\x0b\x1c\x1f$.-,;_ñÑáÉüçøßæĐŁİıſ\xa0 　́̈"
    "ﬁ½²αΩжЯ漢한أ€“”…ẞỆ"
)


def random_texts(n, seed=3, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def apply(spark, texts, expression):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = table.select("i", expression(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_standard_text_equals_rule(spark):
    texts = random_texts(2000)
    assert apply(spark, texts, T.standardize) == [rules.standard(t) for t in texts]


def test_fused_steps_equal_the_step_list(spark):
    texts = random_texts(1000, seed=5)
    stepwise = apply(spark, texts, lambda c: T.standardize(c, T.DEFAULT_STEPS))
    assert apply(spark, texts, T.standardize) == stepwise


def test_caller_may_replace_the_steps(spark):
    steps = [T.lowercase, T.squeeze_spaces]
    assert apply(spark, ["  ÁB \t c."], lambda c: T.standardize(c, steps)) == ["áb c."]


def test_accents_go_and_other_letters_stay(spark):
    texts = random_texts(1500, seed=7, alphabet=ALPHABET.replace("한", ""))

    def without_marks(text):
        parts = unicodedata.normalize("NFD", text)
        return "".join(p for p in parts if unicodedata.category(p) != "Mn")

    assert apply(spark, texts, T.remove_accents) == [without_marks(t) for t in texts]


def test_every_composed_letter_folds_like_decomposition(spark):
    points = [chr(p) for p in range(0x80, 0x3000)]
    folded = [
        unicodedata.normalize("NFD", p).encode("ascii", "ignore").decode() for p in points
    ]
    assert apply(spark, points, T.ascii_fold) == folded


def test_spaces_alphanumerics_and_words(spark):
    texts = random_texts(800, seed=9)
    assert apply(spark, texts, T.squeeze_spaces) == [" ".join(t.split()) for t in texts]
    assert apply(spark, texts, T.strip) == [t.strip() for t in texts]
    assert apply(spark, texts, T.split_words) == [t.split() for t in texts]
    kept = ["".join(c for c in t if c.isspace() or (c.isascii() and c.isalnum())) for t in texts]
    assert apply(spark, texts, T.keep_alphanumeric) == kept


@pytest.mark.parametrize(
    "raw, code", [("123 x", "123"), ("00a", "00"), (" 12", None), ("x 1", None), ("", None)]
)
def test_listing_code(spark, raw, code):
    assert apply(spark, [raw], T.listing_code) == [code]


def test_flatten_lines(spark):
    assert apply(spark, ["a\nb\r\nc"], T.flatten_lines) == ["a b  c"]


def test_keyword_in_any_case(spark):
    found = apply(spark, ["Dev PYTHON", "java"], lambda c: T.contains_keyword(c, "Python"))
    assert found == [True, False]
