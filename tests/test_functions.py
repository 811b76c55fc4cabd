import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.functions import codecs, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_tokens_are_cut_before_lower_casing(spark):
    given_texts = ["It's time to party!   <br><\n12-34-test", "Kx İy", "café", "", "!?", None]
    wanted = [["it", "s", "time", "to", "party", "br", "12", "34", "test"], ["x", "y"], ["caf"], [], [], None]
    assert column(spark, given_texts, text.tokens) == wanted


def test_tokens_match_a_plain_model(spark):
    texts = ["aİB", "٠ 7", "x_y", "A" * 5000, "\U0001f600z", "tab\tnew\r\nline", "ß1"]
    assert column(spark, texts, text.tokens) == [[w.lower() for w in re.findall("[A-Za-z0-9]+", t)] for t in texts]


VOTES = {
    "3/1": (1, 3), "1/0": (0, 1), "7": (1, 7), "5/": (1, 5), "/5": (0, 1), "x/5": (0, 1), "1 / 2": (0, 1), "0/0": (0, 0), "-1/5": (0, 5), "2/-3": (0, 2), " 4/9 ": (4, 9),
    "": (0, 1), "99999999999/1": (0, 1), "-2/-3": (0, 0),
}


def plain_votes(value):
    parts = [p for p in value.strip().split("/")]
    while parts and not parts[-1]:
        parts.pop()
    number = lambda p: int(p) if re.fullmatch(r"[+-]?[0-9]+", p) and -(2**31) <= int(p) < 2**31 else None
    num, den = 0, 1
    if parts and number(parts[0]) is not None:
        num = number(parts[0])
        if len(parts) > 1 and number(parts[1]) is not None:
            den = number(parts[1])
    if num > den:
        num, den = den, num
    num = max(num, 0)
    return num, num if den < 0 else den


def test_helpfulness(spark):
    assert [tuple(r) for r in column(spark, list(VOTES), text.helpfulness)] == list(VOTES.values())
    assert [plain_votes(v) for v in VOTES] == list(VOTES.values())
    assert tuple(column(spark, [None, "1/2"], text.helpfulness)[0]) == (0, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[ ]?[-+]?[0-9x]{0,3}/?[-+]?[0-9]{0,3}", fullmatch=True), min_size=30, max_size=60))
def test_helpfulness_matches_a_plain_model(spark, values):
    assert [tuple(r) for r in column(spark, values, text.helpfulness)] == [plain_votes(v) for v in values]


def test_score(spark):
    assert column(spark, ["4.9", "0.5", "6", "NaN", "x", "", "5", None, "5.99", "-1", "Infinity"], text.score) == [4, 1, 1, 1, 1, 1, 5, 1, 5, 1, 1]


def test_product_key(spark):
    assert column(spark, [" b0x ", "", "  ", None, "B"], text.product_key) == ["B0X", None, None, None, "B"]


def test_varint():
    assert codecs.varint_encode(128) == bytes([0, 129])
    with pytest.raises(ValueError):
        codecs.varint_encode(0)


@given(st.lists(st.integers(1, 2**31 - 1)))
def test_codecs_round_trip(numbers):
    assert list(codecs.varint_decode(b"".join(map(codecs.varint_encode, numbers)))) == numbers
    assert list(codecs.group_varint_decode(codecs.group_varint_encode(numbers))) == numbers


def test_group_varint_bytes():
    assert codecs.group_varint_encode([7, 513, 70000, 255]) == bytes([0b00011000, 7, 2, 1, 1, 17, 112, 255])
    assert codecs.group_varint_encode([300]) == bytes([0b01000000, 1, 44, 0, 0, 0])
    assert codecs.group_varint_encode([2**32 - 1] * 4) == bytes([255] * 17)
    assert codecs.group_varint_encode([]) == b""


def test_sizes_match_the_bytes(spark):
    numbers = [1, 127, 128, 255, 256, 16383, 16384, 65536, 2**24, 2**31 - 1]
    assert column(spark, numbers, codecs.varint_size, "long") == [len(codecs.varint_encode(n)) for n in numbers]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").agg(codecs.group_varint_total(F.count("*"), F.sum(codecs.byte_length(F.col("n")))))
    assert df.first()[0] == len(codecs.group_varint_encode(numbers))


def test_group_varint_of_many_rows():
    import numpy as np

    rows = [[7, 513, 70000, 255], [300], [2**32 - 1] * 5, [], list(range(1, 700))]
    data, sizes = codecs.group_varint_encode_rows(np.array(sum(rows, []), np.int64), np.array([len(r) for r in rows]))
    want = [codecs.group_varint_encode(r) for r in rows]
    assert data.tobytes() == b"".join(want) and sizes.tolist() == [len(w) for w in want]
    numbers, counts = codecs.group_varint_decode_rows(data.tobytes(), sizes)
    assert numbers.tolist() == sum(rows, []) and counts.tolist() == [len(r) for r in rows]
    with pytest.raises(ValueError):
        codecs.group_varint_encode_rows(np.array([0, 1]), np.array([2]))


def test_front_coding():
    joined, marks = codecs.front_encode(["lamp", "lampshade", "lantern", "latch", "late"])
    assert joined == "lampshadenterntchlate" and [m[1] for m in marks] == [0, 4, 2, 2, 0]


@given(st.lists(st.text("ab", max_size=6)))
def test_front_coding_round_trip(words):
    words = sorted(words)
    assert list(codecs.front_decode(*codecs.front_encode(words))) == words


def test_common_prefix_length(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("a", None), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(text.common_prefix_length(F.col("a"), F.col("b"))).collect()] == [2, 0, 0, 4]
