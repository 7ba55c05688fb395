import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from sylvan.functions import text as T


def test_binary_detection(evaluate):
    cases = [
        (b"", False),
        (b"const x = 1;\n", False),
        ("日本語のテキスト".encode(), False),
        (b"\t\n\f\rAB", False),
        (b"\x01" * 5 + b"A" * 95, False),
        (b"A" * 8192 + b"\0" * 100, False),
        (b"AB\0C", True),
        (b"\x01" * 40 + b"A" * 60, True),
        (b"\x01" * 30 + b"A" * 70, False),
        (b"\x01" * 31 + b"A" * 69, True),
        (b"\x7f\x0b\x0e\x1f" * 10 + b"A" * 60, True),
        (b"\x80\xff" * 50, False),
    ]
    got = evaluate(T.is_binary, [c for c, _ in cases], "binary")
    assert got == [e for _, e in cases]


def test_binary_matches_byte_loop(evaluate):
    def model(data):
        head = data[:8192]
        if not head:
            return False
        if 0 in head:
            return True
        bad = sum(b < 32 and b not in (9, 10, 12, 13) or b == 127 for b in head)
        return bad / len(head) > 0.3

    rng = random.Random(3)
    pool = [[1, 65], [7, 8, 9, 10, 65, 66], [127, 126, 200, 31], [0, 65, 66, 67, 68, 69, 70, 71]]
    data = [
        bytes(rng.choices(rng.choice(pool), k=rng.choice([0, 1, 3, 10, 100, 9000]))) for _ in range(300)
    ]
    assert evaluate(T.is_binary, data, "binary") == [model(d) for d in data]


def test_decode_keeps_text_and_replaces_bad_bytes(evaluate):
    data = [b"plain", "é😀".encode(), b"\xef\xbb\xbfx", b"a\xffb", b"\xe3\x81", b"\xed\xa0\x80z", b""]
    got = evaluate(lambda c: T.decode_text(c), data, "binary")
    assert got == [d.decode("utf-8", "replace") for d in data]


def test_sizes(evaluate):
    values = ["", "あ", "abcdefghij", "a😀b", "abcdefgh"]
    assert evaluate(T.byte_length, values) == [0, 3, 10, 6, 8]
    assert evaluate(lambda c: T.tokens_of(T.utf16_length(c)), values) == [0, 1, 3, 1, 2]


def test_line_count(evaluate):
    assert evaluate(T.line_count, ["", "a", "a\n", "a\nb", "\n\n"]) == [1, 1, 2, 2, 3]


def test_format_bytes(evaluate):
    sizes = [0, 1, 512, 1023, 1024, 2048, 106394, 1048576, 1024**3, 5 * 1024**4]
    expected = [
        "0 B", "1.0 B", "512.0 B", "1023.0 B", "1.0 KB", "2.0 KB", "103.9 KB", "1.0 MB",
        "1.0 GB", "5.0 TB",
    ]
    assert evaluate(T.format_bytes, sizes, "long") == expected


def test_format_count(evaluate):
    counts = [0, 999, 1000, 1050, 1150, 1250, 1350, 12345, 999_949, 999_999, 1_000_000, 2_250_000]
    expected = [
        "0", "999", "1.0k", "1.1k", "1.1k", "1.3k", "1.4k", "12.3k", "999.9k", "1000.0k", "1.0m", "2.3m",
    ]
    assert evaluate(T.format_count, counts, "long") == expected


def test_one_decimal_is_exact(evaluate):
    rng = random.Random(5)
    values = [n / 1000 for n in range(0, 5000, 50)] + [rng.random() * 10 ** rng.randint(0, 6) for _ in range(500)]
    exact = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert evaluate(T.one_decimal, values, "double") == exact


def test_trim_takes_unicode_space_and_bom(evaluate):
    values = ["  a b\t", "﻿x ", " y　", "\u0085z\u0085", ""]
    assert evaluate(T.trim, values) == ["a b", "x", "y", "\u0085z\u0085", ""]
    assert evaluate(T.indent_width, ["  a", "\t b", "c ", " d"]) == [2, 2, 0, 1]


def test_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(b"x",)], "c binary")
    text = T.decode_text(F.col("c"))
    plan = df.select(
        T.is_binary(F.col("c")), T.line_count(text), T.utf16_length(text), T.format_bytes(F.octet_length(text))
    )._jdf.queryExecution().toString()
    assert "Python" not in plan
