"""Small tables with every odd case: nulls, empty, blank and long texts, ties, repeated
rows, clashing extra columns."""

import random

import pytest

SF0001, SF001 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

SYLLABLES = ["ta", "ro", "mi", "ken", "sol", "ba", "lun", "dor", "fi", "esh", "qua", "zim"]
CLASHING = ("size long, score double, token string, node long, shard int, taken long, start long, n_tokens long, "
            "items string, len int, x string, line long, _row long, _th long, fingerprint string, block int")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 3))) for _ in range(n)]


def document(seed, n=60):
    w = words(seed, n)
    return "\n".join(" ".join(w[i:i + 15]) for i in range(0, n, 15))


def odd_rows():
    base = document(1, 120)
    near = base.split(" ")
    near[40] = "changed"
    rows = [(i, document(100 + i), "en", f"s{i % 4}") for i in range(20)]
    rows += [(30, base, "en", "s0"), (31, base, "en", "s1"), (32, " ".join(near), "en", "s1"), (30, base, "en", "s0"),
             (40, None, None, None), (41, "", "en", "s2"), (42, " \t\n ", "en", "s2"), (43, "two words", "en", "s3"),
             (43, "two words", "en", "s3"), (None, document(7), "en", None), (None, None, None, "s0"),
             (44, document(9, 9000), "en", "s0"), (45, "É " + "x" * 20000, "fr", "ü"),
             (46, "'s <|endoftext|> İx\x00 # < \\ : ü 12", "fr", "ü")]
    extra = (1, 0.5, "t", 2, 3, 4, 5, 6, "i", 7, "x", 8, 9, 10, "f", 11)
    return [(k, t, lang, s, None if t is None else len(t), *extra) for k, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
