import random

import pytest

WORDS = ["the", "Of", "and", "ring", "était", "größe", "niño", "value", "x1", "end.", "one,", "it's", "QUOTE", "—dash", "日本", "a|b", "###"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, key string, cleaned string, spans string, rep long, __text string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(n))


def corpus(seed=7):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(60, 160)) + "." for _ in range(14)]
    texts = [*base]
    texts += [base[0], base[0], base[1].replace("the", "THE", 1), base[2] + " tail one two three.", "x " + base[3]]
    texts += [base[4][: len(base[4]) // 2] + sentence(rng, 20) + base[5][len(base[5]) // 2 :], base[6] + "\n" + base[6], "a" * 450, "ab" * 300]
    texts += [None, "", " ", "\n\n", "\t \r\n", "one", "two words", "a b c", "Tiny.", "  x", "<|endoftext|> and <|startoftext|>", "▁mark ▁▁ x", "line one.\nline one.\n\nline two.\r\n", "é İ ﬁ"]
    texts += [(sentence(rng, 9) + ".\n") * 400, " ".join(base[:3])]
    texts += ["Home | About | Contact\n" + b + "\nAll rights reserved." for b in base[7:13]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or ""), 1, 2, "k", "c", "s", 3, "t") for i, t in enumerate(texts)]
    rows += [rows[0], rows[14], (5, "another text of id five", "en", "s0", 23, 1, 2, "k", "c", "s", 3, "t"), (None, base[0], None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
