import random

import pytest

from tests.llm.tables import build, sentence


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, "en" if i % 3 else "de", rng.randint(20, 90)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(40)]
    long_text = sentence(rng, "en", 20_000)
    passage = sentence(rng, "en", 60)
    rows += [(40, None, None, None), (41, "", "en", "s0"), (42, " \t\n ", "de", None), (43, long_text, "en", "s0"), (44, "one", "en", "s1"),
             (45, "123 456 !!", "en", "s1"), (46, "x", None, "s2"), (47, "ab" * 4000, "en", "s2"), (48, "é" * 300, "de", "s3"),
             (None, rows[3][1], "en", "s1"), (None, None, None, None), (None, passage, None, "s1"), (3, *rows[3][1:]), (5, *rows[5][1:]), (5, *rows[5][1:]),
             (49, rows[7][1], "en", "s3"), (50, rows[8][1] + " added words", "en", "s0"), (51, rows[9][1] + " " + passage, "en", "s1"), (52, passage + " " + rows[10][1], "en", "s1"),
             (6, rows[11][1], "en", "s2")]
    words = rows[12][1].split()
    words[4] = "changed"
    rows.append((53, " ".join(words), "de", "s0"))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0), "z") for i in range(40)] + [(1, 1, 0, "z"), (2, None, None, None), (None, 1, 1, "z"), (999, 1, 0, "z")]
    item = odd_rows[0][1] or "a b c"
    benchmark = [(1, " ".join(item.split()[:20])), (2, "winter house paper"), (3, None), (4, ""), (5, "!!"), (5, "winter house paper"), (10, " ".join(item.split()[3:18]).upper())]
    talk = [(1, 0, "user", "hi <|end|> you"), (1, 1, "assistant", None), (1, 1, "assistant", "␛1 <|turn|>␛0 [INST]"), (2, None, None, "x"), (None, 0, "assistant", ""),
            (3, 0, "assistant", "a\n<|body|>b"), (3, 0, "assistant", "a\n<|body|>b"), (4, 2, "user", "later"), (4, 1, "assistant<|body|>", "</s>" * 50)]
    return build(spark, tmp_path_factory.mktemp("odd"), odd_rows, labels, benchmark, talk)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("empty"), [])
