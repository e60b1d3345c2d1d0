import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
WORDS = "the of and tion ing her ent ion ter was ere ati hat ver all wit thi oul ight ould est res com per".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls in both, empty, blank, short, repeated rows, copies, near copies, other scripts, one long text."""
    base = prose(200, 1)
    words = base.split()
    near = " ".join(words[:100] + ["other"] + words[101:])
    part = prose(80, 2) + " " + " ".join(words[20:60]) + " " + prose(50, 3)
    return [
        (1, base), (2, near), (3, base), (3, base), (4, part), (5, ""), (6, None), (7, "  \n "), (8, "one two"),
        (9, "one  two"), (10, "é ü 日本語 テスト 😀 " + prose(30, 4)), (None, base), (None, "no id here at all, nothing else"),
        (None, None), (11, prose(30_000, 5)), (12, 'password = "abc123xyz" and secret:short and AKIA' + "Q7" * 9 + " " + "0a1b" * 8),
        (13, "x" * 3000), (14, "tok " * 500), (-5, near), (15, "short token=token: abcdefgh"),
    ]


@pytest.fixture(scope="session")
def spark():
    from terrapix.session import local_session

    s = local_session("*", shuffle_partitions=8, app="terrapix-llm-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns whose names clash with columns the operators make."""
    names = ["class_id", "rowid", "blob", "spans", "row", "weight", "prob", "score", "bucket", "n_tokens", "batch", "tie"]
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None if t is None else len(t), *["old"] * len(names))
            for k, (i, t) in enumerate(edge_rows())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
