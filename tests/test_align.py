import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textdelta.operators import align
from textdelta.operators.align import byte_spans, lcs, script
from textdelta.sources import pairs


def shown(x: str, y: str, algorithm: str, strict: bool = False) -> str:
    a, b = x.split(), y.split()
    return " ".join(k.replace("#", "=") + (a[i] if i is not None else b[j]) for k, i, j in script(a, b, algorithm, strict))


@pytest.mark.parametrize(
    ("x", "y", "myers", "patience", "histogram"),
    [
        ("hello world", "hello rust", "=hello -world +rust", None, None),
        ("The cat sat on the mat", "The dog sat on the mat", "=The -cat +dog =sat =on =the =mat", None, None),
        ("a a", "a", "-a =a", "-a =a", "=a =a"),
        ("a b c", "c b a", "-a -b =c +b +a", "+c +b =a -b -c", "+c +b =a =b =c +b +a"),
        ("x a b y", "x b a y", "=x -a =b +a =y", "=x +b =a -b =y", "=x +b =a =b +a =y"),
        ("the cat the dog", "the dog the cat", "-the -cat =the =dog +the +cat", "+the +dog =the =cat -the -dog", "=the =the =cat =dog =the =the =the =the -dog +cat"),
        ("hello", "", "-hello", None, None),
        ("", "hello world", "+hello +world", None, None),
        ("", "", "", None, None),
    ],
)
def test_scripts(x, y, myers, patience, histogram):
    assert shown(x, y, "myers") == myers
    assert shown(x, y, "patience") == (patience or myers)
    assert shown(x, y, "histogram") == (histogram or myers)


def table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows


def test_lcs_walks_back_as_the_table_does():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        rows, i, j, out = table(a, b), len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif rows[i - 1][j] > rows[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert lcs(a, b) == out[::-1]


@pytest.mark.parametrize("algorithm", ["myers", "patience", "histogram"])
def test_strict_scripts_rebuild_both_sides(algorithm):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 20))] for _ in range(2))
        steps = script(a, b, algorithm, strict=True)
        assert [a[i] for k, i, _ in steps if i is not None] == a
        assert [b[j] for k, _, j in steps if j is not None] == b


def test_byte_spans():
    assert byte_spans("é a é", ["é", "a", "é"]) == [(0, 2), (3, 4), (5, 7)]


def test_operations_in_pieces(monkeypatch):
    rows = [("a b c", "b c d"), (None, "a"), ("", "é x"), ("a b c d e f g", "g"), ("x", None), ("", ""), ("é à x", "x é")]
    columns = []
    for texts in zip(*rows, strict=True):
        columns += [pa.array(texts, pa.string()), pa.array([None if t is None else t.split() for t in texts], pa.list_(pa.string()))]
    for algorithm in ("myers", "histogram"):
        whole = list(align.edit_script(algorithm).func(iter([columns])))
        assert len(whole) == 1
        with monkeypatch.context() as m:
            m.setattr(align, "TOKENS", 4)
            pieces = list(align.edit_script(algorithm).func(iter([columns])))
        assert len(pieces) > 3 and sum((p.to_pylist() for p in pieces), []) == whole[0].to_pylist()
    assert whole[0].to_pylist()[1] is None and [o["edit_type"] for o in whole[0].to_pylist()[2]] == ["Insert", "Insert"]


def test_large_tables_are_dealt_by_bytes(spark, monkeypatch, tmp_path):
    spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(pairs, "MOST_BYTES", 100_000)
    df = pairs.balanced(spark.read.parquet(f"{tmp_path}/t"))
    assert df.rdd.getNumPartitions() > 5 and df.count() == 20_000
