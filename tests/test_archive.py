import pytest

from runloom.functions import codecs
from runloom.operators import archive

FILES = [("a", b"abracadabra" * 30), ("b", b""), ("c", None), ("d", bytes(range(256)) * 3), ("a", b"x")]


@pytest.mark.parametrize(("strategy", "stage"), [("hirsch", "bw94"), ("best50", "bcm"), ("none", "bw94")])
def test_round_trip(spark, strategy, stage):
    files = spark.createDataFrame([(f, bytearray(d) if d is not None else None, 1) for f, d in FILES], "file string, data binary, coded int")
    coded = archive.compress(files, strategy, stage, block_size=100)
    assert all(r.coded is None or bytes(r.coded).startswith(f"{strategy}|{stage}\n".encode()) for r in coded.collect())
    got = sorted((r.file, None if r.data is None else bytes(r.data)) for r in archive.decompress(coded).collect() if r.file != "c")
    assert got == sorted(f for f in FILES if f[1] is not None)
    assert archive.decompress(coded).where("file = 'c' AND data IS NULL").count() == 1


def test_arguments(spark):
    files = spark.createDataFrame([], "file string, data binary")
    assert archive.compress(files).count() == 0
    for bad in ({"strategy": "x"}, {"stage": "x"}, {"block_size": 0}):
        with pytest.raises(ValueError):
            archive.compress(files, **bad)


def test_sql_functions(spark):
    archive.register(spark)
    row = spark.sql("SELECT coded_size('abab', 'hirsch', 'bw94') AS a, least_order(repeat('abc', 20)) AS b").first()
    assert row.a == len(codecs.encode_block(b"abab", "hirsch", "bw94")) and row.b >= 1
