import zlib

from pyspark.sql import functions as F

from ravelin.sources import lists


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_nested_and_indexed_lists(spark):
    assert one(spark, "(a,b),c", lists.nested_list) == [["a", "b"], ["c"]]
    assert one(spark, "", lists.nested_list) == []
    assert one(spark, None, lists.nested_list) is None
    assert [tuple(p) for p in one(spark, "(1,x),y,(2,z),(3,4,5)", lists.indexed_list)] == [("1", "x"), ("2", "z")]


def test_category_takes_the_first_whole_match(spark):
    rules = [("add.*", 2, 1), ("a.*", 3, 2)]
    assert tuple(one(spark, "ADDI", lambda c: lists.category(c, rules))) == (True, 2, 1)
    assert tuple(one(spark, "and", lambda c: lists.category(c, rules))) == (True, 3, 2)
    assert tuple(one(spark, "xadd", lambda c: lists.category(c, rules))) == (False, 1, 0)


def test_redirect_replaces_whole_parts(spark):
    go = lambda c: lists.redirect(c, [("/lib", "/opt/lib"), ("/lib64/x", "/y")])
    assert one(spark, "lib//a", go) == "/opt/lib/a/"
    assert one(spark, "/lib64/x", go) == "/y/"
    assert one(spark, "/libs", go) == "/libs/"


def test_crc_of_the_standard_polynomial(spark):
    for text in ("", "123456789", "Grüße"):
        got = one(spark, text, lambda c: lists.crc(c, 0xEDB88320))
        assert got ^ 0xFFFFFFFF == zlib.crc32(text.encode())


def test_records_get_a_default_and_move(spark):
    r = spark.createDataFrame([("cpu0", "pid", "7"), ("cpu1", "x", "1"), ("disk", "x", "2")], "section string, key string, value string")
    got = lists.moved(lists.with_default(r, "^cpu", "pid", "0"), "^cpu", "^x$", ".old")
    assert {tuple(x) for x in got.collect()} == {("cpu0", "pid", "7"), ("cpu1.old", "x", "1"), ("cpu1", "pid", "0"), ("disk", "x", "2")}
