from harrow.sources import build_log

LOG = """starting
[1:00.05] Processed 7 reviews with a total of 1,200
[1:00.35] Finished creating temporary index at /t/a
[1:01.05] Processed 9 reviews with a total of 2,500
[1:01.06] Finished creating temporary index at /t/b
[1:02.00] So far merged a total of 2,000 tokens out of 2,500
getNumberOfReviews: 16
"""


def test_build_log(spark):
    rows = [("d", i, x) for i, x in enumerate(LOG.split("\n"))] + [("empty", 0, "nothing"), ("empty", 1, None)]
    lines = spark.createDataFrame(rows, "dataset string, line_num int, value string")
    sizes = spark.createDataFrame([("/t/a", 5), ("/t/a", 5), ("/t/b", 7)], "path string, size long")
    found = [tuple(r) for r in build_log.progress(lines).orderBy("line_num").collect()]
    assert found == [("d", 1, "invert", 0, 1200, 16), ("d", 3, "invert", 60, 2500, 16), ("d", 5, "merge", 115, 2000, 16)]
    assert [tuple(r) for r in build_log.index_sizes(lines, sizes).orderBy("line_num").collect()] == [("d", 2, 30, 10, 10), ("d", 4, 61, 7, 17)]
    assert [tuple(r) for r in build_log.summary(lines, sizes).collect()] == [("d", 115, 16, 17)]
    assert build_log.progress(lines.limit(0)).count() == 0
