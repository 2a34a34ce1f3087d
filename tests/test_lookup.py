from datetime import datetime

from pyspark.sql import functions as F

from tidemark import reports
from tidemark.functions import text
from tidemark.schemas import Tables


def test_release_query(spark):
    rows = [(1, " A ", "T feat. X"), (2, 'A "q" \\', "T (x)"), (3, None, "T"), (4, "A", " "), (5, "A", None), (6, "A", "Feat"), (7, "A", "T Ft Someone Else")]
    df = spark.createDataFrame(rows, "i int, artist string, title string")
    got = {r.i: (r.q, r.t) for r in df.select("i", text.release_query(F.col("artist"), F.col("title")).alias("q"), text.lookup_title(F.col("title")).alias("t")).collect()}
    assert got[1] == ('artist:"A" AND recording:"T"', "T") and got[6][1] == "Feat" and got[7][1] == "T"
    assert got[2][0] == 'artist:"A \\"q\\" \\\\" AND recording:"T (x)"'
    assert [got[i][0] for i in (3, 4, 5)] == [None] * 3 and got[5][1] == ""


def test_reports_are_exported(spark):
    t = Tables.empty(spark)
    window = {"since": datetime(2024, 1, 1), "until": datetime(2024, 1, 2)}
    assert all(callable(getattr(reports, name)) for name in reports.__all__)
    assert reports.songs_top(t, **window).count() == reports.timeline(t, **window).count() == 0
    assert isinstance(reports.table(reports.commercials_top(t, **window)), str)
