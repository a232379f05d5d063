"""The golden micro-fixture (FIXTURES.md §2) as native tables."""

import datetime as dt

from pagewise.schema import READER, RECORD, SHELF
from pagewise.sources.binding import ReadingLog

D = dt.date


def shelf_row(u, i, title, page, cat, end, c, up, memo=None, author="A^B"):
    return (u, i, title, author, 1000, page, cat, memo, None, None, None, c, up, end)


def micro_log(spark) -> ReadingLog:
    reader = spark.createDataFrame([(1, "n1", "e1"), (2, "n2", "e2"), (3, "n3", None)], READER)
    shelf = spark.createDataFrame(
        [
            shelf_row(1, 1, "T1", 100, "000", "Y", D(2024, 11, 1), D(2024, 11, 5)),
            shelf_row(1, 2, "T2", 200, "ZZZ", "N", None, None, memo=""),
            shelf_row(1, 3, "T3", 50, "XXX", "Y", D(2024, 11, 2), D(2024, 11, 5)),
            shelf_row(1, 4, "T4", 50, None, "Y", D(2024, 11, 2), D(2024, 11, 3)),
            shelf_row(2, 1, "T1", 100, "000", "N", D(2024, 11, 9), D(2024, 11, 9)),
        ],
        SHELF,
    )
    record = spark.createDataFrame(
        [
            (1, 1, D(2024, 11, 1), 40),
            (1, 1, D(2024, 11, 5), 60),
            (1, 3, D(2024, 11, 2), 50),
            (1, 3, D(2024, 11, 5), 10),
            (1, 4, D(2024, 11, 3), None),
            (2, 1, D(2024, 11, 9), 10),
        ],
        RECORD,
    )
    return ReadingLog(reader, shelf, record)
