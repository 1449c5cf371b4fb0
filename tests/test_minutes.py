"""Attendance whose documents are parsed once."""

from retrospect.operators import minutes as m


def test_lists_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    some = [(1, [["PRESENT:", "Ann Lee, Chair", "Bo Ray"], ["Jo Nolan, Secretary"]]), (2, [["Present"], ["Cy Poe"]]), (3, [["Absent"]]), (4, None)]
    rows = spark.createDataFrame(some, "document long, blocks array<array<string>>").mapInPandas(counted, "document long, blocks array<array<string>>")
    audit = m.roster_audit(m.attendance(rows)).first().asDict()
    assert audit == {"documents": 4, "problems": 3, "read": 1, "members": 2, "distinct_members": 2, "chairs": 1}
    assert read.value == 4
