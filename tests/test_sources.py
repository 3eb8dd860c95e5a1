import pytest

import basketyield as by
from tests.conftest import SIX


def write(tmp_path, text):
    path = tmp_path / "db.txt"
    path.write_text(text)
    return str(path)


def rows(df):
    return [(r["items"], r["utils"], r["tu"]) for r in df.orderBy("tid").collect()]


def test_read_transactions(six):
    assert rows(six)[0] == ([2, 6, 9], [3, 9, 5], 17)
    assert [r[2] for r in rows(six)] == [17, 26, 19, 13, 33, 16]


def test_skips_lines_and_counts_kept_ones(spark, tmp_path):
    text = "# c\n\n1 2:3:1 2\n%x\n@meta\n3:4:4\n5:6:6\n"
    path = write(tmp_path, text)
    assert len(rows(by.read_utility_transactions(spark, path))) == 3
    assert len(rows(by.read_utility_transactions(spark, path, max_count=0))) == 3
    assert [r[0] for r in rows(by.read_utility_transactions(spark, path, max_count=2))] == [[1, 2], [3]]
    assert len(rows(by.read_utility_transactions(spark, path, max_count=99))) == 3


def test_first_n_over_many_splits(spark, tmp_path):
    lines = "".join(f"{i}:{i}:{i}\n" if i % 3 else f"#{i}\n" for i in range(1, 5000))
    path = write(tmp_path, lines)
    kept = [i for i in range(1, 5000) if i % 3]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        for n in (1, 700, 3000):
            df = by.read_utility_transactions(spark, path, max_count=n)
            assert sorted(r["items"][0] for r in df.collect()) == kept[:n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "line", ["1 2:3", "1 x:3:1 2", "1 2:z:1 2", "1 2:3:1", "1  2:3:1 1 1", ":3:1", "1 2:3:1 -2", "99999999999999999999:1:1", "1:99999999999999999999:1"]
)
def test_malformed(spark, tmp_path, line):
    path = write(tmp_path, SIX + line + "\n")
    with pytest.raises(Exception, match="malformed transaction line"):
        by.read_utility_transactions(spark, path).count()
    assert by.read_utility_transactions(spark, path, mode="PERMISSIVE").count() == 6
    assert [r["value"] for r in by.malformed_lines(spark, path).collect()] == [line]


def test_tolerated_lines(spark, tmp_path):
    path = write(tmp_path, "1 2 :3:1 2 9\n4:1:1:extra\n7 7 8:6:1 2 3\n")
    got = rows(by.read_utility_transactions(spark, path))
    assert got == [([1, 2], [1, 2], 3), ([4], [1], 1), ([7, 8], [3, 3], 6)]


def test_64_bit_lines(spark, tmp_path):
    path = write(tmp_path, "1 2:3000000000:1500000000 1500000000\n99999999999:1:1\n")
    got = rows(by.read_utility_transactions(spark, path, validate_tu=True))
    assert got == [([1, 2], [1500000000, 1500000000], 3000000000), ([99999999999], [1], 1)]


def test_header_check(spark, tmp_path):
    path = write(tmp_path, "1 2:3:1 2\n3:9:4\n")
    assert [r[2] for r in rows(by.read_utility_transactions(spark, path))] == [3, 4]
    assert [tuple(r)[1:] for r in by.header_mismatches(spark, path).collect()] == [("3:9:4", 9, 4)]
    with pytest.raises(Exception, match="differs from its header"):
        by.read_utility_transactions(spark, path, validate_tu=True).count()


def test_bad_mode(spark, tmp_path):
    with pytest.raises(ValueError):
        by.read_utility_transactions(spark, "x", mode="DROPMALFORMED")


def test_format_transactions(six):
    lines = [r["value"] for r in by.format_transactions(six).orderBy("tid").collect()]
    assert lines[0] == "2[3] 6[9] 9[5]  Remaining Utility:17 Prefix Utility:0"


def test_lines(spark, tmp_path):
    path = write(tmp_path, "sun\nmoon\nstar\nnight\nmoon dust\n")
    df = by.read_lines(spark, path)
    assert tuple(by.count_lines_containing(df, "value", {"n_o": "oo", "n_t": "t"}).first()) == (2, 3, 5)
    assert [r["value"] for r in by.preview(df, 2)] == ["sun", "moon"]
