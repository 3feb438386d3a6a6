from datetime import date

from pingmill.operators import clean


def test_unreadable_times_stay_and_headers_go(spark):
    rows = [("a", "1634943600", 1.0, 2.0), ("maid", "timestamp", 1.0, 2.0), ("b", "x", 1.0, 2.0), ("c", "5", None, 2.0), ("d", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "maid string, timestamp string, longitude double, latitude double")
    got = {r.maid: (r.timestamp, r.date, r.hour) for r in clean.clean_mobility(df).collect()}
    # 23:00 UTC on the 22nd, although the session is in Jakarta
    assert got == {"a": (1634943600, date(2021, 10, 22), 23), "b": (None, None, None), "d": (None, None, None)}


def test_spikes(ping):
    far = 60 / 111.0
    rows = [("a", 0, 0, 0), ("a", 6, far, 0), ("a", 12, 0, 0), ("a", 17, far, 0), ("a", 17, 0, 0), ("b", 3, 50, 0)]
    flags = [r.is_outlier for r in clean.speed_outliers(ping(rows)).orderBy("seq").collect()]
    # 6 s is 0.1 min exactly and counts; 5 s and 0 s do not; first pings never do
    assert flags == [False, True, True, False, False, False]


def test_flags_do_not_depend_on_input_order(ping):
    rows = [("a", 0, 0, 0, 0), ("a", 60, 0.5, 0, 1), ("a", 120, 0, 0, 2), ("b", 60, 9, 9, 3)]
    one = {r.seq: r.is_outlier for r in clean.speed_outliers(ping(rows)).collect()}
    two = {r.seq: r.is_outlier for r in clean.speed_outliers(ping(rows[::-1]).repartition(7)).collect()}
    assert one == two and one[1] and one[2]


def test_profiles(spark):
    people = spark.createDataFrame([("a", 0, "\\N"), ("a", 1, "X"), ("b", 0, "Y")], "maid string, profile_no int, place1 string")
    got = {r.maid: r.place1 for r in clean.profiles(clean.clean_people(people)).collect()}
    assert got == {"a": None, "b": "Y"}
