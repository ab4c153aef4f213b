"""Bounded harvests: steps, retries, and runs that break off."""

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import harvest as H


def wanted(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)] + [(None,), (0,)], "k bigint")


def answers(log, fails):
    """A fetch that fails so often for each key, and logs its steps."""

    def fetch(rows):
        log.append(sorted((r.k, r.tries) for r in rows.collect()))
        bad = F.col("tries") < F.expr(fails)
        return rows.withColumn("value", F.when(~bad, F.col("k") * 10)).withColumn("error", F.when(bad, "busy"))

    return fetch


def test_steps_are_bounded_and_errors_are_retried(spark, tmp_path):
    log = []
    got = H.harvest(wanted(spark, 25), str(tmp_path), "k", answers(log, "k % 4"), most=7, retries=2, known=spark.createDataFrame([(24,)], "k bigint"))
    rows = {r.k: (r.value, r.error, r.attempts) for r in got.collect()}
    assert rows == {k: (k * 10 if k % 4 < 3 else None, "busy" if k % 4 == 3 else None, min(k % 4 + 1, 3)) for k in range(24)}
    assert [len(x) for x in log] == [7, 7, 7, 3, 7, 7, 4, 7, 5]
    assert max(map(len, log)) == 7
    assert {r.attempt: r.n for r in H.results(spark, str(tmp_path)).groupBy("attempt").agg(F.count("*").alias("n")).collect()} == {0: 24, 1: 18, 2: 12}
    # Done keys stay done; more retries take up what failed, and new keys are fetched from the start.
    log.clear()
    again = H.harvest(wanted(spark, 26), str(tmp_path), "k", answers(log, "k % 4"), most=50, retries=3)
    assert {r.k: r.attempts for r in again.collect()} == {k: k % 4 + 1 for k in range(26)}
    assert log[0] == sorted([(k, 3) for k in range(3, 24, 4)] + [(24, 0), (25, 0)]) and log[1] == [(25, 1)]


@pytest.mark.parametrize("after", [0, 2])
def test_a_run_that_breaks_off_goes_on(spark, tmp_path, after):
    log, good = [], answers([], "0")

    def breaks(rows):
        if len(log) == after:
            raise RuntimeError("the network is gone")
        log.append([r.k for r in rows.collect()])
        return good(rows)

    with pytest.raises(Exception, match="the network is gone"):
        H.harvest(wanted(spark, 20), str(tmp_path), "k", breaks, most=6)
    first = [k for x in log for k in x]
    log.append(None)
    got = H.harvest(wanted(spark, 20), str(tmp_path), "k", lambda rows: log.append([r.k for r in rows.collect()]) or good(rows), most=6)
    assert sorted(r.k for r in got.collect()) == list(range(20))
    rest = [k for x in log[after + 1 :] for k in x]
    assert sorted(first + rest) == list(range(20)) and all(len(x) <= 6 for x in log if x)


def test_nothing_wanted(spark, tmp_path):
    assert H.harvest(wanted(spark, 0).where("k is null"), str(tmp_path), "k", answers([], "0")).count() == 0


def test_offsets():
    r = H.AdmittedReader(10, 4, 0, 2)
    assert r.latestOffset() == {"at": 4} and r.partitions({"at": 0}, {"at": 0}) == []
    assert [(p.start, p.end) for p in r.partitions({"at": 0}, {"at": 4})] == [(0, 2), (2, 4)]
    assert r.latestOffset() == {"at": 8} and list(r.read(H.Range(3, 5))) == [(3,), (4,)]
    r.partitions({"at": 8}, {"at": 10})
    assert r.latestOffset() == {"at": 10}
