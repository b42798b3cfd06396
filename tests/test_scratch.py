import threading
from types import SimpleNamespace

import pytest

from lexmill.plans.scratch import discard, mark, materialize, scratch_dir


def test_discard_removes_what_nothing_reads_any_more(spark):
    since = mark()
    one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
    discard(spark, since, keep=("two",))
    assert two.count() == 7 and mark() == since + 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        one.count()
    discard(spark, since)
    assert mark() == since


def test_a_cluster_needs_a_shared_folder():
    def session(master, named=None, checkpoints=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)

    with pytest.raises(RuntimeError, match="share"):
        scratch_dir(session("spark://host:7077"))
    assert scratch_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_dir(session("yarn", None, "hdfs:///own")) == "hdfs:///own"


def test_threads_keep_their_own_tables(spark):
    """A table written between another thread's mark and discard stays, and the other's marks do not move."""
    begun, written, left = threading.Event(), threading.Event(), []

    def other():
        begun.wait(60)
        since = mark()
        left.append(materialize(spark.range(3), "other"))
        written.set()
        discard(spark, since + 1)

    run = threading.Thread(target=other)
    run.start()
    since = mark()
    mine = materialize(spark.range(4), "mine")
    begun.set()
    assert written.wait(60)
    discard(spark, since)
    run.join()
    assert left[0].count() == 3 and mark() == since
    with pytest.raises(Exception, match="(?i)exist|not found"):
        mine.count()
