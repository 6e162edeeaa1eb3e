import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from levelstream.llm.shared import materialize, scope


def folders(*tables):
    return [os.path.dirname(t.inputFiles()[0]).removeprefix("file:") for t in tables]


def test_a_scope_frees_its_own_tables_alone(spark):
    outside = materialize(spark.range(3), "outside")
    with scope(spark) as own:
        gone, kept = materialize(spark.range(4), "gone"), own.keep(materialize(spark.range(5), "kept"))
        with scope(spark):
            inner = materialize(spark.range(6), "inner")
            paths = folders(outside, gone, kept, inner)
        assert [os.path.isdir(p) for p in paths] == [True, True, True, False]
    assert [os.path.isdir(p) for p in paths] == [True, False, True, False]
    assert outside.count() == 3 and kept.count() == 5


def test_threads_do_not_share_scopes(spark):
    meet = Barrier(2)

    def work(n):
        with scope(spark):
            table = materialize(spark.range(n), f"thread-{n}")
            meet.wait(60)
            if n == 7:  # the other scope ends first
                meet.wait(60)
                return table.count()
        meet.wait(60)
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, [7, 8])) == [7, 8]


def test_the_setting_of_shuffle_files_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: materialize(spark.range(n), "setting"), range(8)))
    assert spark.conf.get(name, "false") == before
