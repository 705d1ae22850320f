"""A blocklist refreshed between micro-batches: an unsound version, a late one, a failed fetch, and a restart."""

from pyspark.sql import functions as F

from veriscore import engine
from veriscore.plans import blocklist as B
from veriscore.streaming.refresh import RefreshedTable, judged_by

HIT = "url.bloomfilter_blacklist_hit"


def filters(spark, version, *names):
    return B.spec_row(spark.createDataFrame([(n,) for n in names], "domain string")).withColumn("version", F.lit(version))


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def hits(spark, path, table, clock, steps):
    """Hosts stopped in each micro-batch; before a batch the clock goes on by a step."""
    out, files = {}, []
    for i, _ in enumerate(steps):
        rows = [(k, f"https://{h}/x", "") for k, h in enumerate(("a.click", "b.click", "c.click"))]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/in/{i}")
        files.append(i)
    src = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")

    def judge(rows, held):
        clock.now += steps[len(out)]
        return engine.judge(rows, "gates", blocklist=held)

    def sink(df, number):
        out[number] = {"abc"[r.page_id] for r in df.collect() if r.gate == HIT}

    q = judged_by(src, table, judge, sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [out[i] for i in sorted(out)]


def test_versions_swap_between_micro_batches(spark, tmp_path):
    clock, folder = Clock(), f"{tmp_path}/side"
    whole = filters(spark, 3, "c.click")
    loads = [filters(spark, 2, "a.click"), filters(spark, 5, "b.click").withColumn("bits", F.lit(None).cast("binary")), OSError("no network"), filters(spark, 1, "b.click"), whole.unionByName(filters(spark, 4, "b.click")), whole]

    def load():
        x = loads.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    table = RefreshedTable(spark, folder, load, B.checked_rows, period=100, first=30, clock=clock)
    assert table.current() is None and len(loads) == 6  # the first attempt comes after a while
    # The step of a batch is taken while it runs, and shows in the next one.
    got = hits(spark, tmp_path, table, clock, [30, 50, 60, 100, 100, 100, 100, 0])
    a, c = {"a"}, {"c"}
    assert got == [set(), a, a, a, a, a, a, c] and not loads
    log = [(r.version, r.outcome) for r in table.attempts().orderBy("tried_at").collect()]
    assert log == [(2, "taken"), (5, "unsound"), (None, "failed"), (1, "late"), (None, "unsound"), (3, "taken")]
    assert "no network" in table.attempts().where("outcome = 'failed'").first().reason

    again = RefreshedTable(spark, folder, lambda: filters(spark, 9, "b.click"), B.checked_rows, period=100, first=30, clock=clock)
    assert again.version == 3 and again.current().first().version == 3  # after a restart the copy is there, and the period goes on
    clock.now += 99
    assert again.current().first().version == 3
    clock.now += 1
    assert again.current().first().version == 9 and again.version == 9


def test_a_copy_without_its_log_row_does_not_count(spark, tmp_path):
    clock, folder = Clock(), f"{tmp_path}/side"
    first = RefreshedTable(spark, folder, lambda: filters(spark, 1, "a.click"), B.checked_rows, clock=clock)
    assert first.refresh() == "taken"
    filters(spark, 2, "b.click").drop("version").write.parquet(f"{folder}/copies/version=2")  # a start that broke off
    table = RefreshedTable(spark, folder, lambda: filters(spark, 2, "b.click"), B.checked_rows, clock=clock)
    assert table.version == 1 and table.refresh() == "taken" and table.version == 2
    assert table.refresh() == "late"
