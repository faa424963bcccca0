"""URL branches by absolute support at every depth, and merging against pooled shares."""

from pyspark.sql import functions as F

from sherdloom.llm import urls


def verdicts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    return {r.page_id: r for r in urls.judge(frame, rules=()).collect()}


def test_small_sections_of_a_big_host_are_told_apart(spark):
    """A hundred sections of 40 pages, one wholly bad; and bad pages four segments deep."""
    rows = [(k, f"http://big.net/s{k % 100}/{k}", int(k % 100 == 7) if k % 3 == 0 else None) for k in range(4000)]
    rows += [
        (10_000 + k, f"http://deep.net/a/b/c/{'spam' if k % 2 else 'news'}/{k}", k % 2 if k % 3 == 0 else None) for k in range(60)
    ]
    got = verdicts(spark, rows)
    assert all((got[k].verdict == "block") == (k % 100 == 7) for k in range(4000))
    assert all((got[10_000 + k].verdict == "block") == (k % 2 == 1) for k in range(60))
    assert got[0].template == "/s0/*" and got[10_001].template == "/a/b/c/spam/*"


def test_branches_with_few_labels_pool_upwards(spark):
    """Two hundred authors of six pages in a bad section, one page in ten labelled."""
    rows = [
        (k, f"http://w.net/{'bad' if k < 1200 else 'good'}/author{k // 6}/{k}", int(k < 1200) if k % 10 == 0 else None)
        for k in range(2400)
    ]
    got = verdicts(spark, rows)
    assert all((got[k].verdict == "block") == (k < 1200) for k in range(2400))


def test_a_ladder_of_shares_is_not_one_group(spark):
    for labels, shares in ((40, range(0, 101, 10)), (20, range(5, 96, 5))):
        rows = [
            ("m.net", "", f"/{share:03d}", int(k < labels * share // 100)) for share in shares for k in range(labels)
        ]
        frame = spark.createDataFrame(rows, "host string, parent string, template string, bad int")
        got = {int(r.template[1:]): r.purity for r in urls.branch_purity(frame).collect()}
        assert sorted(got) == list(shares)
        order = [got[s] for s in shares]
        assert order == sorted(order) and len(set(order)) >= 3
        assert got[max(shares)] >= urls.PURITY and got[90] >= urls.PURITY
        assert got[min(shares)] < 0.3 and got[50] < urls.PURITY


def test_one_label_each_is_chance(spark):
    """Of branches with a single label, a third bad, none is rejected."""
    rows = [("o.net", "", f"/{k}", int(k % 3 == 0)) for k in range(900)]
    frame = spark.createDataFrame(rows, "host string, parent string, template string, bad int")
    got = urls.branch_purity(frame)
    assert got.count() == 900 and got.where(F.col("purity") >= urls.PURITY).count() == 0
