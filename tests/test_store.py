"""The bucketed store gives the fact without a shuffle."""
from conftest import SF_SMALL
from reviewlens.operators import reports as R
from reviewlens.operators.fact import build_fact
from reviewlens.plans import inputs as I
from reviewlens.plans.store import ReviewStore


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_store_equals_the_fact(spark):
    items, scored = I.items(spark, SF_SMALL), I.scored(spark, SF_SMALL)
    store = ReviewStore(spark, "store_test", buckets=4)
    store.replace_items(items.limit(3))
    for half in (0, 1):
        store.add_reviews(scored.where(f"pmod(xxhash64(rid), 2) = {half}"))
    store.replace_items(items)                      # replaced as a whole
    want = _rows(build_fact(items, scored))
    assert _rows(store.fact()) == want
    batches = spark.table(store.stats_table).count()
    store.compact()
    assert _rows(store.fact()) == want and spark.table(store.stats_table).count() < batches
    assert _rows(R.category_sentiment(store.fact())) == _rows(R.category_sentiment(build_fact(items, scored)))


def test_no_exchange_under_the_join(spark):
    items, scored = I.items(spark, SF_SMALL), I.scored(spark, SF_SMALL)
    store = ReviewStore(spark, "store_plan", buckets=4)
    store.replace_items(items)
    store.add_reviews(scored)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.fact()._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        assert "Exchange" in build_fact(items, scored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_grow_with_the_items(spark, monkeypatch):
    from reviewlens.plans import report_queries, store
    made = []
    monkeypatch.setattr(store, "ITEMS_PER_BUCKET", 10)
    monkeypatch.setattr(report_queries, "ReviewStore", lambda *a, **k: made.append(ReviewStore(*a, **k)) or made[-1])
    want = _rows(R.category_sentiment(I.fact(spark, SF_SMALL)))
    assert _rows(report_queries.category_sentiment_stored(spark, SF_SMALL)) == want
    items = I.items(spark, SF_SMALL).count()
    assert made[0].buckets == -(-items // 10) > 8
    assert store.buckets_for(I.items(spark, SF_SMALL).limit(3), least=8) == 8
