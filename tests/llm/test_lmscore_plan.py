from runloom.llm import lmscore


def test_no_token_ids_move_for_the_target_mark(spark, monkeypatch):
    plans, real = {}, lmscore.common.staged

    def staged(df, name, *more, **named):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *more, **named)

    monkeypatch.setattr(lmscore.common, "staged", staged)
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, "")], "doc_id long, text string")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = lmscore.score(docs, docs.select("doc_id").where("doc_id = 1")).collect()
        assert "BroadcastHashJoin" in plans["tokens"] and "SortMergeJoin" not in plans["tokens"]
        joined = lmscore.score(docs, docs.select("doc_id").where("doc_id = 1"), most_ids=0).collect()
        assert "BroadcastHashJoin" not in plans["tokens"] and sorted(joined) == sorted(some)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
