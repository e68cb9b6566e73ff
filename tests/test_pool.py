import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as X
from factloom.functions import url as U
from factloom.operators import pool as P
from factloom.operators.pool_store import ArticlePool
from factloom.sources import history as H

HISTORY = {
    "nickname": "硬科技前沿", "fakeid": "fake-001", "auth_key": "AUTH-KEY-MUST-NOT-PERSIST",
    "data": {"token": "TOKEN-MUST-NOT-PERSIST", "list": [
        {"comm_msg_info": {"id": "group-1", "datetime": 1787184000},
         "app_msg_ext_info": {
             "title": "头条：芯片量产",
             "content_url": "http://mp.weixin.qq.com/s?scene=1&amp;mid=100&amp;idx=1&amp;sn=head&amp;__biz=BizA#wechat_redirect",
             "author": "研究组", "digest": "量产摘要", "copyright_type": 1, "copyright_stat": 1,
             "multi_app_msg_item_list": [
                 {"title": "次条：客户验证", "content_url": "https://mp.weixin.qq.com/s?__biz=BizA&mid=100&idx=2&sn=child&from=timeline",
                  "copyright_type": 1, "copyright_stat": 1, "is_deleted": True}]}},
        {"comm_msg_info": {"id": "group-2", "datetime": 1787270400},
         "app_msg_ext_info": {"title": "头条：新材料订单", "content_url": "https://mp.weixin.qq.com/s/material-story?scene=2",
                              "copyright_type": 1, "copyright_stat": 1, "read_count": 1234, "like_count": 88,
                              "body_markdown_path": "articles/material.md"}}]}}


def documents(spark, *payloads):
    return spark.createDataFrame([(f"f{i}.json", json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)],
                                 "source string, text string")


def articles(spark, payload, name="待识别:history"):
    return P.normalize_articles(H.flatten_history(documents(spark, payload)), name, "json_import")


def test_flatten_nested_groups(spark):
    rows = H.flatten_history(documents(spark, HISTORY)).orderBy("_path").collect()
    assert [(r["title"], r["itemidx"], r["group_key"]) for r in rows] == [
        ("头条：芯片量产", "1", "msgid:group-1"), ("次条：客户验证", "2", "msgid:group-1"), ("头条：新材料订单", "1", "msgid:group-2")]
    assert {r["account_name"] for r in rows} == {"硬科技前沿"} and {r["fakeid"] for r in rows} == {"fake-001"}
    assert [r["publish_time"] for r in rows] == ["1787184000", "1787184000", "1787270400"]
    keys = H.credential_keys(documents(spark, HISTORY)).first()
    assert keys["credential_fields_ignored"] == 2


def test_other_shapes(spark):
    flat = [{"account_name": "号", "title": "t1", "url": "https://mp.weixin.qq.com/s/a", "publish_time": 1787184000},
            {"account_name": "号", "title": "t2", "articles": [{"link": "https://mp.weixin.qq.com/s/b", "title": "x"}]}]
    rows = H.flatten_history(documents(spark, flat, {"nothing": 1})).orderBy("_path").collect()
    assert [(r["title"], r["url"][-1], r["account_name"]) for r in rows] == [("t1", "a", "号"), ("x", "b", "号")]
    assert rows[0]["group_key"].startswith("fallback:") and len(rows[0]["group_key"]) == 33
    left = H.unread_documents(documents(spark, flat, {"nothing": 1}), H.flatten_history(documents(spark, flat)))
    assert [r["source"] for r in left.collect()] == ["f1.json"]


def test_histories_of_any_shape(spark):
    link = lambda n: {"title": n, "url": f"https://mp.weixin.qq.com/s/{n}"}
    deep = link("deep")
    for _ in range(7):
        deep = {"data": [deep]}
    payloads = [
        link("a") | {"sub_articles": [link("b") | {"multi_appmsg": link("c") | {"sub_articles": [link("d")]}}]},
        {"nickname": "N", "list": json.dumps([link("e")])}, {"sub_articles": [link("f"), link("g")]},
        {"items": [link("h"), deep]}, {"articles": [], "sub_articles": [link("no")]},
        {"list": [{"app_msg_ext_info": json.dumps(link("i")), "comm_msg_info": json.dumps({"id": 5})}]}]
    rows = H.flatten_history(documents(spark, *payloads)).orderBy("source", "_path").collect()
    assert [(r["source"][1], r["title"], r["itemidx"]) for r in rows] == [
        ("0", "a", None), ("0", "b", "2"), ("0", "c", "2"), ("0", "d", "2"), ("1", "e", None), ("2", "f", None), ("2", "g", None),
        ("3", "h", None), ("3", "deep", None), ("5", "i", "1")]
    assert len({r["group_key"] for r in rows[:4]}) == 1 and rows[4]["account_name"] == "N" and rows[-1]["group_key"] == "msgid:5"


def test_preview_counts(spark):
    rows = articles(spark, HISTORY)
    empty = P.merge_import(rows).limit(0)
    out = P.preview_import(rows, empty).first()
    assert (out["raw_records"], out["publish_groups"], out["expanded_url_items"], out["original_articles"]) == (3, 2, 3, 2)
    assert (out["added_count"], out["existing_count"], str(out["date_start"]), str(out["date_end"])) == (
        3, 0, "2026-08-20", "2026-08-21")


def test_import_is_idempotent_and_needs_the_fingerprint(spark, tmp_path):
    pool = ArticlePool(spark, str(tmp_path / "pool"), buckets=4)
    rows = articles(spark, HISTORY)
    with pytest.raises(ValueError):
        pool.import_rows(rows, "history.json", "a" * 64, "0" * 64, "now")
    assert pool.articles() is None
    first = pool.import_rows(rows, "history.json", "a" * 64, "A" * 64, "now").first()
    second = pool.import_rows(rows, "history.json", "a" * 64, "a" * 64, "later").first()
    assert (first["added_articles"], first["existing_articles"]) == (3, 0) and (second["added_articles"], second["existing_articles"]) == (0, 3)
    assert second["updated_articles"] == 0 and pool.latest_import().first()["run_id"] == 2
    stats = P.pool_stats(pool.articles()).first()
    assert (stats["stored_article_rows"], stats["publish_groups"], stats["original_articles"]) == (3, 2, 2)
    assert sorted(r["id"] for r in pool.articles().collect()) == [1, 2, 3]
    text = pool.articles().toJSON().collect()
    assert not any("MUST-NOT-PERSIST" in t for t in text)


def test_csv_last_value_wins(spark, tmp_path):
    (tmp_path / "h.csv").write_text(
        "account_name,fakeid,title,url,publish_time,read_count\n"
        "号,f1,旧标题,https://mp.weixin.qq.com/s?__biz=B&mid=1&idx=1&sn=x&scene=1,1787184000,\"1,000\"\n"
        "号,f1,\"新\"\"标题\",https://mp.weixin.qq.com/s?sn=x&idx=1&mid=1&__biz=B,1787184000,2000\n", encoding="utf-8")
    docs = H.read_delimited(spark, str(tmp_path / "h.csv"))
    rows = P.normalize_articles(H.flatten_history(docs), "x", "csv_import")
    merged = P.merge_import(rows).collect()
    assert len(merged) == 1 and merged[0]["title"] == '新"标题' and merged[0]["read_count"] == 2000
    assert merged[0]["fetch_mode"] == "csv_import" and merged[0]["account_key"] == "fakeid:f1"


def test_windows_scopes_and_order(spark):
    def row(i, day, **kw):
        return {"account_name": kw.pop("account", "号"), "fakeid": "", "title": f"t{i}", "url": f"https://mp.weixin.qq.com/s/{i}",
                "publish_time": D.to_epoch(day + "T04:00:00+00:00") if day else None, **kw}
    payload = [row(1, "2026-08-15"), row(2, "2026-08-21", body_markdown_path="b.md"), row(3, "2026-08-01"), row(4, None),
               row(5, "2026-08-20", error="token=abc failed"), row(2, "2026-08-21", account="另一号")]
    stored = P.merge_import(articles(spark, payload)).withColumn("id", F.monotonically_increasing_id())
    low, high = D.day_bounds("2026-08-15", "2026-08-21")
    titles = [r["title"] for r in P.list_articles(stored, None, low, high).collect()]
    assert sorted(titles) == ["t1", "t2", "t2", "t5"] and titles[-1] == "t1"
    assert [r["title"] for r in P.list_articles(stored).collect()][-1] == "t4"
    assert {r["title"] for r in P.list_articles(stored, "pending").collect()} == {"t1", "t3", "t4", "t2"}
    assert [r["error"] for r in P.list_articles(stored, "failed").collect()] == ["token=[redacted] failed"]
    assert P.list_articles(stored, "ready").count() == 1 and P.list_articles(stored, {"account_name": "另一号"}).count() == 1
    counts = P.scope_counts(stored).first()
    assert (counts["expanded_url_items"], stored.count()) == (5, 6)
    assert P.recent_summary(stored, "2026-08-21").first()["stored_article_rows"] == 4
    assert P.recent_articles(stored, "2026-08-21", limit=2).count() == 2
    public = {r["title"]: r for r in P.public_rows(stored).collect()}
    assert public["t5"]["status"] == "failed" and public["t4"]["status"] == "pending" and "error" not in public["t1"].asDict()


def test_upsert_and_global_owner(spark):
    first = [{"account_name": "已有号", "title": "已有文章", "url": "https://mp.weixin.qq.com/s/n", "error": "x", "is_deleted": True}]
    stored = P.upsert(P.merge_import(articles(spark, first)).withColumn("id", F.lit(None).cast("bigint")).limit(0).drop("seq"),
                      P.merge_import(articles(spark, first)))
    lead = [{"account_name": "搜索作者", "title": "搜索标题", "url": "https://mp.weixin.qq.com/s/n", "fetch_mode": "web_discovery",
             "discovered_at": "2026-08-21T03:00:00Z", "discovery_rank": 1}]
    incoming = P.assign_global_owner(P.merge_import(articles(spark, lead)), stored)
    out = P.upsert(stored, incoming).collect()
    assert len(out) == 1 and out[0]["account_key"] == "name:已有号" and out[0]["id"] == 1
    assert out[0]["discovered_at"] == "2026-08-21T03:00:00+00:00" and out[0]["error"] == "" and out[0]["is_deleted"]
    stats = P.pool_stats(P.upsert(stored, incoming)).first()
    assert (stats["discovered_total"], stats["discovered_accounts"]) == (1, 1)


def test_refresh_due(spark):
    from factloom.streaming.imports import refresh_due
    runs = spark.createDataFrame([("a", "ok", "2026-08-20T12:00:00Z"), ("b", "error", "2026-08-21T09:00:00Z"),
                                  ("c", "ok", "2026-08-21T09:00:00Z"), ("d", "ok", None)],
                                 "source string, status string, finished_at string")
    out = {r["source"]: r["due"] for r in refresh_due(runs, D.to_epoch("2026-08-21T11:00:00")).collect()}
    assert out == {"a": False, "b": True, "c": False, "d": True}


def test_clean_without_references_equals_the_decoding_one(spark):
    texts = [None, "", "  a 　 b ", "a &amp; b", "&#65;  c", "plain", "\t", "x&y  z", "&lt"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    whole = F.expr(f"transform(array(coalesce(string(x), '')), x -> {X._clean_sql()})[0]")
    for row in df.select(X.clean("x").alias("a"), whole.alias("b")).collect():
        assert row["a"] == row["b"]


def test_imported_rows_of_one_split_are_read_by_many_tasks(spark):
    rows = spark.createDataFrame([(i, f"https://mp.weixin.qq.com/s?mid={i}&idx=1&__biz=B") for i in range(50)], "seq long, url string").coalesce(1)
    out = P.normalize_articles(rows, "待识别:x")
    assert out.rdd.getNumPartitions() > 4 and out.count() == 50


def test_plain_links_and_single_rows_need_no_lambda_and_no_merge(spark):
    base = "http://mp.weixin.qq.com/s"
    links = [f"{base}?scene=1&amp;mid=7&idx=1&__biz=MzA==#rd", f"{base}?mid=1&mid=2", f"{base}?mid=&sn=a", f"{base}?mid=%41", f"{base}/ab-c?x=1#a&mid=3", f"{base}/ab?itemidx=4&x=", base, "http://other.cn/s?mid=1"]
    df = spark.createDataFrame([(x,) for x in links], "url string").withColumn("link", U.link_text("url")).withColumn("asked", U.query_of_plain_article(F.col("link")))
    got = df.select(U.plain_article(F.col("link"), F.col("asked")).alias("plain"), U.article_url("url").alias("full")).collect()
    assert [i for i, r in enumerate(got) if r["plain"]] == [0, 1, 5] and all(r["plain"] in (None, r["full"]["url"]) for r in got)
    raw = [(i, f"{base}?mid={m}&idx=1&__biz=B", t, d) for i, (m, t, d) in enumerate([(1, "a", "2024-01-05"), (2, "", None), (1, "", "x"), (3, "c", "2024-02-30"), (1, "d", None)])]
    rows = P.normalize_articles(spark.createDataFrame(raw, "seq long, url string, title string, publish_time string"), "号").cache()
    one, other = P.merge_import(rows, sparse=True), P.merge_import(rows)
    assert sorted(map(str, one.select(*other.columns).collect())) == sorted(map(str, other.collect())) and one.count() == 3
    assert {r["title"]: r["publish_time"] for r in one.collect()} == {"d": 1704384000, "": None, "c": None}
