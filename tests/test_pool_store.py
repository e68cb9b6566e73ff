"""The stored pool: versions, buckets, accounts, audit, conflicts, failures and streams."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from factloom.operators import pool as P
from factloom.operators import pool_store
from factloom.operators.pool_store import ArticlePool, Conflict, SharedFolder
from factloom.streaming.imports import stream_imports

SCHEMA = "seq long, account_name string, fakeid string, title string, url string, publish_time string, error string, is_deleted string, read_count string"
DAY = 1787184000


def rows(spark, *items):
    """Normalised rows of (url number, fields)."""
    full = [{"seq": i, "account_name": "号", "url": f"https://mp.weixin.qq.com/s/{n}", "publish_time": str(DAY + n), **kw} for i, (n, kw) in enumerate(items)]
    return P.normalize_articles(spark.createDataFrame(full, SCHEMA), "x", "json_import")


def put(pool, frame, now="t1", **kw):
    return pool.import_rows(frame, "history.json", "a" * 64, "a" * 64, now, **kw)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def by_url(pool, version=None):
    return {int(r["canonical_url"].rsplit("/", 1)[1]): r for r in pool.articles(version).collect()}


@pytest.fixture
def pool(spark, tmp_path):
    return ArticlePool(spark, str(tmp_path / "pool"), buckets=8, most_folders=3)


def test_one_row_writes_its_bucket_only(spark, pool, tmp_path):
    put(pool, rows(spark, *[(i, {"title": f"t{i}"}) for i in range(60)]))
    before, head = files(tmp_path), pool.head()
    put(pool, rows(spark, (7, {"title": "new", "read_count": "5"})), "t2")
    after, now = files(tmp_path), pool.head()
    assert before.items() <= after.items()
    changed = [b for b in now["articles"] if now["articles"][b] != head["articles"][b]]
    assert len(changed) == 1 and len(now["articles"]) == 8
    assert {p.split("/_bucket=")[1].split("/")[0] for p in set(after) - set(before) if "/articles/" in p} == set(changed)
    stored = by_url(pool)
    assert len(stored) == 60 and (stored[7]["title"], stored[7]["read_count"], stored[7]["created_at"], stored[7]["updated_at"]) == ("new", 5, "t1", "t2")
    assert (stored[8]["title"], stored[8]["updated_at"]) == ("t8", "t1") and stored[7]["id"] == 60 - 7
    assert by_url(pool, 1)[7]["title"] == "t7"
    assert len(pool.spark.read.parquet(*[f"{pool.root}/{x}" for x in now["articles"][changed[0]][1:]]).collect()) == 1


def test_only_touched_buckets_are_read(spark, pool, monkeypatch):
    put(pool, rows(spark, *[(i, {}) for i in range(40)]))
    seen = []
    load = ArticlePool._load
    monkeypatch.setattr(ArticlePool, "_load", lambda self, folders: seen.extend(folders) or load(self, folders))
    put(pool, rows(spark, (3, {"title": "x"})), "t2")
    assert len({f for f in seen if f.startswith("articles/")}) == 1


def test_last_non_blank_accounts_and_marks(spark, pool):
    run = put(pool, rows(spark, (1, {"title": "a", "error": "bad", "is_deleted": "1"}), (2, {"account_name": "二", "fakeid": "F2", "title": "b"}), (1, {"title": ""})), "t1", credential_fields=4).first()
    assert [run[x] for x in pool_store.RUN_COUNTS] == [3, 2, 2, 2, 0, 2, 0, 0, 0, 1, 4] and run["run_id"] == 1
    again = put(pool, rows(spark, (1, {"title": "", "error": ""}), (2, {"account_name": "新名", "fakeid": "F2", "title": "b"}), (3, {"url": "https://other.example/x"})), "t2").first()
    # The second article keeps all its own fields (names belong to accounts); the first loses its error.
    assert (again["added_articles"], again["existing_articles"], again["updated_articles"], again["rejected_records"], again["raw_records"]) == (0, 2, 1, 1, 3)
    stored = by_url(pool)
    assert (stored[1]["title"], stored[1]["error"], stored[1]["is_deleted"]) == ("a", "", True)
    assert stored[2]["account_name"] == "新名"
    accounts = {r["account_key"]: r for r in pool.accounts().collect()}
    assert {k: (r["id"], r["account_name"], r["created_at"], r["updated_at"]) for k, r in accounts.items()} == {
        "fakeid:f2": (1, "新名", "t1", "t2"), "name:号": (2, "号", "t1", "t2")}
    assert sorted(tuple(r) for r in pool.scopes().collect()) == [(1, 1, 1, 1, 0), (1, 2, 1, 1, 0), (2, 1, 1, 1, 0), (2, 2, 1, 1, 0)]
    assert [r["run_id"] for r in pool.imports().orderBy("run_id").collect()] == [1, 2] and pool.latest_import().first()["imported_at"] == "t2"


def test_many_imports_are_rewritten_and_equal_the_upsert(spark, pool, tmp_path):
    want = None
    for step in range(5):
        frame = rows(spark, *[(i, {"title": f"s{step}" if i % 2 else "", "account_name": f"a{i % 3}"}) for i in range(step, 12, 2)])
        put(pool, frame, f"t{step}")
        incoming = P.merge_import(frame)
        want = P.upsert(incoming.withColumn("id", F.lit(None).cast("long")).drop("seq").limit(0) if want is None else want, incoming).checkpoint()
    fields = ["account_key", "canonical_url", "title", "publish_time"]
    assert sorted(tuple(r) for r in pool.articles().select(*fields).collect()) == sorted(tuple(r) for r in want.select(*fields).collect())
    assert all(len(f) <= 3 for t in ("articles", "accounts") for f in pool.head()[t].values())
    assert pool.imports().count() == 5 and sorted(r["id"] for r in pool.articles().select("id").collect()) == list(range(1, 13))
    pool.compact(1)
    assert all(len(f) == 1 for f in pool.head()["articles"].values()) and pool.compact(1) == []
    assert pool.articles().count() == 12 and pool.imports().count() == 5


def test_removed_rows_come_back_with_a_new_id(spark, pool):
    put(pool, rows(spark, (1, {}), (2, {})))
    gone = by_url(pool)[1]["id"]
    assert pool.remove(gone, "t2") and not pool.remove(gone, "t2") and set(by_url(pool)) == {2}
    run = put(pool, rows(spark, (1, {})), "t3").first()
    assert run["added_articles"] == 1 and by_url(pool)[1]["id"] == 3 and by_url(pool)[1]["created_at"] == "t3"
    pool.compact(0)
    assert set(by_url(pool)) == {1, 2}


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_failure_leaves_nothing_that_is_read(spark, pool, monkeypatch, step):
    put(pool, rows(spark, (1, {"title": "a"})))

    def fail(*_, **__):
        raise OSError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(ArticlePool, step, fail)
        with pytest.raises(OSError):
            put(pool, rows(spark, (1, {"title": "b"}), (2, {})), "t2")
    assert {n: r["title"] for n, r in by_url(pool).items()} == {1: "a"} and pool.imports().count() == 1 and pool.scopes().count() == 1 and pool.accounts().count() == 1
    assert put(pool, rows(spark, (2, {})), "t3").first()["run_id"] == 2


def test_two_writers_at_once(spark, pool, monkeypatch):
    put(pool, rows(spark, (1, {})))
    gate, commit = threading.Barrier(2, timeout=120), ArticlePool._commit
    monkeypatch.setattr(ArticlePool, "_commit", lambda self, manifest: (gate.wait(), commit(self, manifest))[1])
    frames, results = [rows(spark, (2, {"title": "left"})), rows(spark, (2, {"title": "right"}))], []

    def run(frame):
        try:
            results.append(put(pool, frame, "t2").first()["run_id"])
        except Conflict as error:
            results.append(str(error))
    threads = [threading.Thread(target=run, args=(f,)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, results)) == ["2", "version 2 was committed by another import; run this one again"]
    assert pool.imports().count() == 2 and by_url(pool)[2]["title"] in ("left", "right") and len(by_url(pool)) == 2


def test_manifests_are_put_in_place_once(spark, tmp_path):
    place = SharedFolder(spark, str(tmp_path))
    assert place.names("commits") == [] and place.put_if_absent("commits/1.json", "一") and not place.put_if_absent("commits/1.json", "二")
    assert place.read("commits/1.json") == "一" and place.names("commits") == ["1.json"] and place.names("_drafts") == []
    mounts = spark.sparkContext._jsc.hadoopConfiguration()
    mounts.set("fs.viewfs.mounttable.poolstore.link./data", f"file://{tmp_path}")
    other = SharedFolder(spark, "viewfs://poolstore/data/deep")
    assert other.put_if_absent("commits/2.json", "x") and not other.put_if_absent("commits/2.json", "y") and other.read("commits/2.json") == "x"


def test_empty_pool_and_blank_imports(spark, pool):
    assert pool.articles() is None and pool.accounts() is None and pool.imports().count() == 0 and pool.scopes().count() == 0 and pool.compact() == [] and not pool.remove(1, "t")
    with pytest.raises(ValueError):
        put(pool, rows(spark, (1, {"url": "https://other.example/x"})))
    with pytest.raises(ValueError):
        pool.import_rows(rows(spark, (1, {})), "x", "a" * 64, None, "t")
    assert pool.head()["version"] == 0


def test_stream_batches_count_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    root, check = str(tmp_path / "pool"), tmp_path / "check"
    row = {"seq": 1, "account_name": "号", "title": "t", "url": "https://mp.weixin.qq.com/s/1", "publish_time": str(DAY)}

    def run(name=None, **kw):
        if name:
            (src / name).write_text(json.dumps({**row, **kw}, ensure_ascii=False) + "\n", encoding="utf-8")
        stream_imports(spark, str(src), SCHEMA, root, str(check), buckets=2).awaitTermination()
        return ArticlePool(spark, root)
    run("a.json")
    run("b.json", title="t2")
    pool = run("c.json", title="", url="https://mp.weixin.qq.com/s/2")
    state = pool.head()
    assert pool.imports().count() == 3 and [(r["title"], r["id"]) for r in pool.articles().orderBy("id").collect()] == [("t2", 1), ("", 2)]
    # The last batch is run again, as after a driver that was lost between the pool's commit and the stream's.
    for name in os.listdir(check / "commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(check / "commits" / name)
    assert run().head() == state and run().imports().count() == 3
    bad = run("d.json", url="https://other.example/1")
    last = bad.latest_import().first()
    assert (last["rejected_records"], last["accepted_records"], last["batch"]) == (1, 0, 3) and bad.articles().count() == 2
