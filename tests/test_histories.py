"""Folders of histories in mixed encodings, delimiters and forms."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from factloom.sources import history as H

LINK = "https://mp.weixin.qq.com/s/"


def by_source(frame):
    out = {}
    for r in frame.orderBy("block", "place").collect():
        out.setdefault(r["source"].rsplit("/", 1)[1], []).append((json.loads(r["text"]) if r["text"] and not r["reject_reason"] else r["text"], r["fetch_mode"], r["reject_reason"]))
    return out


def test_encodings_delimiters_and_forms(spark, tmp_path):
    rows = [["account_name", "title", "url", "n"], ["号", 'a "b", c; d\te', LINK + "1", "1"], ["二号", "第一行\n第二行\r\n\n末", LINK + "2", ""], ["", "", LINK + "3", "3"]]
    want = [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]
    for name, sep, code in [("a.csv", ",", "utf-8"), ("b.csv", ";", "gb18030"), ("c.tsv", "\t", "utf-8-sig"), ("d.CSV", "\t", "gb18030"), ("e.tsv", ",", "gb18030")]:
        text = io.StringIO()
        csv.writer(text, delimiter=sep, lineterminator="\n" if name < "c" else "\r\n").writerows(rows)
        (tmp_path / name).write_bytes(text.getvalue().encode(code))
    docs = {"nickname": "硬科技", "list": [{"title": "一", "content_url": LINK + "x"}]}
    (tmp_path / "f.json").write_bytes(json.dumps(docs, ensure_ascii=False, indent=1).encode("gb18030"))
    (tmp_path / "g.json").write_bytes(("﻿" + json.dumps(docs, ensure_ascii=False)).encode())
    (tmp_path / "h.jsonl").write_bytes("\n".join(json.dumps({"n": i, "t": "行"}, ensure_ascii=False) for i in range(3)).encode("gb18030") + b"\n\n")
    (tmp_path / "i.json").write_bytes(b'{"t":\n"\xff\xff\xff"}')
    (tmp_path / "j.csv").write_bytes("title;title,x\na;b,c\n\nonly\nd,e,f\n".encode())
    (tmp_path / "k.csv").write_bytes(b"")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "l.json").write_bytes(b"[1,\n2]")
    got = by_source(H.read_histories(spark, str(tmp_path)))
    assert set(got) == {*"a.csv b.csv c.tsv d.CSV e.tsv f.json g.json h.jsonl i.json j.csv l.json".split()}
    for name in ("a.csv", "b.csv", "c.tsv", "d.CSV", "e.tsv"):
        crlf = [d if name in ("a.csv", "b.csv") else {k: v.replace("\r\n", "\n") for k, v in d.items()} for d in want]
        assert [d for d, _, _ in got[name]] == [{k: v.replace("\r\n", "\n") for k, v in d.items()} for d in crlf], name
        assert {m for _, m, _ in got[name]} == {"csv_import"}
    assert got["f.json"] == [(docs, "json_import", None)] == got["g.json"] and [d["n"] for d, _, _ in got["h.jsonl"]] == [0, 1, 2]
    assert got["h.jsonl"][0][0]["t"] == "行" and got["i.json"][0][2] == "encoding" and got["l.json"][0][0] == [1, 2]
    assert [d for d, _, _ in got["j.csv"]] == [{"title;title": "a;b", "x": "c"}, {"title;title": "only"}, {"title;title": "d", "x": "e"}]


def test_files_are_split_and_large_documents_reported(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"n": str(i), "t": rng.choice(["plain", 'a "quoted" word', "two\nlines", "三\n\n行, and \"more\"\n"]) * rng.randint(1, 9)} for i in range(400)]
    text = io.StringIO()
    out = csv.DictWriter(text, ["n", "t"], lineterminator="\n")
    out.writeheader()
    out.writerows(rows)
    (tmp_path / "a.csv").write_bytes(text.getvalue().encode("gb18030"))
    (tmp_path / "b.json").write_text("[\n" + "1,\n" * 999 + "1]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert H.history_lines(spark, str(tmp_path)).select("block").distinct().count() > 5
        got = by_source(H.read_histories(spark, str(tmp_path), largest=1000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [d for d, _, _ in got["a.csv"]] == rows and got["b.json"] == [(None, "json_import", "size")]
    assert len(by_source(H.read_histories(spark, str(tmp_path)))["b.json"][0][0]) == 1000


def test_mixed_folder_feeds_the_flattening(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(f"title;url;sub_articles\n文;{LINK}a;\"[{{\"\"title\"\":\"\"子\"\",\"\"url\"\":\"\"{LINK}b\"\"}}]\"\n".encode("gb18030"))
    (tmp_path / "b.json").write_bytes(json.dumps([{"title": "甲", "url": LINK + "c"}], ensure_ascii=False).encode("gb18030"))
    docs = H.read_histories(spark, str(tmp_path)).filter(F.col("reject_reason").isNull()).drop("reject_reason", "fetch_mode")
    rows = H.flatten_history(docs).orderBy("source", "_path").collect()
    assert [(r["title"], r["url"][-1]) for r in rows] == [("文", "a"), ("子", "b"), ("甲", "c")]


def test_flat_documents_are_read_without_levels(spark):
    texts = ['{"url":"u1","title":"a","msgid":7}', '{"link":"u2","name":"b","create_time":"2024-01-02"}', '{"title":"no link"}', "{broken", '{"url":"","content_url":"u3","nickname":"号","n":[1]}']
    flat = H.flatten_history(spark.createDataFrame([(x, "s") for x in texts], "text string, source string"))
    nested = H.flatten_history(spark.createDataFrame([(f'{{"list":[{x}]}}' if x[0] == "{" else x, "s") for x in texts], "text string, source string"))
    assert "lambdafunction" not in flat._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(str, df.select(*[x for x in df.columns if x != "_path"]).collect()))
    assert rows(flat) == rows(nested) and len(rows(flat)) == 3
    mixed = spark.createDataFrame([(x, "s") for x in [*texts, '{"\\u006cist":[{"url":"u4"}]}', '{"url":"u5","sub_articles":[{"url":"u6"}]}']], "text string, source string")
    assert sorted(r["url"] for r in H.flatten_history(mixed).collect()) == ["u1", "u2", "u3", "u4", "u5", "u6"]
