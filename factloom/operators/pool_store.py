"""The article pool on shared storage: Parquet in hash buckets, one manifest file per version.

Articles are dealt into buckets by a hash of their URL, accounts by a hash of their key.  An import joins its rows with
the rows of the buckets that it touches, and writes the rows that it adds or changes, whole, as a new folder of those
buckets; the files of all other buckets stay as they are.  A reader takes the newest row of every key: base rows whose key is
not in a later folder, and the newest of the later ones, so only changed keys are ever compared.  A bucket with many
folders is rewritten as one (``compact``).

A manifest (``commits/<version>.json``) names the folders of every bucket, the next ids, the audit row of the import, the
folder of its account scopes, and the last batch of every stream.  It is put in place whole and only if no manifest of that
version is there, so that rows, accounts and audit appear together or not at all: an import that fails leaves folders that
nothing reads, and of two imports at once one ends with :class:`Conflict` and can be run again.  A file system must let a file be
linked (local) or renamed without overwriting (HDFS and alike) for this.

Manifests grow with buckets x folders, not with rows.  Choose buckets so that one fits into a task.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import pool as P
from factloom.operators.common import checkpointed, indexed, small

c = F.col
ARTICLES, ACCOUNTS = "articles", "accounts"
TABLE_KEYS = {ARTICLES: P.KEYS, ACCOUNTS: ["account_key"]}
BUCKET_KEY = {ARTICLES: "canonical_url", ACCOUNTS: "account_key"}
#: Counts of an audit row, in order.
RUN_COUNTS = ["raw_records", "accepted_records", "publish_groups", "expanded_url_items", "original_articles", "added_articles",
              "existing_articles", "updated_articles", "rejected_records", "duplicate_records_removed", "credential_fields_ignored"]
RUN_SCHEMA = ("run_id bigint, source_name string, source_fingerprint string, " + ", ".join(f"{x} bigint" for x in RUN_COUNTS)
              + ", imported_at string, stream string, batch bigint")
SCOPE_SCHEMA = "run_id bigint, account_id bigint, publish_groups bigint, expanded_url_items bigint, original_articles bigint"
_FIRST = {"version": 0, "next_article_id": 1, "next_account_id": 1, "next_run_id": 1, "streams": {}, ARTICLES: {}, ACCOUNTS: {},
          "run": None, "scopes": None}


class Conflict(RuntimeError):
    """Another change was committed since this one read the pool; run it again."""


class SharedFolder:
    """Small files in a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self.root = self._fs.makeQualified(self._path(root)).toString().rstrip("/")

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), False)

    def put_if_absent(self, name: str, text: str) -> bool:
        """Put a whole file in place; False if there is one already."""
        target, draft = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if target.toUri().getScheme() == "file":
                self._jvm.java.nio.file.Files.createLink(self._local(target), self._local(draft))
            else:
                options = self._jvm.org.apache.hadoop.fs.Options
                none = self._jvm.java.lang.reflect.Array.newInstance(getattr(options, "Rename").NONE.getClass(), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, none)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def _local(self, path: Any) -> Any:
        return self._jvm.java.io.File(path.toUri().getPath()).toPath()


def _as_article(name: str) -> Column:
    """A stored field after an import: the incoming value unless it is blank; errors are the incoming ones, deletion marks stay."""
    new, old = c(f"i.{name}"), c(f"k.{name}")
    if name == "error":
        return new
    if name == "is_deleted":
        return F.coalesce(new, F.lit(False)) | F.coalesce(old, F.lit(False))
    return F.when(new.isNull() | (new.cast("string") == ""), F.coalesce(old, new)).otherwise(new)


class ArticlePool:
    """Articles, accounts and the audit of imports below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, most_folders: int = 8) -> None:
        self.spark, self.files = spark, SharedFolder(spark, root)
        self.root, self.most_folders = self.files.root, most_folders
        self._buckets = buckets

    # -- versions ---------------------------------------------------------------------------------

    def head(self) -> dict[str, Any]:
        """The newest manifest (version 0, empty, before the first import)."""
        names = [n for n in self.files.names("commits") if n.endswith(".json") and n[0] not in "._"]
        return json.loads(self.files.read(f"commits/{names[-1]}")) if names else {**_FIRST, "buckets": self._buckets}

    def at(self, version: int) -> dict[str, Any]:
        """The manifest of an earlier version."""
        return json.loads(self.files.read(f"commits/{version:012d}.json"))

    def _commit(self, manifest: dict[str, Any]) -> None:
        if not self.files.put_if_absent(f"commits/{manifest['version']:012d}.json", json.dumps(manifest, ensure_ascii=False)):
            raise Conflict(f"version {manifest['version']} was committed by another import; run this one again")

    # -- rows -------------------------------------------------------------------------------------

    def _bucket(self, table: str, head: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(BUCKET_KEY[table]), F.lit(head["buckets"])).cast("int")

    def _load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def _rows(self, head: dict[str, Any], table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest row of every key in some buckets (all without a list); None if they are empty."""
        by = {b: f for b, f in head[table].items() if buckets is None or int(b) in buckets}
        if not by:
            return None
        keys = TABLE_KEYS[table]
        changed = [f for folders in by.values() for f in folders[1:]]
        rows = self._load([folders[0] for folders in by.values() if len(folders) == 1]) if any(len(f) == 1 for f in by.values()) else None
        if changed:
            later = self._load(changed)
            newest = later.groupBy(*keys).agg(F.max_by(F.struct(*later.columns), "row_version").alias("_r")).select("_r.*")
            base = self._load([folders[0] for folders in by.values() if len(folders) > 1])
            merged = base.join(newest.select(*keys), keys, "left_anti").select(*newest.columns).unionByName(newest)
            rows = merged if rows is None else rows.select(*merged.columns).unionByName(merged)
        return rows.filter(~c("removed")).drop("removed", "row_version") if "removed" in rows.columns else rows.drop("row_version")

    def accounts(self, version: int | None = None) -> DataFrame | None:
        """account_key, id, account_name, fakeid, created_at, updated_at; None before the first import."""
        return self._rows(self.head() if version is None else self.at(version), ACCOUNTS)

    def articles(self, version: int | None = None) -> DataFrame | None:
        """Stored articles with the names of their accounts; None before the first import."""
        head = self.head() if version is None else self.at(version)
        rows = self._rows(head, ARTICLES)
        if rows is None:
            return None
        accounts = self._rows(head, ACCOUNTS).select(c("id").alias("account_id"), "account_name", "fakeid")
        return rows.join(small(accounts), "account_id")

    # -- audit ------------------------------------------------------------------------------------

    def imports(self) -> DataFrame:
        """The audit rows of all imports (no rows before the first)."""
        if not self.files.names("commits"):
            return self.spark.createDataFrame([], RUN_SCHEMA)
        found = self.spark.read.schema(f"run struct<{RUN_SCHEMA.replace(' ', ':').replace(',:', ',')}>").json(f"{self.root}/commits")
        return found.filter(c("run").isNotNull()).select("run.*")

    def latest_import(self) -> DataFrame:
        """Last audit row (no rows before the first)."""
        return self.imports().orderBy(F.desc("run_id")).limit(1)

    def scopes(self) -> DataFrame:
        """run_id, account_id and counts: what every import brought per account."""
        if not self.files.names("commits"):
            return self.spark.createDataFrame([], SCOPE_SCHEMA)
        found = self.spark.read.schema("scopes string").json(f"{self.root}/commits").filter(c("scopes").isNotNull())
        # One folder per import: names only.
        folders = [r["scopes"] for r in found.collect()]
        return self._load(folders) if folders else self.spark.createDataFrame([], SCOPE_SCHEMA)

    # -- changes ----------------------------------------------------------------------------------

    def import_rows(self, articles: DataFrame, source_name: str, fingerprint: str, expected: str | None, imported_at: str,
                    stream: str | None = None, batch: int | None = None, credential_fields: int = 0) -> DataFrame:
        """Apply a previewed import of normalised rows; returns its audit row.

        ``expected`` must be the fingerprint that the preview showed.  A batch of a stream that is committed already is
        left out (no audit row is returned), so a batch that is run again changes nothing.
        """
        if not expected or expected.lower() != fingerprint.lower():
            raise ValueError("preview fingerprint does not match the import")
        head = self.head()
        if stream is not None and head["streams"].get(stream, -1) >= batch:
            return self.imports().limit(0)
        rows = checkpointed(articles)
        incoming = checkpointed(self._incoming(rows))
        if stream is None and incoming.isEmpty():
            raise ValueError("import contains no valid article URLs")
        next_ = {**head, "version": head["version"] + 1, ARTICLES: dict(head[ARTICLES]), ACCOUNTS: dict(head[ACCOUNTS]),
                 "streams": {**head["streams"], **({stream: batch} if stream is not None else {})}, "scopes": None}
        attempt = f"{next_['version']:012d}-{uuid.uuid4().hex}"
        counts = rows.agg(F.count(F.lit(1)).alias("raw_records"), F.count_if(c("reject_reason").isNotNull()).alias("rejected_records")).first().asDict()
        counts |= {x: 0 for x in RUN_COUNTS if x not in counts} | {"credential_fields_ignored": credential_fields}
        if not incoming.isEmpty():
            accounts = self._merge_accounts(head, next_, incoming, imported_at)
            merged = self._merge_articles(head, next_, incoming, accounts, imported_at)
            counts |= merged.agg(F.count(F.lit(1)).alias("accepted_records"), F.count_if(~c("_old")).alias("added_articles"), F.count_if("_old").alias("existing_articles"),
                                 F.count_if(c("_old") & c("_new")).alias("updated_articles")).first().asDict()
            counts["duplicate_records_removed"] = counts["raw_records"] - counts["rejected_records"] - counts["accepted_records"]
            self._write(next_, ACCOUNTS, accounts, attempt)
            self._write(next_, ARTICLES, merged.drop("_old", "_new"), attempt)
            # A URL is once in an account, so only groups are counted distinct there; groups and originals of the import are sums.
            scopes = incoming.groupBy("account_key").agg(F.count_distinct("group_key").alias("publish_groups"), F.count(F.lit(1)).alias("expanded_url_items"),
                                                         F.count_if(P.original()).alias("original_articles")).join(accounts.select("account_key", c("id").alias("account_id")), "account_key")
            next_["scopes"] = f"scopes/{attempt}"
            scopes.select(F.lit(head["next_run_id"]).cast("long").alias("run_id"), "account_id", "publish_groups", "expanded_url_items", "original_articles").write.parquet(f"{self.root}/{next_['scopes']}")
            counts |= self._load([next_["scopes"]]).agg(F.sum("publish_groups").alias("publish_groups"), F.sum("original_articles").alias("original_articles")).first().asDict()
            counts |= incoming.agg(F.count_distinct("canonical_url").alias("expanded_url_items")).first().asDict()
        name = self.spark.range(1).select(X.redact(F.lit(source_name))).first()[0]
        next_["run"] = {"run_id": head["next_run_id"], "source_name": name, "source_fingerprint": fingerprint, **{x: counts[x] for x in RUN_COUNTS},
                        "imported_at": imported_at, "stream": stream, "batch": batch}
        next_["next_run_id"] = head["next_run_id"] + 1
        self._commit(next_)
        if any(len(f) > self.most_folders for t in (ARTICLES, ACCOUNTS) for f in next_[t].values()):
            self.compact()
        return self.imports().filter(c("run_id") == head["next_run_id"])

    def _incoming(self, rows: DataFrame) -> DataFrame:
        """Merged rows of an import with their rank: latest first, then higher places in a group, then arrival."""
        first = rows.withColumn("_first", -c("seq"))
        merged = P.merge_import(first, also_max=["_first"], sparse=True)
        return merged.withColumn("_order", F.struct((-F.coalesce("publish_time", F.lit(0))).alias("a"), (-F.coalesce("itemidx", F.lit(0))).alias("b"),
                                                    (-c("_first")).alias("c"), *P.KEYS)).drop("_first", "seq")

    def _known(self, head: dict[str, Any], table: str, incoming: DataFrame) -> DataFrame | None:
        """Stored rows of the incoming keys, read from the buckets that these touch."""
        keys = TABLE_KEYS[table]
        # At most as many rows as there are buckets.
        touched = [r[0] for r in incoming.select(self._bucket(table, head)).distinct().collect()]
        rows = self._rows(head, table, touched)
        return None if rows is None else checkpointed(rows.join(incoming.select(*keys).distinct(), keys, "left_semi"))

    def _numbered(self, rows: DataFrame, head: dict[str, Any], next_: dict[str, Any], counter: str, keys: list[str]) -> DataFrame:
        """Give rows without an id the next ones in their order."""
        fresh = checkpointed(rows.filter(c("id").isNull()).select(*keys, "_order"))
        next_[counter] = head[counter] + fresh.count()
        ids = indexed(fresh, [F.asc("_order")], "_i").select(*keys, (c("_i") + head[counter]).alias("_id"))
        return rows.join(ids, keys, "left").withColumn("id", F.coalesce("id", "_id")).drop("_id", "_order")

    def _merge_accounts(self, head: dict[str, Any], next_: dict[str, Any], incoming: DataFrame, now: str) -> DataFrame:
        """Accounts of an import: the name and id of their first row, else the stored ones."""
        new = incoming.groupBy("account_key").agg(F.min_by(F.struct("account_name", "fakeid"), "_order").alias("i"), F.min("_order").alias("_order"))
        known = self._known(head, ACCOUNTS, incoming)
        stored = new.withColumn("k", F.lit(None).cast("struct<id:bigint,account_name:string,fakeid:string,created_at:string>")) if known is None else (
            new.join(known.select("account_key", F.struct("id", "account_name", "fakeid", "created_at").alias("k")), "account_key", "left"))
        filled = lambda x: F.coalesce(F.nullif(c(f"i.{x}"), F.lit("")), c(f"k.{x}"), F.lit("")).alias(x)
        rows = stored.select("account_key", c("k.id").alias("id"), filled("account_name"), filled("fakeid"), F.coalesce("k.created_at", F.lit(now)).alias("created_at"),
                             F.lit(now).alias("updated_at"), F.lit(next_["version"]).cast("long").alias("row_version"), "_order")
        return checkpointed(self._numbered(rows, head, next_, "next_account_id", ["account_key"]))

    def _merge_articles(self, head: dict[str, Any], next_: dict[str, Any], incoming: DataFrame, accounts: DataFrame, now: str) -> DataFrame:
        """Whole rows of the incoming articles after the import, with _old (was stored) and _new (a field changed)."""
        fields = [x for x in incoming.columns if x not in (*P.KEYS, "account_name", "fakeid", "date_status", "_order")]
        known = self._known(head, ARTICLES, incoming)
        if known is None:
            known = self.spark.createDataFrame([], incoming.withColumns({"id": F.lit(0).cast("long"), "created_at": F.lit(now)}).schema)
        joined = incoming.alias("i").join(known.alias("k"), P.KEYS, "left")
        same = F.lit(True)
        for x in fields:
            same = same & _as_article(x).eqNullSafe(c(f"k.{x}"))
        rows = joined.select(*P.KEYS, *[_as_article(x).alias(x) for x in fields], c("k.id").alias("id"),
                             F.coalesce("k.created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"),
                             c("k.id").isNotNull().alias("_old"), (~same).alias("_new"), "i._order")
        rows = rows.withColumns({"date_status": F.when(c("publish_time").isNull(), "pending").otherwise("known"), "removed": F.lit(False),
                                 "row_version": F.lit(next_["version"]).cast("long")})
        rows = rows.join(small(accounts.select("account_key", c("id").alias("account_id"))), "account_key")
        return checkpointed(self._numbered(rows, head, next_, "next_article_id", P.KEYS))

    def _write(self, next_: dict[str, Any], table: str, rows: DataFrame, attempt: str, whole: bool = False) -> None:
        """Write rows by bucket and name the new folders in the manifest."""
        dealt = rows.withColumn("_bucket", self._bucket(table, next_))
        folder = f"{table}/{attempt}"
        dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        for name in self.files.names(folder):
            if name.startswith("_bucket="):
                bucket = name.partition("=")[2]
                next_[table][bucket] = ([] if whole else next_[table].get(bucket, [])) + [f"{folder}/{name}"]

    def remove(self, article_id: int, now: str) -> bool:
        """Take one article out of the pool; whether it was there."""
        head = self.head()
        rows = self._rows(head, ARTICLES)
        found = None if rows is None else checkpointed(rows.filter(c("id") == article_id))
        if found is None or found.isEmpty():
            return False
        next_ = {**head, "version": head["version"] + 1, ARTICLES: dict(head[ARTICLES]), "run": None, "scopes": None}
        gone = found.withColumns({"removed": F.lit(True), "updated_at": F.lit(now), "row_version": F.lit(next_["version"]).cast("long")})
        self._write(next_, ARTICLES, gone, f"{next_['version']:012d}-{uuid.uuid4().hex}")
        self._commit(next_)
        return True

    def compact(self, most_folders: int | None = None) -> list[tuple[str, int]]:
        """Rewrite every bucket of more than ``most_folders`` folders as one; which ones."""
        most = self.most_folders if most_folders is None else most_folders
        head = self.head()
        full = [(t, int(b)) for t in (ARTICLES, ACCOUNTS) for b, f in head[t].items() if len(f) > most]
        if not full:
            return []
        next_ = {**head, "version": head["version"] + 1, ARTICLES: dict(head[ARTICLES]), ACCOUNTS: dict(head[ACCOUNTS]), "run": None, "scopes": None}
        attempt = f"{next_['version']:012d}-{uuid.uuid4().hex}"
        for table in (ARTICLES, ACCOUNTS):
            buckets = [b for t, b in full if t == table]
            if buckets:
                rows = self._rows(head, table, buckets).withColumn("row_version", F.lit(next_["version"]).cast("long"))
                for b in buckets:
                    next_[table].pop(str(b))
                self._write(next_, table, rows.withColumn("removed", F.lit(False)) if table == ARTICLES else rows, attempt, whole=True)
        self._commit(next_)
        return full
