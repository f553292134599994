"""Queries by name over the test tables, with the SQL that says the same.

Orders stand for snapshots, documents for files, line items for blob locations, suppliers for packfiles, parts and
customers for catalog rows, events for I/O and the event bus, conversations for objects of ordered chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import codecs, mime, paths, scalars
from tidepool.operators import catalog, content, locate, packs, telemetry, tree
from tidepool.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = datetime(1998, 8, 2, 12)


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- locate and retention --------------------------------------------------------------------------------------------


def items(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    empty = F.array().cast("array<string>")
    return o.select(F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("category"), F.lit("prod").alias("environment"), F.lit("").alias("perimeter"), F.col("o_orderpriority").alias("job"), F.lit("").alias("dataset"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.array("o_orderpriority").alias("types"), F.array("o_orderstatus").alias("origins"), F.array(F.lit("/"), F.concat(F.lit("/"), "o_orderstatus")).alias("roots"), empty.alias("data_classes"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderdate AS ts FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def locate_before_since(spark, d):
    f = locate.Filters(before=datetime(1998, 1, 1), since=datetime(1997, 1, 1))
    return locate.matching(items(spark, d), f).select("item_id", "ts")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%' OR CAST(o_orderkey AS VARCHAR) LIKE '7%'")
def locate_id_prefix(spark, d):
    return locate.matching(items(spark, d), locate.Filters(ids=["12", "7"])).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def locate_tags_all(spark, d):
    return locate.matching(items(spark, d), locate.Filters(tags=["F", "1-URGENT", ""])).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority <> '1-URGENT'")
def locate_tags_none(spark, d):
    return locate.matching(items(spark, d), locate.Filters(ignore_tags=["F", "1-URGENT"])).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def locate_types_origins_any(spark, d):
    return locate.matching(items(spark, d), locate.Filters(types=["1-URGENT", "2-HIGH"], origins=["F", "O"])).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus = 'P'")
def locate_roots_all(spark, d):
    return locate.matching(items(spark, d), locate.Filters(roots=["/", "/P"])).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_custkey = 7")
def locate_scalars(spark, d):
    return locate.matching(items(spark, d), locate.Filters(category="O", job="5-LOW", name="7", environment="prod")).select("item_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1")
def locate_latest(spark, d):
    return locate.matching(items(spark, d), locate.Filters(category="F", latest=True)).select("item_id", "ts")


_KEYS = {"minute": "strftime(ts, '%Y-%m-%d-%H:%M')", "hour": "strftime(ts, '%Y-%m-%d-%H')", "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%G-W%V')", "month": "strftime(ts, '%Y-%m')", "year": "strftime(ts, '%Y')"}


def _key(period: str) -> str:
    return _KEYS.get(period, "strftime(ts, '%G-W%V') || '-' || lower(dayname(ts))")


def _retention_sql(rules: list[tuple[str, int, int]], group: str = "''", source: str = "orders") -> str:
    """The policy in SQL: a branch for each rule, then the best verdict of each item."""
    base = f"SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderdate AS ts, {group} AS grp FROM {source}"
    parts = []
    for i, (period, keep, cap) in enumerate(sorted(rules, key=lambda r: locate.PERIODS.index(r[0]))):
        inside = f"{_key(period)} IN ({', '.join(repr(k) for k in locate.last_keys(period, NOW, keep))})" if keep else f"lower(dayname(ts)) = '{period}'" if period in locate.WEEKDAYS else "true"
        parts.append(f"SELECT item_id, grp, {i} AS ord, '{period}' AS rule, {_key(period)} AS bucket, {cap} AS cap, row_number() OVER (PARTITION BY grp, {_key(period)} ORDER BY ts DESC, item_id) AS rank FROM i WHERE {inside}")
    return f"""WITH i AS ({base}), r AS ({" UNION ALL ".join(parts)}), v AS (SELECT *, CASE WHEN cap = 0 OR rank <= cap THEN 0 ELSE 1 END AS gone FROM r),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gone, rank, ord, grp) AS n FROM v) WHERE n = 1)
    SELECT x.item_id, CASE WHEN gone = 0 THEN 'keep' ELSE 'delete' END AS action, coalesce(rule, '') AS rule, coalesce(bucket, '') AS bucket, CAST(coalesce(rank, 0) AS INTEGER) AS rank, CAST(coalesce(cap, 0) AS INTEGER) AS cap,
           CASE WHEN gone IS NULL THEN 'outside retention windows' WHEN gone = 0 THEN 'within bucket' ELSE 'exceeds per-bucket cap' END AS note
    FROM (SELECT DISTINCT item_id FROM i) x LEFT JOIN b USING (item_id)"""


def _policy(name: str, rules: list[tuple[str, int, int]], group: str | None = None, sql_group: str = "''") -> None:
    def run(spark, d):
        return locate.retain(items(spark, d), rules, NOW, group)

    run.__name__ = name
    query(_retention_sql(rules, sql_group))(run)


for _p in locate.PERIODS:
    _policy(f"retention_{_p}_cap", [(_p, 0, 2)], "category", "o_orderstatus")
    _policy(f"retention_{_p}_keep", [(_p, 60, 0)])
_policy("retention_day_keep_cap", [("day", 90, 1)])
_policy("retention_many_rules", [("day", 30, 2), ("monday", 0, 1), ("week", 26, 3), ("month", 12, 1), ("year", 0, 1)])
_policy("retention_group_by_tag", [("month", 0, 1), ("week", 20, 2)], "tag", "unnest([o_orderstatus, o_orderpriority])")
_policy("retention_group_by_job", [("month", 24, 2)], "job", "o_orderpriority")
_policy("retention_group_unknown", [("year", 0, 3)], "color")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'keep' AS action, 'matched filters' AS note FROM orders WHERE o_orderstatus = 'P'")
def retention_no_rules(spark, d):
    return locate.retain(items(spark, d).where("category = 'P'"), [], NOW).select("item_id", "action", "note")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM orders")
def sort_headers(spark, d):
    keys = locate.sort_keys("-Timestamp,Identifier")
    return locate.numbered(items(spark, d), locate.ordering(keys, {"Timestamp": "ts", "Identifier": "item_id"}, "item_id")).select("item_id", "n")


@query("WITH p AS (SELECT DISTINCT left(CAST(o_orderkey AS VARCHAR), 3) AS prefix FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT CAST(o_orderkey AS VARCHAR) || 'x' FROM orders WHERE o_orderkey % 50 = 0) SELECT prefix, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) = 1 THEN CAST(min(o_orderkey) AS VARCHAR) END AS item_id FROM p LEFT JOIN orders ON starts_with(CAST(o_orderkey AS VARCHAR), prefix) GROUP BY prefix")
def snapshot_prefixes(spark, d):
    o = items(spark, d)
    number = F.col("item_id").cast("long")
    asked = o.where(number % 7 == 0).select(F.substring("item_id", 1, 3).alias("prefix")).unionByName(o.where(number % 50 == 0).select(F.concat("item_id", F.lit("x")).alias("prefix")))
    return locate.prefixes_resolved(asked, o.select("item_id"))


@query("WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderdate AS ts, row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS rank FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01') SELECT item_id, ts FROM m WHERE rank <= 2")
def located_snapshots(spark, d):
    return locate.located(items(spark, d), locate.Filters(category="O", since=datetime(1996, 1, 1)), [("month", 0, 2)], NOW, "job")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'keep' AS action FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1")
def match_latest(spark, d):
    return locate.match(items(spark, d), locate.Filters(job="1-URGENT", latest=True), [("year", 0, 1)], NOW, "tag").select("item_id", "action")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus IN ('F', 'P')")
def locate_data_classes(spark, d):
    return locate.matching(items(spark, d).withColumn("data_classes", F.array("category")), locate.Filters(data_classes=["F", "P"])).select("item_id")


# -- files -----------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files in folders of language and source; every 97th is a link."""
    t = table(spark, d, "documents")
    link = F.col("doc_id") % 97 == 0
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt"))
    parent = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    return t.select(
        "doc_id", F.concat(parent, F.lit("/"), name).alias("path"), parent.alias("parent"), name.alias("name"), F.when(link, "symlink").otherwise("regular").alias("kind"), F.when(link, 0).otherwise(F.octet_length("text")).cast("long").alias("size"), F.col("doc_id").alias("mtime"), F.lit(0.0).alias("entropy"),
        F.when(link, "application/x-not-regular-file").when(F.col("doc_id") % 3 == 0, "text/markdown").when(F.col("doc_id") % 7 == 0, "image/png").otherwise("text/plain").alias("content_type"), F.when(link, 0).otherwise(1).alias("n_chunks"), F.when(link, F.lit("../src0")).otherwise(F.lit("")).alias("target"), "text",
    )


def tree_entries(spark: SparkSession, d: str) -> DataFrame:
    """Files and the directories above them."""
    f = files(spark, d).drop("text", "doc_id")
    dirs = f.select(F.explode(F.array_append(paths.ancestors(F.col("parent")), F.col("parent"))).alias("path")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    dirs = dirs.select("path", F.when(F.col("path") == "/", "").otherwise(paths.dirname(F.col("path"))).alias("parent"), paths.basename(F.col("path")).alias("name"), F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"), none("bigint").alias("mtime"), none("double").alias("entropy"), F.lit("").alias("content_type"), F.lit(0).alias("n_chunks"), F.lit("").alias("target"))
    return f.unionByName(dirs)


_FILES = """f AS (SELECT doc_id, '/' || lang || '/' || source AS parent, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS name, doc_id % 97 = 0 AS link, CASE WHEN doc_id % 97 = 0 THEN 0 ELSE strlen(text) END AS size,
 CASE WHEN doc_id % 97 = 0 THEN 'application/x-not-regular-file' WHEN doc_id % 3 = 0 THEN 'text/markdown' WHEN doc_id % 7 = 0 THEN 'image/png' ELSE 'text/plain' END AS content_type, text FROM documents), g AS (SELECT *, parent || '/' || name AS path FROM f)"""


@query(f"WITH {_FILES} SELECT path FROM g WHERE parent = '/en/src0'")
def vfs_children(spark, d):
    return tree.children(tree_entries(spark, d), "/en/src0").select("path")


@query(f"WITH {_FILES}, a AS (SELECT path FROM g UNION SELECT parent FROM g UNION SELECT '/' || split_part(parent, '/', 2) FROM g UNION SELECT '/') SELECT path, row_number() OVER (ORDER BY string_split(CASE WHEN path = '/' THEN '' ELSE path END, '/')) AS n FROM a WHERE path = '/en' OR starts_with(path, '/en/')")
def vfs_walk_order(spark, d):
    return locate.numbered(tree.walk(tree_entries(spark, d), "/en"), [paths.walk_order(F.col("path"))]).select("path", "n")


@query(f"WITH {_FILES}, a AS (SELECT path FROM g UNION SELECT parent FROM g UNION SELECT '/' || split_part(parent, '/', 2) FROM g UNION SELECT '/') SELECT path, CAST(CASE WHEN path = '/' THEN 0 ELSE length(path) - length(replace(path, '/', '')) END AS INTEGER) AS depth FROM a")
def vfs_depth(spark, d):
    return tree.by_depth(tree_entries(spark, d)).select("path", paths.depth(F.col("path")).alias("depth"))


@query(f"WITH {_FILES} SELECT parent AS path FROM g UNION SELECT '/' || split_part(parent, '/', 2) FROM g UNION SELECT '/'")
def vfs_missing_ancestors(spark, d):
    return tree.missing_ancestors(files(spark, d))


@query(f"WITH {_FILES} SELECT g.path AS link, '/' || split_part(parent, '/', 2) || '/src0' AS path FROM g WHERE link")
def vfs_links(spark, d):
    return tree.resolve_links(tree_entries(spark, d)).select("link", "path")


@query(f"WITH {_FILES} SELECT path FROM g UNION ALL SELECT path || '/below/deep' FROM g WHERE NOT link AND doc_id % 5 = 0")
def vfs_not_below_links(spark, d):
    """Each link, and each fifth file, has an entry two levels below it."""
    f = files(spark, d).select("path", "parent", "target", "doc_id")
    more = f.where("target <> '' OR doc_id % 5 = 0").select(F.concat("path", F.lit("/below/deep")).alias("path"), F.concat("path", F.lit("/below")).alias("parent"), F.lit("").alias("target"), "doc_id")
    return tree.not_below_links(f.unionByName(more)).select("path")


@query(f"WITH {_FILES} SELECT parent AS path, 2147484136::BIGINT AS mode, 0::BIGINT AS mtime FROM g UNION SELECT '/' || split_part(parent, '/', 2), 2147484136, 0 FROM g UNION SELECT '/', 2147484136, 0")
def relinked(spark, d):
    rows = files(spark, d).select("path", "parent", "name", "kind", "size", "mtime", F.lit(0o644).cast("long").alias("mode"))
    return tree.relinked(rows).where("kind = 'directory'").select("path", "mode", "mtime")


@query(f"WITH {_FILES} SELECT path FROM g WHERE parent = '/de/src1'")
def search_children(spark, d):
    return tree.search(tree_entries(spark, d), prefix="/de/src1/", recursive=False, order="path").select("path")


@query(f"WITH {_FILES} SELECT path, content_type FROM g, (VALUES ('text'), ('text/markdown'), ('image/png')) m(mime) WHERE starts_with('/' || content_type || '/', '/' || mime || '/') AND starts_with(path, '/en/')")
def search_mime_index(spark, d):
    """An entry comes once for each asked type that it fits."""
    return tree.search(tree_entries(spark, d), prefix="/en", mimes=["text", "text/markdown", "image/png"], indexed=True).select("path", "content_type")


@query(f"WITH {_FILES} SELECT path FROM g WHERE content_type LIKE 'text/%' ORDER BY content_type, path LIMIT 30 OFFSET 5")
def search_mime_page(spark, d):
    return tree.search(tree_entries(spark, d), mimes=["text"], indexed=True, offset=5, limit=30).select("path")


@query(f"WITH {_FILES}, a AS (SELECT path, 3 AS depth, FALSE AS dir FROM g UNION SELECT parent, 2, TRUE FROM g UNION SELECT '/' || split_part(parent, '/', 2), 1, TRUE FROM g UNION SELECT '/', 0, TRUE) SELECT path FROM a ORDER BY depth, path LIMIT 20 OFFSET 3")
def search_breadth(spark, d):
    return tree.search(tree_entries(spark, d), files_only=False, order="breadth", offset=3, limit=20).select("path")


@query(f"WITH {_FILES} SELECT path FROM g WHERE starts_with(path, '/de/src1/')")
def search_prefix(spark, d):
    return tree.search(tree_entries(spark, d), prefix="/de/src1").select("path")


@query(f"WITH {_FILES} SELECT path FROM g WHERE regexp_matches(name, '^1[0-9]\\.[^/]*$') OR regexp_matches(name, '1[0-9].*')")
def search_name(spark, d):
    return tree.search(tree_entries(spark, d), name="1[0-9].*").select("path")


@query(f"WITH {_FILES} SELECT path FROM g WHERE regexp_matches(name, '^[^/]*7\\.txt$')")
def search_glob(spark, d):
    return tree.search(tree_entries(spark, d), name="*7.txt", exact_mime=True).select("path")


@query(f"WITH {_FILES} SELECT path FROM g WHERE split_part(content_type, '/', 1) IN ('image')")
def search_mime_major(spark, d):
    return tree.search(tree_entries(spark, d), mimes=["image/gif"]).select("path")


@query(f"WITH {_FILES} SELECT path FROM g WHERE content_type = 'text/markdown'")
def search_mime_exact(spark, d):
    return tree.search(tree_entries(spark, d), mimes=["text/markdown"], exact_mime=True).select("path")


@query(f"WITH {_FILES} SELECT path FROM g ORDER BY string_split(path, '/') LIMIT 25 OFFSET 10")
def search_page(spark, d):
    return tree.search(tree_entries(spark, d), offset=10, limit=25).select("path")


@query(f"WITH {_FILES} SELECT path, CASE WHEN starts_with(path, '/en/src1/') THEN false WHEN regexp_matches(name, '[.]md$') THEN true WHEN starts_with(path, '/fr/') THEN true ELSE false END AS excluded FROM g")
def exclude_last_match(spark, d):
    rules = tree.load_rules("# rules\n/fr/\n*.md\n!/en/src1/\n")
    return files(spark, d).select("path", tree.excluded(F.col("path"), F.lit(False), rules).alias("excluded"))


def _fold(value: str, order: str) -> str:
    return f"list_reduce(list({value} ORDER BY {order}), lambda a, x: CASE WHEN a = 0 OR x < a THEN x ELSE a END, 0::BIGINT)"


#: Files of all kinds: modes, times and entropies vary, and some are 0.
_KINDS = f"""{_FILES}, k AS (SELECT *, CASE WHEN link THEN 'symlink' WHEN doc_id % 41 = 0 THEN 'pipe' WHEN doc_id % 43 = 0 THEN 'device' WHEN doc_id % 47 = 0 THEN 'socket' ELSE 'regular' END AS kind,
 doc_id % 13 = 0 AS setuid, doc_id % 17 = 0 AS sticky, doc_id * 7919 % 101 AS mtime, doc_id % 9 AS entropy, CASE doc_id % 29 WHEN 1 THEN 'audio/ogg' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'font/otf' WHEN 4 THEN '' ELSE content_type END AS mime FROM g)"""


def kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    f = files(spark, d)
    kind = F.when(F.col("kind") == "symlink", "symlink").when(n % 41 == 0, "pipe").when(n % 43 == 0, "device").when(n % 47 == 0, "socket").otherwise("regular")
    mime_type = F.when(n % 29 == 1, "audio/ogg").when(n % 29 == 2, "video/mp4").when(n % 29 == 3, "font/otf").when(n % 29 == 4, "").otherwise(F.col("content_type"))
    mode = F.when(n % 13 == 0, scalars.MODE_SETUID).otherwise(0) + F.when(n % 17 == 0, scalars.MODE_STICKY).otherwise(0)
    return f.withColumns({"kind": kind, "content_type": mime_type, "mode": mode.cast("long"), "mtime": n * 7919 % 101, "entropy": (n % 9).cast("double")}).drop("text")


_COUNTED = """count(*) FILTER (kind = 'regular') AS files, 0::BIGINT AS directories, count(*) FILTER (link) AS symlinks, count(*) FILTER (kind = 'device') AS devices, count(*) FILTER (kind = 'pipe') AS pipes, count(*) FILTER (kind = 'socket') AS sockets, count(*) AS children,
 count(*) FILTER (setuid) AS setuid, 0::BIGINT AS setgid, count(*) FILTER (sticky) AS sticky, count(*) FILTER (NOT link) AS objects, count(*) FILTER (NOT link) AS chunks, sum(size)::BIGINT AS size, count(*) FILTER (entropy <= 2) AS low_entropy, count(*) FILTER (entropy >= 7) AS high_entropy,
 count(*) FILTER (mime LIKE 'text/%') AS mime_text, count(*) FILTER (mime LIKE 'image/%') AS mime_image, count(*) FILTER (mime LIKE 'audio/%') AS mime_audio, count(*) FILTER (mime LIKE 'video/%') AS mime_video, count(*) FILTER (mime LIKE 'application/%') AS mime_application, count(*) FILTER (mime LIKE 'font/%') AS mime_other"""


@query(f"""WITH {_KINDS} SELECT parent AS directory, {_COUNTED}, {_fold("size::BIGINT", "path")} AS min_size, max(size)::BIGINT AS max_size, {_fold("mtime::BIGINT", "path")} AS min_mtime, max(mtime)::BIGINT AS max_mtime, {_fold("entropy::BIGINT", "path")} AS min_entropy, max(entropy)::BIGINT AS max_entropy,
 sum(entropy)::BIGINT AS sum_entropy, (CASE WHEN files > 0 THEN sum(size) // files ELSE 0 END)::BIGINT AS avg_size, CASE WHEN files > 0 THEN round(sum(entropy) / files, 6) ELSE 0 END AS avg_entropy FROM k GROUP BY parent""")
def dir_summary(spark, d):
    s = tree.with_averages(tree.directory_summary(kinds(spark, d)))
    whole = {c: F.col(c).cast("long") for c in ("min_entropy", "max_entropy", "sum_entropy")}
    return s.withColumnRenamed("parent", "directory").withColumns({**whole, "avg_entropy": F.round("avg_entropy", 6)})


@query(f"""WITH {_KINDS}, up AS (SELECT '/' AS directory, * FROM k UNION ALL SELECT '/' || split_part(parent, '/', 2), * FROM k), dirs AS (SELECT '/' || split_part(parent, '/', 2) AS up, parent FROM k GROUP BY 1, 2), n AS (SELECT '/' AS directory, (SELECT count(*) FROM dirs) AS n UNION ALL SELECT up, 0 FROM dirs GROUP BY up)
SELECT directory, {_COUNTED.replace("0::BIGINT AS directories", "any_value(n.n)::BIGINT AS directories").replace("count(*) AS children", "(count(*) + any_value(n.n))::BIGINT AS children")}, max(size)::BIGINT AS max_size, max(mtime)::BIGINT AS max_mtime FROM up JOIN n USING (directory) GROUP BY directory""")
def dir_below_rollup(spark, d):
    """What is directly in a directory isn't below it: of the root's subdirectories, those of languages are left out."""
    f = kinds(spark, d)
    dirs = tree_entries(spark, d).where("kind = 'directory'").withColumns({"mode": F.lit(0).cast("long"), "doc_id": F.lit(None).cast("long"), "mtime": F.lit(0).cast("long"), "entropy": F.lit(0.0)})
    return tree.below(tree.directory_summary(f.unionByName(dirs.select(f.columns)))).select("directory", *tree.SUMS, F.col("max_size").cast("long").alias("max_size"), F.col("max_mtime").cast("long").alias("max_mtime"))


@query(f"""WITH {_KINDS}, s AS (SELECT parent AS path, '/' || split_part(parent, '/', 2) AS up, {_fold("size::BIGINT", "path")} AS size, {_fold("mtime::BIGINT", "path")} AS mtime FROM k GROUP BY parent),
l AS (SELECT up AS path, {_fold("v", "path, n")} AS size FROM (SELECT up, path, 0 AS n, 0::BIGINT AS v FROM s UNION ALL SELECT up, path, 1, size FROM s) GROUP BY up), lt AS (SELECT up AS path, {_fold("v", "path, n")} AS mtime FROM (SELECT up, path, 0 AS n, 0::BIGINT AS v FROM s UNION ALL SELECT up, path, 1, mtime FROM s) GROUP BY up),
r AS (SELECT {_fold("v", "path, n")} AS size FROM (SELECT path, 0 AS n, size AS v FROM l UNION ALL SELECT path, 1, 0::BIGINT FROM l)), rt AS (SELECT {_fold("v", "path, n")} AS mtime FROM (SELECT path, 0 AS n, mtime AS v FROM lt UNION ALL SELECT path, 1, 0::BIGINT FROM lt))
SELECT path AS directory, size AS min_size, mtime AS min_mtime FROM l JOIN lt USING (path) UNION ALL SELECT '/', size, mtime FROM r, rt""")
def dir_below_mins(spark, d):
    f = kinds(spark, d)
    own = tree.summaries(f.unionByName(tree_entries(spark, d).where("kind = 'directory'").withColumns({"mode": F.lit(0).cast("long"), "doc_id": F.lit(None).cast("long"), "mtime": F.lit(0).cast("long"), "entropy": F.lit(0.0)}).select(f.columns)))
    return own.where("path NOT LIKE '/%/%'").select(F.col("path").alias("directory"), F.col("below.min_size").cast("long").alias("min_size"), F.col("below.min_mtime").cast("long").alias("min_mtime"))


@query(f"WITH {_FILES}, e AS (SELECT parent FROM g WHERE doc_id % 6 = 0), up AS (SELECT parent AS directory FROM e UNION ALL SELECT '/' || split_part(parent, '/', 2) FROM e UNION ALL SELECT '/' FROM e), a AS (SELECT parent AS directory FROM g UNION SELECT '/' || split_part(parent, '/', 2) FROM g UNION SELECT '/') SELECT directory, count(up.directory) AS errors FROM a LEFT JOIN up USING (directory) GROUP BY directory")
def dir_errors(spark, d):
    """Errors count below their directory and all above it, and in none directly."""
    return tree.summaries(tree_entries(spark, d), files(spark, d).where("doc_id % 6 = 0").select("parent")).select(F.col("path").alias("directory"), "below.errors")


@query(f"WITH {_FILES} SELECT parent, list_reduce(list(size::BIGINT ORDER BY path), lambda a, x: CASE WHEN a = 0 OR x < a THEN x ELSE a END, 0::BIGINT) AS least FROM g GROUP BY parent")
def dir_min_fold(spark, d):
    rows = files(spark, d).groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("s"))
    return rows.select("parent", tree.folded_min(F.col("s.size")).alias("least"))


@query(f"WITH {_FILES} SELECT sum((NOT link)::INT)::BIGINT AS files, (SELECT count(*) FROM (SELECT parent FROM g UNION SELECT '/' || split_part(parent, '/', 2) FROM g UNION SELECT '/')) AS directories, sum(link::INT)::BIGINT AS links, sum(size)::BIGINT AS size FROM g")
def scan_stats(spark, d):
    return tree.scan_stats(tree_entries(spark, d))


@query(f"WITH {_FILES}, p AS (SELECT path FROM g ORDER BY length(text) DESC, path LIMIT 2), t AS (SELECT path AS top, path FROM p UNION SELECT parent, p.path FROM p JOIN g USING (path) UNION SELECT '/' || split_part(path, '/', 2), path FROM p UNION SELECT '/', path FROM p) SELECT arg_max(top, length(top)) AS prefix FROM (SELECT top FROM t GROUP BY top HAVING count(*) = 2)")
def common_prefix(spark, d):
    """Of the two longest files' paths."""
    return tree.common_prefix(files(spark, d).orderBy(F.length("text").desc(), "path").limit(2))


@query(f"WITH {_FILES} SELECT DISTINCT 'fs' AS origin, parent AS root FROM g")
def shadowed_roots(spark, d):
    e = tree_entries(spark, d).where("kind = 'directory'").select(F.lit("fs").alias("origin"), F.col("path").alias("root"))
    return tree.shadowed_roots(e).where("root LIKE '/%/%'")


@query("SELECT p_partkey, p_partkey % 5 <> 0 AND p_size <> 7 AS cached FROM part")
def incremental_changed(spark, d):
    p = table(spark, d, "part")
    info = lambda df: df.select("p_partkey", F.concat(F.lit("/"), "p_partkey").alias("path"), "gone", F.col("p_name").alias("name"), "size", F.lit(0).alias("mode"), *(F.lit(0).alias(c) for c in tree.FILEINFO if c not in ("name", "size", "mode")))
    now = info(p.withColumns({"size": F.col("p_size"), "gone": F.lit(False)}))
    before = info(p.withColumns({"size": F.when(F.col("p_size") == 7, 8).otherwise(F.col("p_size")), "gone": F.col("p_partkey") % 5 == 0})).where("NOT gone")
    return tree.unchanged(now, before).select("p_partkey", "cached")


@query(f"WITH {_FILES} SELECT 0 AS stage, count(*) AS n FROM g WHERE doc_id % 11 = 0 UNION ALL SELECT 1, count(*) FROM g WHERE doc_id % 13 = 0 UNION ALL SELECT 2, count(*) FROM g")
def sync_union(spark, d):
    f = files(spark, d)
    return tree.replay(f, f.where("doc_id % 13 = 0").select("path"), f.where("doc_id % 11 = 0").select("path")).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT substr(path, 4) AS path FROM g WHERE starts_with(path, '/es/')")
def export_subtree(spark, d):
    return tree.exported(tree_entries(spark, d).where("kind <> 'directory'"), "/es").select("path")


# -- content ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS mac, strlen(text)::BIGINT AS size FROM documents")
def content_mac(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.mac(F.encode("text", "UTF-8")).alias("mac"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT sha256(text) AS mac, count(*) AS copies, min(doc_id) AS first_id, max(strlen(text))::BIGINT AS length, (max(strlen(text)) * (count(*) - 1))::BIGINT AS saved FROM documents GROUP BY 1")
def dedup_groups(spark, d):
    return content.duplicate_groups(content_mac(spark, d).select(F.col("doc_id").alias("id"), "mac", F.col("size").alias("length")))


@query("SELECT DISTINCT sha256(text) AS mac FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def new_blobs_anti(spark, d):
    rows = content_mac(spark, d).select("doc_id", "mac", F.lit(9).alias("type"))
    return catalog.new_blobs(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")).select("mac")


@query("SELECT doc_id, round(coalesce(e, 0), 6) AS entropy FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, -sum(p * log2(p)) AS e FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY doc_id, b) GROUP BY doc_id) USING (doc_id)")
def byte_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(content.byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy"))


@query("SELECT conv_id AS object, sum(strlen(text))::BIGINT AS size, count(*) AS n_chunks, round(sum(turn::DOUBLE * strlen(text)) / sum(strlen(text)), 6) AS entropy FROM conversations GROUP BY conv_id")
def object_totals(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("object"), F.octet_length("text").cast("long").alias("length"), F.col("turn").cast("double").alias("entropy"))
    return content.object_totals(rows).withColumn("entropy", F.round("entropy", 6))


@query("SELECT object, sha256(string_agg(text, '' ORDER BY turn, text)) AS mac FROM (SELECT conv_id AS object, turn, text FROM conversations) GROUP BY object")
def object_reassemble(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("object"), F.col("turn").alias("ordinal"), F.col("text").alias("data"))
    return content.reassembled(rows).select("object", scalars.mac(F.encode("data", "UTF-8")).alias("mac"))


@query("SELECT doc_id, i::INT AS ordinal, (i * 500)::BIGINT AS \"offset\", sha256(substr(text, (i * 500 + 1)::BIGINT, 500)) AS mac FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)")
def fixed_chunks(spark, d):
    rows = content.fixed_chunks(table(spark, d, "documents").select("doc_id", F.col("text").alias("data")), 500)
    return rows.select("doc_id", "ordinal", "offset", scalars.mac(F.encode("chunk", "UTF-8")).alias("mac"))


@query("SELECT doc_id, sha256(text) AS mac, strlen(text)::BIGINT AS size, TRUE AS sizes_fit FROM documents WHERE strlen(text) > 0")
def content_chunks(spark, d):
    """Chunks put together again give the content; all but the last are of an allowed size, and each has its own address."""
    text = F.encode("text", "UTF-8")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("content"))
    chunks = content.content_chunks(rows, 256, 1024, 4096).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("content")), "id")
    part = F.expr("substring(content, cast(offset + 1 as int), cast(length as int))")
    chunks = chunks.select(F.col("id").alias("doc_id"), "ordinal", "length", (F.sha2(part, 256) == F.col("mac")).alias("fits"), F.hex(part).alias("part"))
    whole = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "length", "fits"))).alias("c"))
    sizes = F.expr("forall(c, x -> x.fits AND x.length <= 4096 AND (x.length >= 256 OR x.ordinal = size(c) - 1))")
    data = F.unhex(F.array_join(F.col("c.part"), ""))
    return whole.select("doc_id", F.sha2(data, 256).alias("mac"), F.octet_length(data).cast("long").alias("size"), sizes.alias("sizes_fit"))


def blobs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("packfile"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("long").alias("length"))


_PACK = "p AS (SELECT l_suppkey AS packfile, l_orderkey * 100 + l_linenumber AS seq, l_quantity::BIGINT AS length FROM lineitem), o AS (SELECT *, (coalesce(sum(length) OVER (PARTITION BY packfile ORDER BY seq, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM p)"


@query(f"WITH {_PACK} SELECT packfile, seq, length, \"offset\" FROM o")
def pack_offsets(spark, d):
    return content.pack_offsets(blobs(spark, d))


@query(f"WITH {_PACK}, q AS (SELECT packfile, \"offset\", length FROM o WHERE seq % 3 <> 0), e AS (SELECT *, CASE WHEN lag(\"offset\" + length) OVER w = \"offset\" THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY packfile ORDER BY \"offset\", length)), r AS (SELECT *, sum(new) OVER (PARTITION BY packfile ORDER BY \"offset\", length ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT packfile, min(\"offset\") AS \"offset\", (max(\"offset\" + length) - min(\"offset\"))::BIGINT AS length, count(*) AS blobs FROM r GROUP BY packfile, run")
def range_runs(spark, d):
    return content.runs(content.pack_offsets(blobs(spark, d)).where("seq % 3 <> 0").select("packfile", "offset", "length"))


@query()
def read_plan(spark, d):
    return content.read_plan(content.pack_offsets(blobs(spark, d)).where("seq % 3 <> 0"), 200)


@query()
def pack_bins(spark, d):
    return content.pack_bins(blobs(spark, d).withColumnRenamed("packfile", "channel"), 1000)


@query("SELECT doc_id AS object, CASE WHEN doc_id % 17 = 0 THEN 'chunk missing' WHEN doc_id % 19 = 0 THEN 'chunk corrupted' ELSE 'ok' END AS status FROM documents")
def check_full(spark, d):
    t = table(spark, d, "documents")
    whole = F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.encode("text", "UTF-8"))
    refs = t.select(F.col("doc_id").alias("object"), F.lit(0).alias("ordinal"), F.sha2(whole, 256).alias("mac"))
    changed = F.when(F.col("doc_id") % 19 == 0, F.concat(whole, F.lit(b"!"))).otherwise(whole)
    return content.check_chunks(refs, t.where("doc_id % 17 <> 0").select(F.sha2(whole, 256).alias("mac"), changed.alias("data"))).select("object", "status")


@query("SELECT conv_id AS object, CASE WHEN conv_id % 5 = 0 THEN 'object missing' WHEN max((turn = 3)::INT) = 1 THEN 'object corrupted' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id")
def check_objects(spark, d):
    c = table(spark, d, "conversations")
    checked = c.where("conv_id % 5 <> 0").select(F.col("conv_id").alias("object"), F.when(F.col("turn") == 3, "chunk corrupted").otherwise("ok").alias("status"))
    return content.check_objects(c.select(F.col("conv_id").alias("object")).distinct(), checked).select("object", "status")


# -- catalog ---------------------------------------------------------------------------------------------------------


def log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deltas, packfiles, coloured): line items in suppliers, every seventh of which is unknown and every fifth coloured."""
    li = table(spark, d, "lineitem")
    deltas = li.select(F.when(F.col("l_linenumber") == 1, 5).otherwise(9).alias("type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mac"), F.col("l_suppkey").alias("packfile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("packfile"))
    packs = s.where("packfile % 7 <> 0")
    coloured = s.where("packfile % 5 = 0").select(F.lit(4).alias("type"), F.col("packfile").cast("string").alias("mac")).unionByName(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit(5).alias("type"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("mac")))
    return deltas, packs, coloured


_LIVE = "dl AS (SELECT CASE WHEN l_linenumber = 1 THEN 5 ELSE 9 END AS type, l_orderkey || '-' || l_linenumber AS mac, l_suppkey AS packfile, l_orderkey * 10 + l_linenumber AS \"offset\", l_quantity::BIGINT AS length FROM lineitem)"


@query(f"WITH {_LIVE} SELECT type, mac, packfile FROM dl WHERE packfile IN (SELECT s_suppkey FROM supplier) AND packfile % 7 <> 0 AND packfile % 5 <> 0")
def blob_exists_live(spark, d):
    return catalog.live_deltas(*log(spark, d)).select("type", "mac", "packfile")


@query(f"WITH {_LIVE}, a AS (SELECT DISTINCT type, mac FROM dl WHERE length > 45) SELECT a.type, a.mac, min(x.packfile) AS packfile FROM a LEFT JOIN (SELECT * FROM dl WHERE packfile IN (SELECT s_suppkey FROM supplier) AND packfile % 7 <> 0 AND packfile % 5 <> 0) x ON a.type = x.type AND a.mac = x.mac GROUP BY 1, 2")
def blob_locations(spark, d):
    deltas, packs, coloured = log(spark, d)
    return catalog.locate_blobs(deltas.where("length > 45").select("type", "mac").distinct(), deltas, packs, coloured).select("type", "mac", "packfile")


@query(f"WITH {_LIVE} SELECT mac FROM dl WHERE type = 5 AND packfile IN (SELECT s_suppkey FROM supplier) AND packfile % 7 <> 0 AND mac NOT IN (SELECT o_orderkey || '-1' FROM orders WHERE o_orderstatus = 'P')")
def list_snapshots_live(spark, d):
    return catalog.live_snapshots(*log(spark, d)).select("mac")


@query(f"WITH {_LIVE} SELECT mac, packfile FROM dl WHERE packfile % 7 = 0 OR packfile NOT IN (SELECT s_suppkey FROM supplier)")
def orphan_deltas(spark, d):
    deltas, packs, _ = log(spark, d)
    return catalog.orphans(deltas, packs).select("mac", "packfile")


@query("SELECT o_custkey AS key, max(o_orderdate) AS created_at, max_by(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS value FROM orders GROUP BY o_custkey")
def config_lww(spark, d):
    return catalog.newest_settings(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("value")))


@query("SELECT o_custkey AS serial FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_serial(spark, d):
    return catalog.latest_serial(table(spark, d, "orders").select(F.col("o_orderkey").alias("state_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("serial")))


@query("SELECT c_custkey AS state_id, 'missing' AS side FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, 'outdated' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def state_diff(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("state_id"))
    return catalog.state_diff(c.where("state_id % 2 = 0"), c.where("state_id % 3 = 0"))


@query("WITH RECURSIVE t AS (SELECT c_custkey AS state_id, 0::BIGINT AS level FROM customer WHERE c_custkey // 2 = c_custkey OR c_custkey // 2 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT c.c_custkey, t.level + 1 FROM customer c JOIN t ON c.c_custkey // 2 = t.state_id WHERE c.c_custkey <> t.state_id) SELECT state_id, level FROM t")
def state_topo_order(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("state_id"), F.expr("c_custkey div 2").alias("parent"))
    return catalog.generations(c.withColumn("parent", F.when(F.col("parent") != F.col("state_id"), F.col("parent"))))


@query("SELECT p_partkey AS mac FROM part WHERE p_partkey % 10 <> 0")
def state_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("mac"))
    return catalog.merged(p.where("mac % 2 = 0"), p.where("mac % 2 = 1 OR mac % 4 = 0"), ["mac"], p.where("mac % 10 = 0"))


@query("SELECT s_suppkey AS packfile, count(l_suppkey) AS blobs, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS bytes FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber <= 2 GROUP BY 1")
def packfile_refcount(spark, d):
    deltas, _, _ = log(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("packfile"))
    first = table(spark, d, "lineitem").where("l_linenumber <= 2")
    reach = first.select(F.when(F.col("l_linenumber") == 1, 5).otherwise(9).alias("type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mac")).distinct()
    return catalog.used_packfiles(s, deltas, reach)


@query("SELECT event_id, ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTES AS stale FROM events")
def stale_locks(spark, d):
    return catalog.stale_locks(table(spark, d, "events").select("event_id", "ts"), datetime(2024, 1, 15)).select("event_id", "stale")


# -- telemetry and events --------------------------------------------------------------------------------------------


def spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("scope"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"), (F.pmod(F.col("event_id"), F.lit(40)) * 1_000_000).alias("dt_ns"), F.col("ts").alias("at"))


@query("SELECT event_type AS scope, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def io_percentiles(spark, d):
    s = telemetry.throughput_stats(table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("value").alias("throughput")))
    return s.select("scope", "n", *(F.round(c, 6).alias(c) for c in ("least", "most", "p50", "p95", "p99")))


@query("WITH s AS (SELECT event_type AS scope, floor(value * 1000)::BIGINT AS bytes, (event_id % 40) * 1000000 AS dt, ts FROM events) SELECT scope, sum(bytes)::BIGINT AS bytes, coalesce(sum(dt), 0)::BIGINT AS active_ns, epoch_us(max(ts)) - epoch_us(min(ts)) AS wall_us FROM s WHERE bytes <> 0 GROUP BY scope")
def io_totals(spark, d):
    return telemetry.totals(spans(spark, d).withColumn("at", F.col("at").cast("timestamp")))


@query()
def io_sample_buckets(spark, d):
    return telemetry.samples(spans(spark, d))


@query()
def token_bucket_delay(spark, d):
    e = table(spark, d, "events")
    return telemetry.token_bucket(e.select(F.col("event_type").alias("scope"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"), F.col("value").alias("n")), 0.5, 100.0)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts_1h(spark, d):
    return streams.counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# -- scalars ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, ((p_size << 16) | ((p_partkey % 256) << 8) | (p_partkey % 100))::BIGINT AS packed, p_size || '.' || (p_partkey % 256) || '.' || (p_partkey % 100) AS text FROM part")
def version_pack(spark, d):
    v = scalars.version_pack(F.col("p_size").cast("long"), F.col("p_partkey") % 256, F.col("p_partkey") % 100)
    return table(spark, d, "part").select("p_partkey", v.alias("packed"), scalars.version_format(v).alias("text"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS protocol, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages")
def location_parse(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.location_protocol(F.col("url")).alias("protocol"), scalars.location_rest(F.col("url")).alias("rest"))


@query("SELECT p_partkey, '/a/c' || p_partkey AS path, '/a' AS parent, 'c' || p_partkey AS name FROM part")
def path_clean(spark, d):
    p = paths.clean(F.concat(F.lit("//a/./b/../c"), "p_partkey", F.lit("/x/..//")))
    return table(spark, d, "part").select("p_partkey", p.alias("path"), paths.dirname(p).alias("parent"), paths.basename(p).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'symlink' WHEN 2 THEN 'socket' ELSE 'regular' END AS kind FROM part")
def file_kinds(spark, d):
    k = F.col("p_partkey") % 4
    mode = F.when(k == 0, scalars.MODE_DIRECTORY | 0o755).when(k == 1, scalars.MODE_SYMLINK).when(k == 2, scalars.MODE_SOCKET).otherwise(0o644).cast("long")
    return table(spark, d, "part").select("p_partkey", scalars.file_kind(mode).alias("kind"))


@query("SELECT 'doc' || doc_id || ':/x' AS path, 'doc' || doc_id AS prefix, '/x' AS rest FROM documents")
def snapshot_paths(spark, d):
    p = F.concat(F.lit("doc"), "doc_id", F.lit(":/x"))
    return table(spark, d, "documents").select(p.alias("path"), scalars.snapshot_prefix(p).alias("prefix"), scalars.snapshot_path(p).alias("rest"))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'config' WHEN 2 THEN 'lock' WHEN 4 THEN 'packfile' WHEN 5 THEN 'snapshot' WHEN 9 THEN 'chunk' WHEN 21 THEN 'vfs-summary' END AS name FROM nation WHERE n_nationkey IN (1, 2, 4, 5, 9, 21)")
def resource_names(spark, d):
    return table(spark, d, "nation").where("n_nationkey IN (1, 2, 4, 5, 9, 21)").select("n_nationkey", scalars.resource_name(F.col("n_nationkey")).alias("name"))


# -- codecs, content types, links, checks ----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 9::BIGINT AS type, 65536::BIGINT AS version, sha256(l_orderkey::VARCHAR) AS mac, sha256(l_suppkey::VARCHAR) AS packfile, l_partkey * 4294967296 AS \"offset\", CAST(l_quantity AS BIGINT) AS length, l_linenumber::BIGINT AS flags, 85 AS width FROM lineitem")
def delta_records(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(9).alias("type"), F.lit(65536).alias("version"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("mac"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("packfile"), (F.col("l_partkey") * (1 << 32)).alias("offset"), F.col("l_quantity").alias("length"), F.col("l_linenumber").alias("flags"))
    raw = rows.select("l_orderkey", "l_linenumber", codecs.record(codecs.DELTA).alias("raw"))
    return raw.select("l_orderkey", "l_linenumber", *codecs.fields(F.col("raw"), codecs.DELTA), F.octet_length("raw").alias("width"))


@query("SELECT doc_id, sha256(text) AS mac, octet_length(encode(text))::BIGINT AS size FROM documents")
def compressed_contents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    back = codecs.decoded(codecs.encoded(rows, "data", "ZSTD"), "data", "ZSTD")
    return back.select("doc_id", F.sha2("data", 256).alias("mac"), F.octet_length("data").cast("long").alias("size"))


@query("SELECT conv_id, turn, sha256(text) AS mac FROM conversations")
def encrypted_contents(spark, d):
    key = bytes(range(32))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    back = codecs.decoded(codecs.encoded(rows, "data", "LZ4", key), "data", "LZ4", key)
    return back.select("conv_id", "turn", F.sha2("data", 256).alias("mac"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'text/plain; charset=utf-8' WHEN 3 THEN 'text/css' ELSE 'application/x-not-regular-file' END AS content_type FROM part")
def content_types(spark, d):
    k = F.col("p_partkey") % 5
    name = F.encode("p_name", "UTF-8")
    data = F.when(k == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), name)).when(k == 1, F.concat(F.encode(F.lit("<!DOCTYPE html>"), "UTF-8"), name)).when(k == 3, F.concat(F.unhex(F.lit("00FE")), name)).otherwise(name)
    return table(spark, d, "part").select("p_partkey", mime.sniffed(data, F.lit("site.css"), k != 4).alias("content_type"))


@query("SELECT '/l' || p_partkey || '/f' AS asked, CASE WHEN p_partkey % 3 = 0 THEN '/d' || p_partkey || '/f' ELSE '/d' || p_partkey || '/g' END AS path, p_partkey % 3 <> 2 AS found FROM part")
def links_followed(spark, d):
    key = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 3
    p = table(spark, d, "part")
    top = p.select(F.concat(F.lit("/l"), key).alias("path"), F.lit("/").alias("parent"), F.concat(F.lit("d"), key).alias("target"))
    directory = p.select(F.concat(F.lit("/d"), key).alias("path"), F.lit("/").alias("parent"), F.lit("").alias("target"))
    file = p.select(F.concat(F.lit("/d"), key, F.lit("/f")).alias("path"), F.concat(F.lit("/d"), key).alias("parent"), F.when(k == 0, "").otherwise("g").alias("target"))
    target = p.where(k == 1).select(F.concat(F.lit("/d"), key, F.lit("/g")).alias("path"), F.concat(F.lit("/d"), key).alias("parent"), F.lit("").alias("target"))
    entries = top.unionByName(directory).unionByName(file).unionByName(target)
    return tree.follow_links(entries, p.select(F.concat(F.lit("/l"), key, F.lit("/f")).alias("path")))


@query("SELECT count(*) FILTER (WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P') AS files, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P') AS directories, 0::BIGINT AS symlinks, coalesce(sum(o_custkey) FILTER (WHERE o_orderpriority <> '1-URGENT'), 0)::BIGINT AS size, coalesce(sum(o_custkey) FILTER (WHERE o_orderpriority <> '1-URGENT' AND (o_orderstatus = 'P' OR o_orderkey % 7 > 1)), 0)::BIGINT AS checked_bytes, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AND o_orderkey % 7 < 2) AS errors FROM orders")
def check_counters(spark, d):
    o = table(spark, d, "orders").withColumn("path", F.concat(F.lit("/"), "o_orderkey"))
    entries = o.select("path", F.when(F.col("o_orderstatus") == "P", "directory").otherwise("regular").alias("kind"), F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("object"))
    objects = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("object"), F.when(F.col("o_orderkey") % 7 == 1, "object corrupted").otherwise("ok").alias("status"))
    return content.check_tree(entries, objects, "/", o.where("o_orderpriority = '1-URGENT'").select("path"))[1]


@query("SELECT event_type AS scope, date_trunc('day', ts) AS start, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events WHERE floor(value) <> 0 GROUP BY 1, 2")
def io_daily_samples(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("ts").alias("at"), F.floor("value").alias("bytes"))
    return streams.sampled(e, "1 day").select("scope", F.col("start").cast("timestamp_ntz").alias("start"), "bytes")


def roots(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the roots of orders' sources."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot"), (F.col("l_linenumber") - 1).alias("source"), F.col("l_partkey").cast("long").alias("directory"), F.col("l_suppkey").cast("long").alias("below"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("errors"))


@query("SELECT count(*) AS snapshots, sum(l_partkey + l_suppkey)::BIGINT AS size FROM lineitem WHERE l_linenumber = 1")
def logical_size(spark, d):
    return catalog.logical_size(roots(spark, d))


@query("SELECT l_orderkey AS snapshot, sum(l_partkey + l_suppkey)::BIGINT AS size, count(*) FILTER (WHERE l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1")
def commit_totals(spark, d):
    return catalog.commit_totals(roots(spark, d))


@query(f"WITH {_LIVE} SELECT mac, packfile FROM dl WHERE type = 5 AND packfile IN (SELECT s_suppkey FROM supplier) AND packfile % 7 <> 0")
def objects_of_type(spark, d):
    deltas, packs_, _ = log(spark, d)
    return catalog.blobs_of_type(deltas, packs_, catalog.SNAPSHOT).select("mac", "packfile")


@query("WITH s AS (SELECT l_partkey AS key, CASE WHEN l_suppkey % 3 = 0 THEN 'gone' ELSE 'kept' END AS side, l_suppkey AS state_id, l_orderkey AS value FROM lineitem WHERE l_suppkey % 3 <> 0), g AS (SELECT key, min(state_id) AS state_id FROM s GROUP BY key) SELECT g.key, g.state_id, min(s.value) AS value FROM g JOIN s USING (key, state_id) GROUP BY 1, 2")
def state_rebuilt(spark, d):
    """Suppliers are states without parents, every third of which the remote hasn't; the local log has the even ones."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("state_id")).agg(F.min("l_orderkey").alias("value"))
    states = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("state_id"), F.lit(None).cast("long").alias("parent"))
    return catalog.rebuilt(rows.where("state_id % 2 = 0"), rows.where("state_id % 3 <> 0"), states, ["key"])


@query("WITH n AS (SELECT o_orderkey, o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders) SELECT o_orderkey, o_custkey FROM n WHERE o_custkey <= before")
def order_violations(spark, d):
    rows = locate.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey").asc()], "place")
    return catalog.out_of_order(rows, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT event_type AS scope, date_trunc('hour', ts) AS start, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1, 2")
def throttle_drained(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.col("ts").cast("timestamp").alias("at"), F.floor("value").alias("bytes"))
    return telemetry.drained(e, "1 hour").select("scope", F.col("start").cast("timestamp_ntz").alias("start"), "bytes")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id, user_id FROM l WHERE n = 1 AND event_type = 'purchase' AND ts > TIMESTAMP '2024-01-29 00:00:00'")
def locks_held(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("exclusive"), F.lit(False).alias("released"))
    return catalog.conflicts(e, "", False, datetime(2024, 1, 30), 1440).select("event_id", "user_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part")
def files_sorted(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    keys = locate.sort_keys("-Size,Name", tuple(locate.FILE_KEYS))
    return locate.numbered(rows, locate.ordering(keys, locate.FILE_KEYS, "p_partkey"), "place").select("p_partkey", "place")


def packed_documents(spark, d):
    """Documents in packs of 64."""
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 64).cast("string").alias("packfile"), F.col("doc_id").alias("seq"), F.lit(9).alias("type"), F.lit(65536).alias("version"), F.sha2("text", 256).alias("mac"), F.lit(0).alias("flags"), F.encode("text", "UTF-8").alias("data"))


@query("SELECT CAST(doc_id // 64 AS VARCHAR) AS packfile, sha256(text) AS mac, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", octet_length(encode(text))::BIGINT AS length FROM documents")
def pack_index(spark, d):
    return packs.index_of(packs.built(packed_documents(spark, d), 0)).select("packfile", "mac", "offset", "length")


@query("SELECT DISTINCT sha256(text) AS mac, CASE WHEN doc_id // 64 % 2 = 0 THEN octet_length(encode(text))::BIGINT END AS size, CASE WHEN doc_id // 64 % 2 = 1 THEN 'blob not found' END AS error FROM (SELECT min(doc_id) FILTER (WHERE doc_id // 64 % 2 = 0) AS even, min(doc_id) AS least, text, coalesce(even, least) AS doc_id FROM documents GROUP BY text)")
def packed_blobs(spark, d):
    blobs = packed_documents(spark, d)
    held = packs.built(blobs.where("cast(packfile as long) % 2 = 0"), 0)
    index = packs.index_of(held)
    got = packs.get_blobs(blobs.withColumn("type", F.lit(9).cast("long")), index, held.select("packfile"), spark.createDataFrame([], "type int, mac string"), held)
    return got.select("mac", F.octet_length("data").cast("long").alias("size"), "error")
