"""Which snapshots match, and which of them a retention policy keeps, with reasons."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Rules are tried in this order; the first of those with the best rank gives the reason.
PERIODS = ("minute", "hour", "day", *WEEKDAYS, "week", "month", "year")
FANNED = {"data_class": "data_classes", "tag": "tags", "origin": "origins", "type": "types", "root": "roots"}


@dataclass
class Filters:
    """Conditions that all have to hold; what is empty asks for nothing."""

    ids: list[str] = field(default_factory=list)
    before: datetime | None = None
    since: datetime | None = None
    name: str = ""
    category: str = ""
    environment: str = ""
    perimeter: str = ""
    job: str = ""
    dataset: str = ""
    tags: list[str] = field(default_factory=list)
    ignore_tags: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)
    roots: list[str] = field(default_factory=list)
    data_classes: list[str] = field(default_factory=list)
    latest: bool = False

    def condition(self) -> Column:
        words = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        conds = [F.lit(True)]
        if self.ids:
            conds.append(reduce(lambda a, b: a | b, [F.col("item_id").startswith(p) for p in self.ids]))
        if self.before is not None:
            conds.append(F.col("ts") <= F.lit(self.before))
        if self.since is not None:
            conds.append(F.col("ts") >= F.lit(self.since))
        conds += [F.col(c) == getattr(self, c) for c in ("name", "category", "environment", "perimeter", "job", "dataset") if getattr(self, c)]
        conds += [F.arrays_overlap(c, words(getattr(self, c))) for c in ("types", "origins", "data_classes") if getattr(self, c)]
        if self.roots:
            conds.append(F.size(F.array_except(words(self.roots), "roots")) == 0)
        if asked := [t for t in self.tags if t]:
            conds.append(F.size(F.array_except(words(asked), "tags")) == 0)
        if self.ignore_tags:
            conds.append(F.lit(False) if "" in self.ignore_tags else ~F.arrays_overlap("tags", words(self.ignore_tags)))
        return reduce(lambda a, b: a & b, conds)

    @property
    def empty(self) -> bool:
        """Types, origins and tags to ignore don't count."""
        return not any(v for k, v in vars(self).items() if k not in ("types", "origins", "ignore_tags"))


def parse_tags(texts: list[str]) -> tuple[list[str], list[str]]:
    """Comma lists of tags -> (asked, ignored); `!tag` is to be ignored."""
    words = [w.strip() for t in texts for w in t.split(",") if w.strip()]
    return [w for w in words if not w.startswith("!")], [w[1:] for w in words if w.startswith("!")]


def matching(items: DataFrame, filters: Filters) -> DataFrame:
    """Items that match, newest first; of those, the newest only if `latest` is set. Equal times go by id."""
    out = items.where(filters.condition()).orderBy(F.col("ts").desc(), "item_id")
    return out.limit(1) if filters.latest else out


def bucket_key(period: str, ts: Column) -> Column:
    formats = {"minute": "yyyy-MM-dd-HH:mm", "hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    if period in formats:
        return F.date_format(ts, formats[period])
    week = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return week if period == "week" else F.concat(week, F.lit("-"), F.lower(F.date_format(ts, "EEEE")))


def bucket_start(period: str, ts: Column) -> Column:
    if period in WEEKDAYS:
        return F.date_trunc("week", ts) + F.expr(f"INTERVAL {WEEKDAYS.index(period)} DAYS")
    return F.date_trunc(period, ts)


def last_keys(period: str, now: datetime, n: int) -> list[str]:
    """Keys of the last n buckets, that of now first."""
    now = now.astimezone(timezone.utc) if now.tzinfo else now
    at = now.replace(second=0, microsecond=0)
    if period not in ("minute",):
        at = at.replace(minute=0)
    if period not in ("minute", "hour"):
        at = at.replace(hour=0)
    if period in WEEKDAYS or period == "week":
        at -= timedelta(days=at.weekday() - (WEEKDAYS.index(period) if period in WEEKDAYS else 0))
        if at > now:
            at -= timedelta(days=7)
    elif period in ("month", "year"):
        at = at.replace(day=1, **({"month": 1} if period == "year" else {}))
    out = []
    for _ in range(n):
        year, week, _ = at.isocalendar()
        out.append({"minute": f"{at:%Y-%m-%d-%H:%M}", "hour": f"{at:%Y-%m-%d-%H}", "day": f"{at:%Y-%m-%d}", "month": f"{at:%Y-%m}", "year": f"{at:%Y}", "week": f"{year:04d}-W{week:02d}"}.get(period, f"{year:04d}-W{week:02d}-{period}"))
        if period == "month":
            at = (at - timedelta(days=1)).replace(day=1)
        elif period == "year":
            at = at.replace(year=at.year - 1)
        else:
            at -= timedelta(minutes=1) if period == "minute" else timedelta(hours=1) if period == "hour" else timedelta(days=1) if period == "day" else timedelta(days=7)
    return out


def fanned(items: DataFrame, group_by: str | None) -> DataFrame:
    """A row for each item and group: of a list column, one for each value, or "" if there is none."""
    if group_by in FANNED:
        values = F.col(FANNED[group_by])
        return items.withColumn("grp", F.explode(F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(F.array_distinct(values))))
    known = group_by in ("name", "category", "environment", "perimeter", "job", "dataset")
    return items.withColumn("grp", F.coalesce(F.col(group_by).cast("string"), F.lit("")) if known else F.lit(""))


def retain(items: DataFrame, rules: list[tuple[str, int, int]], now: datetime, group_by: str | None = None) -> DataFrame:
    """item_id, action, rule, bucket, rank, cap, note of every item (item_id, ts, group columns).

    rules: (period, keep, cap). keep: only the last so many buckets; cap: only so many of the newest in a bucket; 0: no
    limit. An item is kept if a rule of one of its groups keeps it.
    """
    rules = sorted((r for r in rules if r[1] or r[2]), key=lambda r: PERIODS.index(r[0]))
    if not rules:
        return items.select("item_id", F.lit("keep").alias("action"), F.lit("").alias("rule"), F.lit("").alias("bucket"), F.lit(0).alias("rank"), F.lit(0).alias("cap"), F.lit("matched filters").alias("note"))
    ts, tried = F.col("ts"), []
    for i, (period, keep, cap) in enumerate(rules):
        key = bucket_key(period, ts)
        inside = key.isin(last_keys(period, now, keep)) if keep else F.weekday(ts) == WEEKDAYS.index(period) if period in WEEKDAYS else F.lit(True)
        tried.append(F.when(inside, F.struct(F.lit(i).alias("ord"), F.lit(period).alias("rule"), key.alias("bucket"), F.lit(cap).alias("cap"))))
    rows = fanned(items, group_by).select("item_id", "ts", "grp", F.explode_outer(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("r"))
    w = Window.partitionBy("grp", "r.ord", "r.bucket").orderBy(F.col("ts").desc(), "item_id")
    ranked = rows.where("r IS NOT NULL").select("item_id", "grp", "r.*", F.row_number().over(w).alias("rank"))
    # one struct orders keep before delete, then rank, then rule; min() combines before the shuffle
    verdict = F.struct(F.when((F.col("cap") == 0) | (F.col("rank") <= F.col("cap")), 0).otherwise(1).alias("drop"), "rank", "ord", "grp", "rule", "bucket", "cap")
    none = rows.where("r IS NULL").select("item_id", F.lit(None).cast("struct<drop:int,rank:int,ord:int,grp:string,rule:string,bucket:string,cap:int>").alias("v"))
    all_ = ranked.select("item_id", verdict.alias("v")).unionByName(none).groupBy("item_id").agg(F.min("v").alias("v"))
    return all_.select(
        "item_id", F.when(F.col("v.drop") == 0, "keep").otherwise("delete").alias("action"), F.coalesce("v.rule", F.lit("")).alias("rule"), F.coalesce("v.bucket", F.lit("")).alias("bucket"), F.coalesce("v.rank", F.lit(0)).alias("rank"), F.coalesce("v.cap", F.lit(0)).alias("cap"),
        F.when(F.col("v").isNull(), "outside retention windows").when(F.col("v.drop") == 0, "within bucket").otherwise("exceeds per-bucket cap").alias("note"),
    )


#: Columns that headers may be sorted by.
HEADER_KEYS = ("Timestamp", "Identifier", "Version", "Tags")
#: Keys that files may be sorted by, and their columns; fixed values.
FILE_KEYS = {"Name": "name", "Size": "size", "Mode": "mode", "ModTime": "mtime", "Dev": "dev", "Ino": "ino", "Uid": "uid", "Gid": "gid", "Nlink": "nlink", "Username": "username", "Groupname": "groupname"}


def sort_keys(text: str, allowed: tuple[str, ...] = HEADER_KEYS) -> list[tuple[str, bool]]:
    """`Name,-Size` -> (key, descending); unknown and repeated keys are errors."""
    out: list[tuple[str, bool]] = []
    for word in (w.strip() for w in text.split(",")):
        key = word.removeprefix("-")
        if key not in allowed or key in (k for k, _ in out):
            raise ValueError(f"invalid sort key: {word!r}")
        out.append((key, word.startswith("-")))
    return out


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place in an order, from 1: ranges of the order are sorted and counted by themselves, and a range's
    number of rows before it is added, so no task sees all rows."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # what is counted has to be what is numbered: ranges are drawn anew when they are computed again
    ranges = ranges.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else ranges.persist()
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranges.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside + 1).drop("_id", "_part", "_before")


def ordering(keys: list[tuple[str, bool]], columns: dict[str, str], tie: str) -> list[Column]:
    return [*(F.col(columns[k]).desc() if down else F.col(columns[k]).asc() for k, down in keys), F.col(tie).asc()]


def sort_by(rows: DataFrame, keys: list[tuple[str, bool]], columns: dict[str, str], tie: str) -> DataFrame:
    return rows.orderBy(*ordering(keys, columns, tie))


def sort_files(files: DataFrame, keys: str, tie: str = "path") -> DataFrame:
    """files in the order of `Name,-Size`; all eleven keys sort, modes, times and link counts too."""
    return sort_by(files, sort_keys(keys, tuple(FILE_KEYS)), FILE_KEYS, tie)


# -- snapshots of a store --------------------------------------------------------------------------------------------


def items_of(headers: DataFrame) -> DataFrame:
    """Headers (item_id, ts, sources: array of origin, type, root, and the columns of Filters) as what filters and policies see."""
    of = lambda c: F.transform(F.coalesce("sources", F.array()), lambda s: s[c])
    return headers.withColumns({"types": of("type"), "origins": of("origin"), "roots": of("root")})


def match(items: DataFrame, filters: Filters, rules: list[tuple[str, int, int]], now: datetime, group_by: str | None = None) -> DataFrame:
    """Filters, then the newest only if asked for, then the policy: a verdict for each item that matches."""
    return retain(matching(items, filters), rules, now, group_by)


def located(items: DataFrame, filters: Filters, rules: list[tuple[str, int, int]], now: datetime, group_by: str | None = None) -> DataFrame:
    """item_id and ts of the items that match and are kept, newest first."""
    kept = match(items, filters, rules, now, group_by).where("action = 'keep'").select("item_id")
    return matching(items, filters).join(kept, "item_id", "left_semi").select("item_id", "ts").orderBy(F.col("ts").desc(), "item_id")


def with_prefix(items: DataFrame, prefix: str) -> DataFrame:
    return items.where(F.col("item_id").startswith(prefix))


def snapshot_of(items: DataFrame, prefix: str) -> str:
    """The id of the only snapshot with that prefix; an error if there is none or there are several."""
    found = with_prefix(items, prefix).agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).first()
    if not found.n:
        raise LookupError(f"no snapshot has the prefix {prefix!r}")
    if found.n > 1:
        raise LookupError(f"{found.n} snapshots have the prefix {prefix!r}")
    return found.item_id


def prefixes_resolved(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked (prefix) with how many snapshots have it, n, and the id if it is one: snapshot_of() for many at once. Prefixes of
    a length meet ids cut to that length, so each is an equality join."""
    lengths = [r.n for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as an id has characters, at most
    cut = items.select("item_id", F.explode(F.array(*(F.substring("item_id", 1, n) for n in lengths)) if lengths else F.array().cast("array<string>")).alias("prefix")).distinct()
    found = cut.groupBy("prefix").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    out = asked.select("prefix").distinct().join(found, "prefix", "left")
    return out.select("prefix", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n") == 1, F.col("item_id")).alias("item_id"))


def opened_path(items: DataFrame, text: str) -> tuple[str, str, str]:
    """`prefix:path` -> (id, absolute path, path as it was given relative to the first source's root; "" if absolute)."""
    prefix, _, path = ("", "", text) if text.startswith("/") else text.partition(":")
    item_id = snapshot_of(items, prefix)
    if path.startswith("/"):
        return item_id, posixpath.normpath(path), ""
    root = items.where(F.col("item_id") == item_id).select(F.get("roots", F.lit(0)).alias("root")).first().root or "/"
    return item_id, posixpath.normpath(posixpath.join(root, path)), path or "."
