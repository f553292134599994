"""File trees: entries by path, children, walks, links, search, exclusion, and per-directory summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import paths, scalars

FILEINFO = ("name", "size", "mode", "mtime", "dev", "ino", "uid", "gid", "nlink", "username", "groupname")


def children(entries: DataFrame, directory: str) -> DataFrame:
    return entries.where((F.col("parent") == directory) & (F.col("path") != "/"))


def walk(entries: DataFrame, top: str = "/", pruned: list[str] | None = None) -> DataFrame:
    """Depth first, a directory before what is in it; nothing below the pruned directories."""
    out = entries.where(paths.is_within(F.col("path"), top))
    for p in pruned or ():
        out = out.where(~F.col("path").startswith(p.rstrip("/") + "/"))
    return out.orderBy(paths.walk_order(F.col("path")))


def by_depth(entries: DataFrame) -> DataFrame:
    """By depth, then by bytes of the path."""
    return entries.orderBy(paths.depth(F.col("path")), "path")


def missing_ancestors(entries: DataFrame) -> DataFrame:
    """path of each directory that entries lie below but that isn't an entry."""
    parents = entries.select("parent").distinct().select(F.explode(F.array_append(paths.ancestors(F.col("parent")), F.col("parent"))).alias("path")).distinct()
    return parents.join(entries.select("path"), "path", "left_anti")


def relinked(entries: DataFrame) -> DataFrame:
    """entries, and a directory with mode 0750 and a time of 0 for each one that is missing above them."""
    none = {f.name: F.lit(None).cast(f.dataType) for f in entries.schema.fields}
    path = F.col("path")
    made = {"path": path, "parent": F.when(path == "/", "").otherwise(paths.dirname(path)), "name": paths.basename(path), "kind": F.lit("directory"), "mode": F.lit(scalars.MODE_DIRECTORY | 0o750), "mtime": F.lit(0), "size": F.lit(0)}
    dirs = missing_ancestors(entries).select(*(made.get(c, x).cast(entries.schema[c].dataType).alias(c) for c, x in none.items()))
    return entries.unionByName(dirs)


def resolve_links(entries: DataFrame) -> DataFrame:
    """Symbolic links with the entry that they point to, one step."""
    target = F.when(F.col("target").startswith("/"), paths.clean(F.col("target"))).otherwise(paths.clean(F.concat_ws("/", F.col("parent"), F.col("target"))))
    links = entries.where(F.col("target") != "").select(F.col("path").alias("link"), target.alias("path"))
    return links.join(entries, "path", "left")


def follow_links(entries: DataFrame, asked: DataFrame, most: int = 40) -> DataFrame:
    """asked (path) -> asked, path, found: where each path leads when links above it, and then itself, are followed.

    Each round replaces the topmost link above a path by its target, one join for all paths; paths that still have one
    after `most` rounds go round in circles and aren't found.
    """
    spark = entries.sparkSession
    full = F.when(F.col("target").startswith("/"), paths.clean(F.col("target"))).otherwise(paths.clean(F.concat_ws("/", F.col("parent"), F.col("target"))))
    links = entries.where("target <> ''").select(F.col("path").alias("above"), full.alias("to")).persist()
    now = asked.select(F.col("path").alias("asked"), paths.clean(F.col("path")).alias("path")).distinct()
    for _ in range(most):
        met = now.select("asked", "path", F.explode(paths.ancestors(F.col("path"))).alias("above")).join(links, "above")
        top = met.groupBy("asked").agg(F.min_by(F.struct("above", "to"), F.length("above")).alias("link"))
        top = top.checkpoint() if spark.sparkContext.getCheckpointDir() else top.persist()
        if top.isEmpty():
            break
        step = paths.clean(F.concat("link.to", F.expr("substring(path, length(link.above) + 1)")))
        now = now.join(top, "asked", "left").select("asked", F.coalesce(step, "path").alias("path"))
        now = now.checkpoint() if spark.sparkContext.getCheckpointDir() else now.persist()
    last = now.join(links, now.path == links.above, "left").select("asked", F.coalesce("to", "path").alias("path"))
    return last.join(entries.select("path", F.lit(True).alias("found")), "path", "left").select("asked", "path", F.coalesce("found", F.lit(False)).alias("found"))


def not_below_links(entries: DataFrame) -> DataFrame:
    """Entries with no symbolic link among their ancestors."""
    links = entries.where(F.col("target") != "").select(F.col("path").alias("a"))
    below = entries.select("path", F.explode(paths.ancestors(F.col("path"))).alias("a")).join(links, "a", "left_semi").select("path").distinct()
    return entries.join(below, "path", "left_anti")


def mime_matches(content_type: Column, asked: list[str], exact: bool = False) -> Column:
    """Any of the asked types; only the part before the slash counts unless `exact`."""
    if not asked:
        return F.lit(True)
    if exact:
        return F.lit(False) if not asked else F.array_contains(F.transform(F.array(*map(F.lit, asked)), lambda t: F.concat(F.lit("/"), content_type, F.lit("/")).startswith(F.concat(F.lit("/"), t, F.lit("/")))), True)
    return scalars.mime_major(content_type).isin([t.split("/")[0] for t in asked])


def name_matches(name: Column, pattern: str, regex: bool = True) -> Column:
    """Equal, or fits as a shell pattern, or (where `regex`) as an unanchored regular expression; a bad pattern fits nothing."""
    out = name == pattern
    if (glob := paths.glob_to_regex(pattern)) is not None:
        out = out | name.rlike(glob)
    if regex:
        try:
            re.compile(pattern)
            out = out | name.rlike(pattern)
        except re.error:
            pass
    return out


ORDERS = {"walk": lambda: (paths.walk_order(F.col("path")),), "breadth": lambda: (paths.depth(F.col("path")), F.col("path")), "path": lambda: (F.col("path"),), "none": lambda: ()}


def search(entries: DataFrame, prefix: str = "", name: str = "", mimes: list[str] | None = None, files_only: bool = True, exact_mime: bool = False, offset: int = 0, limit: int = 0, recursive: bool = True, order: str = "walk", indexed: bool = False) -> DataFrame:
    """A page of the entries below a prefix, by default in walk order; directories go before offset and limit count.

    Not `recursive`: what lies directly in the prefix. order: walk (depth first), breadth, path or none. `indexed`: entries
    are found by content type, as an index from types to paths has them: types are whole or have a whole beginning, results
    come in order of asked type, found type and path, an entry once for each asked type that it fits. An index is asked only
    if the search is recursive and asks for types; otherwise entries are walked, and the part before the slash counts.
    """
    out = entries
    if prefix:
        out = out.where(F.col("path").startswith(prefix.rstrip("/") + "/"))
    if not recursive:
        out = out.where((F.col("parent") == (prefix.rstrip("/") or "/")) & (F.col("path") != "/"))
    if files_only:
        out = out.where(F.col("kind") != "directory")
    indexed = indexed and recursive and bool(mimes)
    if name:
        out = out.where(name_matches(F.col("name"), name, regex=not (exact_mime or indexed)))
    if indexed:
        asked = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(m).alias("mime")) for i, m in enumerate(mimes)))
        key = F.concat(F.lit("/"), "content_type", F.lit("/"))
        out = out.withColumn("_asked", F.explode(F.filter(asked, lambda x: key.startswith(F.concat(F.lit("/"), F.rtrim(x["mime"], F.lit("/")), F.lit("/"))))))
        out = out.orderBy("_asked.n", scalars.content_type_key(F.col("content_type"), F.col("path"))).drop("_asked")
    else:
        if mimes:
            out = out.where(mime_matches(F.col("content_type"), mimes, exact_mime))
        if by := ORDERS[order]():
            out = out.orderBy(*by)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def pathnames(entries: DataFrame) -> DataFrame:
    return entries.select("path").orderBy("path")


def file_macs(entries: DataFrame) -> DataFrame:
    """The address of every entry that has one, once each."""
    return entries.where("mac IS NOT NULL").select("mac").distinct()


def listing(entries: DataFrame, directory: str = "", descending: bool = False) -> DataFrame:
    """Entries, or those directly in a directory, by path, either way."""
    out = children(entries, directory) if directory else entries
    return out.orderBy(F.col("path").desc() if descending else F.col("path"))


def with_sorted_xattrs(entries: DataFrame, column: str = "xattrs") -> DataFrame:
    """Names of attributes in ascending order; none for null."""
    return entries.withColumn(column, F.sort_array(F.coalesce(column, F.array().cast("array<string>"))))


def normalised(entries: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Null lists as empty ones, as entries are shown."""
    return entries.withColumns({c: F.coalesce(c, F.array().cast(entries.schema[c].dataType)) for c in lists})


def without_store(entries: DataFrame, store_root: str, importer: str) -> DataFrame:
    """Entries without the store's own files, which only importers of local files could meet."""
    return entries.where(~paths.is_within(F.col("path"), store_root)) if importer in ("fs", "ptar") else entries


def source_root(root: str, is_directory: bool) -> str:
    """Where a source begins: of a single file, the directory that it is in."""
    if is_directory:
        return root
    return root.rpartition("/")[0] or "/"


# -- exclusion -------------------------------------------------------------------------------------------------------


def load_rules(text: str) -> list[str]:
    """Lines of an ignore file without comments, blank lines and trailing blanks that aren't escaped."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("#") or not line.strip():
            continue
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        out.append(line)
    return out


def rule_regex(rule: str) -> tuple[bool, bool, str]:
    """(negated, directories only, regular expression on the path without its leading slash)."""
    negated = rule.startswith("!")
    body = rule[1:] if negated else rule
    body = body[1:] if body.startswith(("\\#", "\\!")) else body
    only_dirs = body.endswith("/")
    body = body.rstrip("/") if only_dirs else body
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return negated, only_dirs, ("^" if anchored else "^(?:.*/)?") + out


def excluded(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits a path, or a directory above it, excludes it. The root never is."""
    bare = F.regexp_replace(path, "^/", "")
    out = F.lit(False)
    for negated, only_dirs, regex in map(rule_regex, rules):
        fits = bare.rlike(regex + "/") | (bare.rlike(regex + "$") & (is_dir if only_dirs else F.lit(True)))
        out = F.when(fits, F.lit(not negated)).otherwise(out)
    return F.when(path.isin("/", ""), False).otherwise(out)


# -- summaries -------------------------------------------------------------------------------------------------------

LOW, HIGH = 2.0, 7.0
#: Counts and sums of a summary, and what it has the least and the most of.
KINDS = {"files": None, "directories": "directory", "symlinks": "symlink", "devices": "device", "pipes": "pipe", "sockets": "socket"}
BITS = {"setuid": scalars.MODE_SETUID, "setgid": scalars.MODE_SETGID, "sticky": scalars.MODE_STICKY}
MIMES = ("text", "image", "audio", "video", "application")
SUMS = (*KINDS, "children", *BITS, "objects", "chunks", "size", "low_entropy", "high_entropy", *(f"mime_{m}" for m in MIMES), "mime_other")
EXTREMES = ("size", "mtime", "entropy")


def folded_min(rows: Column) -> Column:
    """Minimum of an ordered array in which 0 stands for unset and starts the minimum anew."""
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: F.when((a == 0) | (x < a), x).otherwise(a))


def folded_mins(rows: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """key and, for each of `values`, min_<value>: what folded_min() gives for a key's rows in their order.

    That is the least value after the last 0, or 0 if there is none after it: two aggregates that combine before their
    shuffles, so no key's rows have to be in one place.
    """
    last = rows.groupBy(key).agg(*(F.max(F.when(F.col(v) == 0, F.col(order))).alias(f"_{v}") for v in values))
    after = lambda v: F.when(F.col(f"_{v}").isNull() | (F.col(order) > F.col(f"_{v}")), F.col(v))
    return rows.join(last, key).groupBy(key).agg(*(F.coalesce(F.min(after(v)), F.lit(0).cast(rows.schema[v].dataType)).alias(f"min_{v}") for v in values))


def directory_summary(entries: DataFrame) -> DataFrame:
    """Counts and extremes of what lies directly in each directory.

    entries: path, parent, kind, size, mtime, entropy, content_type, n_chunks, and mode if there is one. Directories count
    as children only; the other figures are of everything else, links and devices too. The least ones are folds in path
    order in which 0 starts anew.
    """
    entries = entries.where("path <> '/'")
    if "mode" not in entries.columns:
        entries = entries.withColumn("mode", F.lit(0).cast("long"))
    kind, other = F.col("kind"), F.col("kind") != "directory"
    known = [k for k in KINDS.values() if k]
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    has = F.coalesce("content_type", F.lit("")) != ""
    is_mime = {m: F.col("content_type").startswith(f"{m}/") for m in MIMES}
    any_mime = F.coalesce(reduce(lambda a, b: a | b, is_mime.values()), F.lit(False))
    total = lambda c, kind: F.coalesce(F.sum(F.when(other, F.col(c))), F.lit(0).cast(kind))
    sums = entries.groupBy("parent").agg(
        *(n(~kind.isin(known) if k is None else kind == k).alias(name) for name, k in KINDS.items()),
        F.count("*").alias("children"),
        *(n(other & scalars.has_mode(F.col("mode").cast("long"), bit)).alias(name) for name, bit in BITS.items()),
        n(other & (F.col("n_chunks") > 0)).alias("objects"), total("n_chunks", "long").alias("chunks"), total("size", "long").alias("size"),
        n(other & (F.col("entropy") <= LOW)).alias("low_entropy"), n(other & (F.col("entropy") >= HIGH)).alias("high_entropy"), total("entropy", "double").alias("sum_entropy"),
        *(n(other & is_mime[m]).alias(f"mime_{m}") for m in MIMES), n(other & has & ~any_mime).alias("mime_other"),
        *(F.max(F.when(other, F.coalesce(c, F.lit(0)))).alias(f"max_{c}") for c in EXTREMES),
    )
    least = folded_mins(entries.where(other).select("parent", "path", *(F.coalesce(c, F.lit(0)).alias(c) for c in EXTREMES)), "parent", "path", EXTREMES)
    out = sums.join(least, "parent", "left")
    return out.fillna(0, [f"{m}_{c}" for m in ("min", "max") for c in EXTREMES])


def with_averages(summary: DataFrame) -> DataFrame:
    """avg_size: whole bytes by regular files; avg_entropy; 0 without files."""
    return summary.withColumns({"avg_size": F.when(F.col("files") > 0, F.expr("size div files")).otherwise(0), "avg_entropy": F.when(F.col("files") > 0, F.col("sum_entropy") / F.col("files")).otherwise(0.0)})


def below(summary: DataFrame) -> DataFrame:
    """The sums of all directories below each directory; directories are summed up before their ancestors are listed."""
    up = summary.select(F.explode(paths.ancestors(F.col("parent"))).alias("directory"), *SUMS, *(f"max_{c}" for c in EXTREMES))
    return up.groupBy("directory").agg(*(F.sum(c).alias(c) for c in SUMS), *(F.max(f"max_{c}").alias(f"max_{c}") for c in EXTREMES))


def below_mins(summary: DataFrame) -> DataFrame:
    """directory, min_<value> of what is below it: a fold over its subdirectories in path order, each giving first the least
    below it and then its own; 0 starts anew. From the deepest directories up, a join and a fold for each level."""
    mins = [f"min_{c}" for c in EXTREMES]
    tree = summary.select(F.col("parent").alias("path"), *mins).where("path <> '/'").withColumn("depth", paths.depth(F.col("path")))
    tree = _kept(tree)
    found, deepest = None, tree.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        level = tree.where(F.col("depth") == depth).select("path", *mins)
        under = level.select("path", *(F.lit(0).cast(level.schema[m].dataType).alias(m) for m in mins))
        if found is not None:
            under = under.select("path").join(found, "path", "left").fillna(0, mins)
        both = under.withColumn("n", F.lit(0)).unionByName(level.withColumn("n", F.lit(1))).select(paths.dirname(F.col("path")).alias("up"), F.struct("path", "n").alias("order"), *(F.col(m).alias(m[4:]) for m in mins))
        here = folded_mins(both, "up", "order", EXTREMES).withColumnRenamed("up", "path")
        found = _kept(here if found is None else found.unionByName(here))
    return (found if found is not None else tree.select("path", *mins).limit(0)).withColumnRenamed("path", "directory")


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def summaries(entries: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A row for each directory: path, what is directly in it, as `directory`, and below it, as `below`; two structs.

    entries: as for directory_summary, directories included. errors (parent): count at any depth, and only in `below`.
    """
    places = entries.where("kind = 'directory'").select("path").distinct()
    missing = {c: 0 for c in (*SUMS, "sum_entropy", *(f"{m}_{c}" for m in ("min", "max") for c in EXTREMES), "avg_size", "avg_entropy")}
    own = places.join(directory_summary(entries).withColumnRenamed("parent", "path"), "path", "left").fillna(0)
    own = _kept(own)
    summary = own.withColumnRenamed("path", "parent")
    under = below(summary).join(below_mins(summary), "directory", "left")
    if errors is None:
        counted = own.select(F.col("path").alias("directory"), F.lit(0).cast("long").alias("errors"))
    else:
        per = errors_by_parent(errors)
        counted = per.select(F.explode(F.array_append(paths.ancestors(F.col("parent")), F.col("parent"))).alias("directory"), "errors").groupBy("directory").agg(F.sum("errors").alias("errors"))
    under = own.select(F.col("path").alias("directory")).join(under, "directory", "left").join(counted, "directory", "left").fillna(0)
    own, names = with_averages(own), [c for c in missing if c not in ("sum_entropy", "avg_size", "avg_entropy")]
    under = under.select(F.col("directory").alias("path"), F.struct(*names, "errors").alias("below"))
    return own.select("path", F.struct(*missing).alias("directory")).join(under, "path")


def errors_beneath(errors: DataFrame, top: str = "/") -> DataFrame:
    """errors (path, error) at or below a directory, by path."""
    return errors.where(paths.is_within(F.col("path"), top)).orderBy("path")


def errors_by_parent(errors: DataFrame) -> DataFrame:
    return errors.groupBy("parent").agg(F.count("*").alias("errors"))


def scan_stats(entries: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return entries.agg(F.count_if(kind == "regular").alias("files"), F.count_if(kind == "directory").alias("directories"), F.count_if(kind == "symlink").alias("links"), F.coalesce(F.sum(F.when(kind == "regular", F.col("size"))), F.lit(0)).alias("size"))


def common_prefix(rows: DataFrame, path: str = "path") -> DataFrame:
    """The deepest directory that all paths are in or equal to. A prefix counts if every path has it."""
    tops = F.array_append(paths.ancestors(F.col(path)), F.col(path))
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(F.explode(tops).alias("top")).groupBy("top").count().join(F.broadcast(total), F.col("count") == F.col("total")).agg(F.coalesce(F.max_by("top", paths.depth(F.col("top"))), F.lit("/")).alias("prefix"))


def shadowed_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie below another root of the same origin."""
    up = roots.select("origin", "root", F.explode(paths.ancestors(F.col("root"))).alias("above"))
    return up.join(roots.select("origin", F.col("root").alias("above")).distinct(), ["origin", "above"], "left_semi").select("origin", "root").distinct()


def unchanged(records: DataFrame, previous: DataFrame) -> DataFrame:
    """records with `cached`: the previous entry of the path has equal file information; a size of -1 fits any."""
    old = previous.select("path", F.struct(*FILEINFO).alias("old"))
    same = F.lit(True)
    for c in FILEINFO:
        same = same & (F.col(c).eqNullSafe(F.col(f"old.{c}")) | ((F.col("size") == -1) if c == "size" else F.lit(False)))
    return records.join(old, "path", "left").withColumn("cached", F.col("old").isNotNull() & same).drop("old")


def replay(entries: DataFrame, xattrs: DataFrame, errors: DataFrame) -> DataFrame:
    """A snapshot's records as an importer gives them: errors, then attributes, then entries."""
    stage = lambda df, n: df.withColumn("stage", F.lit(n))
    return stage(errors, 0).unionByName(stage(xattrs, 1), True).unionByName(stage(entries, 2), True)


def exported(entries: DataFrame, top: str) -> DataFrame:
    """Entries of a subtree with paths from its top. A single file comes with its name only, below a directory made for it."""
    within = not_below_links(entries).where(paths.is_within(F.col("path"), top))
    one = entries.where((F.col("path") == top) & (F.col("kind") != "directory")) if "kind" in entries.columns and top != "/" else None
    if one is not None and not one.isEmpty():
        strip, none = top.rpartition("/")[0], {f.name: F.lit(None).cast(f.dataType) for f in entries.schema.fields}
        root = within.limit(1).select(*((F.lit("/") if c == "path" else F.lit("directory") if c == "kind" else x).cast(entries.schema[c].dataType).alias(c) for c, x in none.items()))
        within = within.unionByName(root.withColumn("path", F.lit(f"{strip}/")))
    else:
        strip = top.rstrip("/")
    rest = F.substring(F.col("path"), len(strip) + 1, 1 << 30)
    return within.withColumn("path", F.when(rest == "", "/").otherwise(rest))
