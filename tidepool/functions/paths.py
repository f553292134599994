"""Slash-separated paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """The shortest equal path: no empty parts, no ".", ".." resolved; "" gives "."."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.array_append(done, ".."))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    tail = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), tail)).when(tail == "", ".").otherwise(tail)


def dirname(path: Column) -> Column:
    """What is before the last slash of a clean path; "/" at the root."""
    head = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(head == "", "/").otherwise(head)


def basename(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.substring_index(path, "/", -1))


def join(*parts: Column) -> Column:
    return clean(F.concat_ws("/", *(F.when(p != "", p) for p in parts)))


def depth(path: Column) -> Column:
    """Slashes in a clean absolute path; 0 for the root."""
    return F.when(path == "/", 0).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))


def ancestors(path: Column) -> Column:
    """All directories above a clean absolute path, the root first."""
    parts = F.split(path, "/")
    deeper = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("/")), deeper))


def is_within(path: Column, top: str) -> Column:
    """Equal to a directory or below it."""
    return (path == top) | path.startswith("/" if top == "/" else top.rstrip("/") + "/")


def walk_order(path: Column) -> Column:
    """Sorts directories before what is in them and siblings by name."""
    return F.split(F.when(path == "/", "").otherwise(path), "/")


def glob_to_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern whose * and ? stop at slashes; null if the pattern is malformed."""
    out, i, special = ["^"], 0, set(".^$+{}()|\\[]*?")
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                return None
            out.append("\\" + pattern[i] if pattern[i] in special else pattern[i])
            i += 1
        elif c == "[":
            negated = i < len(pattern) and pattern[i] == "^"
            i += negated
            start, members = i, []
            while i < len(pattern) and (pattern[i] != "]" or i == start):
                if pattern[i] == "\\":
                    i += 1
                    if i == len(pattern):
                        return None
                members.append(pattern[i] if pattern[i] == "-" else "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
                i += 1
            if i >= len(pattern) or not members:
                return None
            i += 1
            out.append("[" + ("^/" if negated else "") + "".join(members) + "]")
        else:
            out.append("\\" + c if c in special else c)
    return "".join(out) + "$"
