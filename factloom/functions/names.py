"""Names, paths, routes and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    """The last part after dots and slashes; a source extension is dropped first."""
    return F.regexp_extract(F.regexp_replace(name, r"\.(go|py|ts|js|rb|java|kt|rs|cs|php|swift|dart|scala)$", ""), r"([^./]*)$", 1)


def owner_name(name: Column) -> Column:
    """What stands before the last ``#``, else before the last dot; null without either."""
    by_hash = F.regexp_extract(name, r"^(.*)#[^#]*$", 1)
    by_dot = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    return F.when(F.contains(name, F.lit("#")), by_hash).when(F.contains(name, F.lit(".")), by_dot)


def has_suffix(name: Column, term: Column) -> Column:
    """Whether a term is the name's qualified suffix: after a dot, slash or hash."""
    low, t = F.lower(name), F.lower(term)
    return F.endswith(low, F.concat(F.lit("."), t)) | F.endswith(low, F.concat(F.lit("/"), t)) | F.endswith(low, F.concat(F.lit("#"), t))


def dirname(path: Column) -> Column:
    """The directory of a path; ``.`` at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """The path and the directories above it, nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve_relative(base: Column, target: Column) -> Column:
    """A relative import against a directory: ``.`` and ``..`` segments are folded; others stay as they are."""
    steps = F.filter(F.split(F.concat(base, F.lit("/"), target), "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.when(F.startswith(target, F.lit(".")), F.array_join(folded, "/")).otherwise(target)


def fact_id(repo: Column, kind: Column, name: Column, file: Column) -> Column:
    """32 hex digits of sha256 over repo, kind, name and file, divided by NUL; plug-in kinds leave the file out."""
    parts = F.concat_ws("\0", repo, kind, name, F.when(F.startswith(kind, F.lit("plugin:")), F.lit("")).otherwise(file))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 32)


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` spans segments, ``*`` and ``?`` stay inside one; a bare directory takes all below it."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in r"\.+^$()[]{}|" else pattern[i]), i + 1
    return f"^{out}(?:/.*)?$" if not any(c in pattern for c in "*?") else f"^{out}$"


def is_test_path(path: Column) -> Column:
    """By folder or file name; every form holds one of three plain strings, which are looked for first."""
    maybe = F.contains(path, F.lit("est")) | F.contains(path, F.lit("spec")) | F.contains(path, F.lit("fixtures"))
    return maybe & (path.rlike(r"(^|/)(tests?|__tests__|spec|specs|testdata|fixtures)(/|$)") | path.rlike(r"(_test\.[a-z]+|\.(test|spec)\.[a-z]+|(^|/)test_[^/]*\.py|Tests?\.(java|kt|cs|swift))$"))


def is_generated_path(path: Column) -> Column:
    return path.rlike(r"(\.pb\.go|_pb2\.py|\.g\.dart|\.generated\.[a-z]+|\.min\.js)$") | path.rlike(r"(^|/)(generated|node_modules|vendor|dist|build)(/|$)")


def route_path(path: Column) -> Column:
    """Slashes trimmed, a format extension of the last segment dropped, parameters as ``{}``."""
    trimmed = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.(json|xml|html)$", "")
    return F.array_join(F.transform(F.split(trimmed, "/"), lambda s: F.when(s.rlike(r"^(:[^/]+|\{[^}]*\}|<[^>]*>|\[[^\]]*\])$"), "{}").otherwise(s)), "/")


def http_method(method: Column) -> Column:
    """Upper case; USE, ALL, ANY and none as ``*``."""
    up = F.upper(F.trim(F.coalesce(method, F.lit(""))))
    return F.when(up.isin("USE", "ALL", "ANY", "*", ""), "*").otherwise(up)


def controller_key(name: Column) -> Column:
    """Lower case, ``::`` as ``/``, without a closing ``controller`` and underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "::", "/"), "controller$", ""), "_", "")


def title_key(title: Column) -> Column:
    """A finding's title with its numbers as ``#``, so that it is the same finding when only counts move."""
    return F.regexp_replace(title, r"[0-9]+(\.[0-9]+)?", "#")


def code_tokens(text: Column) -> Column:
    """The set of identifiers and single signs of a source text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*|[^\s\w])"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def camel_parts(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")), r"[\s_.\-/]+"), lambda p: p != "")


def remote_label(url: Column) -> Column:
    """A repository's label from its remote address: the last path segment without ``.git``."""
    return F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"([^/:]+)$", 1)


def ratio(num: Column, den: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half away from zero on the scaled binary value."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
