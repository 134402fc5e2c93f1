"""URL filter: rules by host and path, and a tree of path templates for what no rule covers.

*Rules* (host, path, allow or block) fit a host, its subdomains, and paths that start with theirs;
the longest wins. The rules are a short list of the caller's, tried as conditions on each url.

*Templates*: per host, the tree of path segments is generalised level by level. A branch becomes
the wildcard ``*`` if its name is a number or the like, if its level has many names for few pages
each, or if its share of blocked labels differs from its siblings' by less than chance allows, so
that similar branches merge. What is left is a template, such as ``/en/*``. The urls that a rule
covers are the labelled ones. The purity of a template is its share of allow labels, smoothed
towards its parent's, that towards the host's, and that towards all. A url without a rule is
blocked if its template's purity is under one half.

All statistics are grouped sums over distinct (host, path) with counts. The first ``FIRST`` levels are
generalised one by one. Below a template whose labels all agree, the rest of each path is then one
branch; where they differ, what all its paths share is passed over at once, and the next segment is
generalised like those above, until no template with mixed labels has paths that go on.

A null url, or one without ``://``, has an empty host and path and is judged as such; empty
segments are names; repeated rows are judged alike, each of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areametrics.operators.joins import sized_join
from areametrics.sources.shared import stored

#: Levels that are generalised whatever their labels.
FIRST = 3
#: A level whose names number over this and hold fewer than so many pages each is a variable.
MANY_NAMES, FEW_PAGES = 20, 3.0
#: Branches that differ by less than so many standard errors merge.
ERRORS = 2.0
#: Pages that a parent counts for in the purity of a template.
WEIGHT = 5.0

_VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,}|.*[0-9]{3,}.*)(?:\.[A-Za-z]{1,5})?$"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = f"regexp_extract(`{url}`, '(?s)^.*?://(.*)$', 1)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), " + (
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return F.coalesce(F.expr(host), F.lit("")), F.coalesce(F.expr(path), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.org/en/`` as host and path."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def with_rule(urls: DataFrame, rules: dict[str, bool]) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) plus ``rule`` and ``allow``, null where none fits.

    The rules are a list of the caller's, so their number does not grow with the urls.
    """
    fits = []
    for rule in sorted(rules, key=lambda r: (len(r), r), reverse=True):
        host, path = split_rule(rule)
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append((own & F.col("path").startswith(path), rule))
    best, allow = F, F
    for fit, rule in fits:
        best = best.when(fit, F.lit(rule))
        allow = allow.when(fit, F.lit(rules[rule]))
    none = F.lit(None)
    return urls.withColumns({
        "rule": (best if fits else none).cast("string"),
        "allow": (allow if fits else none).cast("boolean"),
    })


_SUMS = ("pages", "labels", "allowed")
_HELD = ["host", "path", *_SUMS, "template", "rest"]


def _generalised(named: DataFrame) -> DataFrame:
    """``named`` (``segment`` is what comes next, null past the end) with templates one branch longer."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    named = named.withColumn(
        "segment", F.when(F.col("segment").rlike(_VARIABLE), F.lit("*")).otherwise(F.col("segment"))
    )
    branches = named.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums)
    parents = branches.groupBy("host", "template").agg(
        F.count("*").alias("names"), F.sum("pages").alias("all_pages"),
        F.sum("labels").alias("all_labels"), F.sum("allowed").alias("all_allowed"),
    )
    judged = sized_join(branches, parents, ["host", "template"], how="inner").selectExpr(
        "l.*", "names", "all_pages", "all_labels", "all_allowed"
    )
    variable = f"names > {MANY_NAMES} AND all_pages < {FEW_PAGES} * names"
    pooled = "(all_allowed + 0.5) / (all_labels + 1)"
    apart = (
        f"labels > 0 AND abs(allowed / labels - {pooled}) >"
        f" {ERRORS} * sqrt({pooled} * (1 - {pooled}) / labels)"
    )
    # Branches without labels keep their names as long as they are few: nothing says that
    # they are alike.
    name = F.expr(
        f"CASE WHEN segment = '*' OR ({variable}) THEN '*' WHEN labels = 0 OR {apart} THEN segment"
        " ELSE '*' END"
    )
    renamed = judged.select("host", "template", "segment", name.alias("name"))
    longer = sized_join(named, renamed, ["host", "template", "segment"]).selectExpr(
        *[f"l.{c}" for c in _HELD if c != "template"],
        "CASE WHEN l.segment IS NULL THEN l.template"
        " ELSE concat(l.template, '/', coalesce(name, l.segment)) END AS template",
    )
    return stored(longer.select(*_HELD), "templates")


def _next(rows: DataFrame) -> DataFrame:
    """The next segment of every path."""
    return rows.selectExpr(
        *[c for c in _HELD if c != "rest"], "get(rest, 0) AS segment", "slice(rest, 2, greatest(size(rest) - 1, 0)) AS rest"
    )


def templates(labelled: DataFrame) -> DataFrame:
    """``host``, ``path``, ``template`` for all urls. ``labelled`` has ``host``, ``path`` and
    ``allow`` (null without label), one row per url."""
    rows = labelled.groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.count("allow").alias("labels"),
        F.sum(F.coalesce(F.col("allow").cast("long"), F.lit(0))).alias("allowed"),
    )
    # From the top: the template so far, and the segments that are not in it yet.
    rows = rows.withColumn("template", F.lit("")).withColumn(
        "rest", F.expr("IF(path = '', CAST(array() AS array<string>), split(substr(path, 2), '/', -1))")
    )
    for _ in range(FIRST):
        rows = _generalised(_next(rows))
    own = "nullif(array_join(rest, '/'), '')"
    none = "CAST(array() AS array<string>)"
    while True:
        mixed = stored(rows.groupBy("host", "template").agg(
            F.sum("labels").alias("n"), F.sum("allowed").alias("a"), F.max(F.size("rest")).alias("longest"),
            F.min("rest").alias("first"), F.max("rest").alias("last"),
        ).where("0 < a AND a < n AND longest > 1").selectExpr(
            "host", "template",
            # What the least and the greatest of the paths share, all of them do.
            "coalesce(nullif(array_position(zip_with(first, last, (x, y) -> x <=> y), false), 0) - 1,"
            " least(size(first), size(last))) AS shared",
        ), "mixed")
        if mixed.limit(1).count() == 0:
            break
        joined = sized_join(rows, mixed, ["host", "template"]).selectExpr("l.*", "shared")
        passed = (
            f"concat(template, array_join(transform(slice(rest, 1, int(shared)), x -> concat('/', IF(x RLIKE r'{_VARIABLE}', '*', x))), ''))"
        )
        moved = joined.selectExpr(
            "host", "path", *_SUMS, f"IF(shared IS NULL, template, {passed}) AS template",
            f"IF(shared IS NULL, {own}, get(rest, int(shared))) AS segment",
            f"IF(shared IS NULL, {none}, slice(rest, int(shared) + 2, greatest(size(rest) - int(shared) - 1, 0))) AS rest",
        )
        rows = _generalised(moved)
    return _generalised(rows.selectExpr(
        *[c for c in _HELD if c != "rest"], f"{own} AS segment", f"{none} AS rest"
    )).drop("rest")


def purities(rows: DataFrame) -> DataFrame:
    """``host``, ``template`` and smoothed ``purity`` of every template of :func:`templates`."""
    own = rows.groupBy("host", "template").agg(
        F.sum("labels").alias("labels"), F.sum("allowed").alias("allowed")
    ).withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    by_parent = own.groupBy("host", "parent").agg(
        F.sum("labels").alias("p_labels"), F.sum("allowed").alias("p_allowed")
    )
    by_host = own.groupBy("host").agg(
        F.sum("labels").alias("h_labels"), F.sum("allowed").alias("h_allowed")
    )
    # One row: the share of allow labels among all.
    overall = own.agg(((F.sum("allowed") + 1) / (F.sum("labels") + 2)).alias("share"))
    share = overall.first()["share"]
    share = 0.5 if share is None else float(share)

    def smoothed(allowed, labels, towards):
        return (F.col(allowed) + WEIGHT * towards) / (F.col(labels) + WEIGHT)

    by_host = by_host.withColumn("h", smoothed("h_allowed", "h_labels", F.lit(share)))
    by_parent = sized_join(by_parent, by_host.select("host", "h"), ["host"]).selectExpr("l.*", "h")
    by_parent = by_parent.withColumn("p", smoothed("p_allowed", "p_labels", F.col("h")))
    found = sized_join(own, by_parent.select("host", "parent", "p"), ["host", "parent"]).selectExpr(
        "l.*", "p"
    )
    return found.select(
        "host", "template", "labels", smoothed("allowed", "labels", F.col("p")).alias("purity")
    )


def judge(df: DataFrame, rules: dict[str, bool], key: str = "page_id", url: str = "url") -> DataFrame:
    """A row per url: ``host``, ``path``, ``rule``, ``template``, ``purity``, ``verdict``."""
    host, path = url_parts(url)
    urls = with_rule(df.select(F.col(key), host.alias("host"), path.alias("path")), rules)
    urls = stored(urls, "urls")
    found = templates(urls.select("host", "path", "allow"))
    scored = sized_join(
        found.select("host", "path", "template"), purities(found), ["host", "template"]
    ).selectExpr("l.host", "l.path", "l.template", "purity")
    joined = sized_join(urls, scored, ["host", "path"]).selectExpr("l.*", "template", "purity")
    verdict = F.expr(
        "CASE WHEN coalesce(allow, purity >= 0.5) THEN 'allow' ELSE 'block' END"
    )
    return joined.select(key, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
