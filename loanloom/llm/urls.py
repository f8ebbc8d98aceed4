"""URL filter: a tree of path templates per host, judged by the labelled pages that share a template.

The tree grows from the host down, all hosts at once, a level a round. In each round the pages of a node are counted
by their next path segment:

* A segment stays as it is if at least ``LEAST_PAGES`` pages and one in ``MOST_BRANCHES`` of the node's pages have it, so a
  node has at most ``MOST_BRANCHES`` of them. All others vary and become the wildcard ``*``.
* Branches are put in order of the share of good pages and neighbours are merged while a test of two proportions
  (``ALIKE``) does not tell them apart; they go on as one branch, written ``{de|fr}``, or ``*`` if the wildcard is among them.
* Segments that all pages of a node share are taken at once, so rounds follow branchings, not lengths of paths.
* A node of fewer than ``LEAST_PAGES`` pages has no branches: its template ends in ``/**``.

A template's purity is the share of good ones among its labelled pages, smoothed by ``WEIGHT`` pages of the purity of
its host, and that in turn by the purity of all pages. Templates below ``PURE`` are rejected. Explicit rules come before
templates: a rule fits its host and all subdomains if the path starts with the rule's, and the longest wins (of
equally long ones the longer host, then the one that blocks).

Each page is counted in its node by combined sums; nodes are sent to the pages by broadcast if a count shows them to
be few, else by a join that splits hot nodes. Missing urls and urls without ``://`` have an empty host and path and are
judged by the template they share. Pages without an id, or whose id no label names, are unlabelled; without any labels
every template has a purity of one half and is allowed. Repeated rows count each for themselves; an empty table gives no
rows; further columns of the tables are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import looked_up, ship_package, stash

LEAST_PAGES = 10
MOST_BRANCHES = 64
# Branches whose squared difference of proportions, in squared standard errors, is below this are alike (five per cent).
ALIKE = 3.84
WEIGHT = 4.0
PURE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every row of ``pages`` (``page_id, url``)."""
    start = F.instr("url", "://")
    rest = F.coalesce(F.when(start > 0, F.substr("url", start + 3)), F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def fitting_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text of the rule that decides a row's host and path, and whether it allows; NULL where none fits."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), not r.allow)):  # the last one that fits decides
        host = F.col("host")
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        allow = F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text, allow


def _share(good: int, labelled: int) -> float:
    return (good + 1) / (labelled + 2)


def alike(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two branches with (labelled, good) pages could have the same share of good ones."""
    both = _share(a[1] + b[1], a[0] + b[0])
    difference = _share(a[1], a[0]) - _share(b[1], b[0])
    return difference**2 < ALIKE * both * (1 - both) * (1 / (a[0] + 2) + 1 / (b[0] + 2))


def literal(segment: str) -> str:
    """A segment as it is written in a template, where marks of templates are escaped."""
    return re.sub(r"([*{}|\\])", r"\\\1", segment)


def merged_branches(branches: dict[str | None, tuple[int, int]]) -> dict[str | None, str]:
    """Template text per branch, ``None`` being the wildcard, from its (labelled, good) pages."""
    ordered = sorted(branches, key=lambda s: (_share(branches[s][1], branches[s][0]), s is None, s or ""))
    groups: list[tuple[list[str | None], tuple[int, int]]] = []
    for segment in ordered:
        own = branches[segment]
        if groups and alike(groups[-1][1], own):
            names, (labelled, good) = groups[-1]
            groups[-1] = ([*names, segment], (labelled + own[0], good + own[1]))
        else:
            groups.append(([segment], own))
    texts = {}
    for names, _ in groups:
        known = sorted(literal(s) for s in names if s is not None)
        text = "*" if None in names else known[0] if len(known) == 1 else "{" + "|".join(known) + "}"
        texts.update(dict.fromkeys(names, text))
    return texts


def shared_segments(first: str, last: str) -> str:
    """The whole segments with which all paths between two begin."""
    if first == last:
        return first
    size = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    return first[: max(0, first[:size].rfind("/"))]


def _step(nodes: pd.DataFrame) -> pd.DataFrame:
    found = []
    for node in nodes.itertuples(index=False):
        shared = shared_segments(node.first, node.last)
        if shared:
            found.append((shared, "/".join(map(literal, shared.split("/"))), {}, "*"))
            continue
        children = [] if node.children is None else list(node.children)
        own = {c["segment"]: (int(c["labelled"]), int(c["good"])) for c in children}
        # What is neither a branch nor ends here varies.
        vary = [int(total - sum(c[k] for c in children)) for total, k in zip((node.n, node.labelled, node.good), ("n", "labelled", "good"))]
        if vary[0]:
            own[None] = (vary[1], vary[2])
        texts = merged_branches(own)
        other = texts.pop(None, "*")
        found.append(("", "", texts, other))
    return pd.DataFrame(found, columns=["shared", "written", "branches", "other"])


_STEP = "shared string, written string, branches map<string,string>, other string"
_NODE = ["host", "template"]
_SUMS = ["n", "labelled", "good"]


def _nodes(active: DataFrame) -> DataFrame:
    """What each node that has enough pages does next."""
    segment = F.when(F.col("rest") != "", F.regexp_extract("rest", "^/([^/]*)", 1))
    counted = active.groupBy(*_NODE, segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count("is_good").alias("labelled"), F.count_if("is_good").alias("good"),
        F.min("rest").alias("first"), F.max("rest").alias("last"),
    )
    counted = stash(counted, "url-branches")
    going_on = [F.sum(F.when(F.col("segment").isNotNull(), F.col(c))).alias(c) for c in _SUMS]
    ends = [F.min("first").alias("first"), F.max("last").alias("last")]
    nodes = counted.groupBy(*_NODE).agg(F.sum("n").alias("pages"), *going_on, *ends).where(F.col("pages") >= LEAST_PAGES)
    nodes = stash(nodes.fillna(0, _SUMS), "url-nodes")
    frequent = counted.where((F.col("n") >= LEAST_PAGES) & F.col("segment").isNotNull())
    frequent = looked_up(frequent, nodes.select(*_NODE, "pages"), _NODE).where(F.col("n") * MOST_BRANCHES >= F.col("pages"))
    lists = stash(frequent.groupBy(*_NODE).agg(F.collect_list(F.struct("segment", *_SUMS)).alias("children")), "url-lists")
    known = looked_up(nodes, lists, _NODE)
    step = F.pandas_udf(_step, _STEP)(F.struct("first", "last", *_SUMS, "children"))
    return stash(known.select(*_NODE, step.alias("step")).select(*_NODE, "step.*"), "url-steps")


def with_templates(pages: DataFrame) -> DataFrame:
    """Rows with ``host, path, is_good`` (NULL if unlabelled) and, added, the ``template`` of each."""
    columns = pages.columns
    active = stash(pages.withColumn("template", F.lit("")).withColumn("rest", F.col("path")), "url-rows")
    done = []
    while not active.isEmpty():
        rows = looked_up(active, _nodes(active), _NODE)
        segment = F.regexp_extract("rest", "^/([^/]*)", 1)
        ended, small = F.col("rest") == "", F.col("shared").isNull()
        branch = F.coalesce(F.try_element_at("branches", segment), F.col("other"))
        written = F.when(ended, F.lit("")).when(small, F.lit("/**")).when(F.col("shared") != "", F.col("written")).otherwise(F.concat(F.lit("/"), branch))
        taken = F.when(F.col("shared") != "", F.length("shared")).otherwise(F.length(segment) + 1)
        rest = F.when(ended | small, F.lit(None)).otherwise(F.substr("rest", taken + 1))
        rows = stash(rows.select(*columns, F.concat("template", written).alias("template"), rest.alias("rest")), "url-rows")
        done.append(rows.where("rest IS NULL").select(*columns, "template"))
        active = rows.where("rest IS NOT NULL")
    if not done:
        return active.select(*columns, "template")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def judged_templates(rows: DataFrame) -> DataFrame:
    """``host, template, purity``: shares of good pages, smoothed by the host's, and that by all pages'."""
    counts = rows.groupBy("host", "template").agg(F.count("is_good").alias("labelled"), F.count_if("is_good").alias("good"))
    counts = stash(counts, "url-templates")
    all_good, all_labelled = counts.agg(F.sum("good"), F.sum("labelled")).first()
    overall = _share(all_good or 0, all_labelled or 0)
    hosts = counts.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("labelled").alias("host_labelled"))
    of_host = (F.col("host_good") + WEIGHT * overall) / (F.col("host_labelled") + WEIGHT)
    of_template = (F.col("good") + WEIGHT * of_host) / (F.col("labelled") + WEIGHT)
    return stash(looked_up(counts, stash(hosts, "url-hosts"), ["host"]).select("host", "template", of_template.alias("purity")), "url-purity")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages`` (``page_id, url``).

    ``labels`` (``page_id, is_good``) names known pages; of contradicting labels the bad one counts.
    """
    ship_package(pages.sparkSession)
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("is_good").cast("boolean").alias("is_good"))
    rows = looked_up(parsed(pages.select("page_id", "url")), stash(known, "url-labels"), ["page_id"])
    rows = with_templates(rows.select("page_id", "host", "path", "is_good"))
    judged = looked_up(rows, judged_templates(rows), ["host", "template"])
    rule, allow = fitting_rule(rules)
    allowed = F.coalesce(allow, F.col("purity") >= PURE)
    verdict = F.when(allowed, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "purity")
