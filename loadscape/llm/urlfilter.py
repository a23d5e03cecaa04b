"""URL filters with redirect equivalence: block decisions reach every alias of a page unless an alias is allowed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, named
from loadscape.llm.components import connected_components
from loadscape.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are compiled into one expression; more are joined by host suffix.
COMPILED = 200


class Rule(NamedTuple):
    """verdict: allow or block. The rule fits its host and all subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """The path with ``.`` left out and ``..`` taking back the segment before; no path is the root."""

    def step(done: Column, segment: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == "..", back).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    clean = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda done: F.array_join(done, "/"))
    end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path == "", "/").when(path.contains("/."), F.concat(clean, end)).otherwise(path)


def node_of(url: Column) -> Column:
    """What tells a resource: host, path (dots resolved) and query, without scheme, its default port and fragment; null
    without a host."""
    host = F.regexp_replace(host_of(url), ":$", "")
    host = F.when(url.rlike("(?i)^http://"), F.regexp_replace(host, ":80$", "")).when(url.rlike("(?i)^https://"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(host != "", F.concat(host, _without_dots(path_of(url)), _query_of(url)))


def _compiled(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(rows: DataFrame, rules: Sequence[Rule], host_col: str, path_col: str, out_col: str) -> DataFrame:
    """``rows`` with the struct (rule, verdict) of the longest fitting rule, null where none fits.

    Many rules are joined on the suffixes of distinct (host, path) pairs instead of being tried one by one.
    """
    host, path = named(host_col), named(path_col)
    if len(rules) <= COMPILED:
        return rows.withColumn(out_col, _compiled(rules, host, path))
    table = rows.sparkSession.createDataFrame([tuple(r) for r in rules], "r_verdict string, r_host string, r_path string")
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own_host, own_path = free(rows, "_host", "_path")
    pairs = rows.select(host.alias(own_host), path.alias(own_path), F.explode(suffixes).alias("r_host")).distinct()
    rule = F.concat("r_host", "r_path")
    found = pairs.join(table, "r_host").where(F.col(own_path).startswith(F.col("r_path")))
    found = found.groupBy(own_host, own_path).agg(F.max_by(F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length(rule), rule)).alias(out_col))
    return rows.join(found, (host == F.col(own_host)) & (path == F.col(own_path)), "left").drop(own_host, own_path)


#: What is no markup: comments, and elements whose content is plain text.
_PLAIN = r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|$)"
#: A tag ends at the first > outside quotes; where quotes do not close, at the first of all. With < outside quotes it is none.
_TAG = r"""(?is)(<(?:link|meta|base)(?=[\s/])(?:(?:[^<>"']++|"[^"]*+"|'[^']*+'){0,300}+>|[^<>]*+>))"""
_ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?"""
_ENTITY = r"&(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z]{2,6};)"
#: Named characters that occur in addresses.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "colon": ":", "sol": "/", "period": ".", "quest": "?", "equals": "=", "num": "#",
    "percnt": "%", "commat": "@", "semi": ";", "comma": ",", "lowbar": "_", "plus": "+", "excl": "!", "dollar": "$", "ast": "*", "lpar": "(", "rpar": ")", "Tab": "\t",
}


def _decoded(value: Column) -> Column:
    """The value with its character references replaced, each once."""

    def sign(entity: Column) -> Column:
        number = F.when(entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(entity, r"^&#(\d+)", 1))
        code = F.when(entity.startswith("&#"), number.cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, char in NAMED.items():
            out = out.when(entity == f"&{name};", F.lit(char))
        return out.otherwise(entity)

    between, found = F.split(value, _ENTITY, -1), F.regexp_extract_all(value, F.lit(f"({_ENTITY})"), F.lit(1))
    whole = F.array_join(F.zip_with(between, F.transform(found, sign), lambda x, e: F.concat(x, F.coalesce(e, F.lit("")))), "")
    return F.when(value.contains("&"), whole).otherwise(value)


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, without quotes; empty without it."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    value = F.coalesce(F.try_element_at(values, F.nullif(F.array_position(names, name).cast("int"), F.lit(0))), F.lit(""))
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _resolved(target: Column, url: Column) -> Column:
    """The absolute form of a link on the page ``url``; null for a link to the page itself or of another kind of scheme."""
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("http"))
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    out = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
    out = out.when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(target.startswith("/"), F.concat(root, target))
    return out.when(target.startswith("?"), F.concat(root, path_of(url), target)).otherwise(F.concat(root, folder, target))


#: Where a refresh leads: after the seconds, with or without url=, in quotes or not.
_REFRESH = r"""(?is)^\s*(?:[\d.]+\s*(?:[;,]\s*|\s)(?:url\s*=\s*)?|(?:.*?[;,\s])?url\s*=\s*)(?:"([^"]*)|'([^']*)|([^"'].*))"""


def telling_tags(html: Column) -> Column:
    """The link, meta and base tags that may tell of an alias, outside comments and plain text."""
    bare = F.when(html.rlike(r"(?i)<!--|<(?:script|style|textarea|title|xmp|iframe|noembed|noframes)"), F.regexp_replace(html, _PLAIN, " ")).otherwise(html)
    tags = F.regexp_extract_all(bare, F.lit(_TAG), F.lit(1))
    return F.when(html.rlike("(?i)canonical|refresh|&"), F.filter(tags, lambda tag: tag.rlike("(?i)^<base|canonical|refresh|&"))).otherwise(F.array().cast("array<string>"))


def alias_edges(rows: DataFrame) -> DataFrame:
    """(a, b): from the node of each row of (node, url, tags) to the nodes that its canonical links and refreshes name.

    Absolute targets, targets without scheme, from the host's root and relative to the page, or to its first base
    element, are followed. Each step is a column of its own, so that no expression is repeated within the next.
    """
    is_base = lambda tag: tag.rlike("(?i)^<base")
    bases = F.filter(F.transform(F.filter("tags", is_base), lambda tag: F.trim(_attribute(tag, "href"))), lambda x: x != "")
    tags = rows.where(F.size("tags") > 0).select("node", "url", "tags", F.try_element_at(bases, F.lit(1)).alias("base"))
    tags = tags.select("node", "url", "tags", _decoded(F.col("base")).alias("base"))
    tags = tags.select("node", "tags", F.coalesce(_resolved(F.col("base"), F.col("url")), "url").alias("base"))
    tags = tags.select("node", "base", F.explode("tags").alias("tag")).where(~is_base(F.col("tag")))
    canonical = F.col("tag").rlike("(?i)^<link") & F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    named_ = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, _attribute(F.col("tag"), "content"))
    links = tags.select("node", "base", canonical.alias("canonical"), named_.alias("said")).where("said is not null")
    links = links.select("node", "base", "canonical", _decoded(F.col("said")).alias("said"))
    moved = F.concat(*[F.regexp_extract("said", _REFRESH, k) for k in (1, 2, 3)])
    links = links.select("node", "base", F.regexp_replace(F.when(F.col("canonical"), F.col("said")).otherwise(moved), r"^\s+|\s+$|[\t\n\r]", "").alias("target"))
    return links.select("node", _resolved(F.col("target"), F.col("base")).alias("to")).select(F.col("node").alias("a"), node_of(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, component): one row per row of ``pages``.

    The longest fitting rule decides. Where none fits, the page's aliases do: pages are joined by all canonical links and
    refresh redirects of their HTML and by ``redirects`` (from_url, to_url), and a group with a blocked member is blocked
    unless a member is explicitly allowed. All else is allowed. component is the group's smallest node (host, path and
    query), null for a page without aliases. A null URL, or one without a host, has no rule and no alias; null or empty
    HTML names none; repeated rows are judged alike; an empty table gives no rows. Other columns are not read. HTML is
    read once and never shuffled: only addresses and the tags that tell of aliases are written.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    url, html = named(url_col).cast("string"), named(html_col).cast("string")
    rows = pages.select(named(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), url.alias("url"), telling_tags(html).alias("tags"))
    rows = scratch.table(rows)
    edges = scratch.table(alias_edges(rows))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url").cast("string")), node_of(F.col("to_url").cast("string"))))
    groups = connected_components(edges, "a", "b", scratch)
    members = groups.unionByName(groups.select(F.col("component").alias("node"), "component")).distinct()
    known = F.concat(F.lit("http://"), F.col("node"))
    ruled = match_rules(members.select("*", host_of(known).alias("host"), path_of(known).alias("path")), rules, "host", "path", "found")
    allowed = F.coalesce(F.max(F.col("found.verdict") == "allow"), F.lit(False))
    blocked = F.coalesce(F.max(F.col("found.verdict") == "block"), F.lit(False))
    decided = ruled.groupBy("component").agg(F.when(blocked & ~allowed, "block").otherwise("allow").alias("group_verdict"))
    decided = members.join(decided, "component").select("node", "component", "group_verdict")
    out = match_rules(rows.drop("url", "tags"), rules, "host", "path", "found").join(decided, "node", "left")
    verdict = F.coalesce("found.verdict", "group_verdict", F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "component")
