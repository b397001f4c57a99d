"""URL filters: rules by host and path, and block decisions carried to redirect and canonical aliases.

Everything is DataFrame expressions and joins; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofspark.llm.common import stored
from proofspark.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are an expression; more than these want a table of their own.
MOST_RULES = 1000
#: Rows of a table (16 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 500_000

#: What sites answer with a redirect to their plain address.
SITE_PREFIXES = "www|m"
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits a host, or a parent of it, and the start of a path.

    Of rules of one length the one with the longer host wins, then an allowing one.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, r.name).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    """The verdict of a rule's name; null for none."""
    verdicts: dict[str, str] = {}
    for r in rules:
        verdicts[r.name] = "allow" if "allow" in (r.verdict, verdicts.get(r.name)) else r.verdict
    allowed, blocked = ([n for n, v in verdicts.items() if v == kind] for kind in ("allow", "block"))
    return F.when(rule.isin(allowed), "allow").when(rule.isin(blocked), "block")


def plain_address(url: Column) -> Column:
    """The address that a site's variants of one page redirect to: https, without ``www.`` or ``m.``,
    default port, index page, ``.html``, last slash, tracking parameters and fragment. Null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), "[.]$", "")
    host = F.regexp_replace(host, f"^(?:{SITE_PREFIXES})[.](?=[^.]+[.])", "")
    path = F.regexp_replace(path_of(url), "/index[.](?:html?|php)$", "/")
    path = F.regexp_replace(F.regexp_replace(path, "[.]html?$", ""), "/+$", "")
    query = F.regexp_extract(_behind_scheme(url), r"^[^?#]*[?]([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")), "&")
    full = F.concat(F.lit("https://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when((F.instr(url, "://") > 0) & (host != ""), full)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty where there is none."""
    found = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def linked_addresses(html: Column) -> Column:
    """Targets, as written, of a page's canonical links and refreshing redirects: an array of strings."""
    markup = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<link") & _attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")),
        lambda t: _attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<meta") & _attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1),
    )
    found = F.transform(F.concat(canonical, refresh), lambda a: F.trim(F.regexp_replace(a, "(?i)&(?:amp|#38|#x26);", "&")))
    # most pages have neither, and are not parsed
    return F.when(html.rlike("(?i)canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def with_resolved(links: DataFrame) -> DataFrame:
    """Adds ``to_url``: ``target`` as written on the page ``from_url``, made absolute; null if not of the web."""
    steps = (
        {"_scheme": F.regexp_extract("from_url", "(?i)^(https?)://", 1), "_bare": F.regexp_replace("target", "(?s)#.*$", "")},
        {
            "_site": F.concat("_scheme", F.lit("://"), F.regexp_extract(_behind_scheme(F.col("from_url")), "^[^/?#]*", 0)),
            "_path": path_of(F.col("from_url")),
            "_own": F.regexp_extract("_bare", "(?s)^[^?]*", 0),
            "_query": F.regexp_extract("_bare", "(?s)[?].*$", 0),
        },
        {"_joined": F.when(F.col("_own").startswith("/"), F.col("_own")).otherwise(F.concat(F.regexp_replace("_path", "[^/]*$", ""), "_own"))},
        {"_joined": F.when(F.col("_joined").startswith("/"), F.col("_joined")).otherwise(F.concat(F.lit("/"), "_joined"))},
        {"_steps": F.split("_joined", "/", -1)},
        {"_walked": _without_dots(F.col("_steps"))},
    )
    for columns in steps:  # column by column, so that what later steps repeat is worked out once
        links = links.withColumns(columns)
    folder = F.when(F.col("_joined").rlike("/[.]{1,2}$") & (F.size("_walked") > 0), "/").otherwise("")
    dotless = F.when(
        F.col("_joined").rlike("/[.]{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join("_walked", "/"), folder)
    ).otherwise(F.col("_joined"))
    bare = F.col("_bare")
    to_url = (
        F.when(bare == "", None)
        .when(bare.rlike("(?i)^https?://[^/?]"), bare)
        .when((F.col("_scheme") == "") | bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(bare.startswith("//"), F.concat("_scheme", F.lit(":"), bare))
        .otherwise(F.concat("_site", F.when(F.col("_own") == "", F.col("_path")).otherwise(dotless), "_query"))
    )
    return links.select("from_url", to_url.alias("to_url"))


def _without_dots(steps: Column) -> Column:
    """The steps of a path from its root, without ``.`` and ``..``; the first, empty one is left out."""
    return F.aggregate(
        F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )


def _node(url: Column) -> Column:
    """128 bits of a URL's SHA-256."""
    return F.unhex(F.left(F.sha2(url, 256), F.lit(32)))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """Pairs (from_url, to_url) of different addresses of one page.

    From a page's address and each address that it names as canonical or refreshes to; from the rows of
    ``redirects`` (columns from_url, to_url); and from each of all these to its plain address.
    """
    u = F.col(url)
    links = None
    if html is not None:
        written = pages.where(F.instr(u, "://") > 0).select(u.alias("from_url"), F.explode(linked_addresses(F.col(html))).alias("target"))
        links = with_resolved(stored(written))
    if redirects is not None:
        given = redirects.select("from_url", "to_url")
        links = given if links is None else links.union(given)
    urls = pages.select(u.alias("from_url"))
    pairs = None
    if links is not None:
        pairs = links.where("from_url is not null and to_url is not null")
        urls = urls.union(pairs.select(F.explode(F.array("from_url", "to_url"))))
    variants = urls.select("from_url", plain_address(F.col("from_url")).alias("to_url"))
    return (variants if pairs is None else variants.union(pairs)).where("from_url <> to_url").distinct()


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The nodes (``node``, distinct) that are linked, directly or over others, with a blocked address.

    An address that a rule allows neither takes a block on nor hands one on: its edges are left out.
    Components are found by iterated joins over the rest.
    """
    sides = ("from", "to")  # column by column, so that what later steps repeat is worked out once
    judged = edges.withColumns({f"{s}_host": host_of(F.col(f"{s}_url")) for s in sides} | {f"{s}_path": path_of(F.col(f"{s}_url")) for s in sides})
    judged = judged.withColumns({f"{s}_rule": rule_of(F.col(f"{s}_host"), F.col(f"{s}_path"), rules) for s in sides})
    judged = judged.withColumns({f"{s}_verdict": F.coalesce(verdict_of(F.col(f"{s}_rule"), rules), F.lit("")) for s in sides})
    judged = stored(
        judged.where("from_verdict <> 'allow' and to_verdict <> 'allow'").select(
            _node(F.col("from_url")).alias("u"),
            _node(F.col("to_url")).alias("v"),
            (F.col("from_verdict") == "block").alias("u_blocked"),
            (F.col("to_verdict") == "block").alias("v_blocked"),
        )
    )
    blocked = judged.where("u_blocked").select(F.col("u").alias("id")).union(judged.where("v_blocked").select("v")).distinct()
    labels = stored(components(judged.select("u", "v")))
    hit = labels.join(_bounded(blocked), "id", "left_semi").select("component_id").distinct()
    return labels.join(_bounded(hit), "component_id", "left_semi").select(F.col("id").alias("node"))


def _bounded(rows: DataFrame) -> DataFrame:
    """The rows to be broadcast if they are counted to be few, else as they are."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """All rows of ``pages`` with host, path, rule, verdict and ``by``: what decided.

    A rule decides what it fits (``by`` = rule). Else an address that is linked by redirects, canonical
    links or the variants of one address with a blocked one is blocked (alias), and all others are
    allowed (default). Blocks don't pass through addresses that a rule allows.

    A null url or one without ``://`` has empty host and path, no aliases, and is allowed unless a rule's
    host is empty. Null or empty html has no links. Rows with one url get one verdict, whatever page of
    it holds the link. Columns of ``pages`` whose names clash with added ones are replaced. No rows give none.
    """
    added = {"host", "path", "rule", "verdict", "by"} - {url.lower()}
    rows = pages.drop(*[c for c in pages.columns if c.lower() in added])
    # written first: the optimizer would else repeat the making of addresses in all that is asked of them
    edges = stored(alias_edges(pages, redirects, url, html))
    aliases = _bounded(stored(blocked_aliases(edges, rules)))
    u = F.col(url)
    out = rows.withColumns({"host": F.coalesce(host_of(u), F.lit("")), "path": F.coalesce(path_of(u), F.lit(""))})
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_node", F.when(F.col("rule").isNull(), _node(u)))
    out = out.join(aliases.withColumnRenamed("node", "_alias"), F.col("_node") == F.col("_alias"), "left")
    alias = F.col("_alias").isNotNull()
    return out.withColumns(
        {
            "verdict": F.coalesce(verdict_of(F.col("rule"), rules), F.when(alias, "block").otherwise("allow")),
            "by": F.when(F.col("rule").isNotNull(), "rule").when(alias, "alias").otherwise("default"),
        }
    ).drop("_node", "_alias")


def op11_url_filters(spark, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "by")
