"""URL filter by redirect equivalence: decisions spread over redirects and canonical links, explicit allows first.

DataFrame functions only. Rules meet urls by an equi-join on the host's suffixes, so their number is free; components
come from ``components``, so no chain or hub of aliases meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from seqlytics.llm.components import broadcast_if, components
from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TO = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
#: Character references as they occur in urls; other ones stay as they are.
REFERENCES = ((r"(?i)&(?:amp|#0*38|#x0*26);", "&"), (r"(?i)&(?:sol|#0*47|#x0*2f);", "/"))
MOST_RULES_SENT = 100_000


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """One name for a resource: host, path and query without scheme and fragment; null for what is no url."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), tail))


def without_dots(path: Column) -> Column:
    """``path``, which begins with ``/``, with its ``.`` and ``..`` segments resolved; ``..`` above the root is dropped."""
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    folded = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.lit(""), step)
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), F.concat(folded, F.lit("/"))).otherwise(folded)


def target_node(url: Column, to: Column) -> Column:
    """The node that a reference ``to`` in the page at ``url`` names; null where it names none.

    Absolute, ``//host/path``, ``/path``, ``?query`` and relative ones (``next.html``, ``../a``), the latter from the
    directory of the page. References of other schemes (``mailto:``), and fragments alone, name no other resource.
    """
    parts = F.regexp_extract(to, r"^([^?#]*)", 1)
    query = F.regexp_extract(to, r"^[^?#]*(\?[^#]*)", 1)
    directory = F.coalesce(F.nullif(F.regexp_extract(path_of(url), "^(.*/)", 1), F.lit("")), F.lit("/"))
    inside = (
        F.when(parts.startswith("/"), without_dots(parts))
        .when(parts == "", path_of(url))
        .otherwise(without_dots(F.concat(directory, parts)))
    )
    here = F.when(F.locate("://", url) > 0, F.concat(host_of(url), inside, query))
    return (
        F.when(F.regexp_like(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), node_of(to))
        .when(to.startswith("//"), node_of(F.concat(F.lit("http:"), to)))
        .when(~F.regexp_like(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^#")), here)
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes: each page to the targets of its canonical links and refresh redirects, see ``target_node``.

    References to ``&`` and ``/`` in targets are decoded. Null html: no edge. A ``base`` tag changes nothing.
    """
    canonical = F.transform(F.regexp_extract_all(F.col(html), F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(F.col(html), F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TO, 1))
    found = pages.select(F.col(url).alias("_url"), F.explode(F.concat(canonical, refresh)).alias("_to")).where("_to <> ''")
    to = F.col("_to")
    for pattern, sign in REFERENCES:
        to = F.regexp_replace(to, pattern, sign)
    named = found.select("_url", to.alias("_to"))
    edges = named.select(node_of(F.col("_url")).alias("src"), target_node(F.col("_url"), F.col("_to")).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst")


def rule_table(df: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(rule_host, rule_path, action) of (action, host, path) tuples, as literals of the plan; a long list is better read from a table."""
    rows = [F.struct(F.lit(host).alias("rule_host"), F.lit(path).alias("rule_path"), F.lit(action).alias("action")) for action, host, path in rules]
    if not rows:
        return df.sparkSession.createDataFrame([], "rule_host string, rule_path string, action string")
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def matched(keyed: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, rule, action): the longest rule that fits host and path of each key; keys without one are left out.

    ``keyed`` has ``key``, ``host``, ``path``, with one host and path for each key. Equal rules with both actions: allow.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = keyed.where("host <> ''").distinct().withColumn("rule_host", F.explode(suffixes))
    fit = asked.join(broadcast_if(rules, MOST_RULES_SENT), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("ok"), rule.alias("rule"), F.col("action").alias("action"))
    return fit.groupBy(key).agg(F.max(best).alias("b")).select(key, "b.rule", "b.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A url's own longest rule decides. Without one, the class of urls that redirects and canonical links tie together
    decides: an explicit allow of any member first, else a block of any member, else allow. ``redirects`` (src, dst urls) adds
    links that the html lacks. Null or other text without ``://``: empty host and path, no rule, allow. Repeated rows
    stay; columns of ``pages`` named like a result column are replaced. Empty table: no rows.
    """
    made = ("host", "path", "rule", "verdict")
    # the caller's columns travel in one, so none of them can clash with a helper's name
    own = F.struct(*[f"`{c}`" for c in pages.columns if c not in made]).alias("_own")
    links = link_edges(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    tied = components(links).withColumnRenamed("id", "_node")
    tied = checkpoint(tied)
    u = F.concat(F.lit("://"), F.col("_node"))
    named = tied.select("_node", host_of(u).alias("host"), path_of(u).alias("path"))
    ruled = tied.join(matched(named, "_node", rules), "_node")
    verdicts = ruled.groupBy("root").agg(F.bool_or(F.col("action") == "allow").alias("_ok"))
    aliases = split_join(tied, verdicts, ["root"]).select("_node", "_ok")

    # urls meet rules by host and path, once for each that occurs
    rows = pages.select(own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("_node"))
    rows = rows.withColumn("_key", F.concat_ws("/", "host", "path"))
    rules_of = matched(rows.select("_key", "host", "path"), "_key", rules)
    rows = split_join(rows, rules_of, ["_key"], "left")
    if aliases.limit(1).count():
        rows = split_join(rows, aliases, ["_node"], "left")
    else:
        rows = rows.withColumn("_ok", F.lit(None).cast("boolean"))
    verdict = F.coalesce("action", F.when(~F.col("_ok"), "block"), F.lit("allow"))
    return rows.select("_own.*", "host", "path", "rule", verdict.alias("verdict"))
