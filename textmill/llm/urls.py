"""URL filter: rules of hosts and paths, then trust and distrust that flow along links between hosts. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, quoted, written

#: Trust and distrust are each handed out in this many whole units, so that sums don't depend on their order.
UNITS = 10**15
#: Percent of a host's units that flow on along its links.
DAMPING = 85
#: Up to so many rules are one expression; more are joined.
FEW_RULES = 64

#: A run of a name's characters with a dot in it. It begins only where a run does and never steps back, so it is linear.
_DOTTED = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+\.[A-Za-z0-9_.-]*+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _split(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, f"/{path}"


def _by_expression(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules tried from the longest on (equal ones: longer host, then text); no shuffle."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -len(_split(r[0])[0]), r[0])):
        host, path = _split(rule)
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    found = F.lit(None).cast("struct<rule string, verdict string>") if found is None else found
    return pages.withColumn("hit", found)


def _by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules: the ends of each host with the beginnings of each path, of lengths that rules have,
    meet the rules by equality. A page makes at most (labels of its host) x (lengths) keys, however many rules there are."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.substring("rule", slash, F.char_length("rule"))).otherwise("/")
    rows = rules.select("rule", "verdict", host.alias("rule_host"), path.alias("rule_path"))
    lengths = sorted(r[0] for r in rows.select(F.char_length("rule_path")).distinct().collect())  # bounded by the longest path of a rule
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path", F.explode(F.array_distinct(ends)).alias("rule_host"))
    starts = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    keys = keys.select("host", "path", "rule_host", F.explode(F.array_compact(starts)).alias("rule_path"))
    place = F.struct(-F.char_length("rule"), -F.char_length("rule_host"), "rule")
    best = keys.join(rows, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), place).alias("hit"))
    return pages.join(best, ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n): on how many pages a host's html names another host of the table, in a link or in text.

    Names are taken once a page and counted by pair before the shuffle, so a host with a third of all pages is a row a
    task for each host that it names. A name is a run of letters, digits, '_', '-' and '.', without dots at its ends. Names of hosts without pages are left out: no verdict depends on them."""
    found = F.regexp_extract_all("html", F.lit(_DOTTED), F.lit(0))
    names = F.array_distinct(F.transform(found, lambda x: F.translate(F.trim(x, F.lit(".")), _UPPER, _LOWER)))
    named = pages.filter("host <> ''").select("host", F.explode(names).alias("dst")).filter("host <> dst")
    pairs = named.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))
    hosts = pages.filter("host <> ''").select(F.col("host").alias("dst")).distinct()
    return pairs.join(hosts, "dst", "left_semi")


def propagated(links: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Rows (kind, host, units) of personalised PageRank: what walks from the seeds (kind, host, units) leave on hosts.

    Kind 'trust' walks along links, 'distrust' against them: a host that names distrusted ones is distrusted. A step
    hands on DAMPING percent of a host's units by the number of pages that name each neighbour, rounded down; units of a
    host without neighbours end there. Each step is a join and a sum by host, written to the shared folder; steps end
    early when nothing is left."""
    ways = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    total = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    ways = written(ways.join(total, ["kind", "src"]), "ways")
    step = written(seeds, "step0")
    steps = [step]
    for k in range(1, rounds + 1):
        wide = [F.col(c).cast("decimal(18,0)") for c in ("units", "n", "all")]
        flow = step.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).withColumns(dict(zip(("x", "y", "z"), wide, strict=True)))
        moved = flow.select("kind", F.col("dst").alias("host"), F.expr(f"(x * y * {DAMPING}BD) div (z * 100BD)").alias("units"))
        step = written(moved.groupBy("kind", "host").agg(F.sum("units").alias("units")).filter("units > 0"), f"step{k}")
        steps.append(step)
        if step.isEmpty():
            break
    ranks = written(reduce(DataFrame.union, steps).groupBy("kind", "host").agg(F.sum("units").alias("units")), "ranks")
    for table in (ways, *steps):
        discard(table)
    return ranks


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, rounds: int = 12, percent: int = 50, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust): whether each page's URL is allowed or blocked.

    rules are pairs (rule, 'allow' or 'block'), or a table with these columns; a rule like 'example.net/en/' fits its
    host and all subdomains where the path begins with '/en/'. The longest that fits decides; of equally long ones that
    with the longer host. Other pages follow their host: pages that rules allow make their hosts seeds of trust, pages
    that rules block seeds of distrust, each host by its number of such pages, and both are propagated over the links
    between hosts. A host is blocked if its distrust is over `percent` percent of its trust and distrust together.

    Everything is whole numbers, so results are the same on any number of tasks.

    Defined results: a null URL, or one without '://', has an empty host and path, no rule and is allowed, as is a host
    that neither trust nor distrust reaches; an empty path begins with no rule's path; a null html names nothing; null and
    repeated ids are judged row by row; other columns, whatever their names, are ignored; an empty table gives no rows.
    Long pages count whole."""
    host, path = url_parts(F.col(quoted(url_col)))
    base = pages.select(F.col(quoted(id_col)).alias("page_id"), host.alias("host"), path.alias("path"), F.col(quoted(html_col)).alias("html"))
    flat = base.drop("html")
    if not isinstance(rules, list):
        few = rules.select("rule", "verdict").limit(FEW_RULES + 1).collect()
        rules = [tuple(r) for r in few] if len(few) <= FEW_RULES else rules
    elif len(rules) > FEW_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "rule string, verdict string")
    ruled = _by_expression(flat, rules) if isinstance(rules, list) else _by_join(flat, rules)
    kind = F.when(F.col("hit.verdict") == "allow", "trust").otherwise("distrust")
    counted = ruled.filter("hit is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    counted = written(counted, "seeds")
    whole = counted.groupBy("kind").agg(F.sum("n").alias("all"))
    share = F.expr(f"(cast(n as decimal(18,0)) * {UNITS}BD) div cast(all as decimal(18,0))")
    seeds = counted.join(F.broadcast(whole), "kind").select("kind", "host", share.alias("units")).filter("units > 0")  # two rows
    links = written(host_links(base), "host_links")
    ranks = propagated(links, seeds, rounds)
    discard(links)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("units"))), F.lit(0))
    scores = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    out = ruled.join(scores, "host", "left").fillna(0, ["trust", "distrust"])
    bad = F.col("distrust") * (100 - percent) > F.col("trust") * percent
    verdict = F.coalesce(F.col("hit.verdict"), F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
