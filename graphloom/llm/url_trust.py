"""URL filters: stated rules first, then trust and distrust that spread over host links.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages the rules block are blocked seeds, each by its share of such
pages. Trust follows links (personalised PageRank from the trusted seeds); distrust runs against them (a host that links to a
distrusted host takes some of it). Both spread together, as rows of one table, in DataFrame operations only, until what has not
arrived yet could change no host by more than a tolerance. A host whose
distrust is above its trust and reaches half of what a wholly blocked host has by itself is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textkit import stored

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOLERANCE, MOST_ROUNDS = 1e-7, 2000
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what is after the first :// up to /, ? or # with A-Z lower-cased; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, DOWN), path


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, n): absolute links between different hosts; pages has host."""
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), target.alias("dst")).withColumn("dst", F.translate("dst", UPPER, DOWN))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    """(host, trust, distrust) within TOLERANCE of the fixed point. seeds: host, t, d in [0, 1]; links: src, dst, n.

    A round adds what paths of one more link carry: never less than nothing, and in all `damping` times what the round before
    added at most. So the sums over all hosts tell how much the paths not yet followed can carry. MOST_ROUNDS without an end is an error.
    """
    ahead = links.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    back = links.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = ahead.union(back)
    share = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = stored(both.join(share, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("w")), "edges")
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("t"), F.lit("d"), F.col("d"))).alias("kind", "s")).filter("s > 0")
    start = stored(start.select("kind", "host", (F.col("s") * (1 - damping)).alias("s")), "seeds")
    mass = lambda rows: rows.agg(F.sum("s")).first()[0] or 0.0
    state, held, block = start, mass(start), 4
    for _ in range(0, MOST_ROUNDS, block):
        for _ in range(block):
            moved = state.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("s") * F.col("w") * damping).alias("s"))
            state = start.union(moved).groupBy("kind", "host").agg(F.sum("s").alias("s"))
        state = stored(state, "ranks")  # short lineage
        before, held = held, mass(state)
        if (held - before) * damping**block / (1 - damping**block) <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"trust has not settled after {MOST_ROUNDS} rounds: the last {block} added {held - before}")
    state = state.withColumn("s", F.round("s", 9))
    out = state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("s"))).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("s"))).alias("distrust"))
    return out.select("host", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("trust", "distrust")))


def judge_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), damping: float = 0.85) -> DataFrame:
    """The columns in keep with host, path, rule (or null), verdict (allow or block), trust and distrust.

    rules: verdict by rule, a host and a path like `net/fr/`; the longest that fits decides. Elsewhere the host's trust and
    distrust decide; a host without either is allowed, and so are urls that are null or have no ://. Null html has no links.
    Repeated rows are judged alike and count again in their host's shares and links. An empty table gives an empty table.
    Columns of keep that are called host, path, rule, verdict, trust or distrust would clash and are refused.
    """
    clash = {"host", "path", "rule", "verdict", "trust", "distrust"} & set(keep)
    if clash:
        raise ValueError(f"columns that clash with results: {sorted(clash)}")
    host, path = split_url(F.col(url))
    split = pages.select(*keep, F.col(html).alias("html"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, word in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(word)).otherwise(verdict)
    ruled = ruled.withColumn("ruled", verdict)
    share = lambda word: (F.count_if(F.col("ruled") == word) / F.count("*"))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("t"), share("block").alias("d"))
    scores = spread(host_links(ruled, "html"), seeds, damping)
    out = ruled.drop("html").join(scores, "host", "left")
    for c in ("trust", "distrust"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= round((1 - damping) / 2, 6))
    return out.select(*keep, "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
