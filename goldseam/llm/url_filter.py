"""URL filter: host and path rules first, then a ratio of two character language models.

The rules decide what they fit, and what they allow and block trains two Markov
models of the other URLs' characters, of orders 0 to 4. A probability is that of
the longest context, drawn towards the next shorter one by a fixed weight, down to
the uniform distribution. A URL's score is its log-likelihood difference per
character; the bound between block and allow is calibrated on the URLs that rules
decide.

Everything is counted and scored over distinct windows of five characters, which
are far fewer than the URLs; digits count as one character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import cut, lookup

SPAN = 5
PULL = 2.0
ALPHABET = 64
BINS = 64
#: One URL in so many is kept for the bound.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


# Fixed values.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def decide(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(out)
    return out


def model_text(url: Column) -> Column:
    """What the models read: the URL without its scheme, ASCII lower case, digits as 0, rare characters as ?, padded."""
    body = lower_ascii(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    body = F.regexp_replace(F.regexp_replace(body, "[0-9]", "0"), r"[^a-z0/?#&=._%+:@~-]", "?")
    return F.concat(F.lit("^" * (SPAN - 1)), body, F.lit("$"))


def window_scores(windows: DataFrame) -> DataFrame:
    """From (window, good, bad), one row per window: its log-likelihood difference.

    Order by order from the shortest: counts of the last k characters and of the
    context before the last of them, joined to the probabilities of order k - 1.
    """
    level = None
    for k in range(1, SPAN + 1):
        tail = F.substring("window", SPAN - k + 1, k)
        counts = cut(windows.groupBy(tail.alias("tail")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        context = F.substring("tail", 1, k - 1)
        totals = cut(
            counts.groupBy(context.alias("context")).agg(F.sum("good").alias("good_total"), F.sum("bad").alias("bad_total"))
        )
        rows = lookup(counts.withColumn("context", context), totals, ["context"])
        if level is None:
            rows = rows.withColumns({"good_before": F.lit(1 / ALPHABET), "bad_before": F.lit(1 / ALPHABET)})
        else:
            before = level.toDF("shorter", "good_before", "bad_before")
            rows = lookup(rows.withColumn("shorter", F.substring("tail", 2, k - 1)), before, ["shorter"])
        level = cut(
            rows.select(
                "tail",
                *((F.col(c) + PULL * F.col(f"{c}_before")) / (F.col(f"{c}_total") + PULL) for c in ("good", "bad")),
            ).toDF("tail", "good", "bad")
        )
    return level.select(F.col("tail").alias("window"), F.log(F.col("good") / F.col("bad")).alias("difference"))


def calibrated_bound(scored: DataFrame) -> float | None:
    """The score that parts allowed from blocked with the least balanced error; None if either is missing.

    Scores are summed in bins of 1/64, of which there are a few hundred at most.
    """
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = sorted((r["bin"], r["good"], r["bad"]) for r in bins.filter("good + bad > 0").collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    # A bound anywhere between two bins parts them alike: the middle is taken.
    best, lost, passed, last = (2.0, 0.0), 0, bad, rows[0][0] - 1
    for number, more_good, more_bad in rows:
        best = min(best, (lost / good + passed / bad, (last + 1 + number) / 2))
        lost, passed, last = lost + more_good, passed - more_bad, number
    return best[1] / BINS


def held_out(body: Column) -> Column:
    """A share of the URLs, by hash, that the models are not fitted on and the bound is found on."""
    return F.pmod(F.xxhash64(F.lit("bound"), body), F.lit(HELD_OUT)) == 0


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score (log-likelihood difference per character).

    A null URL, or one without "://", has an empty host and path and no rule, and is
    judged by the models as the text that it is. One in HELD_OUT of the URLs that rules
    decide is kept out of the models, and the bound is the best for these; without any of
    one verdict among them, for all. Without URLs that rules decide, all scores are 0 and
    the verdict is allow. No rows in, none out. Other columns are not read.
    """
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    urls = urls.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), model_text(F.col("url")).alias("body"))
    host, path = F.col("host"), F.col("path")
    ruled = urls.withColumns(
        {"rule": decide(rules, host, path, lambda r: r.name), "fixed": decide(rules, host, path, lambda r: r.verdict)}
    )
    bodies = cut(
        ruled.groupBy("body").agg(
            F.count_if(F.col("fixed") == "allow").alias("good"), F.count_if(F.col("fixed") == "block").alias("bad")
        )
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.length("body") - SPAN + 1), lambda i: F.substring(F.col("body"), i, F.lit(SPAN))
    )
    fit = {c: F.when(held_out(F.col("body")), 0).otherwise(F.col(c)).cast("long") for c in ("good", "bad")}
    dealt = bodies.withColumns(fit).select("body", "good", "bad", F.explode(windows).alias("window"))
    differences = window_scores(cut(dealt.groupBy("window").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))))
    scores = lookup(dealt.select("body", "window"), differences, ["window"]).groupBy("body").agg(
        F.avg("difference").alias("score")
    )
    scored = cut(bodies.join(scores, "body"))
    bound = calibrated_bound(scored.filter(held_out(F.col("body"))))
    if bound is None:
        bound = calibrated_bound(scored) or 0.0
    verdict = F.coalesce(F.col("fixed"), F.when(F.col("score") >= bound, "allow").otherwise("block"))
    # 128 bits stand for a URL, so that what may be broadcast has a fixed width.
    hashes = {f"h{n}": F.xxhash64(F.lit(n), "body") for n in (1, 2)}
    found = scored.withColumns(hashes).select("h1", "h2", "score")
    return lookup(ruled.withColumns(hashes).drop("body"), found, ["h1", "h2"]).select(
        F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score"
    )
