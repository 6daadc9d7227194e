"""URL filter: rules by host and path and, where no rule fits, a ratio of two character language models.  DataFrame operations only.

**Rules.**  A rule such as ``allow example.com/en/`` fits the host and all its subdomains if the path starts with the rule's; of the
rules that fit, the longest wins.

**Models.**  The URLs that rules allow and those that rules block train two Markov models of variable order over characters, with Witten-Bell
smoothing.  With n(g) the count of a gram g (a context and a character), N the count of its context and T the number of different characters
seen behind the context,

    P(g) = (n(g) + T * P(g without its first character)) / (N + T),    P(g) = P(g without its first character) where N = 0,

down to a uniform chance of 1 / ``ALPHABET``.  Only grams seen ``min_count`` times in both models together are kept, so contexts are as long as the
data support them, up to ``order`` characters.

**Score.**  The log ratio of a URL's two likelihoods is a sum over its substrings: one that is a kept gram adds the change that the gram makes
to the ratio of its shorter gram, one that is a kept context adds the ratio of the two models' escape weights T / (N + T), all
others add nothing.  So a model is a table of substrings and weights, and scoring is one join and one sum.  Weights are whole
millionths: sums don't depend on their order, and a recomputed task gives the same verdict.  The score is that sum over the
number of characters, the end included: positive where the model of allowed URLs is the likelier.

**Calibration.**  A quarter of the labelled URLs (the first hex digit of their MD5 is 0, 4, 8 or c) trains nothing; scores fall in cells of a hundredth,
the cell is found below which it is best to block (largest sum of the shares rightly allowed and rightly blocked; the lowest of equals), and
the limit lies in the middle of the gap between it and the next lower cell that holds a score.  URLs that score below the limit are blocked.  Without both kinds of URLs to train on, no model is made and URLs without a rule are allowed with a null score.

**Bounds.**  All different URLs that a rule decides train or calibrate.  Weights are broadcast only when
measured small.  Long URLs are cut into overlapping blocks, so that a row of grams stays small.

A null URL or one without ``://`` has an empty host and path, fits no rule, and is scored as it is (null as empty).  Repeated rows are judged alike; rows
with null in any column stay; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.storage import checkpointed, small_side, unused_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand before and behind a URL.
START, END = "\x02", "\x03"
ALPHABET = 65_536
#: Whole parts of a weight.
PARTS = 1_000_000
#: Characters of a URL whose grams are made at a time.
BLOCK = 1000
#: Hundredths of the score that a limit is looked for in.
WIDEST = 2000

# The rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and for URLs without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty for null and for URLs without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The (rule, verdict) that fits, null if none does; of several, the longest, then the first."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        on, slash, below = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + below)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def grams(urls: DataFrame, order: int, keep: tuple[str, ...]) -> DataFrame:
    """One row for each substring of at most ``order`` + 1 characters of a framed ``url``: the columns ``keep`` and ``gram``."""
    framed = urls.select(*keep, F.concat(F.lit(START), "url", F.lit(END)).alias("_url"))
    starts = F.sequence(F.lit(1), F.char_length("_url"), F.lit(BLOCK))
    blocks = framed.select(*keep, F.explode(F.transform(starts, lambda at: F.substr("_url", at, F.lit(BLOCK + order)))).alias("_block"))
    letters = blocks.select(*keep, F.split("_block", "").alias("_c"))

    def of_length(m: int) -> Column:
        last = F.least(F.size("_c") - m, F.lit(BLOCK - 1))
        joined = lambda i: reduce(lambda a, b: F.concat(a, b), [F.get("_c", i + k) for k in range(m)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), joined)).otherwise(F.array().cast("array<string>"))

    return letters.select(*keep, F.explode(F.concat(*[of_length(m) for m in range(1, order + 2)])).alias("gram"))


def weights(labelled: DataFrame, order: int, min_count: int) -> DataFrame:
    """``gram`` and ``weight`` (millionths) of the two models; the empty gram's row is added once for each character.

    ``labelled`` has ``url`` and ``allowed``; counts are summed where the URLs are before they are shuffled.
    """
    counts = grams(labelled, order, ("allowed",)).where(F.col("gram") != START).groupBy("gram")
    counts = counts.agg(F.sum(F.col("allowed").cast("long")).alias("n1"), F.sum((~F.col("allowed")).cast("long")).alias("n0"))
    kept = checkpointed(counts.where(F.col("n1") + F.col("n0") >= min_count).withColumn("context", F.expr("left(gram, char_length(gram) - 1)")))
    sums = [f(c).alias(to) for c, n, t in (("n1", "total1", "kinds1"), ("n0", "total0", "kinds0")) for f, to in ((F.sum, n), (lambda x: F.count_if(F.col(x) > 0), t))]
    contexts = kept.groupBy("context").agg(*sums)
    stats = kept.join(contexts, "context").select("gram", F.struct(F.char_length("gram").alias("length"), "n1", "total1", "kinds1", "n0", "total0", "kinds0").alias("stat"))
    shorter = kept.select(F.col("gram").alias("whole"), F.explode(F.expr("transform(sequence(1, char_length(gram)), i -> right(gram, i))")).alias("gram"))
    chains = shorter.join(stats, "gram").groupBy("whole").agg(F.array_sort(F.collect_list("stat")).alias("chain"))  # order + 1 entries at most

    def chance(chain: Column, which: int) -> Column:
        step = lambda p, s: F.when(s[f"total{which}"] > 0, (s[f"n{which}"] + s[f"kinds{which}"] * p) / (s[f"total{which}"] + s[f"kinds{which}"])).otherwise(p)
        return F.aggregate(chain, F.lit(1.0 / ALPHABET), step)

    def ratio(chain: Column) -> Column:
        return F.log(chance(chain, 1)) - F.log(chance(chain, 0))

    left = lambda which: F.when(F.col(f"total{which}") > 0, F.col(f"kinds{which}") / (F.col(f"total{which}") + F.col(f"kinds{which}"))).otherwise(1.0)
    escapes = contexts.select(F.col("context").alias("gram"), (F.log(left(1)) - F.log(left(0))).alias("weight"))
    own = F.element_at("chain", -1)
    escape = lambda which: F.when(own[f"total{which}"] > 0, own[f"kinds{which}"] / (own[f"total{which}"] + own[f"kinds{which}"])).otherwise(1.0)
    change = ratio(F.col("chain")) - ratio(F.slice("chain", 1, F.size("chain") - 1)) - (F.log(escape(1)) - F.log(escape(0)))
    both = chains.select(F.col("whole").alias("gram"), change.alias("weight")).unionByName(escapes)
    return both.select("gram", F.round(F.col("weight") * PARTS).cast("long").alias("weight")).groupBy("gram").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def scores(urls: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``id`` and ``score`` of URLs (``id``, ``url``; one row an id); ``model`` is checkpointed."""
    each = model.where("gram = ''").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    table = small_side(model.where("gram <> ''"))
    found = grams(urls, order, ("id",)).join(table, "gram").groupBy("id").agg(F.sum("weight").alias("weight"))
    length = F.char_length("url") + 1
    # Both sides have a row an id: the sums join the URLs that they were made of.
    return urls.join(found, "id", "left").select("id", ((F.coalesce("weight", F.lit(0)) + each * length) / length / PARTS).alias("score"))


def best_limit(scored: DataFrame) -> float | None:
    """The limit that parts ``allowed`` scores best; None without scores of both kinds."""
    cell = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(F.col("score") * 100))).cast("int")
    cells = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("allowed").cast("long")).alias("good"), F.sum((~F.col("allowed")).cast("long")).alias("bad"))  # 2 * WIDEST + 1 rows at most
    upward, every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shares = cells.select("cell", F.coalesce(F.sum("bad").over(upward), F.lit(0)).alias("stopped"), F.coalesce(F.sum("good").over(upward), F.lit(0)).alias("lost"), F.sum("good").over(every).alias("goods"), F.sum("bad").over(every).alias("bads"), F.lag("cell").over(Window.orderBy("cell")).alias("lower"))
    best = shares.where("goods > 0 and bads > 0").orderBy(F.desc(F.col("stopped") * F.col("goods") - F.col("lost") * F.col("bads")), "cell").first()
    if best is None:
        return None
    return (best["cell"] if best["lower"] is None else (best["lower"] + 1 + best["cell"]) / 2) / 100


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", order: int = 4, min_count: int = 3, limit: float | None = None
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score`` (null where a rule decides); columns of these names are replaced.

    ``limit`` replaces the calibrated one.
    """
    names = ("host", "path", "rule", "verdict", "score")
    kept = pages.drop(*(c for c in names if c != url))
    at, found, out_of = (unused_name(kept, c) for c in ("_host", "_rule", "_id"))
    ruled = kept.withColumn(at, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    ruled = ruled.withColumn(found, rule_for(F.col(f"{at}.host"), F.col(f"{at}.path"), rules))
    ruled = ruled.withColumn(out_of, F.when(F.col(found).isNull(), F.md5(F.coalesce(F.col(url), F.lit("")))))
    plain = ruled.select(F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(f"{found}.verdict").alias("verdict"))
    verdicts = _verdicts(plain, order, min_count, limit)
    columns = [F.col(f"`{c}`") for c in kept.columns if c not in names]
    decided = [F.col(f"{at}.host").alias("host"), F.col(f"{at}.path").alias("path"), F.col(f"{found}.rule").alias("rule")]
    if verdicts is None:
        return ruled.select(*columns, *decided, F.coalesce(F.col(f"{found}.verdict"), F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    named = verdicts.select(F.col("id").alias(out_of), F.col("verdict").alias(f"{out_of}v"), F.col("score").alias(f"{out_of}s"))
    # Rows that a rule decides have a null id: a join would deal them all to one task, so they pass beside it.
    joined = ruled.where(F.col(out_of).isNotNull()).join(named, out_of, "left")
    by_model = joined.select(*columns, *decided, F.col(f"{out_of}v").alias("verdict"), F.col(f"{out_of}s").alias("score"))
    by_rule = ruled.where(F.col(out_of).isNull()).select(*columns, *decided, F.col(f"{found}.verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(by_model)


def _verdicts(plain: DataFrame, order: int, min_count: int, limit: float | None) -> DataFrame | None:
    """``id``, ``verdict`` and ``score`` of the different URLs without a rule; None if no model can be made."""
    labelled = plain.where(F.col("verdict").isNotNull()).select(F.md5("url").alias("id"), "url", (F.col("verdict") == "allow").alias("allowed"))
    different = labelled.groupBy("id").agg(F.first("url").alias("url"), F.first("allowed").alias("allowed"))  # equal ids: the same URL, so the same rule
    # A URL makes some 200 grams, so a small table of URLs is dealt to all tasks, not merged into a few.
    taught = checkpointed(different.repartition(int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))
    if taught.select("allowed").distinct().count() < 2:
        return None
    held = F.substr("id", F.lit(1), F.lit(1)).isin("0", "4", "8", "c")
    model = checkpointed(weights(taught.where(~held), order, min_count))
    if limit is None:
        limit = best_limit(scores(taught.where(held).select("id", "url"), model, order).join(taught, "id"))
    if limit is None or model.isEmpty():
        return None
    rest = plain.where(F.col("verdict").isNull()).groupBy(F.md5("url").alias("id")).agg(F.first("url").alias("url"))
    return scores(rest, model, order).select("id", F.when(F.col("score") >= limit, "allow").otherwise("block").alias("verdict"), "score")
