"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path.

Everything here is a DataFrame expression, training included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespan.llm.common import materialize
from treespan.plans.lineage import small

#: Buckets that n-grams are hashed to, their length, and the passes over the labelled urls.
BUCKETS = 512
GRAM = 3
PASSES = 40
RATE = 6.0
#: Most urls to train from: they go into one row.
MOST_LABELLED = 2000
#: A list of so many rules at most becomes one expression; longer lists, and tables of any length, are joined.
MOST_IN_EXPRESSION = 200
BLOCK_AT = 0.5

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A small labelled table for use without one of one's own: 1 is to be blocked.
LABELLED = tuple(
    [(f"https://{u}", 1) for u in (
        "casino-bonus.bet/free-spins", "www.bestcasino.win/slots/jackpot", "poker-online.bet/bonus", "xxx-tube.example/porn/videos", "freeporn.cam/xxx/123",
        "adult-cams.live/sexy/show", "cheap-viagra.shop/buy/pills", "pharmacy-online.shop/viagra/discount", "pills4you.shop/cialis/buy-now", "winner-prize.click/claim?id=1",
        "free-iphone.click/win/prize", "track.adserver.biz/click/banner", "ads.doubleclick.example/pixel/track", "pixel.tracker.biz/ad/banner.gif", "cracked-games.download/keygen",
        "warez.download/serial/crack", "torrent-movies.download/free/crack.zip", "malware-update.xyz/install.exe", "secure-login-bank.xyz/verify/account", "paypa1-login.xyz/verify/password",
        "earn-money-fast.biz/crypto/profit", "crypto-doubler.biz/invest/bonus", "hot-singles.date/sexy/chat", "sexy-dating.date/adult/signup", "replica-watches.shop/cheap/rolex",
    )]
    + [(f"https://{u}", 0) for u in (
        "en.wikipedia.org/wiki/Mathematics", "de.wikipedia.org/wiki/Physik", "docs.python.org/3/library/re.html", "spark.apache.org/docs/latest/", "www.gutenberg.org/ebooks/1342",
        "news.site.com/2020/05/science-report", "www.university.edu/research/papers", "library.university.edu/catalog/item/9", "www.museum.org/collection/painting", "blog.engineer.dev/posts/databases",
        "www.example.org/en/100", "m.example.org/de/2000", "www.example.com/en/31", "blog.example.com/fr/4711", "shop.example.com/es/55.html",
        "stackoverflow.com/questions/11227809", "www.weather.gov/forecast/local", "www.parliament.uk/business/debates", "recipes.kitchen.com/soup/tomato", "www.hospital.org/health/guide",
        "www.nature.com/articles/s41586", "arxiv.org/abs/1706.03762", "www.court.gov/opinions/2019", "travel.guide.com/italy/rome", "forum.garden.net/topic/roses",
    )]
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, with A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (of equally long ones the first given) and its verdict, both null without one."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def with_rule(df: DataFrame, host_col: str, path_col: str, rules: DataFrame, rule_col: str, verdict_col: str) -> DataFrame:
    """Adds the longest fitting rule and its verdict, both null without one, from a table of rules (host, path, verdict).

    Rules of one host are one row; rows of `df` look up their host's last label, last two labels and so on, one equi-join
    for each number of labels that rules have. Rows aren't multiplied, and join sides are broadcast only where they are
    few. Of equally long rules the least one goes first; rules with a null host or path fit nothing.
    """
    longest = F.struct((-F.length(F.concat("host", "path"))).alias("n"), F.concat("host", "path").alias("rule"), "path", "verdict")
    known = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    known = known.groupBy("host").agg(F.array_sort(F.collect_set(longest)).alias("own")).withColumn("labels", F.size(F.split("host", "[.]")))
    known = materialize(known)
    labels = F.split(host_col, "[.]")
    out, best = df, F.lit(None).cast("struct<n:int,rule:string,path:string,verdict:string>")
    for n in sorted(r.labels for r in known.select("labels").distinct().collect()):
        own = small(known.where(F.col("labels") == n).select(F.col("host").alias("__of"), F.col("own").alias(f"__own{n}")))
        last = F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
        out = out.withColumn("__last", last).join(own, F.col("__last") == F.col("__of"), "left").drop("__of", "__last")
        fits = F.get(F.filter(f"__own{n}", lambda r: F.col(path_col).startswith(r["path"])), F.lit(0))
        best = F.least(best, fits)  # nulls are skipped; the longest has the least n
    return out.withColumn("__best", best).withColumns({rule_col: F.col("__best.rule"), verdict_col: F.col("__best.verdict")}).select(*df.columns, rule_col, verdict_col)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for all its uses, those in lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(host_col: Column, path_col: Column) -> Column:
    """Buckets of the character n-grams of host and of path, repeats included."""

    def of(mark: str, text: Column) -> Column:
        gram = lambda ch, i: F.concat(*(F.coalesce(F.get(ch, i + k), F.lit("")) for k in range(GRAM)))
        bucket = lambda ch, i: F.pmod(F.xxhash64(gram(ch, i)), F.lit(BUCKETS)).cast("int")
        every = lambda ch: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ch) - GRAM, F.lit(0))), lambda i: bucket(ch, i))
        return _with(F.split(F.concat(F.lit(mark), text, F.lit("$")), ""), every)

    return F.concat(of("^", host_col), of("~", path_col))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> list[float]:
    """Weights, the constant last: gradient steps over the labelled urls as one aggregation of one row.

    Labels are 1 (block) and 0 (allow); rows with nulls are left out, repeated ones count again. Without rows
    all weights are zero. The result has BUCKETS + 1 numbers whatever the table's size.
    """
    rows = labelled.select(F.col(url_col).alias("u"), F.col(label_col).cast("double").alias("y")).where("u is not null and y is not null").limit(MOST_LABELLED + 1)
    g = grams(host(F.col("u")), path(F.col("u")))
    held = rows.select(F.struct(F.xxhash64("u").alias("h"), "u", "y", g.alias("g")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"), F.count("*").alias("n"))
    share = lambda g: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(g, lambda x: x == b)) / F.size(g))
    held = held.select("n", F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.concat(share(r["g"]), F.array(F.lit(1 / BUCKETS))).alias("x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        z = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        by = F.lit(RATE) * (row["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        return _with(by, lambda by: F.zip_with(w, row["x"], lambda a, b: a + by * b))

    zero = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    seen = F.flatten(F.array_repeat(F.col("rows"), PASSES))
    got = held.select("n", F.aggregate(seen, zero, step).alias("w")).first()
    if got.n > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled urls")
    return got.w


def score(host_col: Column, path_col: Column, weights: list[float]) -> Column:
    """Probability that a url is to be blocked."""
    w = F.array(*(F.lit(float(x)) for x in weights[:BUCKETS]))
    mean = _with(grams(host_col, path_col), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(w, b)) / F.size(g))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(mean + F.lit(weights[BUCKETS] / BUCKETS))))


def judge(df: DataFrame, weights: list[float], rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score of each url; columns of these names are replaced.

    Rules are a list or a table of (host, path, verdict).
    Null urls and urls without :// have an empty host and path and are judged by the model. Rows are independent.
    """
    url = F.col(url_col)
    added = ("host", "path", "rule", "verdict", "score")
    out = df.select("*", host(url).alias("__h"), path(url).alias("__p"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_IN_EXPRESSION:
        rules = df.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    if isinstance(rules, DataFrame):
        out = with_rule(out, "__h", "__p", rules, "__r", "__v")
    else:
        rule, verdict = matching_rule(F.col("__h"), F.col("__p"), rules)
        out = out.withColumns({"__r": rule, "__v": verdict})
    out = out.withColumn("__s", score(F.col("__h"), F.col("__p"), weights))
    kept = [c for c in df.columns if c not in added or c == url_col]
    verdict = F.coalesce("__v", F.when(F.col("__s") >= BLOCK_AT, "block").otherwise("allow"))
    return out.select(*kept, F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("__r").alias("rule"), verdict.alias("verdict"), F.col("__s").alias("score"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED))
    return spark.range(1).select(F.inline(rows))
