"""URL filters, in DataFrame functions only.

Rules on host and path decide first; other URLs go to a logistic regression on hashed character n-grams of host and
path, fitted by plain gradient steps in SQL over a small labelled table of URLs. Weights have a fixed size and travel
as one array literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import rows_of, staged, unstage

#: Rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS, GRAM, STEPS, RATE, DECAY = 2048, 3, 60, 4.0, 0.0005
#: The labelled table, of URLs of our own under names kept for examples: 1 is to be blocked.
LABELLED = (
    *((u, 1) for u in ("content-mill.invalid/a/1", "www.junk-links.invalid/b/22.html", "m.spammy-offers.invalid/c/33", "cheap-pills.shop.example/buy/now", "free-casino-bonus.example/win", "online-casino.example/slots/play", "best-poker-bonus.example/join", "adult-cams.example/live", "xxx-videos.example/watch/1", "hot-porn.example/free", "win-free-prize.example/claim", "click-here-free.example/offer", "replica-watches.example/sale", "payday-loans.example/apply", "viagra-cheap.example/order", "warez-crack.example/download", "torrent-cracks.example/get/2", "link-farm.example/links/77", "seo-spam.example/backlinks", "betting-tips.example/odds", "spamblog.example/post/3", "free-gift-cards.example/win", "phishing-login.example/verify", "malware-downloads.example/setup.exe", "doorway-page.example/kw/9", "www.click-farm.example/en/41", "content-farm.example/fr/page/7/", "spam-site.example/de/3", "m.spammers.example/es/980/")),
    *((u, 0) for u in ("www.riverside.invalid/en/story/", "blog.harbour.invalid/notes/27/", "m.meadow.invalid/en/57", "orchard.invalid/de/seite/", "lighthouse.invalid/fr/page/42/", "m.bakery.invalid/es/67/", "thinker.invalid/essays/52/", "www.weaver.invalid/en/86", "news.town.example/en/world/12", "docs.tool.example/guide/start", "wiki.town.example/en/History", "university.example/research/paper", "library.example/books/42", "museum.example/art/7", "blog.cook.example/2020/05/notes", "recipes.example/soup", "weather.example/today", "health.example/topics/sleep", "science.example/physics/1", "forum.garden.example/thread/88", "city.example/council/minutes", "school.example/lessons/3", "journal.example/article/15", "code.example/project/readme", "travel.example/fr/paris", "www.anderson.example/en/8601/", "m.thornton.example/fr/212", "blog.ingham.example/de/2980/", "hendrik.example/es/907", "www.rowan.example/en/45/", "m.estate.example/en/731")),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: then up to ?, # or the end."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/``) and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, buckets: int = BUCKETS, n: int = GRAM) -> Column:
    """Bucket numbers of the character n-grams of host and of path, each between marks."""

    def of(text: Column, mark: str) -> Column:
        t = F.concat(F.lit(mark), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(mark), t.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(of(host, "^"), of(path, "/"))


def fit(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights of the buckets and, last, the intercept: gradient steps inside one SQL fold over the small table."""
    rows = ", ".join(f"('http://{u}', {y})" for u, y in labelled)
    table = spark.sql(f"select * from values {rows} as t(url, y)")
    host, path = host_and_path(F.col("url"))
    data = table.select(F.array_sort(F.array_distinct(grams(host, path, buckets))).alias("x"), F.col("y").cast("double").alias("y")).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("rows"))
    # Few buckets occur: dense positions 0.. of those, so that a step costs what the small table does.
    data = data.withColumn("used", F.array_sort(F.array_distinct(F.flatten("rows.x")))).withColumn("at", F.expr("transform(rows, r -> named_struct('y', r.y, 'x', transform(r.x, b -> cast(array_position(used, b) as int) - 1)))"))
    data = data.withColumn("by", F.expr("transform(sequence(0, size(used) - 1), k -> filter(sequence(0, size(at) - 1), j -> array_contains(at[j].x, k)))"))
    n = len(labelled)
    error = "transform(at, r -> (1 / (1 + exp(-(w[size(used)] + aggregate(r.x, 0D, (a, k) -> a + w[k]) / sqrt(size(r.x))))) - r.y))"
    down = f"concat(transform(by, (js, k) -> w[k] * (1 - {rate * decay}) - {rate / n} * aggregate(js, 0D, (a, j) -> a + e[j] / sqrt(size(at[j].x)))), array(w[size(used)] - {rate / n} * aggregate(e, 0D, (a, b) -> a + b)))"
    step = staged(data.select("used", "at", "by"), "urls")  # one row of fixed size
    weights = step.select("used", F.expr(f"aggregate(sequence(1, {steps}), array_repeat(0D, size(used) + 1), (w, i) -> element_at(transform(array({error}), e -> {down}), 1))").alias("w")).first()
    unstage(step)
    out = [0.0] * (buckets + 1)
    for b, w in zip(weights.used, weights.w):
        out[b] = w
    out[buckets] = weights.w[-1]
    return out


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of being blocked) of each row.

    A null url or one without :// has an empty host and path, fits no rule and goes to the model; of rules that fit, the
    longest wins, and a score of just one half allows. Long urls are read whole. Repeated rows stay, further columns go;
    an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parts = rows_of(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    table = F.array(*map(F.lit, weights[:-1]))
    x = F.array_distinct(grams(F.col("host"), F.col("path"), len(weights) - 1))
    summed = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.col("_w")[b]) / F.sqrt(F.size(x))
    scored = parts.withColumn("_w", table).withColumn("score", 1 / (1 + F.exp(-(F.lit(weights[-1]) + summed))))
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(spark))
