"""URL filter: rules first, then words of the host and a naive Bayes score.

Names in hosts are words written together. A unigram model over the words of all page titles, of
path parts and of hyphenated host parts gives each word its cost; a Viterbi pass finds the cheapest
split of every name. Host words and path parts are the tokens of a URL, and multinomial naive Bayes
scores them.

The classifier learns from seed words: a URL with one of them among its tokens is taken for bad, any
other for good, and what occurs along with seeds gains weight. All counts come from all pages, summed
map-side, and stay tables of any size: the parts of every distinct host that may be words are joined
with the unigram table, so the Viterbi pass of a host sees the words of that host and no others; the
tokens of all pages are joined with the table of their odds, which are summed per page. Nothing is
sent to all tasks, and no word is too rare to count.
"""

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newstide.llm.common import row_udf
from newstide.sources.layout import written

# (rule, verdict): host and path start of what a rule fits. The longest wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))
# Words that mark a bad address.
SEEDS = ("spam", "casino", "casinos", "bets", "betting", "gambling", "poker", "jackpot", "pills",
         "viagra", "pharma", "porn", "adult", "xxx", "sex", "escort", "ads", "adserver", "tracker",
         "track", "clickbait", "malware", "phishing", "warez", "torrent", "crack")
SMOOTHING = 0.5
# Log odds of bad from which a URL is blocked.
BLOCK_FROM = 0.0
# Fixed value: the longest host name there is (RFC 1035). A longer run of letters is no name; it is
# one token and not split.
LONGEST_NAME = 253
# Letters, marks and digits of any script.
_WORD = r"[\p{L}\p{M}\p{N}]+"
# Odds are summed as exact decimals, so that a score depends on no order.
_ODDS = "decimal(30,15)"


def _lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, null without one. Of equal rules the first is found."""
    found = F
    for rule in sorted({name for name, _ in rules}, key=lambda r: (-len(r), r)):
        domain, slash, start = rule.partition("/")
        fits = (((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start))
        found = found.when(fits, rule)
    return F.lit(None).cast("string") if found is F else found


def _title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1),
                      F.array().cast("array<string>"))


def _path_words(path: Column) -> Column:
    """Words of a path, percent escapes decoded where they are whole."""
    return _words(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit(" "))), path))


@dataclass(frozen=True)
class Unigrams:
    """Cost (negative log probability) of known words, and of a letter outside any. For the split of
    a name it is enough to know the words that occur in it."""

    costs: Mapping[str, float]
    letter: float

    def split(self, name: str) -> list[str]:
        """Cheapest split of a name of letters; what fits no word stays together.

        ``best[i]`` is the cost of the first i letters and ``start[i]`` where their last word begins.
        """
        best, start = [0.0], [0]
        longest = max(map(len, self.costs), default=0)
        for end in range(1, len(name) + 1):
            cost, at = best[end - 1] + self.letter, end - 1
            for begin in range(max(end - longest, 0), end):
                word = self.costs.get(name[begin:end])
                if word is not None and best[begin] + word < cost:
                    cost, at = best[begin] + word, begin
            best.append(cost)
            start.append(at)
        words, end = [], len(name)
        while end:
            words.append(name[start[end]:end])
            end = start[end]
        merged: list[str] = []
        loose = False
        for word in reversed(words):
            known = word in self.costs
            if not known and loose:
                merged[-1] += word
            else:
                merged.append(word)
            loose = not known
        return merged


def learn_unigrams(pages: DataFrame, url_col: str = "url", html_col: str | None = "html",
                   seeds: Sequence[str] = SEEDS) -> tuple[DataFrame, int]:
    """Table (word, n) from all pages, of titles, path parts and host parts that stand alone, and
    the number that costs refer to. A seed that no page has counts as seen once."""
    url = pages[url_col]
    hosts = F.filter(F.split(host_of(url), r"[.:@]"), lambda part: part.contains("-"))
    sources = [_path_words(path_of(url)), _words(F.array_join(hosts, " "))]
    if html_col is not None:
        sources.append(_words(_title(pages[html_col])))
    seen = (pages.select(F.explode(F.concat(*sources)).alias("word")).where(F.length("word") > 1)
            .groupBy("word").agg(F.count("*").alias("n")))
    wanted = pages.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(seed) for seed in seeds]).cast("array<string>")).alias("word"),
        F.lit(0).cast("bigint").alias("n"))
    counts = written(seen.union(wanted).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")),
                     "unigrams")
    return counts, (counts.agg(F.sum("n")).first()[0] or 0) + 1


def _splitter(total: int):
    """Words of the names of a host, from the counts of the words that occur in them."""

    def make():
        def split(names, found):
            costs = {word["word"]: math.log(total / word["n"]) for word in found or ()}
            # a letter costs more than a word seen once
            model = Unigrams(costs, math.log(total) + math.log(26))
            return ([word for name in names for word in
                     (model.split(name) if len(name) <= LONGEST_NAME else [name])],)

        return split

    return make


def split_hosts(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, words) for every distinct host of a table with that column.

    Every stretch of a name that is as long as some word is joined with the counts: at most as many
    rows per host as its letters times the lengths of words."""
    distinct = written(hosts.select("host").distinct()
                       .select("host", _words(F.col("host")).alias("names")), "hosts")
    sizes = [row[0] for row in counts.select(F.length("word").alias("size")).distinct()
             .where(F.col("size") <= LONGEST_NAME).collect()]  # at most so many numbers
    lengths = F.array(*[F.lit(size) for size in sorted(sizes)]).cast("array<int>")
    stretches = (distinct.select("host", F.explode(F.array_distinct("names")).alias("name"))
                 .where(F.length("name") <= LONGEST_NAME)
                 .select("host", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
                 .select("host", "name", "at", F.explode(lengths).alias("size"))
                 .where(F.col("at") + F.col("size") - 1 <= F.length("name"))
                 .select("host", F.expr("substring(name, at, size)").alias("word")).distinct())
    found = (stretches.join(counts, "word")
             .groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("found")))
    split = row_udf("words array<string>", _splitter(total))
    return (distinct.join(found, "host", "left")
            .select("host", split("names", "found")["words"].alias("words")))


def learn_bayes(tokens: DataFrame, seeds: Sequence[str] = SEEDS) -> tuple[DataFrame, float]:
    """Table (token, odds) with the log odds of bad for every token in any row of a table with
    ``tokens``, and the log odds of the prior."""
    marks = [F.lit(f"{place}:{seed}") for place in "hp" for seed in seeds]
    bad = F.arrays_overlap("tokens", F.array(*marks).cast("array<string>"))
    marked = tokens.select("tokens", bad.cast("int").alias("bad"))
    pages = marked.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    counts = written(
        marked.select(F.explode("tokens").alias("token"), "bad").groupBy("token")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n")), "tokens")
    n_bad, n_all, keys = counts.agg(*[F.coalesce(x, F.lit(0)) for x in (
        F.sum("bad"), F.sum("n"), F.count("*"))]).first()
    width = SMOOTHING * (keys + 1)

    def log_share(n: Column, total: int) -> Column:
        return F.log((n + SMOOTHING) / F.lit(float(total + width)))

    odds = (log_share(F.col("bad"), n_bad)
            - log_share(F.col("n") - F.col("bad"), n_all - n_bad)).alias("odds")
    return counts.select("token", odds), math.log((pages[0] + 1) / (pages[1] - pages[0] + 1))


def scores(tokens: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """(rid, score): log odds of bad of every row, from the odds of its tokens."""
    summed = (tokens.select("rid", F.explode("tokens").alias("token"))
              .join(odds.select("token", F.col("odds").cast(_ODDS).alias("odds")), "token")
              .groupBy("rid").agg(F.sum("odds").cast("double").alias("odds")))
    return (tokens.select("rid").join(summed, "rid", "left")
            .select("rid", (F.coalesce("odds", F.lit(0.0)) + prior).alias("score")))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                html_col: str | None = "html", rules: Sequence[tuple[str, str]] = RULES,
                seeds: Sequence[str] = SEEDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, tokens, score.

    Null URLs and those without ``://`` have an empty host and path, no tokens and the verdict of
    the prior. Repeated rows are judged each and count each; an empty table gives an empty result.
    Tokens are words of letters and digits of any script, of hosts and of paths with their percent
    escapes decoded; a run of over 253 letters, which no host name has, is one token.
    """
    slim = written(pages.select(
        F.monotonically_increasing_id().alias("rid"), pages[id_col].alias("page_id"),
        host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
        .withColumn("path_words", _path_words(F.col("path"))), "urls")
    hosts = split_hosts(slim, *learn_unigrams(pages, url_col, html_col, seeds))

    def marked(words: str, place: str) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(place), w))

    tokens = written(slim.join(hosts, "host").select(
        "rid", "page_id", "host", "path",
        F.concat(marked("words", "h:"), marked("path_words", "p:")).alias("tokens")), "url-tokens")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    of_rule = F.lit(None).cast("string")
    for name, verdict in dict(reversed(rules)).items():
        of_rule = F.when(F.col("rule") == name, verdict).otherwise(of_rule)
    return (tokens.join(scores(tokens, *learn_bayes(tokens, seeds)), "rid")
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(
                of_rule, F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "tokens", "score"))
