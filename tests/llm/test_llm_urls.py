"""URL filter against a plain reading of the contract, segmentation, and planted addresses."""

import math
import random
import re
from collections import Counter
from urllib.parse import quote, unquote

import pytest

from newstide.llm import url_filter

PAGES = "page_id long, url string, html string, host int, tokens string, score string, rule int"
RULES = dict(url_filter.RULES)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "t", "s", 2) for i, u, h in rows], PAGES)


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for rule in RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best):
                best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http:///x", "://a.net/b", "http://A.Example.NET/en/1?q#f",
        "https://example.net/EN/1", "http://x.net", "http://x.net?a=/b", "http://x.net#/", "http://net/",
        "http://example.com/de/", "http://www.example.com/de", "http://notexample.com/de/1",
        "http://org/fr/1", "http://a.org/fr", "http://u@h.org:80/fr/x://y", "ftp://É.net/ü?",
        "http://a.b\nc.net/d\ne?f", "x://y://z.net/", "http://example.net/en/", "HTTP://NET/en/",
        "http://" + "a" * 5000 + ".net/" + "b" * 50_000]


def test_parts_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(3, URLS[3], None), (None, URLS[5], "x")]
    got = url_filter.filter_urls(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {r.page_id: r for r in got}
    for i, url in enumerate(URLS):
        host, path, rule = plain(url)
        assert (seen[i].host, seen[i].path, seen[i].rule) == (host, path, rule), url
        if rule:
            assert seen[i].verdict == RULES[rule]
    assert url_filter.filter_urls(pages_of(spark, [])).count() == 0


def brute_split(model, name):
    """Cost of the cheapest of all splits."""
    if not name:
        return 0.0
    best = model.letter + brute_split(model, name[1:])
    for end in range(1, len(name) + 1):
        if name[:end] in model.costs:
            best = min(best, model.costs[name[:end]] + brute_split(model, name[end:]))
    return best


@pytest.mark.parametrize("name", ["spamfarm", "cheappills", "freebets", "xspamx", "zzz", "", "aab",
                                  "farmspamfarm", "therapist"])
def test_viterbi_is_the_cheapest_split(name):
    costs = {"spam": 4.0, "farm": 5.0, "cheap": 5.0, "pills": 6.0, "free": 3.0, "bets": 6.0, "the": 1.0,
             "therapist": 7.0, "rapist": 8.0, "a": 2.0, "ab": 2.5, "far": 3.0}
    model = url_filter.Unigrams(costs, 9.0)
    words = model.split(name)
    assert "".join(words) == name
    total = sum(costs[w] if w in costs else model.letter * len(w) for w in words)
    assert total == pytest.approx(brute_split(model, name))


def test_bayes_counts(spark):
    rows = [(["h:spam", "h:farm"],), (["h:farm", "p:en"],), (["p:en"],), ([],)]
    table, prior = url_filter.learn_bayes(spark.createDataFrame(rows, "tokens array<string>"), ["spam"])
    odds = {r.token: r.odds for r in table.collect()}
    width = 0.5 * 4
    assert odds["h:farm"] == pytest.approx(math.log(1.5 / (2 + width)) - math.log(1.5 / (3 + width)))
    assert odds["p:en"] == pytest.approx(math.log(0.5 / (2 + width)) - math.log(2.5 / (3 + width)))
    assert prior == pytest.approx(math.log(2 / 4))


def plain_verdicts(rows, seeds):
    """Score per page from dictionaries: counts, cheapest splits and odds, in one process."""
    word = re.compile(r"[^\W_]+")
    parts = {i: plain(u)[:2] for i, u, _ in rows}
    words = Counter(seeds)
    for i, u, html in rows:
        host, path = parts[i]
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
        texts = [unquote(path), " ".join(p for p in re.split("[.:@]", host) if "-" in p),
                 title[1] if title else ""]
        words.update(w for t in texts for w in word.findall(t.lower()) if len(w) > 1)
    for seed in seeds:
        words[seed] -= words[seed] > 1
    total = sum(words.values()) + 1
    model = url_filter.Unigrams({w: math.log(total / n) for w, n in words.items()},
                                math.log(total) + math.log(26))
    tokens = {i: ["h:" + w for name in word.findall(h.lower()) for w in model.split(name)]
              + ["p:" + w for w in word.findall(unquote(p).lower())] for i, (h, p) in parts.items()}
    bad = {i for i, ts in tokens.items() if any(t[2:] in seeds for t in ts)}
    n_bad = Counter(t for i in bad for t in tokens[i])
    n_all = Counter(t for ts in tokens.values() for t in ts)
    width = 0.5 * (len(n_all) + 1)
    sum_bad, sum_all = sum(n_bad.values()), sum(n_all.values())
    odds = {t: math.log((n_bad[t] + 0.5) / (sum_bad + width))
            - math.log((n - n_bad[t] + 0.5) / (sum_all - sum_bad + width)) for t, n in n_all.items()}
    prior = math.log((len(bad) + 1) / (len(rows) - len(bad) + 1))
    return tokens, {i: prior + sum(odds[t] for t in ts) for i, ts in tokens.items()}


def test_scores_equal_a_plain_computation(spark):
    r = random.Random(3)
    some = "spam farm news weather bet365 pills über новости a1 the".split()
    rows = []
    for i in range(150):
        host = ".".join("".join(r.choices(some, k=r.randint(1, 3))) + r.choice(["", "-", "7"])
                        for _ in range(r.randint(1, 2)))
        path = "/".join(quote(r.choice(some)) if r.random() < 0.5 else r.choice(some)
                        for _ in range(r.randint(0, 3)))
        rows.append((i, f"http://{host}.com/{path}", f"<title>{' '.join(r.choices(some, k=3))}</title>"))
    tokens, score = plain_verdicts(rows, list(url_filter.SEEDS))
    for row in url_filter.filter_urls(pages_of(spark, rows)).collect():
        assert row.tokens == tokens[row.page_id]
        assert row.score == pytest.approx(score[row.page_id])


def test_a_rare_seed_decides_among_many_words(spark):
    """60,000 distinct tokens, each as frequent as a seed or more."""
    rows = [(i, f"http://site{i % 9}.com/word{i % 30_000}x{i % 7}", None) for i in range(120_000)]
    rows += [(200_000, "http://malware/xxx/warez/viagra/torrent/phishing", None),
             (200_001, "http://mallwear/xyz/wares/viadra/torment/fishing", None)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages_of(spark, rows))
           .where("page_id >= 200000 OR page_id < 20").collect()}
    assert {got[i] for i in range(20)} == {"allow"}
    assert got[200_000] == "block" and got[200_001] == "allow"


def test_long_words_and_other_scripts(spark):
    long_ = "donaudampfschifffahrtsgesellschaftskapitaen"
    title = f"<title>{long_} новости bet365 погода</title>"
    rows = [(1, f"http://{long_}spam.de/x", title), (2, "http://новостипогода.рф/%D0%BF%D0%BE%D0%B3%D0%BE%D0%B4%D0%B0", title),
            (3, "http://bet365.com/100%/a+b", title), (4, "http://" + "spam" * 100 + ".com/", title)]
    got = {r.page_id: r.tokens for r in url_filter.filter_urls(pages_of(spark, rows)).collect()}
    assert got[1] == [f"h:{long_}", "h:spam", "h:de", "p:x"]
    assert got[2] == ["h:новости", "h:погода", "h:рф", "p:погода"]
    assert got[3] == ["h:bet365", "h:com", "p:100", "p:a", "p:b"]
    assert got[4] == ["h:" + "spam" * 100, "h:com"]  # no host name has 400 letters


def test_written_together_and_beside_seeds(spark):
    title = "<title>farm of spam, cheap pills and the news of weather today</title>"
    rows = [(i, f"http://news{i % 7}.example.com/en/{i}", title) for i in range(60)]
    rows += [(100 + i, f"http://spamfarm.example.com/en/{i}", title) for i in range(5)]
    rows += [(200, "http://cheappillsfarm.example.com/en/1", title), (201, "http://weathernews.org/a", title)]
    got = {r.page_id: r for r in url_filter.filter_urls(pages_of(spark, rows)).collect()}
    assert got[100].tokens[:2] == ["h:spam", "h:farm"] and got[100].verdict == "block"
    assert got[200].tokens[:3] == ["h:cheap", "h:pills", "h:farm"] and got[200].verdict == "block"
    assert got[201].verdict == "allow" and got[3].verdict == "allow"


def test_planted_addresses(spark):
    sf = "/root/testdata/sf0.1"
    got = url_filter.filter_urls(spark.read.parquet(f"{sf}/pages.parquet")).where("rule IS NULL").collect()
    bad = ("spam-farm", "casino-win", "cheap-pills", "adult-x", "free-bets", "ads-track")
    for r in got:
        assert (r.verdict == "block") == any(b in r.host for b in bad), r.host
