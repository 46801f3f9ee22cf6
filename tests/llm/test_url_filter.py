import itertools
import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import common
from ledgerloom.llm import url_filter as U
from ledgerloom.llm.queries import RULES, op2_url_filter


def brute(rows, rules):
    """(page_id, host, path, rule, verdict) of rows (page_id, url, html), in plain Python."""
    urls, told = {}, {}
    for _, url, _ in rows:
        url = url or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for r, v in rules if (h := r.partition("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        urls[url] = host, path, *(max(fit)[1:] if fit else (None, None))
    words = Counter(w for _, _, html in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ", html or "").lower()))
    total = sum(words.values()) or 1

    def cost(w):
        return math.log(words[w] / total) if w in words else -math.log(total) - math.log(10) * len(w)

    def split(name):
        cuts = (itertools.pairwise([0, *c, len(name)]) for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n))
        return max(([name[a:b] for a, b in c] for c in cuts), key=lambda x: sum(map(cost, x)))

    def tokens(host, path):
        return Counter([f"host:{w}" for name in re.findall(r"[^\W\d_]+", host) for w in (split(name) if len(name) < 12 else U.best_split(name, words, total))] + [f"path:{w}" for w in re.findall(r"[^\W\d_]+", path.lower())])

    bag = {u: tokens(x[0], x[1]) for u, x in urls.items()}
    seen = {v: sum((bag[u] for u, x in urls.items() if x[3] == v), Counter()) for v in ("allow", "block")}
    n = Counter(x[3] for x in urls.values())
    size = len({t for b in bag.values() for t in b})
    for u, (host, path, rule, verdict) in urls.items():
        score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(
            k * (math.log(seen["block"][t] + 1) - math.log(seen["allow"][t] + 1) + math.log((sum(seen["allow"].values()) + size + 1) / (sum(seen["block"].values()) + size + 1))) for t, k in bag[u].items()
        )
        told[u] = host, path, rule, verdict or ("block" if bag[u] and round(score, 9) > 0 else "allow")
    return sorted(((i, *told[u or ""]) for i, u, _ in rows), key=str)


def rows_of(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def test_split():
    known = {"cheap": 50, "pills": 40, "che": 3, "a": 900, "pill": 30, "s": 100}
    assert U.best_split("cheappills", known, 2000) == ["cheap", "pills"]
    assert U.best_split("xq", known, 2000) == ["xq"]
    assert U.best_split("x" * 63, {}, 1) != [] and U.best_split("", known, 10) == []


def test_words_and_names_of_any_length(spark):
    long, longer = "donaudampfschifffahrtsgesellschaft", "x" * 64
    assert U.best_split("die" + long, {long: 5, "die": 9}, 2000) == ["die", long]
    pages = spark.createDataFrame([(f"<p>die {long} {long} die {longer}</p>",)], "html string")
    counts = common.written(U.word_counts(pages), "test-counts")
    assert {r.word: r.n for r in counts.collect()} == {"die": 2, long: 2, longer: 1}
    names = spark.createDataFrame([("die" + long,), (longer + "die",), ("q" * 3000 + long + "die" * 500,), ("",)], "name string")
    assert {tuple(r.words) for r in U.segment(names, counts).collect()} == {("die", long), (longer, "die"), ("q" * 3000, long, *["die"] * 500)}
    assert U.segment(names, counts.where("n > 9")).where("name like 'die%'").first().words == list("die" + long)  # without counts all splits are equally likely: shortest last words


def test_splits_are_the_likeliest(spark):
    rng = random.Random(8)
    for _ in range(150):
        known = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(0, 6))}
        name, total = "".join(rng.choices("abc", k=rng.randint(1, 9))), 2 * sum(known.values()) + 1
        cost = lambda w: math.log(known[w] / total) if w in known else -math.log(total) - math.log(10) * len(w)  # noqa: E731, B023
        cuts = (itertools.pairwise([0, *c, len(name)]) for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n))
        most = max(sum(cost(name[a:b]) for a, b in c) for c in cuts)
        got = U.best_split(name, known, total)
        assert "".join(got) == name and abs(sum(map(cost, got)) - most) < 1e-9


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7", "http://example.com/en/6", "http://a.example.com/en/77?x", "http://badexample.com/en/", "http://com/en/", "https://x.net/de/8", "https://x.example.net/de/80#t", "https://example.org?/es/", "ftp://é.org/es/é", "x://http://y.com/en/", "http://spamfarm.org/es/1", "http://spamfarm.org/fr/1", "http://goodplace.net/de/1", "http://goodplace.net/fr/1", "http://" + "q" * 200 + ".io/" + "p/" * 3000, "http://y\n.com/en/\n"]
    rows = [(i, u, "<p>spam farm &amp; good place</p><script>var x</script>") for i, u in enumerate(urls)] + [(1, "http://spamfarm.org/fr/1", None)] * 2
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, rule int").repartition(3)
    assert rows_of(U.judged(df, RULES)) == brute(rows, RULES)
    assert U.judged(df.where("page_id < 0"), RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op2(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert rows_of(op2_url_filter(spark, d)) == brute(rows, RULES)
