import itertools
import math
import re
from collections import Counter

import pytest

from tidemark.llm.queries import URL_RULES
from tidemark.llm.urls import LONGEST, PIECE, SEEDS, best_split, judged, rule_words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAGES = "page_id long, url string, html string, host string, word string, n int"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_for(host, path):
    fits = [
        r for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.text), default=None)


def breaks(text):
    return [w for w in re.split(r"[\W_]+", text) if w]


def likeliest(piece, counts, total):
    """By trying every way to cut the piece."""
    def p(w):
        if w in counts:
            return math.log(counts[w]) - math.log(total)
        return (1 - len(w)) * math.log(10) - math.log(total)

    best = None
    for cuts in itertools.product((0, 1), repeat=len(piece) - 1):
        words, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(piece[at:i])
                at = i
        words.append(piece[at:])
        score = sum(map(p, words)) if all(len(w) <= LONGEST for w in words) else -math.inf
        if best is None or score > best + 1e-9:
            best = score
    return best


def brute(pages):
    counts = Counter()
    for words in SEEDS.values():
        counts.update({w: 20 for w in words})
    for _, _, html in pages:
        plain = re.sub(r"<[^>]*>", " ", html or "").lower()
        counts.update(w for w in re.split(r"[\W\d_]+", plain) if 0 < len(w) <= LONGEST)
    total = sum(counts.values())

    def split(host):
        words = []
        for run in breaks(host):
            for k in range(0, len(run), PIECE):
                piece = run[k : k + PIECE]
                known = {
                    (a, b - a): math.log(counts[piece[a:b]]) - math.log(total)
                    for a in range(len(piece)) for b in range(a + 1, len(piece) + 1)
                    if piece[a:b] in counts
                }
                words += best_split(piece, known, total)
        return words

    def tokens(host, path):
        found = ["0" if w.isdigit() else w for w in breaks(path.lower())]
        return split(host) + found

    by_class = {v: Counter({w: 20 for w in SEEDS[v]}) for v in SEEDS}
    size, own = Counter(), set(rule_words(URL_RULES))
    for _, url, _ in pages:
        rule = rule_for(*parse(url))
        if rule:
            size[rule.verdict] += 1
            by_class[rule.verdict].update(w for w in tokens(*parse(url)) if w not in own)
    vocabulary = set(by_class["block"]) | set(by_class["allow"])
    sums = {v: sum(c.values()) + len(vocabulary) + 1 for v, c in by_class.items()}
    prior = math.log((size["block"] + 1) / (size["allow"] + 1))
    out = []
    for page, url, _ in pages:
        host, path = parse(url)
        rule = rule_for(host, path)
        score = prior + sum(
            math.log((by_class["block"][w] + 1) / sums["block"])
            - math.log((by_class["allow"][w] + 1) / sums["allow"])
            for w in tokens(host, path) if w in vocabulary
        )
        verdict = rule.verdict if rule else "block" if score > 0 else "allow"
        out.append((page, host, path, rule and rule.text, verdict, None if rule else round(score, 6)))
    return out


def key(row):
    return repr(row)


def check(spark, pages):
    df = spark.createDataFrame([(*p, "h", "w", 1) for p in pages], PAGES).repartition(3)
    rows = judged(df, URL_RULES).collect()
    got = [
        (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"],
         None if r["score"] is None else round(r["score"], 6))
        for r in rows
    ]
    assert sorted(got, key=key) == sorted(brute(pages), key=key)
    return rows


def test_verdicts_equal_those_of_brute_force(spark):
    html = "<p class=x>the cheap pills shop has news of the book club and the farm</p>"
    pages = [
        (1, "http://BookClub.example.net/en/1", html), (2, "https://a.net/", html),
        (3, "http://pillshop.example.net/de/7?x=://y", html), (4, "https://x.example.com/de/5", None),
        (5, "https://newsfarm.example.com/en/12#top", "<b>club"), (6, "http://q.org/fr/x", ""),
        (7, "http://cheappills.example.org/en/33/buy", html), (8, "http://net", html),
        (9, "http://bookclub.org?x=1/fr/", html), (10, "ftp://örtchen.example.org/Ä/_1", html),
        (11, None, None), (None, "no scheme", html), (12, "", html), (12, "", html),
        (13, "http://" + "thebookclub" * 30 + ".org/en/", html),
        (14, "http://sub.example.com/de/" + "p/" * 3000, html),
        (15, "a://b://c.net/", html), (16, "http://notnet/x", html),
        (17, "http://evilexample.net/en/3", html),
    ]
    rows = {r["page_id"]: r for r in check(spark, pages)}
    assert rows[7]["host_words"].startswith("cheap pills")
    assert rows[1]["rule"] == "example.net/en/" and rows[3]["rule"] == "net/"
    assert rows[8]["rule"] is None and rows[15]["host"] == "b:"


def test_given_pages_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check(spark, [tuple(r) for r in table.select("page_id", "url", "html").collect()])


def test_a_split_is_the_likeliest_of_all():
    counts = Counter(the=50, book=9, club=9, bookclub=2, a=30, he=20, t=1)
    total = sum(counts.values())
    for piece in ("thebookclub", "abookt", "xyz", "hethe", "bookclubs"):
        known = {
            (a, b - a): math.log(counts[piece[a:b]]) - math.log(total)
            for a in range(len(piece)) for b in range(a + 1, len(piece) + 1)
            if piece[a:b] in counts
        }
        words = best_split(piece, known, total)
        assert "".join(words) == piece
        at, score = 0, 0.0
        for w in words:
            unknown = (1 - len(w)) * math.log(10) - math.log(total)
            score += known.get((at, len(w)), unknown)
            at += len(w)
        assert score == pytest.approx(likeliest(piece, counts, total))


def test_no_pages(spark):
    assert judged(spark.createDataFrame([], PAGES), URL_RULES).count() == 0
