"""URL filter, periodic runs and fill-in-middle against plain computations, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nodeloom.llm import infill, queries, runs, urlfilter
from tests.conftest import SF, same_rows

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n bigint, form string, output string, runs int, key string, _cut string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = "lorem ipsum dolor sit amet " * 30_000
    texts = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, "x " * 40 + "y z " * 20), (None, "no key " * 8), (None, None), (7, "<P> in a text"), (8, "ünï 日本語 🎉\u00a0x \v\f y\r\n"), (9, "one"), (10, "a<S b> <M c")]
    return spark.createDataFrame([(i, t, 5, None, "o", 1, "k", "c") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# Periodic runs


def plain_runs(words, min_length=6, min_exponent=4):
    """Every period tried at every place."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (3, 3)])
def test_runs_of_random_sequences(min_length, min_exponent):
    rng = random.Random(min_exponent)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.randint(1, 5)
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 8 else 0):
            p, s = rng.randint(1, n // 5), rng.randrange(n)
            for i in range(s, min(n, s + p * rng.randint(2, 8))):
                words[i] = words[s + (i - s) % p]
        assert runs.find_runs(words, min_length, min_exponent) == plain_runs(words, min_length, min_exponent)


def test_runs_rest_on_words_not_on_hashes(monkeypatch):
    """With hashes that are all equal, extensions are cut at the first different word."""
    monkeypatch.setattr(runs.Stretch, "equal", lambda self, i, j, length: True)
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        stretch = runs.Stretch(words)
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                same = next((k for k in range(len(words) - j) if words[i + k] != words[j + k]), len(words) - j)
                before = next((k for k in range(i) if words[i - 1 - k] != words[j - 1 - k]), i)
                assert stretch.onward(i, j) == same and stretch.back(i, j) == before


def test_long_periodic_sequences_take_little_work():
    assert runs.find_runs([1] * 300_000) == [(0, 300_000, 1)]
    assert runs.find_runs([i % 977 for i in range(300_000)]) == [(0, 300_000, 977)]
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert runs.find_runs(b) == []  # a Fibonacci word holds no fourth power
    with pytest.raises(ValueError):
        runs.find_runs([1], 2, 1)


def plain_op12(doc_id, text):
    words = WORDS.findall((text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *rest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12_equals_brute_force(spark, texts):
    short = {i: t for i, t in texts.items() if len((t or "").split()) < 2500}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert set(got) == set(texts) and len(short) > 150
    assert {i: got[i] for i in short} == {i: plain_op12(i, t) for i, t in short.items()}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_periodic_runs_odd_rows(spark, odd):
    got = runs.periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert [r.collapsed for r in rows if r.doc_id == 1] == ["a b"] * 2 and by[1].runs[0].asDict() == {"start": 0, "length": 18, "period": 2}
    assert [(r.n_words, r.runs, r.collapsed) for r in rows if r.doc_id in (2, 3, 4)] == [(0, [], "")] * 3
    assert (by[5].n_words, by[5].collapsed) == (150_000, "lorem ipsum dolor sit amet")
    assert by[6].collapsed == "x y z" and [tuple(r) for r in by[6].runs] == [(0, 40, 1), (40, 40, 2)]
    assert sorted(r.collapsed for r in rows if r.doc_id is None) == ["", "no key"]
    assert by[8].collapsed == "ünï 日本語 🎉\u00a0x y"
    assert runs.periodic_runs(odd.where("false")).count() == 0


def test_planted_repeats_odd_rows(odd):
    got = queries.planted_repeats(odd).collect()
    assert len(got) == 13
    for r in got:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            assert r.text == odd.where(f"doc_id <=> {'null' if r.doc_id is None else r.doc_id}").where(f"text <=> {'null' if r.text is None else 'text'}").first().text


# Fill in the middle


def plain_op13(doc_id, text):
    text = text or ""
    ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(ends)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = lambda k: ends[k - 1] if k else 0
    prefix, middle, suffix = text[: at(lo)], text[at(lo) : at(hi)], text[at(hi) :]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text))
    return (doc_id, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text))


def test_op13_equals_brute_force(spark, texts):
    got = {r.doc_id: tuple(r) for r in queries.op13_fill_in_middle(spark, SF).collect()}
    assert got == {i: plain_op13(i, t) for i, t in texts.items()}
    assert {r[2] for r in got.values()} == {"plain", "spm", "psm"}


def test_fill_in_middle_odd_rows(odd):
    cut = infill.fill_in_middle(odd, fim_percent=100)
    assert set(cut.columns) == {*odd.columns, "prefix_chars", "middle_chars"}
    rows = cut.withColumn("back", infill.restore(cut.output, cut.form)).collect()
    assert len(rows) == 13 and all(r.back == (r.text or "") and r.key == "k" and r._cut == "c" for r in rows)
    plain = [r for r in rows if r.form == "plain"]
    assert sorted(r.text or "" for r in plain) == ["", "", "", "<P> in a text"] and all(r.prefix_chars is None for r in plain)
    assert infill.fill_in_middle(odd.where("false")).count() == 0
    none = infill.fill_in_middle(odd, fim_percent=0).collect()
    assert all(r.form == "plain" and r.output == (r.text or "") for r in none)


def test_restoring_slices_that_look_like_marks():
    rng = random.Random(2)
    for k in range(3000):
        text = "".join(rng.choice("<>PSM \n") for _ in range(rng.randint(0, 12)))
        _, form, _, _, output = infill.transformed(text, str(k), 7, 100, 50)
        assert infill.restored(output, form) == text


# URLs


def test_op11_equals_sql(spark, duck):
    same_rows(queries.op11_url_filters(spark, SF), duck.sql(queries.ORACLE_SQL["op11_url_filters"]))


URLS = [
    ("http://a.com/x", "a.com", "/x", "com/"),
    ("http://com/x", "com", "/x", "com/"),
    ("HTTP://WWW.Example.COM/en/Q?a=/b", "www.example.com", "/en/Q", "www.example.com/en/"),
    ("x://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"),
    ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/"),
    ("http://a.com", "a.com", "", None),
    ("http://a.com?q=/en/", "a.com", "", None),
    ("http://a.com#/en/", "a.com", "", None),
    ("http://acom/x", "acom", "/x", None),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/"),
    ("http://net/fr/", "net", "/fr/", "net/fr/"),
    ("http://a.net/fr", "a.net", "/fr", None),
    ("http://É.COM:80/a://b.net/es/", "É.com:80", "/a://b.net/es/", None),
    ("http://a.com:80/x", "a.com:80", "/x", None),
    ("a.com/x", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("://", "", "", None),
    ("http://a\n.com/x\ny", "a\n.com", "/x\ny", "com/"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df).collect()}
    assert [(got[i].url, got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == URLS
    said = {"com/": "allow", "www.example.com/en/": "allow"}
    assert all(r.verdict == said.get(r.rule, "block") for r in got.values() if r.rule) and all(r.verdict in ("allow", "block") for r in got.values())


def plain_ratio(allowed, blocked, url, order=4, least=3):
    """The two models' chances of each character, one after the other, from counts in dictionaries."""
    framed = lambda u: "\x02" + u + "\x03"
    counts = []
    for part in (allowed, blocked):
        c = Counter()
        for u in part:
            s = framed(u)
            c.update(s[i - m + 1 : i + 1] for i in range(1, len(s)) for m in range(1, order + 2) if i - m + 1 >= 0)
        counts.append(c)
    kept = {g for c in counts for g in c if counts[0][g] + counts[1][g] >= least}
    total, kinds = (Counter(), Counter()), (Counter(), Counter())
    for which, c in enumerate(counts):
        for g in kept:
            total[which][g[:-1]] += c[g]
            kinds[which][g[:-1]] += c[g] > 0
    s, ratio = framed(url), 0.0
    for i in range(1, len(s)):
        chance = [1 / 65536, 1 / 65536]
        for m in range(1, min(order + 1, i + 1) + 1):
            g = s[i - m + 1 : i + 1]
            for which in (0, 1):
                if n := total[which][g[:-1]]:
                    seen = counts[which][g] if g in kept else 0
                    chance[which] = (seen + kinds[which][g[:-1]] * chance[which]) / (n + kinds[which][g[:-1]])
        ratio += math.log(chance[0] / chance[1])
    return ratio / (len(url) + 1)


def test_scores_equal_two_plain_models(spark):
    rng = random.Random(3)
    make = lambda words: "http://" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    allowed = sorted({make(["home", "news", "über", "🎉", "a1"]) for _ in range(60)})
    blocked = sorted({make(["spam", "pills", "news", "win"]) for _ in range(60)})
    tried = ["", "http://news", "http://pills/spam/win", "zzz", "🎉🎉", "http://home/" + "news/" * 700, allowed[0] + blocked[0]]
    labelled = spark.createDataFrame([(u, True) for u in allowed] + [(u, False) for u in blocked], "url string, allowed boolean")
    model = urlfilter.checkpointed(urlfilter.weights(labelled, 4, 3))
    got = {r.id: r.score for r in urlfilter.scores(spark.createDataFrame(list(enumerate(tried)), "id long, url string"), model, 4).collect()}
    for i, u in enumerate(tried):
        assert got[i] == pytest.approx(plain_ratio(allowed, blocked, u), abs=1e-5)


def test_limit_parts_best(spark):
    df = spark.createDataFrame([(0.5, True), (0.31, True), (0.2, False), (-1.0, False), (0.305, False)], "score double, allowed boolean")
    assert urlfilter.best_limit(df) == 0.31  # cells 30 and 31: no gap
    assert urlfilter.best_limit(df.where('score <> 0.305')) == (20 + 1 + 31) / 200
    assert urlfilter.best_limit(df.where("allowed")) is None and urlfilter.best_limit(df.where("false")) is None


def test_judging_odd_tables(spark):
    schema = "page_id long, url string, host string, score string, _id string, _rule string, _host string"
    rows = [(1, "http://a.com/x", "h", None, "i", "r", "o"), (1, "http://a.com/x", "h", None, "i", "r", "o"), (None, "http://b.org/en/", None, "s", None, None, None), (2, None, "h", "s", "i", "r", "o"), (3, "http://b.org/" + "x" * 50_000, "h", "s", "i", "r", "o"), (4, "http://b.net/es/", "h", "s", "i", "r", "o")]
    df = spark.createDataFrame(rows, schema)
    got = urlfilter.judge_urls(df)
    assert set(got.columns) == {"page_id", "url", "_id", "_rule", "_host", "host", "path", "rule", "verdict", "score"}
    found = got.collect()
    assert len(found) == 6 and all(r.verdict for r in found) and [r._id for r in found if r.page_id == 1] == ["i", "i"]
    assert urlfilter.judge_urls(df.where("false")).count() == 0
    none = urlfilter.judge_urls(df.where("url like '%org%'")).collect()
    assert [(r.verdict, r.score) for r in none] == [("allow", None)] * 2  # nothing to learn from


def test_learned_urls_are_told_apart(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [f"http://{name()}.com/shop/{name()}" for _ in range(300)] + [f"http://{name()}.net/es/cheap-pills-{name()}" for _ in range(300)]
    new = [(f"http://{name()}.org/shop/{name()}", "allow") for _ in range(50)] + [(f"http://{name()}.org/cheap-pills-{name()}", "block") for _ in range(50)]
    df = spark.createDataFrame([(u,) for u in rows + [u for u, _ in new]], "url string")
    got = {r.url: r for r in urlfilter.judge_urls(df).collect()}
    assert sum(got[u].verdict == said for u, said in new) >= 97


def test_every_ruled_url_teaches(spark, monkeypatch):
    """more different URLs of each kind than the former cap of 100,000 all reach the models and the limit."""
    counted, plain = [], urlfilter.weights
    monkeypatch.setattr(urlfilter, "weights", lambda urls, *a: counted.append(urls.count()) or plain(urls.limit(10), *a))
    monkeypatch.setattr(urlfilter, "best_limit", lambda scored: counted.append(scored.count()))
    ids = spark.range(220_000)
    urls = ids.select(F.concat(F.when(ids.id % 2 == 0, "https://www.a.com/").otherwise("https://a.net/fr/"), ids.id.cast("string")).alias("url"))
    urlfilter.judge_urls(urls, order=1)
    assert sum(counted) == 220_000
