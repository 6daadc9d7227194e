"""Text operators against brute force and the tokenizers library, with odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nodeloom.llm import bytebpe, decontam, langid, ngram_lm, queries, sharding, simhash, tokencount, toxicity
from nodeloom.llm.storage import held_out
from tests.conftest import SF

SCHEMA = "doc_id bigint, text string, lang string, key string, h long, score double, _said string"
LONG = "lorem ipsum dolor sit amet " * 30_000  # 810,000 characters


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    texts = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \t\n "), (6, "!!! 123 ???"), (7, LONG), (8, "ünïcödé wörds — 日本語 🎉"), (None, "no key here"), (9, "one"), (10, "a\u0000b <|endoftext|> c")]
    return spark.createDataFrame([(i, t, None, "k", 1, 0.5, "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bytebpe.default_vocabulary())


def test_bpe_equals_library(spark, docs, texts, library):
    got = {r.doc_id: r for r in queries.op6_bpe_roundtrip(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(odd, library):
    got = bytebpe.encode_texts(odd).collect()
    assert len(got) == 12 and set(got[0].asDict()) == {*odd.columns, "token_ids", "decoded"}
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bytebpe.encode_texts(odd.where("false")).count() == 0 and bytebpe.token_digests(odd.where("false")).count() == 0


def test_decode_replaces_broken_bytes(library):
    v = bytebpe.vocabulary(None)
    for ids in ([0, 173, 50256], [223, 224], [8582, 236], [5, 128, 5]):
        assert v.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_merging_random_strings(library):
    rng = random.Random(0)
    v, c = bytebpe.vocabulary(None), tokencount.piece_counts(None)
    for _ in range(400):
        t = "".join(rng.choice("ab eé\n'sT0 日\t<|>") for _ in range(rng.randint(0, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(v.encode(t), "<u4").tolist() == ids and c.of(t) == len(ids)


def test_token_counts(spark, texts, odd, library):
    got = {r.doc_id: r for r in queries.op9_token_counts(spark, SF).collect()}
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    rows = {r.doc_id: r for r in tokencount.count_tokens(odd).collect()}
    assert rows[3].n_tokens == rows[3].n_bytes == 0 and rows[7].over_limit
    assert tokencount.count_tokens(odd.where("false")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == "0" * 16 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert by[2].component_id == 1 and by[None].component_id is None
    kept = [r.doc_id for r in simhash.without_near_duplicates(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 6, 7, 8, 9, 10] and None in kept
    assert simhash.near_duplicates(odd.where("false")).count() == 0
    for hot in (1, 3, 100):  # hot fingerprints meet their rows by a broadcast: the same rows
        assert sorted(map(tuple, simhash.near_duplicates(odd, hot=hot).collect()), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("leaf_rows", [65_536, 64, 8])
def test_trie_join_equals_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flip = lambda x, n: x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, flip(base[:80], 80), flip(flip(flip(base[0], 250), 250), 250), [np.uint64(0), np.uint64(2**64 - 1)]]))
    want = brute_components({int(v): int(v) for v in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp bigint"), 2, leaf_rows)
    from nodeloom.operators.components import connected_components

    got = {r.node & 2**64 - 1: r.component & 2**64 - 1 for r in connected_components(links).collect()}
    groups = lambda of: {frozenset(k for k in of if of[k] == c) for c in set(of.values())}
    assert groups({k: got.get(k, k) for k in want}) == groups(want)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(800):
        p = [rng.randint(0, 3) for _ in range(rng.randint(1, 11))]
        t = [rng.randint(0, 3) for _ in range(rng.randint(0, 16))]
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        edits, end = decontam.best_match(np.array(p), np.array(t, dtype=int))
        assert edits == min(row) and (end == row.index(min(row)) - 1 or edits == len(p))


def test_decontamination_equals_brute_force(spark, texts):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, j) for i, t in texts.items() for j, p in items.items() if decontam.best_match(np.array([hash(w) for w in p]), np.array([hash(w) for w in words(t)], dtype=int))[0] <= int(0.2 * len(p))}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    assert got == want and want


def test_pieces_avoid_shared_phrases_and_miss_nothing():
    """Items that begin alike: cuts differ where pieces are shared, and every passage within the budget is found."""
    rng = random.Random(3)
    items = [(i, "which of the following is true about the " + " ".join(f"t{i}x{j}" for j in range(rng.randint(1, 12)))) for i in range(60)]
    p = decontam.Pieces(items, 0.2)
    for i, text in items:
        words = text.split()
        k = int(0.2 * len(words))
        for _ in range(5):
            w = words[:]
            for at in rng.sample(range(len(w)), k):
                w[at] = "other"
            assert i in {hit[0] for hit in p.matches("some " + " ".join(w) + " text")}
    assert all(sum(a < b for a, b in zip(c, c[1:])) == 4 and c[0] == 0 and c[-1] == 17 for c in decontam.cuts(17, 4)) and decontam.cuts(3, 3)[0] == [0, 1, 2, 3]
    assert decontam.pieces_of(items, 0.2) is decontam.pieces_of(items, 0.2)


def test_partitions_of_several_shards(spark, docs, monkeypatch):
    """More shards than partitions give the same scores; shards grow with the corpus between their bounds."""
    some = docs.where("doc_id < 60")
    key = lambda rows: sorted((r.doc_id, round(r.score, 6), r.n_known) for r in rows.collect())
    make = lambda: key(ngram_lm.score(some, ngram_lm.train(some, max_entries=50, shard_tokens=2000)))
    want = make()
    monkeypatch.setattr(ngram_lm, "by_shards", lambda df, shards, deal=ngram_lm.by_shards: deal(df, shards, 3))
    assert make() == want and len(want) == 60
    assert [ngram_lm.grown_shard(n) for n in (1, 5 * 10**9, 10**11, 2 * 10**13)] == [1 << 22, 1 << 22, 10**11 >> 12, 1 << 26]


def test_windows_of_several_widths():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 40):
        words = rng.integers(0, 2**63, n).astype(np.uint64)
        got = dict(decontam.windows_of(words, [5, 1, 4]))
        assert got.keys() == {w for w in (1, 4, 5) if w <= n}
        for w, h in got.items():
            np.testing.assert_array_equal(h, decontam.window_hashes(words, w))


def test_a_benchmark_too_large_to_broadcast(spark, docs, odd):
    """Joins over pieces give what the broadcast gives, from one pass over the texts."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "item_id", "first_word", "end_word", "edits").collect()), key=repr)
    want = key(decontam.benchmark_matches(both, bench))
    kept = sorted((r.doc_id, r.text) for r in decontam.without_benchmark(both.where("doc_id is not null and text is not null"), bench).collect())
    large = decontam.benchmark_matches(both, bench, block_words=50)
    assert key(large) == want and len(want) > 2
    assert sorted((r.doc_id, r.text) for r in decontam.without_benchmark(both.where("doc_id is not null and text is not null"), bench, block_words=50).collect()) == kept
    clash = odd.withColumn("_text", F.lit("c"))
    assert set(decontam.without_benchmark(clash, bench, block_words=50).columns) == set(clash.columns) and decontam.without_benchmark(clash, bench, block_words=50).count() == 12
    assert decontam.benchmark_matches(both.where("false"), bench, block_words=50).count() == 0
    ties = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (2, "seven eight nine ten eleven"), (None, "six five four three two one"), (3, None), (4, "!")], "item_id bigint, text string")
    texts = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven"), (1, "one two three four five six one two three four five six"), (None, "six five four x two one"), (5, "nothing")], "doc_id bigint, text string")
    assert key(decontam.benchmark_matches(texts, ties, block_words=1)) == key(decontam.benchmark_matches(texts, ties))


def test_decontamination_of_edited_passages_and_odd_rows(spark, odd):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "..."), (1, item)], "item_id int, text string")
    edited = item.replace("w3 ", "").replace("w9", "other W8").upper()
    far = " ".join(f"w{i}" if i % 3 else "x" for i in range(20))
    rows = [(1, f"before, {edited}; after", None, None, None, None, None), (2, far, None, None, None, None, None), (3, "w0 w1 w2 w3", None, None, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(rows, SCHEMA)).withColumn("item_id", odd.doc_id)
    got = decontam.benchmark_matches(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 1, 3)] and got[0].first_word >= 1
    assert decontam.without_benchmark(docs, bench).count() == docs.count() - 1
    assert decontam.benchmark_matches(docs, bench, block_words=1).count() == 1
    assert decontam.benchmark_matches(docs, bench.where("false")).count() == 0 and decontam.without_benchmark(docs.where("false"), bench).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    hits = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert hits > 0.95 and sum(caught) > 0.75 * len(caught) and sum(clean) < 0.02 * len(clean)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("held_out <> (doc_id is not null and crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_ftrl_step_by_hand():
    m = toxicity.Ftrl(bits=4)
    m.learn(np.array([0, 3]), 1)
    assert m.z[3] == pytest.approx(-0.5) and m.n[3] == pytest.approx(0.25) and m.weights(np.array([3]))[0] == 0.0
    assert m.weights(np.array([0]))[0] == pytest.approx(0.5 / (1 + 0.5))


def test_ftrl_equals_a_plain_loop(spark, docs, texts):
    """Weights and scores against a loop over dicts: z and n by coordinate, in the order of the keys' hashes."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    order = [(r.doc_id, r.toxic) for r in labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).collect()]
    z, n, grams = {}, {}, {}

    def features_of(t):
        words = re.findall(r"\w+", (t or "").lower())
        h = [xxh64_intdigest(w) for w in words]
        one = lambda v: np.array([v], np.uint64)
        at = {int(toxicity.mixed(one(a))[0]) >> 44 for a in h}
        at |= {int(toxicity.joined(one(a), one(b), 1)[0]) >> 44 for a, b in zip(h, h[1:])}
        at |= {int(toxicity.joined(one(a), one(b), 2)[0]) >> 44 for a, b in zip(h, h[2:])}
        return sorted(at | {0})

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == 0 else 3.0
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / (1.0 + math.sqrt(n.get(i, 0.0)))

    for doc, y in order[:60]:
        at = grams.setdefault(doc, features_of(texts[doc]))
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            change = math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))
            z[i] = z.get(i, 0.0) + g - change * w[i]
            n[i] = n.get(i, 0.0) + g * g
    model = toxicity.train(docs, labels, max_rows=min(60, len(order)))
    got = dict(zip(model[0].tolist(), model[1].tolist(), strict=True))
    want = {i: weight(i) for i in z if weight(i)}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.limit(10), model).collect()}
    for doc, s in scores.items():
        assert s == pytest.approx(1 / (1 + math.exp(-sum(want.get(i, 0.0) for i in features_of(texts[doc])))), rel=1e-9)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, 0), (99, 1), (4, None), (8, 5), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(scored) == 11 and all(0 <= s <= 1 for s in scored.values()) and scored[3] == scored[4]
    nothing = toxicity.train(odd, labels.where("false"))
    assert toxicity.score(odd, nothing).where("score = 0").count() == 12 and toxicity.without_toxic(odd, nothing).count() == 12
    assert toxicity.score(odd.where("false"), model).count() == 0
    assert toxicity.without_toxic(odd, model, threshold=2.0).columns == odd.columns


def test_language_held_out(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.1")
    truth = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert sum(r.rejected for r in rows) < 0.005 * len(rows) and got.where("score < 0 or score > 1").count() == 0


#: Article 1 of the Universal Declaration of Human Rights in languages that the tables don't have.
UNLEARNED = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_rejection_of_unlearned_languages(spark, sf):
    """Lettered texts of unlearned languages, Latin script included, are rejected; held rows of the learned ones are kept."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    held = held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs, allowed=~held)
    others = spark.createDataFrame(list(UNLEARNED.items()), "name string, text string")
    assert langid.identify(others, model).where("rejected").count() == len(UNLEARNED) and langid.without_unknown(others, model).count() == 0
    rows = langid.identify(docs.where(held).where("text rlike '[a-zA-Z]{4}'"), model)
    assert rows.where("rejected").count() <= 0.01 * rows.count()
    assert all(0 < v < 1 for v in model.limits.values())


def test_centroids_equal_a_plain_computation(spark):
    """Counts, idf, k-means, limits and predictions against plain loops over a small table."""
    rng = random.Random(4)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "vier"]}
    rows = [(i, " ".join(rng.choices(words[la], k=rng.randint(3, 9))), la) for i in range(40) for la in [rng.choice(["aa", "bb"])]]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), clusters=2)
    assert model.langs == ["aa", "aa", "bb", "bb"]

    def grams(t):
        """Hashed coordinates by a loop over the characters."""
        line, out = f" {t} ", Counter()
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                key = 0
                for ch in line[i : i + n]:
                    key = key << 21 | ord(ch)
                h = int(langid.mixed(np.array([key + n], np.uint64))[0])
                out[h >> 64 - langid.DIMS_BITS] += 1
        return out

    counts = [grams(t) for _, t, _ in rows]
    df = Counter(a for c in counts for a in c)
    idf = lambda a: math.log((1 + len(rows)) / (1 + df[a])) + 1 if df[a] else math.log(1 + len(rows)) + 1

    def vector(c):
        x = {a: (1 + math.log(n)) * idf(a) for a, n in c.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {a: v / size for a, v in x.items()}

    vectors = [vector(c) for c in counts]
    for j, (la, centre) in enumerate(zip(model.langs, model.centroids, strict=True)):
        # Each centroid is the unit mean of the rows of its language that are nearest to it.
        mine = [v for v, (_, _, of) in zip(vectors, rows, strict=True) if of == la]
        other = model.centroids[[k for k, x in enumerate(model.langs) if x == la and k != j][0]]
        near = [v for v in mine if sum(w * centre[a] for a, w in v.items()) >= sum(w * other[a] for a, w in v.items()) - 1e-6]
        mean = Counter()
        for v in near:
            for a, w in v.items():
                mean[a] += w
        size = math.sqrt(sum(w * w for w in mean.values()))
        assert all(abs(centre[a] - mean[a] / size) < 1e-4 for a in range(langid.DIMS) if centre[a] or a in mean)
    said = [r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).orderBy("doc_id").collect()]
    for r, v in zip(said, vectors, strict=True):
        best = max((sum(w * float(c[a]) for a, w in v.items()), la) for la, c in zip(model.langs, model.centroids, strict=True))
        assert r.score == pytest.approx(min(1, best[0]), abs=1e-5) and r.lang_pred == best[1] == r.lang


def test_a_hot_key_is_learned_from_once(spark):
    """A third of all rows share one doc_id: the sample stays a sample, and the models are those of distinct rows."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(i, f"words of text number {i} stand here", "en" if i % 2 else "de") for i in range(40)], "doc_id bigint, text string, lang string")
    hot = base.unionByName(spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("words of text number 7 stand here").alias("text"), F.lit("en").alias("lang")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    a, b = toxicity.train(base, labels), toxicity.train(hot, labels)
    assert a[0].tolist() == b[0].tolist() and np.allclose(a[1], b[1])
    a, b = langid.train(base), langid.train(hot)
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids) and a.limits == pytest.approx(b.limits)


def test_every_language_is_learned(spark):
    """However many there are: in blocks of a few centroids they give what one broadcast gives."""
    rng = random.Random(8)
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    kinds = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "xyzä", "öüßé"]
    rows = [(i, words(kinds[i % 8]), f"l{i % 8}") for i in range(80)] + [(100 + i, words("abcd"), f"rare{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, many = langid.train(df), langid.train(df, most_centroids=9)
    assert isinstance(many, langid.CentroidBlocks) and many.blocks > 2
    assert {la for i in range(many.blocks) for la in many.block(i).langs} == set(one.langs) == {r[2] for r in rows}
    odd = spark.createDataFrame([(i, t, "c") for i, t in enumerate([r[1] for r in rows] + [None, "", "12 ½", "ж ж ж"])], "doc_id bigint, text string, _said string")
    key = lambda m: sorted((r.doc_id, r.lang_pred, round(r.score, 5), r.rejected, r._said) for r in langid.identify(odd, m).collect())
    assert key(one) == key(many)
    kept = lambda m: sorted(r.doc_id for r in langid.without_unknown(odd, m).collect())
    assert kept(one) == kept(many) and len(kept(one)) > 70


@pytest.mark.parametrize("text", ["½", "²³ ①②", "Ⅷ", "12 ½ _", "٣٤", "!?", "\u0301"])
def test_numbers_have_no_letter(spark, text):
    """Categories No, Nl, Nd, punctuation and marks."""
    assert langid.ngram_counts(text) is None and langid.ngram_counts(text + "ж") is not None
    known = spark.createDataFrame([(1, "some words of a language", "en")], "doc_id bigint, text string, lang string")
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), langid.train(known)).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def test_letters_by_category():
    """The line of letters against the Unicode categories of each character."""
    import unicodedata

    rng = random.Random(9)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x300, 0x3500), rng.randint(0xAC00, 0xD7A3)])) for _ in range(40))
        want = "".join(c if unicodedata.category(c).startswith("L") else " " for c in t.lower())
        assert langid.letter_line(t) == " ".join(want.split())


def test_language_odd_rows(spark, odd):
    known = spark.createDataFrame([(i, t, la, None, None, None, None) for i, (t, la) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("", "de"), (None, "en"), ("123", "fr")])], SCHEMA)
    model = langid.train(known)
    assert model.langs == sorted(model.langs) and set(model.langs) == {"de", "en"}
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4 and got[3].score == 0.0 and got[3].rejected
    assert got[1].lang_pred == "en" and set(langid.identify(odd, model).columns) == {*odd.columns, "lang_pred", "score", "rejected"}
    assert langid.identify(odd, langid.train(known.where("false"))).where("lang_pred = 'und' and rejected").count() == 12
    assert langid.identify(odd.where("false"), model).count() == 0


def lm_tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]


@pytest.mark.parametrize("max_entries", [1 << 21, 500])
def test_lm_base_score_and_perplexity(spark, docs, texts, max_entries):
    """With few entries most words are rare and are counted in their shards."""
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    from pyspark.sql import functions as F

    model = ngram_lm.train(docs.where(~held_out(F.col("doc_id"), 7, 2)), max_entries=max_entries)
    assert (model.n, model.v) == (n, v) and len(model.frequent[0]) <= max_entries
    got = {r.doc_id: r for r in ngram_lm.score(docs, model).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = lm_tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in c for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert -1e9 < got[i].score < 0
    unseen = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i].score for i in unseen) > 1.03 * sum(got[i].base_score for i in unseen)  # not far below the base on unseen texts


def lowered(c, least=1, base=1.5):
    """A count rounded down to the scale."""
    steps = [math.ceil(least * base**i - 1e-9) for i in range(60)]
    return max((s for s in steps if s <= c), default=0)


def plain_probability(v, w, c, pairs, total, read, share=0.2):
    """P(w | v) of the docstring, with ``read`` for a bigram's count."""
    p = (c[w] + 1) / total
    return (1 - share) * p + share * read(v, w) / c[v] if c[v] else p


@pytest.mark.parametrize("max_entries", [1 << 21, 500, 1])
def test_lm_score_equals_brute_force(spark, docs, texts, max_entries):
    """Every bigram counts, whichever of its words are rare; ``score`` is the plain formula with counts rounded down (two rare words: the first one's up)."""
    c, pairs = Counter(), Counter()
    for t in texts.values():
        h = ngram_lm.tokens(t).tolist()
        c.update(h)
        pairs.update(zip(h[:-1], h[1:], strict=True))
    n = sum(c.values())
    total, least = n + len(c) + 1, max(1, math.ceil(n / max_entries))
    model = ngram_lm.train(docs, max_entries=max_entries, shard_tokens=20_000)
    assert model.shards > 3 and (max_entries > n) == (least == 1)

    def read(v, w):
        k = pairs[v, w]
        if k >= least:
            return min(lowered(k, least), c[v])
        if c[v] >= least or c[w] >= least:
            return lowered(k)
        ups = sorted({math.ceil(1.5**i - 1e-9) for i in range(60)})
        up = min(s for s in ups if s > c[v]) - 1  # the last count of c(v)'s level
        return lowered(k) * c[v] / max(up, c[v])

    from pyspark.sql import functions as F

    odd = docs.unionByName(docs.select("doc_id", F.reverse("text").alias("text")).withColumn("doc_id", -1 - F.col("doc_id")), allowMissingColumns=True)
    got = {r.doc_id: r.score for r in ngram_lm.score(odd, model).collect()}
    off = []
    for i, t in [*texts.items(), *((-1 - i, t and t[::-1]) for i, t in texts.items())]:
        h = ngram_lm.tokens(t).tolist()
        want = math.log10((c[h[0]] + 1) / total) + sum(math.log10(plain_probability(v, w, c, pairs, total, read)) for v, w in zip(h[:-1], h[1:], strict=True))
        off.append(abs(got[i] - want) / len(h))
    # False positives (0.1 % a probe) and the 0.1 % steps of factors are all that may differ.
    assert np.median(off) < 2e-3 and np.mean(off) < 1e-2 and max(off) < 1


def test_lm_probabilities_sum_to_at_most_one(texts):
    """The mass that rounding down loses is what the docstring says: at most a third of ``share``."""
    words = [lm_tokens(t) for t in texts.values()]
    c, pairs = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t[:-1], t[1:]))
    total = sum(c.values()) + len(c) + 1
    read = lambda v, w: lowered(pairs[v, w])
    for v in [*sorted(c, key=lambda w: -c[w] if w else 0)[:5], "never seen"]:
        mass = sum(plain_probability(v, w, c, pairs, total, read) for w in [*c, "unseen"])
        lost = 0.2 * sum(pairs[v, w] - read(v, w) for w in c) / c[v] if c[v] else 0
        assert mass == pytest.approx(1 - lost, rel=1e-9) and 1 - 0.2 / 3 <= mass + 1e-9


def test_lm_filter_counts_are_of_their_level():
    rng = np.random.default_rng(0)
    h, c = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.integers(5, 3000, 4000)
    f = ngram_lm.LogFrequencyFilter.of(h, c, 5, 1.5)
    low, high = f.counts(h), f.counts_above(h)
    want = np.array([lowered(x, 5) for x in c])
    assert (low >= want).all() and (low == want).mean() > 0.99 and (high >= c).mean() > 0.99 and (high <= c * 1.5 + 1).mean() > 0.97
    assert (f.counts(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.005
    again = ngram_lm.LogFrequencyFilter.unpacked(*f.packed())
    assert (again.counts(h) == low).all() and (ngram_lm.EMPTY.counts(h) == 0).all()


def test_lm_odd_rows(odd):
    model = ngram_lm.train(odd)
    got = ngram_lm.score(odd, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and sum(r.doc_id == 2 for r in got) == 2
    assert by[3].n_tokens == by[4].n_tokens == 1 and by[3].base_score == pytest.approx(by[5].base_score)
    assert by[1].score == pytest.approx(by[2].score) and by[7].n_tokens == 150_001
    assert ngram_lm.score(odd.where("false"), model).count() == 0
    empty = ngram_lm.score(odd, ngram_lm.train(odd.where("false"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in empty)  # one unseen word has all the mass


def test_sharding(spark, texts):
    got = {r.doc_id: r for r in queries.op7_sharding(spark, SF).collect()}
    assert set(got) == set(texts)
    loads, slots, by_text = Counter(), {}, {}
    for i, t in texts.items():
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) == set(range(16)) and max(loads.values()) < 1.1 * min(loads.values())


def plain_loads(sizes, shards):
    """Loads, and shards of each size with how often, of a plain heap over all groups."""
    heap, used = [(0, s) for s in range(shards)], Counter()
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        used[size, s] += 1
        heapq.heappush(heap, (load + size, s))
    return dict((s, load) for load, s in heap), used


@pytest.mark.parametrize("seed", range(6))
def test_classes_are_scheduled_as_a_plain_heap_schedules_groups(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 7, 16])
    sizes = [rng.choice([1, 5, 5, 70, 900, rng.randint(1, 2000)]) for _ in range(rng.choice([0, 3, 200, 3000]))]
    _, used = plain_loads(sizes, shards)
    got = Counter()
    for size, at, ends in sharding.schedule(list(Counter(sizes).items()), shards):
        got.update({(size, s): end - start for s, start, end in zip(at, [0, *ends[:-1]], ends, strict=True)})
    assert got == used
    loads = [rng.randint(0, 500) for _ in range(shards)]
    for count in (0, 1, 4 * shards, 4 * shards + 1, 777):
        want, heap = [0] * shards, [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heapq.heappop(heap)
            want[s] += 1
            heapq.heappush(heap, (load + 9, s))
        assert sharding.filled(loads, 9, count) == want


@pytest.mark.parametrize("n", [300, 20_000])
def test_shards_equal_a_plain_heap(spark, n):
    """At few and at many groups (most of a few sizes), loads are those of a plain heap over all groups."""
    from pyspark.sql import functions as F

    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat(string(id % 9000), int(1 + pow(id % 13, 3) % 40))").alias("text"))
    if n > 1000:
        docs = docs.unionByName(spark.range(9000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    rows = sharding.shard_documents(docs, shards=7).collect()
    groups = Counter()
    for r in docs.collect():
        groups[r.text] += len(r.text) + 1
    want, _ = plain_loads(groups.values(), 7)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert len(rows) == docs.count() and {s: load for s, load in want.items() if load} == dict(loads)
    for s in want:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_odd_rows(odd):
    got = sharding.shard_documents(odd, shards=3).collect()
    assert len(got) == 12 and len({r.shard for r in got if r.doc_id in (1, 2)}) == 1 and len({r.shard for r in got if r.doc_id in (3, 4)}) == 1
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(odd.where("false")).count() == 0
