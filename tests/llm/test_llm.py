import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillgrid.llm")

from brute import components  # noqa: E402

from quillgrid.llm import ann, bpe, chat, common, decontaminate, html_text, langid, minhash, quality, sharding, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS_4 = "doc_id long, text string, lang string, source string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f", "en", "s", 1, "x", "x", "x"),
        (1, "a b c d e f", "en", "s", 1, "x", "x", "x"),
        (2, "A  B\tC\nd e f", None, None, None, None, None, None),
        (3, None, "en", "s", 1, "x", "x", "x"),
        (4, "", "en", "s", 1, "x", "x", "x"),
        (5, "  \n ", "en", "s", 1, "x", "x", "x"),
        (6, "one two", "de", "s", 1, "x", "x", "x"),
        (7, long, "de", "s", 1, "x", "x", "x"),
        (8, "1234 ### 💩", "de", "s", 1, "x", "x", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    return bpe.Codec(bpe.sentencepiece_model(ranks), ranks, P.PATTERN), ranks, P


def test_bpe_equals_tiktoken(codec):
    import tiktoken

    own, ranks, P = codec
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "a\x85b \xa0c　d\x1c e \x00", "\n \n a  ", "x" * 2000, "I'll don't 日本語 ١٢٣ <|endoftext|>"]
    texts += ["".join(rng.choice(" \n\t\x1c\x1fab'sX1é日#💩​ ") for _ in range(rng.randint(1, 50))) for _ in range(2000)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_bpe_query(spark, odd, none, codec):
    _, _, P = codec
    got = {r["doc_id"]: r for r in bpe.encode_decode(odd, P.path(bpe.VOCABULARY), P.PATTERN, with_ids=True).collect()}
    for r in odd.collect():
        assert got[r["doc_id"]]["decoded"] == (r["text"] or "")
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert len(got[r["doc_id"]]["ids"]) == got[r["doc_id"]]["n_tokens"]
    assert bpe.encode_decode(none, P.path(bpe.VOCABULARY), P.PATTERN).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, odd, k, percent):
    rng = random.Random(k)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    base = [f"v{rng.randint(0, 400)}" for _ in range(150)]
    for i in range(100, 160):  # a group of near copies, each edited in its own places
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(200, 230):
        rows.append((i, " ".join(f"u{rng.randint(0, 50)}" for _ in range(rng.randint(1, 12)))))
    want = components(rows, k, percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_large_group_with_few_links(spark):
    rng = random.Random(4)
    base, rows = [f"v{i}" for i in range(300)], []
    for i in range(300):  # two copies edited at the same places: linked with each other only, in buckets of hundreds
        places = rng.sample(range(2, 298, 4), 6)
        for half in range(2):
            words = list(base)
            for p in places:
                words[p] = f"e{rng.randint(0, 10**9)}"
            rows.append((2 * i + half, " ".join(words)))
    want = components(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 250
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_at_the_threshold(spark):
    """A group in which most pairs lie just below the threshold, so that few links hold it together."""
    rng = random.Random(4)
    base, rows = [f"v{i}" for i in range(400)], []
    for i in range(500):
        words = list(base)
        for p in rng.sample(range(400), 7):
            words[p] = f"e{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    want = components(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 100
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_of_ids_with_several_texts_or_none(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (None, a), (None, a), (5, a), (5, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 26, None, True)] * 2 + [(1, 36, 1, True)] * 2 + [(2, 26, 2, True), (3, 36, 1, False), (4, 36, 1, False)] + [(5, 26, 2, False)] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_duplicates_of_a_table(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = components([tuple(r) for r in docs.collect()], 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == want
    assert minhash.near_duplicates(none).count() == 0


def test_shards(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(odd.select("doc_id", "text", "lang", "source"))
    rows = sharding.shard(docs, 4).toPandas()
    assert len(rows) == docs.count()
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * rows["size"].max()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (rows.groupby(["text_crc32", "size"])["shard"].nunique() > 1).sum() <= 3  # only at cuts
    assert sharding.shard(none.select("doc_id", "text", "lang", "source"), 4).count() == 0


def test_shards_cut_a_hot_text(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = sharding.shard(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 12


def test_shards_of_far_ids_equal_rows_and_values_with_one_prefix(spark):
    ids = [2**62 + i for i in range(150)] + [-(2**62) - i for i in range(100)] + [7] * 200 + [None] * 50
    rows = [(i, "same", "common-crawl-en", f"common-crawl-{n % 4}") for n, i in enumerate(ids)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS_4), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 500 and len(sizes) == 8 and sizes.max() - sizes.min() <= 10
    docs = spark.createDataFrame([(i, f"text {100 + i}", "en", f"common-crawl-{'ab'[i % 2]}") for i in range(400)], DOCS_4)
    half = sharding.shard(docs, 2).join(docs, "doc_id").select("shard", "source").distinct()
    assert half.count() == 2  # whole sources, as they are the widest dimension


def test_shard_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = sharding.op7_kd_shards(spark, d).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_decontamination(spark, none):
    item = "A train travels 60 km in 2 hours before Alice boards, and Alice pays 30 dollars for the trip."
    texts = {
        1: f"Some words before it. {item} And after.",
        2: "So: a train travels 9 miles in 7 minutes before Zoe boards, and Zoe pays 8 euros for the trip, twice.",
        3: "So: a train travels 9 miles in 7 minutes before Dave boards, and Erin pays 8 euros for the trip, twice.",
        4: "Nothing of the kind, only 60 km and Alice.",
        5: None,
        6: "",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, slot string")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, "too short", 1), (9, None, 1), (10, "six words that stand for themselves", 1)], "item_id long, text string, at int")
    assert {tuple(r) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7), (2, 7)}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(none.select("doc_id", "text"), bench).count() == 0
    kept = common.only_ids(docs.withColumn("_word", F.lit("y")), decontaminate.matches(docs, bench).select("doc_id"), inside=False)
    assert sorted((r["doc_id"], r["slot"], r["_word"]) for r in kept.collect()) == [(i, "x", "y") for i in (3, 4, 5, 6)]
    assert decontaminate.matches(docs.withColumn("doc_id", F.lit(None).cast("long")), bench).count() == 0


PEOPLE, CITIES = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy".split(), "Rome Paris Oslo Cairo Lima Delhi Quito Bern".split()
STORIES = (
    "{a} has {x} apples and gives {y} of them to {b}. {a} then walks {z} km from {c} to the market with {b}.",
    "{a} pays {x} dollars for a ticket to {c}, and {b} pays {y} dollars more than that. How much did {a} and {b} pay?",
    "In {c} a bus with {x} seats leaves every {y} minutes. How many people can ride with {a} between noon and {z} hours later?",
)


def _story(rng, k):
    a, b = rng.sample(PEOPLE, 2)
    return STORIES[k].format(a=a, b=b, c=rng.choice(CITIES), x=rng.randint(3, 99), y=rng.randint(3, 99), z=rng.randint(3, 99))


def test_decontamination_recall_of_reparameterised_items(spark):
    rng = random.Random(8)
    bench = spark.createDataFrame([(k, _story(rng, k)) for k in range(len(STORIES))], "item_id long, text string")
    filler = lambda: " ".join(f"word{rng.randint(0, 999)}" for _ in range(40))
    rows = [(i, f"{filler()}. {_story(rng, i % 3)} {filler()}") for i in range(90)] + [(100 + i, f"{filler()}. {filler()}") for i in range(90)]
    got = {tuple(r) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len({(i, i % 3) for i in range(90)} & got) >= 86
    assert got <= {(i, i % 3) for i in range(90)}


def test_decontamination_by_shuffle_equals_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert want and sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == want


def test_decontamination_of_long_runs(spark):
    item = "A train travels 60 km in 2 hours before the old driver stops it."
    texts = {
        1: " ".join(["Lima"] * 100_000) + f" {item}",
        2: ",".join(["7"] * 100_000) + f" {item}",
        3: " ".join(f"w{i % 977}" for i in range(700_000)) + f" {item}",  # some MB
        4: "X" * 1_000_000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.matches(docs, bench).collect()} == {(1, 7), (2, 7), (3, 7)}


def test_decontamination_of_numbers_names_and_long_items(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    items = {1: "12, 14, 18, 22, 30 what comes next?", 2: "WHAT IS THE CAPITAL OF FRANCE AND ITS LARGEST RIVER", 3: " ".join(words), 4: "Ann Lee, Bob Ray, Cy Fox, Di Orr, Ed Poe"}
    texts = {i: f"so he asked this. {t} and went on" for i, t in items.items()} | {3: f"so {' '.join(words[100:160])} and", 5: f"so {' '.join(words[100:130])} and", 6: "12, 15, 18, 22, 31 what comes next?"}
    docs, bench = (spark.createDataFrame(list(x.items()), f"{k} long, text string") for x, k in ((texts, "doc_id"), (items, "item_id")))
    assert {tuple(r) for r in decontaminate.matches(docs, bench).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_decontamination_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    items = [flat(r["text"]) for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(x in flat(r["text"]) for x in items)}
    assert {r["doc_id"] for r in decontaminate.matches(docs, bench).collect()} == want


def test_segments_are_maximal():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.choice([-2, -1, -0.5, 0, 1, 2, 3]) for _ in range(rng.randint(0, 14))]
        found = toxicity.segments(s)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        if best > 0:
            assert max(v for *_, v in found) == pytest.approx(best)
        for a, b, v in found:
            assert v == pytest.approx(sum(s[a:b])) and all(sum(s[a:i]) > 0 for i in range(a + 1, b + 1)) and all(sum(s[i:b]) > 0 for i in range(a, b))


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    word = lambda: f"w{rng.randint(0, 60)}"
    rows = []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 8 == 0:
            words[10:10] = ["vile", "scum"]
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(toxicity.train_rows(docs, labels, 1000))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in rows)
    assert toxicity.passages(rows[8][1], model)[0][:2] == (10, 12)
    assert toxicity.accepted(docs.withColumn("score", F.lit("x")), model).columns == ["doc_id", "text", "score"]
    assert toxicity.accepted(docs, model).count() == 350
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == 9 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(toxicity.train_rows(docs, labels.limit(0), 10)) == {"constant": 0.0}


def test_toxicity_fit_reads_whole_texts(spark):
    assert toxicity.MAX_DOCS == 30_000
    clean = [" ".join(["calm"] * 60 + [f"odd{i % 7}"] * 39) for i in range(40)]
    toxic = [" ".join(["calm"] * 60 + ["vile", "calm", "calm"] * k) for k in [80, 400] * 20]
    rows = [(i, t, int(i >= 40)) for i, t in enumerate(clean + toxic)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    folds = {0: {}, 1: {}}
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")).collect()}
    n = {(f, t): sum(fold[i] == f and x == t for i, _, x in rows) for f in (0, 1) for t in (0, 1)}
    for f in folds:  # each fold is scored by the other's odds
        counts = {}
        for i, text, t in rows:
            if fold[i] != f:
                for s in {x for w in set(toxicity.tokens_of(text)) for x in toxicity.steps_of(w)}:
                    c = counts.setdefault(s, [0, 0])
                    c[1 - t] += 1
        folds[f] = toxicity._log_odds(counts, n[1 - f, 1], n[1 - f, 0])
    scanned = [(t, toxicity.scan(text, toxicity._Tokens(folds[fold[i]]))) for i, text, t in rows]
    values = np.concatenate([s for t, (_, s, _) in scanned if t == 0])
    best = [(size, max((v for *_, v in found), default=0.0), 1) for t, (size, _, found) in scanned if t == 0]
    law = toxicity._law(values, np.ones(len(values)), best)
    assert model["law"] == pytest.approx(law, rel=0.01, abs=0.01)
    x = np.array([toxicity._evidence(size, found, law) for _, (size, _, found) in scanned])
    assert model["curve"] == pytest.approx(toxicity._logistic(x, np.array([t for t, _ in scanned], float)).tolist(), rel=0.05, abs=0.05)


def test_language(spark, odd, none):
    en, de = "the house of the old man", "das haus von dem alten mann"
    train = spark.createDataFrame([(i, t, x) for i in range(20) for t, x in ((en, "en"), (de, "de"))] + [(99, en, None), (98, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    docs = spark.createDataFrame([(1, "the man"), (2, "dem haus"), (3, None), (4, "123 !"), (5, "househome"), (6, "mannhaus")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert len(langid.predict(odd, model).collect()) == 9
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(train.limit(0))).collect()} == {"und"}


def test_letters():
    assert langid.words_of("½ ² Ⅷ ٣ _ 12") == [] and langid.words_of("e² naïve日本") == ["e", "naïve日本"]


def test_language_of_a_very_long_word(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 1000)
    word = "ab" * 3000 + "xyz"
    assert [g for p in langid.pieces_of(word, 4) for g in p] == langid.grams_of(word, 4)


def test_language_equals_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]
    counts = defaultdict(Counter)  # (lang, n)
    for r in train:
        for w in langid.words_of(r["text"]):
            counts[r["lang"], 0][w] += 1
            for n in range(1, 6):
                counts[r["lang"], n].update(f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted({x for x, _ in counts})
    totals = {k: sum(c.values()) for k, c in counts.items()}

    def feature(f, n):
        seen = [counts[x, n][f] if n or counts[x, n][f] > 1 else 0 for x in langs]
        if not any(seen):
            return None
        logs = [math.log(c / totals[x, n] if c else 0.5 / (totals[x, n] + 1)) for c, x in zip(seen, langs, strict=True)]
        return np.array(logs) - np.mean(logs)

    def word(w):
        if (s := feature(w, 0)) is not None:
            return s
        for n in range(5, 0, -1):
            got = [s for i in range(len(w) + 3 - n) if (s := feature(f"<{w}>"[i : i + n], n)) is not None]
            if got:
                return np.mean(got, axis=0)
        return np.zeros(len(langs))

    got = {r["doc_id"]: r["lang_pred"] for r in langid.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    for r in rows[:300]:
        words = langid.words_of(r["text"])
        assert got[r["doc_id"]] == (langs[int(np.argmax(sum(map(word, words))))] if words else "und")


def test_language_model_bounds(spark):
    rows = [(i, "hello there", "en") for i in range(15_000)] + [(20_000 + i, "hello there", f"l{i}") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["langs"]) == 31  # a sample of 20,000 leaves no row of these out
    assert len(model["places"]) == 6 and "<hell" in model["places"][5]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lang = langid.op9_language_id(spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    good = quality.op10_quality(spark, d).where("held_out").join(labels, "doc_id")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    found = toxicity.op6_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {r["toxic"]: r["p"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] > 0.8 and share[0] < 0.05


def test_pool_is_every_unlabelled_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    views = quality.features(docs)
    model = quality.fit(docs, labels, views=views)
    counted = views.mapInArrow(quality._pool_scores(model), "view int, bin int, n long").groupBy("view").agg(F.sum("n").alias("n")).collect()
    assert [r["n"] for r in counted] == [docs.count()] * 2
    low, high, below, above = quality._cuts({-3000: 4, -2000: 5, -10: 9, 10: 9, 1500: 6}, 6, 3)
    assert (low, below, high, above) == (-2000, 9, 1500, 6)
    again = quality.fit(docs, labels.unionByName(labels.withColumn("quality", F.lit(0))), views=views)  # the larger label counts
    assert np.allclose(again["both"], model["both"])


def test_digit_share_is_of_the_whole_text():
    for text in ("", "a1" * 1950, "a1" * 2000, "a" * 2000 + "7" * 1999, "".join("5" if i % 10 else "b" for i in range(20_000))):
        assert quality.text_view(text)[9] == pytest.approx(sum(map(str.isdigit, text)) / max(1, len(text)) * 10)


def test_quality_edges(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(quality.score(odd, model).collect()) == 9
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.score(none, model).count() == 0
    nothing = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing == {"constant": 1.0} and quality.accepted(odd, nothing).count() == 9


PAGE = "<!DOCTYPE html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li>Menu</li></ul></nav><header>Head</header><article><h1>Big &amp; bold</h1><p>One<br>two <b>th</b>ree<p>Four &lt;5&gt;<div class='comments'>I say</div></article><aside>x</aside><footer>f</footer></body>"


def test_html(spark):
    rows = [(1, "http://a.com/1", PAGE, "x"), (1, "http://a.com/1", PAGE, "x"), (2, None, None, "x"), (3, "http://a.com/2", "", "x"), (4, "http://a.com", "just <i>te</i>xt < 3 <scr", "x")]
    rows += [(10 + i, f"http://b.com/{i}", f"<body><div class=q1><ul><li>Home</li><li>Us</li></ul></div><div><p>story {i}</p><p>more of {i}</p></div><div>All rights</div>", "x") for i in range(30)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Big & bold One two three Four <5>" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""
    assert got[4]["text"] == "just text < 3"
    assert got[15]["text"] == "story 5 more of 5"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_section_templates_of_a_large_host(spark):
    rows = [(i, f"http://a.com/{i}", f"<body><div class=q><p>section {i // 8}</p><p>more here</p></div><div><p>story {i}</p></div></body>") for i in range(800)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i}" for i in range(800)}


def test_words_in_names_and_attributes_keep_their_text():
    main = lambda page: html_text._main(html_text.parse(page)[0], [])
    assert main("<article><p title=it's>one two</p><p>don't stop</p></article>") == "one two don't stop"
    kept = '<div class="share-price"><p>price</p></div><section id="notice-of-motion"><p>motion</p></section>'
    gone = '<div class="share-buttons">a</div><div class="commentList">b</div><div id="comments-42">c</div><div class="x ad">d</div>'
    assert main(f"<article>{kept}{gone}<p>end</p></article>") == "price motion end"
    assert main("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_template_is_counted_before_names_are_looked_at(spark, monkeypatch):
    rows = [(i % 37, f"http://a.com/{i}", f"<body><nav><a href=/>Home</a></nav><div class=z>All rights</div><div><p>story {i}</p></div></body>") for i in range(40)]
    rows += [(i, f"http://b.com/{i}", f"<body><nav><a href=/>Home</a></nav><div><p>story {i}</p></div></body>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, html_text.extract(pages).collect()))
    assert {(r[2], r[4] > 0) for r in got if "a.com" in r[1]} == {(f"story {i}", True) for i in range(40)}
    assert {(r[2], r[4]) for r in got if "b.com" in r[1]} == {(f"story {i}", 0) for i in range(3)}
    monkeypatch.setattr(html_text, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, html_text.extract(pages).collect())) == got


def test_extraction_equals_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    seen, parsed = defaultdict(set), []
    for r in pages:
        blocks, spans = html_text.parse(r["html"] or "")
        parsed.append((r, blocks, spans))
        for h, *_ in spans:
            seen[html_text.host_of(r["url"]), h].add(html_text._main(blocks, []))
    want = {}
    for r, blocks, spans in parsed:
        gone = {i for h, a, b in spans if len(seen[html_text.host_of(r["url"]), h]) >= 5 for i in range(a, b)}
        left = [(t, region) for i, (t, region, listed) in enumerate(blocks) if i not in gone and not listed]
        want[r["page_id"]] = " ".join(t for t, region in left if region == max(x for _, x in left))
    assert {r["page_id"]: r["text"] for r in html_text.op8_html_extract(spark, "/root/testdata/sf0.01").collect()} == want


def test_mirrors_keep_their_article(spark):
    rows = [(i, f"http://a.com/{i}", "<article><h1>Same</h1><div><p>story</p></div></article>") for i in range(40)]
    assert {r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same story"}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "a\\b<\\|c", "", None, "💩<|", "x\n\ny\\"]
    rows = [(c, t, "assistant" if t % 2 else "user\n<|", nasty[(c + t) % len(nasty)], "x") for c in range(4) for t in range(300 if c == 0 else 5)]
    rows += [(9, 1, None, "t", "x"), (9, 1, None, "t", "x")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf string")
    messages = chat.as_trees(said)
    turns = chat.paths(messages).join(messages.select("tree", "message", "role", "text"), ["tree", "message"])
    done = {r["tree"]: r for r in chat.format_paths(turns).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert chat.read(done[c]["formatted"]) == [(r[2] or "", r[3] or "") for r in mine]
        learned = [chat.unescape(done[c]["formatted"][s["start"] : s["start"] + s["length"]]) for s in done[c]["loss"]]
        assert learned == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert chat.paths(messages.limit(0)).count() == 0
    far = spark.createDataFrame([(1, t, "user", f"{t}", "x") for t in (5000, None, -9, 1024, 3)] + [(None, 1, "user", "a", "x")], "conv_id long, turn long, role string, text string, leaf string")
    assert [r["text"] for r in chat.as_trees(far).orderBy("message").collect()] == ["None", "-9", "3", "1024", "5000"]
    assert chat.as_trees(far).agg(F.max("message")).first()[0] == 5


def test_chat_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    got = chat.op4_chat_format(spark, "/root/testdata/sf0.01")
    want = con.execute(f"select {', '.join(got.columns)} from ({chat.ORACLE_SQL['op4_chat_format']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 0.0), (1, 6, 77, 1.0), (1, 8, 9, 1.0), (1, 9, 8, 1.0), (2, 1, None, None)]
    trees = spark.createDataFrame(rows, "tree long, message long, parent long, score double")
    got = {}
    for r in chat.paths(trees).orderBy("position").collect():
        got.setdefault((r["tree"], r["leaf"]), []).append(r["message"])
    assert got == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (1, 6): [6], (2, 1): [1]}
    assert {(r["tree"], r["leaf"]) for r in chat.paths(trees, branches=1).collect()} == {(1, 4), (2, 1)}


def _exact(rows, top):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in good:
        out[q] = [j for _, j in sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), j) for j, v in good.items() if j != q)][:top]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 3), (2004, [None] + [1.0] * 7), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "id long, vec array<double>, score double")
    want = _exact(rows, 10)
    got: dict[int, list] = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    queries = [i for i in want if i % 20 == 0]
    assert set(got) == set(queries)
    hits = sum(len(set(got[q]) & set(want[q])) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)
    assert got[1000] == want[1000]  # its copies, smallest ids first


def test_search_finds_clusters_without_an_entry(spark):
    rng = np.random.default_rng(3)
    n, each = 900, 40  # more nodes than SPACING to each broadcast entry
    x = (rng.uniform(-10, 10, (n, 1, 8)) + rng.normal(0, 0.01, (n, each, 8))).reshape(-1, 8)
    codes = ann.encode(x)
    near, want = [], {}
    for c in range(n):  # the graph links each node to its 32 nearest, all inside the cluster
        part = x[c * each : (c + 1) * each]
        d = ((part[:, None] - part[None, :]) ** 2).sum(axis=2)
        for i, row in enumerate(d):
            order = [int(j) for j in np.argsort(row) if j != i]
            near.append((c * each + i, [(float(row[j]), c * each + j) for j in order[: ann.DEGREE]]))
            want[c * each + i] = [c * each + j for j in order[:10]]
    asked = list(range(0, n * each, 311))
    table = spark.createDataFrame(list(enumerate(codes)), "node long, code binary")
    graph = spark.createDataFrame(near, "node long, old array<struct<d:float,other:bigint>>")
    found: dict[int, set] = {}
    for r in ann.search(table.where(F.col("node") % 311 == 0).select(F.col("node").alias("query"), "code"), table, graph).collect():
        found.setdefault(r["query"], set()).add(r["node"])
    assert sum(len(found[q] & set(want[q])) for q in asked) >= 0.99 * 10 * len(asked)


def test_few_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 10).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    assert got == {0: [(3, 1.0), (20, 1.414214)], 20: [(3, 1.0), (0, 1.414214)]}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(df.limit(1), F.col("id") % 20 == 0).count() == 0
