"""Corpus operators against brute force, and on rows that are odd in every way the contract names."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F
from util import agree

from trailmark.llm import common, exact_dedup, fuzzy_hash, kd_shards, language_id, license_scan, minhash, mixture, packing, suffix_dedup, toxicity
from trailmark.llm.components import connected_components
from trailmark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, node long, h long"
TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def documents(spark, texts, ids=None):
    """Extra columns carry names that operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, [None, "en", "fr"][n % 3], [None, "a", "b", "b"][n % 4], None, "x", 1, 2) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, one long text, ties and repeated rows."""
    words = [f"w{i % 97}x" for i in range(30_000)]
    return documents(spark, [None, "", "   ", "!!!", "one", "one", "One", " ".join(words), "a b c d e f g", "ünïcode ß 東京", "a b c d e f g"], [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9])


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracles(spark, duck, name):
    if name in ORACLE_SQL:
        agree(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_empty_tables(spark, some):
    none = some.limit(0)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (
        suffix_dedup.remove_repeats(none), language_id.identify(none, {}), kd_shards.kd_shards(none), fuzzy_hash.compare_with_next(none), toxicity.score_toxicity(none, labels),
        mixture.mix_sources(none), minhash.near_duplicates(none), license_scan.scan_licenses(none), packing.pack_documents(none, TOKENIZER), exact_dedup.exact_groups(none),
        mixture.mixed(none), minhash.drop_near_copies(none), exact_dedup.drop_exact_copies(none),
    ):
        assert df.count() == 0
    assert language_id.learn_profiles(none) == {}


# 1 suffix arrays


def removed(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        rest = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        yield len(b), sum(mark), spans, sha256(rest).hexdigest()


def passages(texts, length):
    """Maximal runs covered by strings that other texts have too."""
    held = defaultdict(set)
    for n, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            held[b[i : i + length]].add(n)
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if len(held[b[i : i + length]]) > 1:
                mark[i : i + length] = b"\1" * length
        yield sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))


@pytest.mark.parametrize(("contents", "shard"), [(1, 500), (1000, 10**6)])
def test_repeats(spark, contents, shard):
    random.seed(contents)
    passage = "".join(random.choice("abcdé") for _ in range(300))
    texts = ["".join(random.choice("ab c") for _ in range(random.randrange(200))) + passage[random.randrange(100) : random.randrange(120, 300)] + "".join(random.choice("xyz") for _ in range(random.randrange(90))) for _ in range(40)]
    texts += [None, "", "aaaa" * 60, texts[0], texts[1]]
    df = documents(spark, texts)
    got = suffix_dedup.remove_repeats(df, length=60, passage=30, gram=8, shard=shard, contents=contents).orderBy("doc_id").collect()
    data = [(t or "").encode() for t in texts]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == list(removed(data, 60))
    assert [r["n_passages"] for r in got] == list(passages(data, 30))


def test_repeats_odd(spark, odd):
    got = suffix_dedup.remove_repeats(odd.withColumn("text", F.repeat("text", 200)), length=400).collect()
    assert len(got) == odd.count()
    assert {r["n_removed"] for r in got if r["n_bytes"] < 400} == {0}
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] in (4, 7, 9))  # repeated rows and copies


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(2, 300))).astype(np.uint8)
        order, rank, eight = suffix_dedup.suffix_order(data, 16)
        text = data.tobytes()
        heads = [text[i : i + 16] for i in order]
        assert heads == sorted(heads)
        found = suffix_dedup.common_prefixes(order, rank, eight, 16, lanes=int(rng.integers(1, 9)))
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert found[k] == min(same, 16)


def test_shared_strings_by_ranks_need_no_prefixes(monkeypatch):
    """Neighbours share what their bytes say, and shards are searched without a pass for common prefixes."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 3, 90, dtype=np.uint8).tobytes() for _ in range(4)]
    for n in (1, 9, 60, 400):
        for data in (rng.integers(0, 2, n, dtype=np.uint8), np.zeros(n, np.uint8), np.frombuffer(b"".join(words[i] for i in rng.integers(0, 4, n // 9 + 1)), np.uint8)):
            for passage, length in ((8, 8), (8, 30), (13, 50), (32, 77), (64, 64)):
                kept = {(depth := 2 ** (passage.bit_length() - 1)): None}
                order, _, _ = suffix_dedup.suffix_order(data, length, kept)
                for width in (passage, length):
                    got = suffix_dedup.shares(order, kept[depth], depth, width)
                    slow = [i > 0 and max(order[i], order[i - 1]) + width <= len(data) and bytes(data[order[i] : order[i] + width]) == bytes(data[order[i - 1] : order[i - 1] + width]) for i in range(len(data))]
                    assert got.tolist() == slow
    monkeypatch.setattr(suffix_dedup, "common_prefixes", None)
    text = rng.integers(0, 250, 130, dtype=np.uint8).tobytes()
    found, wide, _ = suffix_dedup.repeated_starts([text, b"x" + text], [50, 51], [1, 1], [1, 2], [False, False], 80, 16)
    assert found[0].tolist() == list(range(50)) and found[1].tolist() == list(range(1, 51))
    assert wide[0].tolist() == list(range(50)) and wide[1].tolist() == list(range(1, 51))


# 2 language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op2_rank_order_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_against_counting():
    letters = language_id._letter_table()
    text = "Ab a1b, ab ßé"
    grams, counts = language_id.ngram_counts(text, letters)
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    want = Counter([c for c in plain if c != " "] + [plain[i : i + 2] for i in range(len(plain) - 1)] + [plain[i : i + 3] for i in range(len(plain) - 2) if plain[i + 1] != " "])
    assert sorted(counts) == sorted(want.values()) and len(grams) == len(want)


def test_language_odd(spark, odd):
    profiles = language_id.learn_profiles(documents(spark, ["the cat and the hat", "le chat et la vache"] * 3).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")))
    got = language_id.identify(odd, profiles)
    assert got.count() == odd.count() and set(got.columns) == {*odd.columns, "lang_pred", "score"}
    assert {r["lang_pred"] for r in got.filter("doc_id IN (1, 2, 3) OR doc_id IS NULL").collect()} == {"und"}


def slow_language(texts, profiles, length):
    """Out-of-place distances from counted n-grams."""
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        counts = Counter()
        for w in words:
            framed = f" {w} "
            counts.update(w)
            counts.update(framed[i : i + 2] for i in range(len(framed) - 1))
            counts.update(framed[i : i + 3] for i in range(len(framed) - 2))
        number = lambda g: sum((ord(c) if c != " " else 0) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) | {1: 0, 2: 1 << 62, 3: 1 << 61}[len(g)]
        own = [g for _, g in sorted((-n, number(g)) for g, n in counts.items())[:length]]
        if not own:
            yield "und", 0.0
            continue
        far = {x: sum(abs(p.index(g) - i) if g in p else length for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        yield best, 1 - far[best] / (length * len(own))


def test_language_against_slow_distances(spark, some):
    docs = some.limit(60)
    profiles = language_id.learn_profiles(some.filter(F.col("lang").isNotNull()), length=80)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, profiles, length=80).collect()}
    text = texts_of(docs)
    for (d, t), (lang, score) in zip(text.items(), slow_language(text.values(), profiles, 80), strict=True):
        assert got[d][0] == lang and got[d][1] == pytest.approx(score), t[:50]


# 3 shards


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = kd_shards.kd_shards(docs, shards=8).collect()
    text = texts_of(docs)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        b = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 1, zlib.crc32(b))
    slots, sizes, home = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        home[text[r["doc_id"]]].add(r["shard"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)


def test_shards_odd(spark, odd):
    assert kd_shards.kd_shards(odd).count() == odd.count()
    same = documents(spark, ["copy"] * 400)
    sizes = kd_shards.kd_shards(same).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 8 and max(r["s"] for r in sizes) < 2 * min(r["s"] for r in sizes)  # one hot group is parted
    with pytest.raises(ValueError, match="more than 10"):
        kd_shards.kd_shards(same, target_bytes=1, max_leaves=10)


@pytest.mark.parametrize("n", [1, 9, 40, 300])
def test_shards_of_uneven_sizes(spark, n):
    """Sizes over four magnitudes, and groups of copies: eight shards, equal texts together, no shard far from the others."""
    rng = random.Random(n)
    texts = ["x" * int(10 ** rng.uniform(1, 5)) + str(i) for i in range(n)]
    texts += [rng.choice(texts) for _ in range(n // 3)]
    got = kd_shards.kd_shards(documents(spark, texts), shards=8).collect()
    sizes, home, groups = Counter(), defaultdict(set), Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
        home[texts[r["doc_id"]]].add(r["shard"])
        groups[texts[r["doc_id"]]] += r["size"]
    assert set(sizes) <= set(range(8)) and len(got) == len(texts)
    mean, largest = sum(sizes.values()) / 8, max(groups.values())
    for text, where in home.items():
        assert len(where) == 1 or groups[text] > mean
    if largest <= mean:
        assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * mean + (largest if n < 100 else 0)


# 4 fingerprints


def test_fingerprints(spark, some):
    text = sorted(texts_of(some).items())
    want = {d: (len(t), sha256(fuzzy_hash.edited(t, n).encode()).hexdigest(), fuzzy_hash.fingerprint(t)) for (d, t), (_, n) in zip(text, text[1:] + text[:1], strict=True)}
    got = fuzzy_hash.compare_with_next(some, rows_per_part=16).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got} == want
    long = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and np.mean([r["near_next"] for r in long]) < 0.1


def test_rolling_hash_and_subsequence():
    data = np.frombuffer(b"the quick brown fox", np.uint8)
    got = fuzzy_hash.rolling(data)
    for i in range(len(data)):
        window = [int(data[i - b]) if i >= b else 0 for b in range(7)]
        shifted = 0
        for b, c in enumerate(window):
            shifted ^= c << (5 * b % 32) & 0xFFFFFFFF
        assert int(got[i]) == (sum(window) + sum((7 - b) * c for b, c in enumerate(window)) + shifted) % 2**32

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
        return row[-1]

    random.seed(0)
    for _ in range(50):
        a, b = ("".join(random.choice("abcd") for _ in range(random.randrange(20))) for _ in range(2))
        assert fuzzy_hash.common_subsequence(a, b) == longest(a, b)


def slow_fingerprint(text):
    """Byte by byte, as the method is told."""
    data = text.encode()

    def letters(block):
        out, begin = [], 0
        for i in range(len(data)):
            window = data[max(0, i - 6) : i + 1]
            shifted = 0
            for back, c in enumerate(reversed(window)):
                shifted ^= (c << 5 * back % 32) & 0xFFFFFFFF
            rolled = (sum(window) + sum((7 - back) * c for back, c in enumerate(reversed(window))) + shifted) % 2**32
            if rolled % block == block - 1 and len(out) < 63:
                out.append(fuzzy_hash.LETTERS[zlib.crc32(data[begin : i + 1]) & 63])
                begin = i + 1
        if begin < len(data):
            out.append(fuzzy_hash.LETTERS[zlib.crc32(data[begin:]) & 63])
        return "".join(out)

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(letters(block)) < 32:
        block //= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def slow_likeness(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            above, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(above[j - 1] if c == d else 1 + min(above[j], row[-1]))
        return row[-1]

    (m, *ours), (n, *theirs) = a.split(":"), b.split(":")
    best = 1.0 if a == b else 0.0
    for i, x in enumerate(ours):
        for j, y in enumerate(theirs):
            if int(m) << i == int(n) << j:
                k = max(1, min(4, min(len(x), len(y)) // 4))
                common = any(x[p : p + k] in y for p in range(len(x) - k + 1)) if x and y else x == y
                best = max(best, (1 - distance(x, y) / (len(x) + len(y)) if x or y else 1.0) if common else 0.0)
    return best


def test_fingerprints_against_slow_ones():
    rng = random.Random(4)
    texts = ["", "a", "é" * 50] + ["".join(rng.choice("abcde é\n") for _ in range(rng.randrange(3000))) for _ in range(12)]
    prints = [fuzzy_hash.fingerprint(t) for t in texts]
    assert prints == [slow_fingerprint(t) for t in texts]
    prints += [fuzzy_hash.fingerprint(t[: len(t) * 3 // 4] + texts[-1][:40]) for t in texts]
    for a in prints:
        for b in prints:
            assert fuzzy_hash.likeness(a, b) == pytest.approx(slow_likeness(a, b))


def test_fingerprints_odd(spark, odd):
    got = fuzzy_hash.compare_with_next(odd, rows_per_part=3).collect()
    assert len(got) == odd.count()
    only = fuzzy_hash.compare_with_next(odd.filter("doc_id = 6")).collect()[0]
    assert only["near_next"] == 1.0
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[7] == by[9] and by[1] == by[None]


# 5 toxicity


def test_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = toxicity.score_toxicity(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    clean = [r for r in got if not r["toxic"]]
    toxic = [r for r in got if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def kneser_ney(texts, discount, shared):
    """P(letter | beginning) of either class as dicts, counted one by one: class -> beginning -> letter -> p."""
    count = {0: Counter(), 1: Counter()}
    for text, y in texts:
        for word in set(toxicity.words_of(text)):
            for i in range(len(word) + 2):
                count[y][(word + "$")[:i]] += 1
    both = count[0] + count[1]
    nodes = [p for p in both if p]
    kids = Counter(p[:-1] for p in nodes)
    follows = Counter(p[-1] for p in nodes)
    found = {0: defaultdict(dict), 1: defaultdict(dict)}
    for p in nodes:
        q = p[:-1]
        backoff = max(both[p] - shared, 0) / both[q] + shared * kids[q] / both[q] * follows[p[-1]] / len(nodes)
        for y in (0, 1):
            taken = sum(min(discount, count[y][q + x]) for x in follows if q + x in both)
            left = taken / count[y][q] if count[y][q] else 1.0
            found[y][q][p[-1]] = (max(count[y][p] - discount, 0) / count[y][q] if count[y][q] else 0.0) + left * backoff
            found[y][q][None] = left  # what a letter never seen gets, but for the backoff
    return found, count[1]


def test_kneser_ney_against_counting(spark):
    rng = random.Random(8)
    stems = ["lo", "low", "ba", "bar", "be", "ü"]
    texts = [(" ".join(rng.choice(stems[: 3 + 3 * y]) + rng.choice(["", "n", "ei", "er", "x" * 300]) for _ in range(12)), y) for y in (0, 0, 1) for _ in range(30)]
    found, toxic = kneser_ney(texts, 2.0, 0.75)
    model = toxicity.Model.of(toxicity.learn(spark.createDataFrame(texts, "text string, toxic int"), discount=2.0, shared_discount=0.75))
    words = sorted({w for t, _ in texts for w in toxicity.words_of(t)}) + ["lowx", "zz", "barei"]
    for word, got in zip(words, model.of_words(words).tolist(), strict=True):
        want = 0.0
        for i, x in enumerate(word + "$"):
            q = word[:i]
            if toxic[q] <= 2:
                break  # from here on both go on with the shared counts
            x = x if x in found[1][q] else None
            want += np.log(found[1][q][x] / found[0][q][x])
            if x is None:
                break
        assert got == pytest.approx(want, abs=1e-9), word
    for y in (0, 1):
        for q, p in found[y].items():
            seen = sum(v for x, v in p.items() if x)
            assert seen <= 1 + 1e-9  # the rest is for letters that never follow


def test_most_toxic_passage():
    assert toxicity.most_toxic(np.array([]), 2) == 0 and toxicity.most_toxic(np.array([3.0]), 2) == 3
    rng = np.random.default_rng(1)
    for n in (2, 3, 9):
        x = rng.normal(size=n)
        assert toxicity.most_toxic(x, 2) == pytest.approx(max(x[i : i + 2].mean() for i in range(n - 1)))


def test_toxicity_of_a_model_above_max_nodes(spark, some, odd):
    """The model stays whole: the scores are those of the form that holds it in memory."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = some.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(some.select("doc_id", "text").limit(3))
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["score"])
    want, got = (sorted(toxicity.score_toxicity(docs, labels, max_nodes=m).collect(), key=key) for m in (300_000, 1))
    assert sum(r["predicted"] for r in want) > 0 and len(want) == len(got)
    for x, y in zip(want, got, strict=True):
        assert (x["doc_id"], x["predicted"]) == (y["doc_id"], y["predicted"]) and x["score"] == pytest.approx(y["score"], abs=1e-9)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (77, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.threshold([(0.0, 0), (0.1, 0), (0.5, 1)]) == pytest.approx(0.3)


def test_threshold_of_all_rows(spark):
    """Running counts in ranges find what one sorted list does."""
    rng = random.Random(5)
    cases = [[(rng.choice([rng.gauss(y, 1.5), round(rng.gauss(y, 1), 1)]), y) for y in (rng.random() < share for _ in range(n)) for y in [int(y)]] for n, share in ((1, 1), (2, 0.5), (40, 0.3), (400, 0.1), (400, 0.9))]
    cases += [[], [(1.0, 0)], [(-1.0, 1), (-2.0, 0)], [(0.5, 1), (0.5, 0)], [(0.0, 1), (2.0, 0), (2.0, 1)]]
    for pairs in cases:
        want = toxicity.threshold(pairs)
        rows = spark.createDataFrame(pairs, "ratio double, toxic int")
        assert [toxicity.fitted_threshold(rows, part_rows=n) for n in (7, 50_000)] == [want, want]


def test_labels_behind_the_first_200_000_move_the_threshold(spark):
    """Only the last 500 labelled rows by hash of the id show that the middling word is toxic rather than not."""
    rows = spark.range(200_500).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")).alias("at"))
    word = F.when(F.col("at") > 200_000, "murk").when(F.col("at") <= 100, "murk").when(F.col("at") <= 1100, "vile").otherwise("calm")
    rows = rows.select("doc_id", F.concat_ws(" ", word, "doc_id").alias("text"), ((F.col("at") > 200_000) | F.col("at").between(101, 1100)).cast("int").alias("toxic")).cache()
    got = toxicity.score_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).join(rows, "doc_id")
    found = {(r[0], r[1]): r[2] for r in got.groupBy(F.split("text", " ")[0], "predicted").count().collect()}
    rows.unpersist()
    assert found == {("murk", 1): 600, ("vile", 1): 1000, ("calm", 0): 198_900}


# 6 mixing


def test_mixture_against_a_fold(spark, some):
    got = mixture.mix_sources(some, target_entropy=0.99, max_repeats=1.5).collect()
    tokens = Counter()
    for r in got:
        assert r["copies"] >= 0
        tokens[r["source"]] += r["tokens"]
    total = sum(tokens.values())
    shares = [tokens[s] / total for s in sorted(tokens)]
    a = mixture.find_exponent(shares, 0.99, 1.5)
    z = sum(s**a for s in shares)
    read = Counter()
    longest = max(r["tokens"] for r in got)
    for r in got:
        read[r["source"]] += r["tokens"] * r["copies"]
    for s, share in zip(sorted(tokens), shares, strict=True):
        budget = share**a / z * total
        assert -1 <= budget - read[s] <= longest  # a block is filled in order until one document does not fit
        assert read[s] <= 1.5 * tokens[s] + longest


def test_exponent():
    shares = [0.7, 0.1, 0.1, 0.05, 0.05]
    a = mixture.find_exponent(shares, 0.95, 100)
    assert mixture.entropy(shares, a) == pytest.approx(0.95 * np.log(5), abs=1e-9)
    b = mixture.find_exponent(shares, 1.0, 2.0)
    assert mixture.repetition(shares, b, 1.0) == pytest.approx(2.0, abs=1e-6)
    assert mixture.find_exponent([0.5, 0.5], 0.5, 9) == 1.0 and mixture.find_exponent([1.0], 0.5, 9) == 1.0


def test_mixture_odd(spark, odd):
    assert mixture.mix_sources(odd).count() == odd.count()
    out = mixture.mixed(odd)
    assert out.columns == odd.columns
    with pytest.raises(ValueError, match="sources"):
        mixture.mix_sources(odd, max_sources=1)


# 7 near copies


def components(texts, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, size, percent):
    random.seed(size)
    base = [[f"w{random.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    texts = {}
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(random.randrange(5)):
            words[random.randrange(len(words))] = f"n{random.randrange(9999)}"
        texts[i] = " ".join(words)
    texts |= {150: "a b", 151: "A  b", 152: "", 153: "x y z", 154: "x y z q"}
    df = documents(spark, list(texts.values()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size, percent).collect()}
    assert got == components(texts, size, percent)


def test_near_copies_in_small_chunks(spark):
    random.seed(3)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        words = list(base)
        words[random.randrange(200)] = f"n{i}"
        texts[i] = " ".join(words)
    df = documents(spark, list(texts.values()))
    drawn = minhash.sketches(df, 5, 22, 4)
    pairs = minhash.candidates(minhash.buckets(drawn), 0.8, chunk=8)
    links = minhash.confirmed(df, pairs, 5, 80, chunk=8)
    assert {r["component"] for r in connected_components(links).collect()} == {0}
    assert pairs.count() < 22 * 9 * 120


def look_alikes(n):
    """Texts of 80 words, all alike at 70/90, and pairs of them at 72/88."""
    return {i: " ".join([f"c{k}" for k in range(70)] + [f"p{i // 2}a", f"p{i // 2}b"] + [f"o{i}n{k}" for k in range(8)]) for i in range(n)}


def test_links_among_look_alikes(spark):
    df = documents(spark, list(look_alikes(200).values()))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 1, 80).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


def test_links_across_chunks_of_a_bucket(spark):
    texts = look_alikes(700)
    df = documents(spark, list(texts.values()))
    sizes = minhash.buckets(minhash.sketches(df, 1, 22, 4)).groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes > 256
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 1, 80).collect()}
    assert got == {i: i - i % 2 for i in range(700)}


def test_near_copies_odd(spark, odd):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 3, 85).collect()}
    assert (7, 7, True) in got and (9, 7, False) in got and (5, 4, False) in got
    assert {(1, 1, True), (2, 2, True)} <= got
    assert minhash.drop_near_copies(odd).columns[0] == "doc_id"


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (50, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 100: 50, 101: 50, 102: 50}
    assert connected_components(df.limit(0)).count() == 0


# 8 licences


def test_licences_against_scanning(spark, some):
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(some).collect()}
    for d, t in texts_of(some).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(fold))
        hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[d]
        places = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_templates():
    made = license_scan.compile_template("one <<optional>>big <<optional>>red<</optional>><</optional>> dog <<any:2>> barks")
    run = lambda t: made.run(t.split(), 0)
    assert run("one dog barks") == 3 and run("one big dog barks x") == 4 and run("one big red dog so very barks") == 7
    assert run("one red dog barks") == -1 and run("one dog a b c barks") == -1
    for bad in ("<<optional>>a<</optional>>", "<<optional>>a", "<<any:2>> a", "<<what>> a"):
        with pytest.raises(ValueError):
            license_scan.compile_template(bad)


def as_pattern(markup):
    """The same template for the regular expression engine, over words that each end with a blank."""
    import re

    out = []
    for token in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if token in ("<<optional>>", "<</optional>>"):
            out.append("(?:" if token == "<<optional>>" else ")?")
        elif token.startswith("<<any:"):
            out.append(rf"(?:\S+ ){{0,{token[6:-2]}}}")
        elif token.startswith("<<one:"):
            out.append("(?:" + "|".join("".join(f"{w} " for w in license_scan.words_of(x)) for x in token[6:-2].split("|")) + ")")
        else:
            out += [f"{w} " for w in license_scan.words_of(token)]
    return re.compile(r"(?:^|(?<= ))" + "".join(out))


def one_wording(markup, rng):
    import re

    words, dropped = [], []
    for token in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if token == "<<optional>>":
            dropped.append(rng.random() < 0.5)
        elif token == "<</optional>>":
            dropped.pop()
        elif not any(dropped):
            if token.startswith("<<any:"):
                words += ["somebody"] * rng.randrange(int(token[6:-2]) + 2)
            else:
                words += license_scan.words_of(rng.choice(token[6:-2].split("|")) if token.startswith("<<one:") else token)
    return words


def test_templates_against_patterns():
    rng = random.Random(6)
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    patterns = {label: as_pattern(t) for label, t in license_scan.TEMPLATES.items()}
    base, found = set(license_scan.PHRASES.values()), Counter()
    for label, markup in license_scan.TEMPLATES.items():
        for turn in range(6):
            words = ["so", "said", *one_wording(markup, rng), "and", "so", "on"]
            if turn % 3 == 2:
                del words[rng.randrange(len(words))]
            got = set(scanner.scan(" ".join(words))[5].split(",")) - base - {""}
            text = "".join(f"{w} " for w in words)
            assert got == {x for x, p in patterns.items() if p.search(text)}, (label, text)
            found.update(got)
    assert set(found) == set(patterns)


def test_licences_odd(spark, odd):
    got = license_scan.scan_licenses(odd).collect()
    assert len(got) == odd.count() and {r["labels"] for r in got} == {""}


# 9 packing


def unpacked(rows, tokens, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, ids in tokens.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def test_packing_round_trip(spark, some):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokens = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts_of(some).items()}
    assert unpacked(packing.pack_documents(some, TOKENIZER).collect(), tokens) == 0
    assert unpacked(packing.pack_documents(some, TOKENIZER, capacity=256, max_open=5).collect(), tokens, 256) == 0


def test_words_agree_with_the_tokenizer():
    codec = packing.WordCodec(TOKENIZER, words=3)
    for text in ["İstanbul it's we'll 'S", "a\x85b\xa0c", "<|endoftext|> x", "straße ǅ ﬁ", "ΣΑΣ", "²³¼ 12 $$%%a'sb", "\x1f a", "\xad a", "", "  \n", "ÀÉ naïve, x1y2"]:
        assert codec.encode([text])[0].tolist() == [*codec.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_sum_of_squares_level():
    packer = packing.Packer(16, 100, 0)
    packer.counts[[4, 6]] = 3, 1
    for size in range(1, 16):
        grown = {}
        for level in [0, *np.flatnonzero(packer.counts[:16])]:
            if level + size <= 16:
                n = packer.counts.copy()
                if level:
                    n[level] -= 1
                if level + size < 16:
                    n[level + size] += 1
                grown[level] = int((n[:16] ** 2).sum())
        assert grown[packer.level(size)] == min(grown.values())


def test_packing_odd(spark, odd):
    got = packing.pack_documents(odd, TOKENIZER)
    assert got.filter("start = 0").count() == odd.count()


# 10 exact copies


def test_exact_odd(spark, odd):
    got = [tuple(r)[:4] for r in exact_dedup.exact_groups(odd).collect()]
    assert len(got) == odd.count()
    assert {(None, 1, 2, False), (1, 1, 2, True), (4, 5, 3, False), (5, 5, 3, True), (7, 9, 2, False), (9, 9, 2, True)} <= set(got)
    kept = exact_dedup.drop_exact_copies(odd.union(odd.filter("doc_id = 6")))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 2, 3, 5, 6, 8, 9]
    assert kept.columns == odd.columns


# the pipeline


def test_likely_among(spark):
    rows = spark.createDataFrame([(i if i % 9 else None, i, "x") for i in range(400)], "doc_id long, __place long, __bits string")
    ids = spark.range(0, 400, 5).toDF("doc_id")
    from trailmark.llm.common import likely_among

    some, others = likely_among(rows, ids, bits=128).collect(), likely_among(rows, ids, bits=128, others=True).collect()
    assert sorted(r["__place"] for r in [*some, *others]) == list(range(400)) and some[0].__fields__ == rows.columns
    assert {i for i in range(0, 400, 5) if i % 9} <= {r["doc_id"] for r in some} and None not in {r["doc_id"] for r in some}


def test_tasks_give_memory_back(spark, some, monkeypatch):
    """A task's freed memory isn't kept by its worker, and every Python task of the pipeline's stages sees to that."""

    def resident():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon:")) / 1024

    pins = []

    def run(batches):
        held = [np.ones(8000) for _ in range(3000)]  # 190 MB in blocks that the allocator keeps below one still in use
        pins.append(np.ones(8000))
        del held
        yield from batches

    before = resident()
    assert list(common.trimmed(run)(iter([1, 2]))) == [1, 2] and resident() - before < 60
    seen = []
    frame = type(some)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, real=frame.mapInArrow, **b: seen.append(f.__qualname__) or real(self, f, *a, **b))
    language_id.identify(some, {}), language_id.count_profiles(some), minhash.sketches(some, 5, 8, 4), packing.pack_documents(some, TOKENIZER)
    minhash.confirmed(some, spark.createDataFrame([(1, 2)], "a long, b long"), 5, 80)
    assert len(seen) == 5 and set(seen) == {"trimmed.<locals>.task"}


def test_stages_on_odd_tables(spark, odd):
    """No rows at all, and repeated rows, nulls, ties and a long text, through every stage."""
    import corpus_pipeline as P

    for docs in (odd.limit(0), odd.unionByName(odd)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        n = docs.count()
        for name, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "pack" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (docs.count() > 0) == (n > 0)


def test_filters_keep_columns_of_any_name(spark):
    rows = [(1, "a b c", "s", "x", 1, 2), (2, "A b c", "s", "y", 3, 4), (3, None, None, None, None, None), (None, "", "t", "z", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __sha string, __copy long, __rows long")
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    again = mixture.mixed(df.toDF("doc_id", "text", "source", "__id", "__copies", "__copy"), target_entropy=0.1)
    assert again.count() == 4 and sorted(r["__copy"] or 0 for r in again.collect()) == [0, 2, 4, 6]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark, [None, "", "123 !!"], [9001, 9002, 9003]).select("doc_id", "text", "lang", "source", "n_chars"))
    known = P.language(spark, docs, SF)
    assert known.columns == docs.columns and docs.count() - known.count() == 3
    once = P.exact(spark, known, SF)
    groups = defaultdict(list)
    for d, t in texts_of(known).items():
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t)].append(d)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(max(g) for g in groups.values())
    near = P.near(spark, once, SF)
    want = components(texts_of(once), 5, 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    mix = P.mix(spark, near, SF)
    assert mix.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mix.collect())
    plan = {r["doc_id"]: r["copies"] for r in mixture.mix_sources(near, 0.95, 4.0).collect()}
    assert copies == Counter({d: n for d, n in plan.items() if n})
    packed = P.pack(spark, mix, SF)
    assert packed.filter("start = 0").count() == sum(copies.values())


def test_intersections_against_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40 if i % 2 else 4000, rng.integers(0, 60))).astype(np.uint64) for i in range(30)]
    for first, second in ((slice(0, 11), slice(11, None)), (slice(0, 30), slice(None))):
        got = minhash.intersections(sets, first, second, few=3, width=7)
        want = np.array([[len(np.intersect1d(a, b)) for b in sets[second]] for a in sets[first]])
        if second.start is None:
            np.fill_diagonal(got, 0), np.fill_diagonal(want, 0)
        assert (got == want).all()
