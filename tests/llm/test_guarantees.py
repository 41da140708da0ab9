"""What the operators promise beside their results: ids, bounds, repeatable places, inverses, held-out accuracy."""

import datetime as dt
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import bloom, common, exact_dedup, graph, packing, pieces, pii, quality_rules, registry, secret_scan, sharding, simhash, site_quality, toxicity

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"
WORD_BPE, PIECES, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


# Ids come back as they were.


@pytest.fixture(scope="module", params=["long", "string"])
def odd_ids(request, spark):
    """Ids beyond 2**53 beside a null id in one batch; texts tell the rows apart."""
    ids = [2**60 + 1, 2**60 + 3, None, 7]
    ids = ids if request.param == "long" else [i and f"id-{i}" for i in ids]
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join([*words[k:], *words[:k], f"end{k}", "token=abcdef"]) for k in range(4)]
    return spark.createDataFrame(list(zip(ids, texts)), f"doc_id {request.param}, text string").coalesce(1), dict(zip(ids, texts))


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_ids_are_left_untouched(spark, odd_ids):
    df, texts = odd_ids
    kind = df.schema["doc_id"].dataType
    labels = spark.createDataFrame([(next(iter(texts)), 1, 1)], f"doc_id {kind.simpleString()}, quality int, toxic int")
    scans = secret_scan.scanned(df, RANKS, public_tokenizers.PATTERN)
    packs = packing.pack(df, WORD_BPE)
    prints = simhash.fingerprint_groups(df)
    segments = pieces.segmentation_digests(df, PIECES)
    others = [toxicity.scored(df, labels), quality_rules.judged(df, labels), exact_dedup.exact_groups(df), sharding.shuffled(df), pii.pseudonymised(df, "k")]
    for out in (scans, packs, prints, segments, *others):
        assert out.schema["doc_id"].dataType == kind and set(_by_id(out)) == set(texts)
    tokenizer = packing.encoder(WORD_BPE)._tokenizer
    for key, text in texts.items():
        assert _by_id(scans)[key].spans == f"assign:{text.index('token=')}:{len(text)}"
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert _by_id(packs)[key].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert _by_id(segments)[key].n_ids == len(pieces.pieces(PIECES).best(text, 1)[0][1]) // 4
    assert {r.doc_id: r.component_id for r in prints.collect()} == {k: k for k in texts}
    left = simhash.survivors(df)
    assert set(_by_id(left)) == set(texts)


# Folders, vocabularies and keys.


class _Cluster:
    """As much of a session as ``shared_folder`` looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self._folder = self, master, folder

    def getCheckpointDir(self):
        return self._folder

    def setCheckpointDir(self, folder):
        self._folder = folder

    def getConf(self):
        return {}


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(_Cluster(master))
    assert common.shared_folder(_Cluster("yarn", "s3://x/y")) == "s3://x/y"
    assert common.shared_folder(_Cluster("local[4]"))


def test_vocabularies_that_do_not_fit_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with pytest.raises(ValueError, match="white space"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    model = pb.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.pieces[500].piece = "a▁b"
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="blank"):
        pieces.Pieces(str(tmp_path / "m"))


def test_a_score_of_zero_is_a_piece(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    first = next(i for i, p in enumerate(model.pieces) if p.type == 1)
    shift = model.pieces[first].score
    for p in model.pieces:
        if p.type == 1:
            p.score -= shift
    (tmp_path / "m").write_bytes(model.SerializeToString())
    m = pieces.Pieces(str(tmp_path / "m"))
    assert model.pieces[first].score == 0
    for text in (model.pieces[first].piece.replace("▁", " ") * 3, "the thing that they think"):
        assert m.best(text, 1)[0] == pytest.approx(m.best(text, 3)[0]) and m.best(text, 3)[0][0] == max(s for s, _ in m.best(text, 3))
        assert m.best(text, 1)[0][0] == m._search("▁" + text.replace(" ", "▁"), 1)[0][0]


def test_pipeline_draws_a_key_or_takes_the_sessions(spark):
    docs = spark.createDataFrame([(1, "mail a.person@mail.example.com today")], "doc_id long, text string")
    texts = lambda: corpus_pipeline.private(spark, docs, SMALL).first().text
    assert texts() != texts()
    spark.conf.set("spark.chronoloom.pii.key", "secret")
    try:
        assert texts() == texts() == pii.pseudonymised(docs, "secret").first().text
    finally:
        spark.conf.unset("spark.chronoloom.pii.key")


# Pseudonyms of every kind, by an independent version and its inverse.


def _f(key, tag, i, x):
    return int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:15], 16)


def _feistel(value, a, b, key, tag, back=False):
    left, right = divmod(value, b)
    sign = -1 if back else 1
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + sign * _f(key, tag, i, right)) % a
        else:
            right = (right + sign * _f(key, tag, i, left)) % b
    return left * b + right


def _luhn(body):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(x, digits):
    new = iter(digits)
    return re.sub(r"\d", lambda m: next(new), x)


def _card(x, back):
    d = re.sub(r"\D", "", x)
    n = len(d) - 1
    half = n - n // 2
    body = str(_feistel(int(d[:n]), 10 ** (n - half), 10**half, "k", "card", back)).zfill(n)
    return _refill(x, body + _luhn(body))


def _ssn(x, back):
    a, g, s = map(int, x.split("-"))
    new = _feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "k", "ssn", back)
    head = new // 9999
    area = head // 99 + 1
    return f"{area + (area >= 666):03}-{head % 99 + 1:02}-{new % 9999 + 1:04}"


def _day(d, back):
    century = (d.year - 1) // 100
    a, b = (51, 709) if century == 99 else (75, 487) if century % 4 == 3 else (92, 397)
    start = dt.date(century * 100 + 1, 1, 1)
    return start + dt.timedelta(_feistel((d - start).days, a, b, "k", f"date{century}", back))


def _email(x, back):
    at = x.rindex(".")
    head, tail = x[:at], x[at:]
    left, right = head[: len(head) // 2], head[len(head) // 2 :]

    def moved(s, i, other):
        digest = "".join(hashlib.sha256(f"k|email|{i}|{n}|{other}".encode()).hexdigest() for n in range((max(len(s), 1) - 1) // 32 + 1))
        out = []
        for k, c in enumerate(s):
            by = int(digest[2 * k : 2 * k + 2], 16) * (-1 if back else 1)
            for low, size in (("a", 26), ("A", 26), ("0", 10)):
                if ord(low) <= ord(c) < ord(low) + size:
                    c = chr((ord(c) - ord(low) + by) % size + ord(low))
                    break
            out.append(c)
        return "".join(out)

    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        if i % 2 == 0:
            left = moved(left, i, right)
        else:
            right = moved(right, i, left)
    return left + right + tail


def test_every_kind_by_an_independent_version_and_its_inverse(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    day = lambda: dt.date(1, 1, 1) + dt.timedelta(rng.randrange(3652059))
    cards = [c + _luhn(c) for c in (digits(n) for n in range(12, 19) for _ in range(5))]
    ssns = [f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 600)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(40)]
    days = [dt.date(1, 1, 1), dt.date(9999, 12, 31), dt.date(2000, 2, 29), dt.date(1900, 12, 31), dt.date(9901, 1, 1), *[day() for _ in range(60)]]
    mails = [f"{''.join(rng.choices('abcXYZ019._+-', k=n))}x@{''.join(rng.choices('abz09', k=n + 1))}.Org" for n in (0, 1, 2, 5, 20, 33, 70)]
    texts, want = [], []
    for kind, values, make in (("card", cards, _card), ("ssn", ssns, _ssn), ("email", mails, _email)):
        for x in values:
            new = make(x, False)
            assert make(new, True) == x
            texts.append(f"see {x} here")
            want.append((kind, f"see {new} here"))
    for d in days:
        new = _day(d, False)
        assert _day(new, True) == d
        for form in ("{0.year:04}-{0.month:02}-{0.day:02}", "{0.day:02}.{0.month:02}.{0.year:04}", "{0.day:02}/{0.month:02}/{0.year:04}"):
            texts.append(f"see {form.format(d)} here")
            want.append(("date", f"see {form.format(new)} here"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "k").collect()}
    for i, (kind, text) in enumerate(want):
        assert got[i].text == text and {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: int(k == kind) for k in pii.KINDS}, (texts[i], text)


def test_registered_query_keeps_plain_text(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in registry.op2_pii(spark, SMALL).collect():
        if not any(r[f"n_{k}"] for k in pii.KINDS):
            assert r.text == before[r.doc_id]


# Secrets: base spans of a whole table by an independent scanner, and time by length.


def _base_spans(text):
    """The three fixed kinds, by walking the text."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, out, at = text.lower(), [], 0
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    while at < len(text):
        end = None
        for name in names:
            if low.startswith(name, at) and text[at : at + len(name)].isascii():
                k = at + len(name)
                k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
                    stop = k
                    while stop < len(text) and text[stop] in word:
                        stop += 1
                    if stop > k:
                        end = stop
                        if stop - k >= 6:
                            out.append((at, 0, stop))
                        break
        at = end or at + 1
    for kind, start, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            if text.startswith(start, at) and (start or text[at] in chars):
                stop = at + len(start)
                while stop < len(text) and text[stop] in chars:
                    stop += 1
                if stop - at >= max(least, len(start) + 1):
                    out.append((at, kind, stop))
                at = max(stop, at + 1) if stop > at + len(start) else at + 1
            else:
                at += 1
    return sorted(out)


def test_base_spans_of_a_table_by_an_independent_scanner(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    met = 0
    for r in registry.op4_secret_scans(spark, SMALL).collect():
        base = _base_spans(texts[r.doc_id])
        met += len(base)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("opaque")] == [s for s in text.split(",") if s]
    assert met > 20


def test_scan_time_grows_with_the_length_only():
    encode = secret_scan.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=32)) for _ in range(80_000))
    began = time.time()
    spans = secret_scan.spans_of(text, lambda s: len(encode(s)), 2.2)
    assert len(spans) >= 79_000 and {k for _, k, _ in spans} == {2} and time.time() - began < 8


# Toxicity: FTRL-proximal by its definition, one coordinate at a time.


def test_ftrl_by_its_definition():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 40, rng.integers(0, 12))), int(rng.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2, offset, epochs = 0.3, 1.0, 0.4, 0.5, -0.2, 2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, label in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(offset + sum(w.values())))) - label
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    got = toxicity.ftrl(rows, offset, 6, epochs, alpha, beta, l1, l2)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want) and 0 < len(want) < 40


def test_features_by_their_definition():
    text, mask = "The quick brown FOX, the lazy dog", 2**64 - 1
    words = ["the", "quick", "brown", "fox", "the", "lazy", "dog"]
    h = lambda w, seed=1: xxhash.xxh64_intdigest(w, seed)
    raw = [x for w in words for x in (h(w), h(w[:4], 2), h(w[:6], 3))]
    raw += [(h(words[i]) * 0x9E3779B97F4A7C15 + h(words[i + gap]) * (2 * gap + 1)) & mask for gap in (1, 2, 3) for i in range(len(words) - gap)]
    places = {(((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - toxicity.BITS) for x in raw}
    assert set(toxicity.Hasher().places(text).tolist()) == places


def test_the_learner_is_bounded_by_ids_and_features(spark):
    docs = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.when(F.col("id") % 2 == 0, "vile words here").otherwise("kind words there").alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("toxic"))
    every = toxicity.fit(docs, labels)
    assert len(every.places) > 0
    few = toxicity.fit(docs, labels, max_features=10)
    assert len(few.places) == 0
    once = toxicity.fit(docs.where("doc_id < 100").dropDuplicates(["doc_id"]), labels)
    assert sorted(zip(once.places, once.weights)) == sorted(zip(every.places, every.weights))


# Quality: no label speaks for its own document.


def test_identical_documents_on_hosts_of_their_own_score_alike(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the same words in each of these texts, ten and more of them").alias("text"), F.concat(F.lit("h"), "id").alias("source"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    out = site_quality.posteriors(docs, labels, F.col("source"), F.lit("p"))
    assert out.select("score").distinct().count() == 1 and out.count() == 200


def test_posteriors_by_brute_force(spark):
    rng = random.Random(9)
    sites = [("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.2), ("b", "y", 0.1), ("c", None, 0.6), (None, "x", 0.5)]
    rows = []
    for i in range(300):
        host, path, rate = rng.choice(sites)
        good = rng.random() < rate
        rows.append((i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(20 if good else 12)) + ("" if good else " # $ %"), host, path, int(good)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3], "doc_id long, quality int")
    got = _by_id(site_quality.posteriors(docs, labels, F.col("host"), F.col("path")))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    y = {r[0]: float(r[4]) for r in rows if r[0] % 3 and not held(r[0])}
    p = {i: got[i].doc_probability for i in got}
    w = {i: 1.0 if i in y else 0.1 for i in p}
    g = {i: y.get(i, p[i]) for i in p}
    site = {r[0]: r[2:4] for r in rows}

    def strength(groups):
        """groups: parent -> list of (good, labelled)."""
        between = noise = spread = of = weight = 0.0
        for members in groups.values():
            members = [(k, n) for k, n in members if n]
            if not members:
                continue
            n, m = sum(n for _, n in members), sum(k for k, _ in members) / sum(n for _, n in members)
            between += sum(c * (k / c - m) ** 2 for k, c in members)
            noise += (len(members) - 1) * m * (1 - m)
            spread += n - sum(c * c for _, c in members) / n - (len(members) - 1)
            of, weight = of + n * m * (1 - m), weight + n
        if spread <= 0 or of <= 0:
            return 100.0
        own = (between - noise) / spread
        return min(max(of / weight / own - 1, 1.0), 1e4) if own > 0 else 1e4

    labelled = defaultdict(lambda: [0.0, 0])
    for i, label in y.items():
        for key in (site[i], site[i][0]):
            labelled[key][0] += label
            labelled[key][1] += 1
    hosts = {h for h, _ in site.values()}
    at_host = strength({None: [labelled[h] for h in hosts]})
    at_path = strength({h: [labelled[s] for s in set(site.values()) if s[0] == h] for h in hosts})
    overall = sum(w[i] * g[i] for i in w) / sum(w.values())
    # The rate of learned-from labels, by the mean of the sample.
    rate = (sum(y.values()) + 0.5) / (len(y) + 1)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for i in p:
        of_host = [j for j in p if site[j][0] == site[i][0] and j != i]
        of_path = [j for j in of_host if site[j] == site[i]]
        sums = lambda ids: (sum(w[j] * g[j] for j in ids), sum(w[j] for j in ids))
        k, n = sums(of_host)
        host_rate = (k + at_host * overall) / (n + at_host)
        k, n = sums(of_path)
        path_rate = (k + at_path * host_rate) / (n + at_path)
        score = 1 / (1 + math.exp(-(logit(p[i]) - math.log(rate / (1 - rate)) + logit(path_rate))))
        assert (got[i].host_rate, got[i].path_rate, got[i].score) == pytest.approx((host_rate, path_rate, score))


def _auc(score, bad):
    rank = score.rank()
    return (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = registry.op5_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").select("score", "kept", "quality").toPandas()
    good = seen["quality"] == 1
    assert _auc(seen["score"], good) > 0.9
    assert seen.loc[good, "kept"].mean() > 0.97


def test_forest_sample_is_thinned_before_it_leaves_a_task(spark):
    rates = ", ".join(f"cast(id % {k} as double) / {k} as {c}" for k, c in zip((7, 11, 13), quality_rules.RATES))
    stats = spark.sql(f"select id, {rates} from range(40000)")
    assert 900 < len(quality_rules.sampled(stats, 1000, 5)) < 1100
    hot = stats.withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")))
    assert len(quality_rules.sampled(hot, 1000, 5)) < 1100
    nulls = stats.withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")))
    assert len(quality_rules.sampled(nulls, 1000, 5)) < 1100


def test_any_quality_over_zero_is_good(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(12)], F.when(F.col("id") % 10 == 0, F.repeat(F.lit(" #$%"), 8)).otherwise("")).alias("text"))
    two = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("quality"))
    one = two.withColumn("quality", F.least("quality", F.lit(1)))
    kept = lambda labels: {r.doc_id for r in quality_rules.judged(docs, labels).where("kept").collect()}
    assert kept(two) == kept(one) and len(kept(one)) >= 269


# Exact copies: what the filter holds, and how it is sent.


def test_filter_follows_the_repeated_texts(spark):
    assert bloom.bitmaps_for(0, 16, 1 << 31) == 1
    assert bloom.bitmaps_for(10**6, 16, 1 << 31) == 489
    assert bloom.bitmaps_for(10**9, 16, 1 << 31) == 1 << 16
    assert common.executor_bytes(spark) == 1 << 30
    texts = spark.range(30000).select((F.col("id") % 20000).cast("string").alias("t"))
    bitmaps, buckets = exact_dedup.repeated_filter(texts, 16, 1 << 31)
    assert buckets == 5
    probed = exact_dedup._probed(texts, bitmaps, buckets)
    assert probed._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    maybe = {r.t for r in probed.where("maybe").collect()}
    assert maybe >= {str(i) for i in range(10000)} and len(maybe) < 10200


# Near copies over a whole table.


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
def test_near_stage_equals_brute_force_on_a_table(spark, measure):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in table.collect()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            a, b = sets[i], sets[j]
            both, all = len(a & b), len(a | b)
            if a == b or (25 * both**2 >= 16 * len(a) * len(b) > 0 if measure == "cosine" else 5 * both >= 4 * all > 0):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert sorted(r.doc_id for r in simhash.survivors(table, measure=measure).select("doc_id").collect()) == [i for i in ids if root(i) == i]


def test_a_measure_is_one_of_two(spark):
    with pytest.raises(ValueError, match="hamming"):
        simhash.survivors(spark.createDataFrame([(1, "a")], "doc_id long, text string"), measure="hamming")


def test_variants_of_a_template_are_candidates_but_no_copies(spark, monkeypatch):
    """Texts that share a template below the similarity form one component of candidates, in which nothing resembles the pivot.

    Rows dealt then go with the square of the component over ``chunk``; they are
    counted here, so that the figure stays what the README says.
    """
    n, chunk = 2000, 256
    words = lambda key, count: [hashlib.blake2b(b"%s:%d" % (key, i), digest_size=5).hexdigest() for i in range(count)]
    template = words(b"template", 64)
    rows = [(i, " ".join([*template, *words(b"%d" % i, 40)])) for i in range(n)]
    # 60 of 100 shingles are common.  One variant has two real copies, with one further word and with two.
    rows += [(n, rows[7][1] + " more"), (n + 1, rows[7][1] + " and more")]
    kept, inner = [], simhash.durable

    def noting(df):
        kept.append(inner(df))
        return kept[-1]

    monkeypatch.setattr(simhash, "durable", noting)
    stay = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), chunk=chunk)
    assert sorted(r.doc_id for r in stay.collect()) == [*range(n)]
    blocks = [x for x in kept if x.columns == ["key", "n", "node", "data"]][-1]
    apart = [x for x in kept if x.columns == ["key", "u", "v", "data"]][-1].where("v is null")
    size, left = blocks.agg(F.max("n")).first()[0], apart.count()
    assert size > 0.9 * n and left > 0.9 * size
    dealt = size * -(-left // chunk) + left * -(-size // chunk)
    assert dealt <= 2 * (n + chunk) ** 2 / chunk


def test_hot_nodes_can_be_split(spark):
    """Both sides of each join have an exchange of their own, which is what adaptive execution can split."""
    edges = common.durable(spark.range(1, 2000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for step in (graph._large_star, graph._small_star):
            plan = step(edges)._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
            sorts = [i for i in range(at, len(lines)) if re.search(r"[:+]- Sort \[u", lines[i])]
            assert len(sorts) == 2 and all("Exchange" in lines[i + 1] for i in sorts), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = graph.components(edges)
    assert got.where("root <> 0").count() == 0 and got.count() == 2000


# Shards: bounds of buckets, places that follow from the rows.


def _hot(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.create_map(F.lit("lang"), "lang").alias("meta")).repartition(parts)
    same = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.create_map(F.lit("a"), F.lit("b")).alias("meta"))
    return docs.unionByName(same)


def test_buckets_keep_their_bound_without_ids(spark):
    rows = spark.range(16000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    scattered, buckets = sharding.scattered(rows, "doc_id", "text", 16, 17, 32 << 20, 1000, False)
    sizes = [r["count"] for r in scattered.groupBy("bucket").count().collect()]
    assert buckets == len(sizes) == 16 and max(sizes) < 1200


def test_places_follow_from_the_rows(spark):
    seen = []
    for parts, adaptive in ((5, "false"), (8, "true"), (23, "false")):
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            rows = sharding.shuffled(_hot(spark, parts), bucket_rows=150, payload=True)
            seen.append({(r.shard, r.slot): (r.doc_id, r.text_crc32, str(r["_row"].meta)) for r in rows.collect()})
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    assert len(seen[0]) == 2000 and seen[0] == seen[1] == seen[2]


def test_shards_by_their_law(spark):
    rows = sharding.shuffled(_hot(spark, 3).where("doc_id is not null")).collect()
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")
    for shards, name in ((16, "shard"), (17, "grown_shard")):
        weights = [F.xxhash64("doc_id", F.lit(j)).alias(f"w{j}") for j in range(shards)]
        best = {r.doc_id: max(range(shards), key=lambda j: r[f"w{j}"]) for r in ids.select("doc_id", *weights).collect()}
        assert all(r[name] == best[r.doc_id] for r in rows)
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)


def test_copies_are_numbered_in_parts(spark):
    rows = common.durable(spark.range(1000).select(F.when(F.col("id") < 700, 1).when(F.col("id") < 702, 2).otherwise(F.col("id")).alias("k"), F.col("id").alias("u")))
    numbered = sharding.with_copies(rows, together=50).collect()
    assert len(numbered) == 1000 and len({(r.k, r.copy) for r in numbered}) == 1000
    counts = Counter(r.k for r in numbered)
    assert all(0 <= r.copy < counts[r.k] for r in numbered)


def test_forest_scores_by_their_definition():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(5, 1, (3, 3))])
    forest = quality_rules.grow(x, 20, 32, seed=2)

    def path(t, row):
        node = 0
        while forest.feature[t, node] >= 0:
            node = forest.left[t, node] + (row[forest.feature[t, node]] >= forest.value[t, node])
        return forest.value[t, node]

    harmonic = lambda n: math.log(n) + np.euler_gamma
    norm = 2 * harmonic(31) - 2 * 31 / 32
    want = [2 ** (-sum(path(t, row) for t in range(20)) / 20 / norm) for row in x]
    assert forest.score(x) == pytest.approx(np.array(want))
    # A leaf's value is its depth, and for the rows left in it the mean path of a search among them.
    for t in range(20):
        depth, todo = {0: 0}, [0]
        while todo:
            node = todo.pop()
            if forest.feature[t, node] < 0:
                assert forest.value[t, node] >= depth[node] and depth[node] <= 5
                continue
            for child in (forest.left[t, node], forest.left[t, node] + 1):
                depth[child] = depth[node] + 1
                todo.append(child)


def test_threshold_by_trying_all():
    rng = random.Random(3)
    for _ in range(60):
        good = Counter(rng.randrange(12) for _ in range(rng.randrange(0, 40)))
        bad = Counter(rng.randrange(6, 21) for _ in range(rng.randrange(0, 20)))
        found = quality_rules.best_threshold(good, bad, 20, 0.2)
        n, m = sum(good.values()), sum(bad.values())
        gains = {}
        for b in range(21) if n and m else ():
            lost, caught = sum(c for k, c in good.items() if k >= b) / n, sum(c for k, c in bad.items() if k >= b) / m
            if lost <= 0.2 and caught > lost:
                gains[b / 20] = caught - lost
        assert found == 2.0 if not gains else gains[found] == pytest.approx(max(gains.values()))


def test_blocks_in_chunks_join_what_is_near(spark):
    """A hot block of which many rows do not resemble its pivot, and small ones, against brute force."""
    rng = np.random.default_rng(6)
    rows, prints = [], {}
    for key, n, bases in ((1, 90, 12), (2, 40, 1), (3, 7, 3), (4, 1, 1), (-5, 33, 33)):
        base = rng.integers(0, 256, (bases, 8), dtype=np.uint8)
        x = base[rng.integers(0, bases, n)].copy()
        x[np.arange(n), rng.integers(0, 8, n)] ^= 1 << rng.integers(0, 8, n).astype(np.uint8)
        for k, fp in enumerate(x):
            rows.append((key, n, key * 1000 + k, fp.tobytes()))
            prints[key * 1000 + k] = key, int.from_bytes(fp.tobytes(), "big")
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = {(i, j) for i, (a, p) in prints.items() for j, (b, q) in prints.items() if i < j and a == b and (p ^ q).bit_count() <= 2}
    for i, j in near:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    for chunk in (4, 16, 1000):
        blocks = common.durable(spark.createDataFrame(rows, "key long, n long, node long, data binary").where("n > 1"))
        links = {(r.u, r.v) for r in simhash.linked(blocks, chunk, simhash.near_bits(2)).collect()}
        assert all((min(p), max(p)) in near or p[0] == p[1] or prints[p[0]] == prints[p[1]] for p in links)
        got = {i: i for i in prints}

        def top(x):
            while got[x] != x:
                x = got[x]
            return x

        for i, j in links:
            got[max(top(i), top(j))] = min(top(i), top(j))
        assert {i: top(i) for i in prints} == {i: root(i) for i in prints}


# Packing: ids of whole tables, and places without a shuffle of ids.


def test_ids_of_a_whole_table_are_the_tokenizers(spark):
    docs = registry.table(spark, SMALL, "documents")
    whole = packing.encoder(WORD_BPE)._tokenizer
    ids = {}
    for r in packing.pack(docs, WORD_BPE).select("doc_id", "start", "ids").collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in docs.select("doc_id", "text").collect():
        want = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert b"".join(x for _, x in sorted(ids[r.doc_id])) == np.array(want, "<u4").tobytes(), r.doc_id


def test_words_of_letters_take_the_merges_alone():
    encode = packing.Encoder(WORD_BPE)
    assert encode._merges is not None
    rng = random.Random(6)
    signs = [*"aeionstrlZTÉéèçñÄßÿµªºıİŉΣσςж日ﬁǅ'-_.,;0", "é", "́", " ", " "]
    for _ in range(4000):
        text = " ".join("".join(rng.choices(signs if rng.random() < 0.5 else signs[:18], k=rng.randrange(1, 9))) for _ in range(3))
        assert encode.encode(text) == np.array(encode._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_places_by_parts_and_by_dealing_agree_in_kind(spark):
    docs = registry.table(spark, SMALL, "documents").repartition(5).drop("lang")
    both = [packing.pack(docs, WORD_BPE, most_starts=n) for n in (2_000_000, 0)]
    plan = both[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Exchange" in both[1]._jdf.queryExecution().executedPlan().toString()
    for df in both:
        rows = df.select("doc_id", "piece", "length", "sequence_id", "offset").collect()
        taken = {}
        for r in rows:
            taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in taken.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert len({df.select("sequence_id").distinct().count() for df in both}) == 1
