"""Small cases of every operator: against brute force, and the rows that go wrong first."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.llm import embedding_dedup, fingerprints, jaccard_join, language, line_dedup, mixing, packing, quality, samples, substring_dedup, toxicity

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
LINE = "this line is long enough to be counted as boilerplate"
TEXTS = [
    "the quick brown fox jumps over the lazy dog again and again until it sleeps",
    "the quick brown fox jumps over the lazy dog again and again until it sleeps",
    None, "", " \n\t ", "one", LONG, LONG + " tail", f"a\n{LINE}\nb", f"{LINE}\n{LINE.upper()}  ", LINE, LINE, f"x\n{LINE}", "é 漢字 ñ, ok.", "x" * 400,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, shared long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "clash", "k", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """A null id, and rows that repeat an id, with the same and with another text."""
    extra = docs.filter("doc_id = 0").selectExpr("cast(null AS long) AS doc_id", *docs.columns[1:])
    return docs.unionByName(extra).unionByName(docs.filter("doc_id = 8")).unionByName(docs.filter("doc_id = 5").selectExpr("7L AS doc_id", *docs.columns[1:]))


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_targets_share_all_and_stop_at_three_times():
    got = mixing.targets([10, 1000, 0, 500], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 1510) < 1e-6
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation_and_its_inverse(n):
    there = mixing.permute(np.arange(n), n, 42)
    assert sorted(there.tolist()) == list(range(n))
    assert mixing.permute(there, n, 42, back=True).tolist() == list(range(n))


def test_hypergeometric_draws():
    from math import comb

    rng = np.random.default_rng(2)
    drawn = np.bincount([mixing.hypergeometric(rng, 7, 5, 6) for _ in range(20_000)], minlength=8) / 20_000
    assert np.abs(drawn - [comb(7, k) * comb(5, 6 - k) / comb(12, 6) if 1 <= k <= 6 else 0 for k in range(8)]).max() < 0.012
    assert mixing.hypergeometric(rng, 0, 9, 4) == 0 and mixing.hypergeometric(rng, 9, 0, 4) == 4
    large = np.array([mixing.hypergeometric(rng, 3 * 10**10, 10**10, 2 * 10**10) for _ in range(40)], float)
    deviation = (2e10 * 0.75 * 0.25 * 0.5) ** 0.5
    assert np.abs(large - 1.5e10).max() < 6 * deviation and large.std() > deviation / 2


def test_shards_counts_of_any_size_add_up():
    totals = np.array([10**12, 0, 3, 57 * 10**9])
    parts = [mixing.shard_counts(totals, i, 5, 1) for i in range(5)]
    assert (sum(c for c, _ in parts) == totals).all() and all((c >= 0).all() for c, _ in parts)
    assert [int(c.sum()) for c, _ in parts] == [(i + 1) * int(totals.sum()) // 5 - i * int(totals.sum()) // 5 for i in range(5)]


def test_shards_counts_add_up():
    totals = np.array([100, 0, 3, 57])
    parts = [mixing.shard_counts(totals, i, 7, 1) for i in range(7)]
    assert (sum(c for c, _ in parts) == totals).all()
    assert all((parts[i][1] == sum(c for c, _ in parts[:i])).all() for i in range(1, 7))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mixing_takes_the_targets(request, name):
    table = request.getfixturevalue(name)
    mix = mixing.mix_sources(table.select("doc_id", "text", "source"), block=16, shard_slots=8)
    got = rows(mix.taken())
    assert len(got) == table.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values())
    texts = rows(mixing.materialise(table, mix))
    assert sum(len(re.findall(mixing.WORD, r["text"])) for r in texts) == sum(r["taken"] for r in got)
    assert set(texts[0]) == set(table.columns)
    clash = table.withColumns({"__size": F.lit("k"), "__h": F.lit("h"), "copy_no": F.lit(7), "first": F.lit(8)})
    assert all((r["__size"], r["__h"], r["copy_no"], r["first"]) == ("k", "h", 7, 8) for r in rows(mixing.materialise(clash, mix)))


def brute_vectors(vectors, labels):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and labels[i] is not None for i, v in enumerate(vectors)]
    near = [[j for j in range(n) if i != j and ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]) and np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.98] for i in range(n)]
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    vectors = [list(map(float, base[i % 12] + rng.normal(size=8) * 0.05 * (i % 3))) for i in range(150)]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 8, [float("nan")] * 8, [None, *[1.0] * 7], [1.0, 2.0]]
    labels = [i % 2 for i in range(150)] + [0, 0, 0, 0, 0, 0, 0, 0]
    labels[3] = None
    table = spark.createDataFrame([(i, v, k, 1) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int, n int")
    exact = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embedding_dedup.near_vectors(table, shard_rows=20))}
    assert got == brute_vectors(exact, labels)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_embeddings_of_any_norm_over_many_shards(spark):
    """A hot label over many shards, groups of near copies, norms that overflow or vanish."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(90, 16))
    vectors = [base[i % 90 if i % 3 else 0] + rng.normal(size=16) * rng.choice([0, 0.02, 0.05]) for i in range(900)]
    vectors = [v * s for v, s in zip(vectors, rng.choice([1.0, 1e200, 1e-200], 900), strict=True)]
    labels = [0 if i % 5 else i % 4 for i in range(900)]
    table = spark.createDataFrame([(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embedding_dedup.near_vectors(table, shard_rows=100))}
    unit = [v / np.abs(v).max() for v in vectors]
    assert got == brute_vectors(unit, labels) and max(n for n, _ in got.values()) > 200


def test_fingerprints(docs, odd, empty):
    got = {r["doc_id"]: r for r in rows(fingerprints.fingerprint_edits(docs))}
    for i, t in enumerate(TEXTS):
        edited = fingerprints.edited_text(t or "", TEXTS[(i + 1) % len(TEXTS)] or "")
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t or "") and 0 <= got[i]["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[5]["fingerprint"]
    assert got[0]["near_next"] == 1 and got[6]["near_next"] > 0.9 and got[7]["near_next"] < 0.1
    again = {r["doc_id"]: r["fingerprint"] for r in rows(fingerprints.fingerprints(docs))}
    assert again == {i: r["fingerprint"] for i, r in got.items()}
    assert fingerprints.fingerprint_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_edits(empty).count() == 0


def brute_fingerprint(text):
    """Bins one by one: least hash, then the first non-empty bin in each empty bin's own order."""
    values = fingerprints.sh.shingles(*fingerprints.sh.words([text.encode()]), pad=True)[0].tolist()
    bins = {}
    for v in values:
        bins[v >> 56] = min(bins.get(v >> 56, 1 << 64), v & ((1 << 56) - 1))
    full = [bins.get(b, bins[next(c for c in fingerprints._ORDER[b] if c in bins)] if bins else 0) for b in range(256)]
    return "".join(f"{v & 15:x}" for v in full), bool(bins)


def test_fingerprints_bin_by_bin(spark, odd):
    def like(a, b):
        (x, some), (y, other) = a, b
        return min(1, max(0, (sum(p == q for p, q in zip(x, y, strict=True)) / 256 - 1 / 16) / (15 / 16))) if some and other else float(some == other)

    h = {r["text"]: r["h"] for r in rows(odd.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))}
    source = sorted(((r["doc_id"], r["text"] or "") for r in rows(odd)), key=lambda p: (p[0] is not None, p[0] or 0, h.get(p[1], h.get(None))))
    want = []
    for k, (i, text) in enumerate(source):
        following = source[(k + 1) % len(source)][1]
        edited = fingerprints.edited_text(text, following)
        own, changed, after = map(brute_fingerprint, (text, edited, following))
        want.append((i, own[0], changed[0], round(like(own, changed), 9), round(like(own, after), 9)))
    got = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows(fingerprints.fingerprint_edits(odd, bucket_bytes=2_000))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ranges_split_an_id():
    cut_doc, cut_h = np.array([3, 5, 5, 5, 9]), np.array([0, -2, 4, 7, 1])
    pairs = [(d, h) for d in range(11) for h in range(-4, 10)]
    want = [sum((a, b) < p for a, b in zip(cut_doc.tolist(), cut_h.tolist(), strict=True)) for p in pairs]
    assert fingerprints.range_of(*(np.array(x) for x in zip(*pairs, strict=True)), cut_doc, cut_h).tolist() == want


def test_fingerprint_estimates_resemblance():
    words = [f"w{i}" for i in range(4000)]
    for share in (0.25, 0.5, 0.8, 0.95):
        other = words[: int(4000 * share)] + [f"v{i}" for i in range(4000 - int(4000 * share))]
        low, some = fingerprints.signatures([" ".join(words).encode(), " ".join(other).encode()])
        true = share / (2 - share)
        assert abs(fingerprints.likeness(low[:1], low[1:], some[:1], some[1:])[0] - true) < 0.12
    assert (fingerprints.unpacked(fingerprints.packed(low)[0]) == low[0]).all()


def test_language_is_that_of_the_nearest_centroid(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.learn_from(texts))
    for r in rows(language.identify(texts, model)):
        cells = np.zeros(language.DIMS)
        for a, b, c in zip(*[f"\0{(r['text'] or '').lower()}\0"[k:] for k in range(3)], strict=False):
            x, y, z = (ord(ch) if ch.isalpha() else 0 for ch in (a, b, c))
            if y:
                one = y * 0xC2B2AE3D27D4EB4F
                two = one + x * 0x9E3779B97F4A7C15 + 1
                for value in (one, two, two + 1 + z * 0x165667B19E3779F9):
                    cells[(value * 0x9E3779B97F4A7C15) % (1 << 64) >> 52] += 1
        if not cells.any():
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        v = np.log1p(cells) * model.idf
        cosine = model.centroids.astype(float) @ v / np.linalg.norm(v)
        near = {model.languages[i] for i in np.flatnonzero(cosine > cosine.max() - 1e-5)}
        assert r["lang_pred"] in near and abs(r["score"] - min(1, max(0, cosine.max()))) < 1e-5


def test_held_out_rows_reach_no_fit(spark):
    """Their labels may be anything: the samples never hold them, nor rows without an id."""
    import zlib as z

    docs = spark.createDataFrame([(i, f"t{i}", "aa") for i in range(400)] + [(None, "n", "aa")], "doc_id long, text string, lang string")
    learned = {r["doc_id"] for r in rows(language.learn_from(docs))}
    assert learned == {i for i in range(400) if z.crc32(str(i).encode()) % 4 != 2}
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (7, 5)], "doc_id long, toxic int")
    sample = quality.labelled_sample(docs, labels, "toxic", 1_000)
    assert {(r["doc_id"], r["label"]) for r in rows(sample)} == {(i, i % 2) for i in range(400) if z.crc32(str(i).encode()) % 5}
    many = docs.limit(0).unionByName(spark.range(5_000).selectExpr("1L AS doc_id", "concat('t', id) AS text", "'aa' AS lang"))
    assert quality.labelled_sample(many, labels, "toxic", 100).count() < 400
    assert [r["held_out"] for r in rows(docs.filter("doc_id IS NULL").select(samples.held_out("doc_id", 5, 0)))] == [False]


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_scores_of_odd_rows(request, name):
    table = request.getfixturevalue(name)
    for score in (quality.score(table, quality.Machine(0)), toxicity.score(table, toxicity.Model([]))):
        got = rows(score)
        assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r["doc_id"] for r in rows(table)), key=repr) and all(0 <= r["score"] <= 1 for r in got)


def test_language(spark, docs, empty):
    model = language.fit(spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the house and the garden are big", "en"), ("das haus und der garten sind schön", "de"), ("la maison et le jardin sont grands", "fr")] * 5)], "doc_id long, text string, lang string"))
    assert [x[0] for x in model.predict(["the garden", "der garten und das", None, "", "123 !", "le jardin " * 5000])] == ["en", "de", "und", "und", "und", "fr"]
    assert all(r for _, _, r in model.predict([None, "42"])) and not model.predict(["the house"])[0][2]
    assert model.predict(["漢字" * 50])[0][2]
    assert language.identify(docs, model).count() == len(TEXTS) and language.identify(empty, model).count() == 0
    assert language.fit(empty).predict(["the"])[0] == ("und", 0.0, True)


def brute_lines(source, least=5):
    """The kept text of each (doc_id, text); rows that repeat a doc_id count once."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = {}
    for i, text in source:
        for k in {trim(x) for x in text.split("\n")}:
            where.setdefault(k, set()).update([] if i is None else [i])
    hot = {k: max(v) for k, v in where.items() if len(k) >= 40 and len(v) >= least}
    return [(i, "\n".join(x for x in text.split("\n") if i is None or hot.get(trim(x), i) <= i)) for i, text in source], hot


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_lines_against_brute_force(request, name):
    table = request.getfixturevalue(name)
    want, hot = brute_lines([(r["doc_id"], r["text"] or "") for r in rows(table)])
    assert sorted(((r["doc_id"], r["text"] or "") for r in rows(line_dedup.dedup_lines(table))), key=repr) == sorted(want, key=repr)
    assert hot


def test_a_document_that_repeats_counts_once(spark):
    table = spark.createDataFrame([(1, LINE)] * 4 + [(2, LINE)], "doc_id long, text string")
    assert {r["n_dropped"] for r in rows(line_dedup.dedup_lines(table, batches=2, counts=("n_lines", "n_dropped")))} == {0}


@pytest.mark.parametrize("fanout,batches", [(2, 9), (3, 5)])
def test_runs_on_three_levels(spark, fanout, batches):
    rng = np.random.default_rng(8)
    lines = [f"{LINE} number {i}" for i in range(12)]
    source = [(i, "\n".join([*rng.choice(lines, rng.integers(0, 5)), f"only in {i} and nowhere else in the corpus"])) for i in range(70)]
    table = spark.createDataFrame(source, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.dedup_lines(table, batches=batches, fanout=fanout))}
    want, hot = brute_lines(source)
    assert got == dict(want) and hot
    runs = line_dedup.LineRuns(fanout)
    posts = line_dedup.postings(table, "text", "doc_id", 40).withColumn("b", F.pmod("doc", F.lit(batches))).cache()
    for b in range(batches):
        runs.add(posts.filter(F.col("b") == b).drop("b"))
    keys = [(r["h1"], r["h2"]) for run in runs.runs() for r in rows(run)]
    assert len(keys) == len(set(keys)) == posts.select("h1", "h2").distinct().count()  # a key stands in one run
    assert len(runs.levels) == (4 if fanout == 2 else 2) and all(len(level) < fanout for level in runs.levels)


def test_lines_beside_clashing_columns(docs):
    table = docs.withColumns({"__drops": F.lit("a"), "__doc": F.lit(1), "__kept": F.lit(2), "h1": F.lit(3), "last": F.lit(4)})
    got = line_dedup.dedup_lines(table, counts=("n_lines", "n_dropped"))
    assert got.columns == [*table.columns, "n_lines", "n_dropped"] and {r["__drops"] for r in rows(got)} == {"a"}


def test_lines_empty(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_sets(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = dict.fromkeys(sets)
    root = lambda a: a if up[a] is None else root(up[a])
    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_texts():
    rng = np.random.default_rng(5)
    out = []
    for g, size in enumerate((3, 5, 6, 7, 9, 12, 20, 60, 200)):
        base = [f"g{g}w{rng.integers(10_000)}" for _ in range(size)]
        for _ in range(9):
            words = list(base)
            for k in rng.integers(0, size, rng.integers(0, 1 + size // 25 + 1)):
                words[k] = f"x{rng.integers(1_000_000)}"
            out.append(" ".join(words[: size - int(rng.integers(0, 2))]))
    return out


def test_jaccard_against_brute_force(spark, docs, odd, empty):
    texts = near_texts() + TEXTS
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.near_duplicates(table))}
    want = brute_sets(texts)
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 20
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_keeps_one(odd):
    assert jaccard_join.near_duplicates(odd).count() == odd.count()
    kept = [r["doc_id"] for r in rows(jaccard_join.keep_one(odd))]
    assert kept.count(0) == 1 and 1 not in kept and None in kept


@pytest.mark.parametrize("size", range(4, 80))
def test_signatures_of_similar_sets_meet(size):
    rng = np.random.default_rng(size)
    x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
    for other in range(int(np.ceil(size * 0.8)), int(size / 0.8) + 1):
        most = (size + other) // 9  # the sets' difference
        shared = (size + other - most + 1) // 2
        if 100 * shared < 80 * (size + other - shared) or shared > min(size, other) or shared == size == other:
            continue
        y = np.unique(np.concatenate([x[:shared], rng.integers(0, 1 << 62, other - shared).astype(np.uint64)]))
        assert set(jaccard_join.signatures(x).tolist()) & set(jaccard_join.signatures(y).tolist()), (size, other)


def brute_bytes(pairs):
    seen, out = set(), {}
    for i, text in pairs:
        raw, gone = (text or "").encode(), set()
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone |= set(range(at, at + 100))
            seen.add(raw[at : at + 100])
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        out[i] = (len(raw), len(gone), sum(k - 1 not in gone for k in gone), kept)
    return out


def repeated_texts():
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(60))
    out = TEXTS + [f"{rng.integers(1e9)} {passage[: int(rng.integers(90, len(passage)))]} {rng.integers(1e9)} é" for _ in range(25)]
    return [*out, "ab" * 150, "ab" * 90, passage * 2, LONG[500:900] + "!" + LONG[100:700], passage * 2]


def test_substrings_against_brute_force(spark):
    texts = repeated_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows(substring_dedup.remove_repeats(table))}
    assert got == brute_bytes(enumerate(texts))


@pytest.mark.parametrize("chunk,held,many", [(2_000_000, 600_000, 1000), (3_000, 40, 7), (150, 1, 1)])
def test_substring_steps_of_any_size(monkeypatch, chunk, held, many):
    """The same steps in this process: buckets that are sorted at once, in parts, or by keys."""
    import pandas as pd

    for name, value in (("CHUNK", chunk), ("HELD", held)):
        monkeypatch.setattr(substring_dedup, name, value)
    texts = [t or "" for t in repeated_texts()]
    docs = pd.DataFrame({"doc": range(len(texts)), "tie": 5, "text": texts})

    def batches(frame, size):
        return (frame.iloc[i : i + size] for i in range(0, len(frame), size))

    def sort(frames):
        return pd.concat(list(frames), ignore_index=True).sort_values(["a", "c", "doc", "at"], ignore_index=True)

    marks = pd.concat(list(substring_dedup._settle(batches(sort(substring_dedup._runs(batches(docs, 3))), many))))
    wanted = marks[marks["d"] >= 0].groupby("doc")[["a", "lo", "n", "d"]].agg(list).reset_index()
    parts = sort(substring_dedup._parts(batches(docs.merge(wanted, on="doc"), 3)))
    found = pd.concat(list(substring_dedup._compare(batches(parts, many))))
    keyed = found[found["k1"].notna()].sort_values(["doc", "lo"])
    assert chunk > 150 or len(keyed)
    again = pd.concat([marks[marks["d"] < 0], found[found["k1"].isna()], keyed[keyed.duplicated(["a", "k1", "k2"])]])
    got = {(d, s + k) for d, s, n in again[["doc", "lo", "n"]].itertuples(index=False) for k in range(n)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        raw = t.encode()
        for at in range(len(raw) - 99):
            (want.add((i, at)) if raw[at : at + 100] in seen else seen.add(raw[at : at + 100]))
    assert got == want


def test_substrings_odd_rows(spark, odd, empty):
    """Rows that repeat id and text are one document; other texts of an id are documents of
    their own; the least id is null."""
    table = odd.unionByName(odd.filter("doc_id = 7").selectExpr("7L AS doc_id", f"'{LONG} end' AS text", *odd.columns[2:]))
    source = [(r["doc_id"], r["text"] or "") for r in rows(table)]
    tie = {r["text"]: r["x"] for r in rows(table.select("text", F.expr("xxhash64(coalesce(text, '')) & 16777215").alias("x")))}
    pairs = sorted(set(source), key=lambda p: (p[0] is not None, p[0] or 0, tie.get(p[1], tie.get(None))))
    want = dict(zip(pairs, brute_bytes((k, t) for k, (_, t) in enumerate(pairs)).values(), strict=True))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in rows(substring_dedup.remove_repeats(table))), key=repr)
    assert got == sorted(((i, want[i, t][0], want[i, t][1], want[i, t][3]) for i, t in source), key=repr)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_packing_round_trip(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = rows(packing.pack(odd, packing.tokenizer_path()))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in rows(odd)), key=repr)
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids = np.frombuffer(p["ids"], "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"] and len(ids) == p["length"]
        got.setdefault(p["doc_id"], []).extend(ids.tolist())
    unique = {i for i, _ in texts if sum(i == j for j, _ in texts) == 1}
    for i, text in texts:
        if i in unique:
            assert got[i] == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert ends.get(p["sequence_id"], 0) == p["offset"]
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 4096
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


ODD_TEXTS = ["it's DON'T [x] 'll", "a b  c", "<|endoftext|> x", "a<|StartOfText|>b <|startoftext|>", "İstanbul Σας ΣΑΣ", "naïve—dash “q” 3.14 ½", "\x1cab\x85cd", "x" * 300, "ÀÉÎõü ß", "", "\u00a0a\u3000b\x0b\x0cc"]


@pytest.mark.parametrize("size", [300_000, 3])
def test_words_ids_are_the_tokenizers(size):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.WordIds(packing.tokenizer_path(), size)
    got = map(words.of_text, ODD_TEXTS + ODD_TEXTS[::-1])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS + ODD_TEXTS[::-1]]
    assert words.by_word and words.direct


def test_steps_are_balanced():
    sizes = [4096] * 50 + [2048] * 11 + [512] * 9 + [16, 1]
    steps = packing.step_groups(sizes, 32_768)
    held = [[s for s, k in zip(sizes, steps, strict=True) if k == step] for step in range(max(steps) + 1)]
    totals = [sum(h) for h in held]
    assert len(held) == round(sum(sizes) / 32_768) and max(totals) - min(totals) <= 2048 and max(map(len, held)) - min(map(len, held)) <= 8
    assert packing.step_groups([]) == [] and packing.step_groups([5]) == [0]


def test_plan_pads_little():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.lognormal(6, 1, 2000)] + [20_000, 1, 4096]
    plan = packing.plan(lengths)
    parts = sorted((d, s, n) for q in plan for d, s, n in q)
    at = {}
    for d, s, n in parts:
        assert at.get(d, 0) == s
        at[d] = s + n
    assert at == dict(enumerate(lengths))
    size = [sum(n for _, _, n in q) for q in plan]
    assert sum(4096 - s for s in size if s & (s - 1)) < 4096


def test_mixing_sizes_and_targets_in_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows(mixing.op1_mixing(spark, sf))}
    sizes = duckdb.sql(f"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM '{sf}/documents.parquet'")
    totals = duckdb.sql("SELECT source, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes GROUP BY source ORDER BY k").fetchall()
    left, share, open_ = sum(n for _, n, _ in totals), {}, {s: (5, 2, 1)[k % 3] for s, n, k in totals if n}
    size = {s: n for s, n, _ in totals}
    while True:
        each = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * each > 3 * size[s]]
        if not over:
            break
        for s in over:
            share[s] = 3.0 * size[s]
            left -= share[s]
            del open_[s]
    share |= {s: w * each for s, w in open_.items()}
    assert got == {(i, n, size[s], round(share.get(s, 0.0), 6)) for i, s, n in sizes.fetchall()}


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(2)
    good = [" ".join(f"word{rng.integers(500)}" for _ in range(60)) for _ in range(60)]
    bad = [" ".join(f"word{rng.integers(500)}!!" for _ in range(60)).upper() for _ in range(60)]
    table = spark.createDataFrame([(t, 1, 5) for t in good] + [(t, 0, 5) for t in bad], "text string, label int, n_chars long")
    model = quality.fit(table, ("n_chars",))
    both = spark.createDataFrame([(i, t, None) for i, t in enumerate([good[0][::-1], bad[0][::-1], *good[:5], *bad[:5], "", None, LONG])], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["score"] for r in rows(quality.score(both, model, ("n_chars",)))}
    assert all(got[i] > 0.7 for i in range(2, 7)) and all(got[i] < 0.3 for i in range(7, 12)) and all(0 <= x <= 1 for x in got.values())
    assert quality.score(empty, model, ("n_chars",)).count() == 0
    n, row, cell, value, stats = 1, *quality.features([b"one two three"])
    x = np.zeros(model.size)
    x[cell], x[quality.WORDS :] = value, model._dense(np.column_stack([stats, [[0.0]]]))[0]
    pairs = sum(model.v[i] @ model.v[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert np.isclose(model._sums(n, row, cell, value, model._dense(np.column_stack([stats, [[0.0]]])))[0][0], model.w0 + model.w @ x + pairs)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(3)
    plain = lambda: " ".join(rng.choice(["alpha", "stone", "river", "table", "green", "window", "motion", "idea"], 30))
    toxic = [f"{plain()} you {rng.choice(['grobnak', 'fizzwort'])} {plain()}" for _ in range(40)]
    table = spark.createDataFrame([(t, 1) for t in toxic] + [(plain(), 0) for _ in range(80)], "text string, label int")
    model = toxicity.fit(table)
    texts = ["a grobnak", "g r o b n a k here", "grob.nak!", "grxobnak", "fizzworted", plain(), "", "table idea"]
    score = model.score([t.encode() for t in texts])
    assert (score[:5] >= 0.5).all() and (score[5:] < 0.5).all()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(table.filter("label = 0")).score([b"x"])[0] < 0.5


def test_subsequence_kernel_against_recursion():
    def brute(s, t, p):
        from itertools import combinations

        return sum(toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i in combinations(range(len(s)), p) for j in combinations(range(len(t)), p) if all(s[a] == t[b] for a, b in zip(i, j, strict=True)))

    for s, t in ((b"idixot", b"idiot"), (b"loweiung", b"lowei"), (b"abcabc", b"abcab")):
        got = toxicity.kernel(toxicity._rows([s], 0), toxicity._rows([t], 1), 4)[0]
        assert np.isclose(got, brute(s, t, 4), rtol=1e-4)


def test_no_word_that_the_kernel_counts_is_filtered_out():
    rng = np.random.default_rng(4)
    landmarks = [b"scum", b"jerk", b"fool", b"idiot", b"moron", b"loser", b"pathetic"]
    model = toxicity.Model(landmarks)
    model.own = np.array([toxicity._own(z) for z in landmarks])
    for k, z in enumerate(landmarks):
        for many in (2, 3):
            for _ in range(60):
                word = z.decode()
                for at in sorted(rng.choice(len(z) - 1, min(many, len(z) - 1), replace=False), reverse=True):
                    word = word[: at + 1] + "qxzvwyhb"[rng.integers(8)] + word[at + 1 :]
                want = [toxicity.kernel(toxicity._rows([word.encode()], 0), toxicity._rows([y], 1), toxicity.order_of(y))[0] / model.own[i] for i, y in enumerate(landmarks)]
                want = np.where(np.array(want) < toxicity.LEAST, 0, want)
                found, _ = model.sentences([word.encode()])
                assert np.allclose(found[0] if len(found) else 0, want, rtol=1e-5), word
                assert want[k] > 0, word


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    known = language.learn_from(docs)
    model = language.fit(known)
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = [" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n)) for n in (40, 100, 500) for _ in range(30)]
    junk += ["".join(rng.choice(letters + list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 600)) for _ in range(30)]
    junk.append("Helsinki on Suomen pääkaupunki ja maan suurin kaupunki, jossa asuu paljon ihmisiä eri puolilta maailmaa ja jossa on hyvät kulkuyhteydet muualle.")
    assert all(r for _, _, r in model.predict(junk))
    assert language.identify(docs.filter("text RLIKE '[a-zA-Z]'"), model).filter("rejected").count() == 0
    for left_out in ("de", "es", "fr"):  # rows of other languages hold English
        other = language.fit(known.filter(F.col("lang") != left_out))
        got = language.identify(docs.filter((F.col("lang") == left_out) & (F.length("text") > 600)), other).agg(F.avg(F.col("rejected").cast("int")).alias("r")).first().r
        assert got > 0.8, left_out


def test_packing_keeps_ids_of_large_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "small": 5, "big": 70_000}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "large.json"))
    table = spark.createDataFrame([(1, "small big big"), (2, "big")], "doc_id long, text string")
    for r in rows(packing.pack(table, str(tmp_path / "large.json"))):
        want = np.array([5, 70_000, 70_000, 2] if r["doc_id"] == 1 else [70_000, 2], "<u4")[r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.tolist() and r["ids_crc32"] == zlib.crc32(want.tobytes())


def test_plan_is_best_fit_over_all_rooms():
    # best fit puts 200 beside 300, and 162 and 100 beside 250, whose rooms are 100 and 0 more
    plan = packing.plan([300, 250, 200, 100, 162], (512,))
    assert [[d for d, _, _ in q] for q in plan if sum(n for _, _, n in q) == 512] == [[1, 4, 3]]
