import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plinth.llm import decontaminate, language, license, mixing, pii, queries, simhash, sketch, substring, tokens, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, and columns with the operators' own names."""
    long = "the quick brown fox of the licence " * 20_000
    rows = [(1, None, None, None), (2, "", "en", "src1"), (3, long, "en", "src1"), (3, long, "en", "src1"), (None, "some words without an id", "en", None), (5, " \n\t", None, "x"), (6, "one", "fr", "src2"), (7, "1234 ...", "fr", "src2"), (8, long, "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_words": F.lit(7), "mix": F.lit("m"), "fp": F.lit(1), "spans": F.lit("s"), "score": F.lit(0.5), "n_chars": F.length("text").cast("long")})


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name, columns", [("op7_benchmark_decontamination", None), ("op8_substring_dedup", None)])
def test_oracles(spark, name, columns):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[want.columns.index(c)] for c in names)) for r in want.fetchall())


def test_odd_tables(spark, odd):
    bench = spark.createDataFrame([("a", "some words without an id"), ("b", None), (None, "one"), ("c", "")], "item_id string, text string")
    finds = {
        "op2": license.find, "op3": tokens.round_trip, "op5": pii.find, "op6": simhash.find, "op7": lambda d: decontaminate.find(d, bench),
        "op8": substring.find, "op9": sketch.find, "op10": lambda d: language.predict(d, language.train(d)),
    }
    for name, find in finds.items():
        assert find(odd).count() == odd.count(), name
        assert find(odd.limit(0)).count() == 0, name
    assert mixing.keep_mixture(odd).columns == odd.columns
    assert mixing.keep_mixture(odd.limit(0)).count() == 0
    hits = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.find(odd, bench)).collect()}
    assert hits[None]["items_sha256"] == hashlib.sha256(b"a").hexdigest() and hits[6]["n_hit"] == 1 and hits[6]["n_items"] == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd, None, 6).collect()]
    assert len(kept) == len(set(kept)) and 3 in kept and 8 not in kept
    removed = {r["doc_id"]: r for r in substring.find(odd).collect()}
    assert removed[8]["n_removed"] == removed[8]["n_words"] > 0


def test_stages_on_odd_tables(spark, odd):
    clashing = ("_id", "_key", "_n", "_taken", "_bucket", "text_hash", "key", "bucket", "row", "heavy", "lang_pred", "held_out", "epochs", "budget")
    docs = odd.withColumns({n: F.lit(n) for n in clashing})
    for rows in (docs, docs.limit(0), docs.where("text IS NULL")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name == "token_output":
                assert out.count() == rows.count()
                continue
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            kept = out.collect()
            # Mixing repeats documents, up to its number of epochs.
            assert len(kept) <= rows.count() * (mixing.MAX_EPOCHS if name == "source_mixing" else 1)
            assert all(r[n] == n for r in kept for n in clashing), name
    languages = [r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, SF).collect()]
    assert not {1, 2, 5, 7} & set(languages)
    clean = [r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()]
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_odd_pages(spark):
    rows = [(1, None), (2, "no host"), (3, "http://a.com"), (4, "HTTP://Www.Example.COM/en/1?x"), (5, "http://example.com/en/"), (6, "http://x.net/es/1"), (None, "")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k]["rule"] for k in (1, 2, 3, 4, 5, 6)] == [None, None, None, "www.example.com/en/", "example.com/en/", "net/es/"]
    assert (got[4]["host"], got[4]["path"], got[1]["host"]) == ("www.example.com", "/en/1", "")


def test_wu_manber_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (sorted(map(str, decontaminate.digest(decontaminate.find(docs, bench, block_words=n)).collect())) for n in (2_000_000, 800))
    assert one == many


def test_license_brute(documents, spark):
    from plinth.llm.common import words_of

    got = {r["doc_id"]: r for r in license.op2(spark, SF).collect()}
    for doc, text in documents:
        w = words_of(text.encode())
        places = [(i, label) for phrase, label in license.BASE.items() for p in [phrase.encode().split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))


def test_automaton_long_match():
    s = license.Scanner({"a b": "ab"}, [("t", "p q r s t u v w"), ("u", "q r s t x y")])
    places, spans = s.scan(b"z a b p q r s t u z w a b".split())
    assert places == [(1, 0), (11, 0)]
    assert [(a, b, s.labels[t]) for a, b, t, _ in spans] == [(3, 9, "t")]


def test_tokens_are_the_librarys(documents, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
    extra = ["It's I'LL Àé ß ÷× 12a3 «x» a\x1cb a b <|endoftext|> x<|startoftext|>y ΑΣ Σ İ é 中文 😀", "\x85 ª µ º --''s 's't", "It's I'LL Àé ß 12a3\ta\x0bb\x0cc\r\n's't --''s don'T's ÿÖx Þ " + "ab" * 50]
    start = 0
    got = {r["doc_id"]: r for r in tokens.op3(spark, SF).collect()}
    for doc, text in sorted(documents):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert tuple(got[doc])[1:] == (start, len(ids), zlib.crc32(raw))
        start += len(ids)
    for text in extra:
        assert own.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 2, 40, 50_000, 1 << 40, (1 << 64) - 1):
        ids = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        ids[::7] = 0
        words, offsets = tokens.encode(ids)
        assert (tokens.decode(words) == ids).all()
        assert (tokens.decode_range(words, offsets, 1000, 1900) == ids[1000:1900]).all()
    assert len(tokens.decode(tokens.encode(np.empty(0, np.uint64))[0])) == 0


def test_simhash_brute(documents, spark):
    prints = {d: simhash.fingerprint(words(t)) for d, t in documents}
    text = documents[0][1]
    h = [xxhash.xxh64_intdigest(b" ".join(words(text)[i : i + 3]), 42) for i in range(len(words(text)) - 2)]
    assert prints[documents[0][0]] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


def test_covering_and_heavy_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40)
    fps = set(base.tolist())
    for f in base[:20].tolist():
        for _ in range(15):
            a, b = rng.integers(0, 63, 2)
            f ^= (1 << int(a)) ^ (1 << int(b))
            fps.add(f)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    results = []
    for heavy in (50_000, 8):
        prints = nodes.withColumn("doc_id", F.col("fp"))
        results.append(sorted(map(tuple, simhash.components(prints, 2, heavy).select("doc_id", "component_id").collect())))
    assert results[0] == results[1]
    assert all(c in {x for _, x in results[0]} for c in [min(fps)])


def test_distance_with_the_sign_bit(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 61)
    fps = [(int(f) + (1 << 64)) % (1 << 64) for f in base]
    fps += [f ^ (1 << 63) ^ (1 << j) for j, f in enumerate(fps)] + [f ^ (7 << 61) for f in fps]
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    parent = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                low, high = sorted((parent[a], parent[b]))
                parent = [low if x == high else x for x in parent]
    assert len(set(parent)) == 122
    assert dict(simhash.components(prints, 2).select("doc_id", "component_id").collect()) == dict(enumerate(parent))


def test_similar_forest_brute():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 40, int(rng.integers(5, 40)))
        for _ in range(6):
            kept = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 40, int(rng.integers(0, 3)))])))
    sets += [np.empty(0, np.int64)] * 2
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def groups(pairs):
        parent[:] = range(len(sets))
        for a, b in pairs:
            parent[root(a)] = root(b)
        return [sorted(y for y in range(len(sets)) if root(y) == root(x)) for x in range(len(sets))]

    def alike(a, b):
        both = len(set(a) & set(b))
        return both >= 0.8 * (len(a) + len(b) - both) - 1e-9

    edges = simhash.similar_forest(list(range(len(sets))), sets, 0.8)
    assert len(edges) < len(sets)
    assert groups(edges) == groups([(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])])


def near_rows():
    text = [" ".join(f"w{i}x{j}" for j in range(120)) for i in range(4)]
    one = text[0].replace("w0x60", "new")
    half = " ".join(text[1].split()[:60] + text[2].split()[:60])
    rows = [(5, text[0]), (2, one), (9, text[0].upper()), (3, text[1]), (4, half), (6, text[3]), (6, text[3]), (7, text[3]), (None, text[2]), (8, text[2] + " end"), (None, "alone"), (10, None), (11, ""), (12, "  ")]
    return rows, {2, 3, 4, 6, 8, 10, None}


@pytest.mark.parametrize("heavy", [simhash.HEAVY_MARKS, 150])
def test_near_dedup(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.SIMILAR, heavy))
    rows, want = near_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, bucket int")
    got = simhash.keep_one(docs, None, 6).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "node", "bucket"}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((x is None, x or 0) for x in want)
    assert simhash.keep_one(docs.limit(0), None, 6).count() == 0


def planted_rows(documents):
    """Texts with near copies of contiguous edits: 5 % and 10 % of the end replaced by another text's or by new words, appends, short texts."""
    rng = np.random.default_rng(8)
    texts = [t.split() for _, t in documents if t and len(t.split()) >= 40][:120]
    out = []
    for i, w in enumerate(texts):
        other, new = texts[(i + 60) % len(texts)], [f"n{i}x{j}" for j in range(len(w))]
        n, m = len(w) // 20, len(w) // 10
        short = [f"s{i}x{int(x)}" for x in rng.integers(0, 10**6, 16 + i % 5)]
        out += [w, w[:-n] + other[-n:], w[:-m] + other[-m:], w[:-n] + new[:n], w[:-m] + new[:m], w + new[: len(w) // 5], short, short[:-1] + [f"e{i}"], short + [f"e{i}", f"f{i}"]]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_dedup_of_contiguous_edits(spark, documents):
    rows = planted_rows(documents)
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    having, parent = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = 0
    for i, s in enumerate(sets):
        for j in {j for x in s for j in having[x] if j < i}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both) - 1e-9:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
                pairs += 1
    assert pairs > 500
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), None, 6)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(len(rows)) if root(i) == i]


def test_sketch():
    a, b = sketch.parts_of([b"one two three four\nfive six seven\n" * 30, b"one two three four\nfive six seven\n" * 20 + b"other words here\n" * 9])
    ((mine, theirs),) = sketch.differences([a.paragraphs], [b.paragraphs])
    assert set(mine) == set(a.paragraphs.tolist()) - set(b.paragraphs.tolist()) and set(theirs) == set(b.paragraphs.tolist()) - set(a.paragraphs.tolist())
    empty = sketch.parts_of([b""])
    assert sketch.likeness([a], [a]) == [1.0] and sketch.likeness(empty, empty) == [1.0]
    assert sketch.edited("abcdefgh", "XYZ") == "abcdefXY" and sketch.edited("abcdef", "X") == "abcdX"


def test_fingerprint_brute(documents, spark):
    order = sorted(documents, reverse=True)
    got = {r["doc_id"]: r for r in sketch.op9(spark, SF).collect()}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        changed = sketch.edited(text, after)
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b = sketch.parts_of([text.encode(), changed.encode()])
        assert r["fingerprint"] == sketch.sketched([a.paragraphs]).texts()[0]
        x, y = (collections.Counter(p.cells.tolist()) for p in (a, b))
        assert r["near_edited"] == pytest.approx(1 - sum(((x - y) + (y - x)).values()) / max(1, len(a.cells) + len(b.cells)))


def test_budgets():
    assert mixing.fill(10, [100, 100], [3, 1]) == [8, 2] or mixing.fill(10, [100, 100], [3, 1]) == [7, 3]
    assert mixing.fill(90, [10, 100, 100], [1, 1, 1]) == [10, 40, 40]
    assert mixing.fill(500, [10, 20], [1, 1]) == [10, 20]
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 1000}
    got = mixing.budgets(leaves, 300, {}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 190}


def test_mixture_takes_the_budget(spark):
    rows = mixing.op1(spark, SF).groupBy("domain", "lang", "source", "budget").agg(F.sum("taken").alias("n"), F.sum(F.when((F.col("cut") > 0) & (F.col("cut") < F.col("n_tokens")), 1).otherwise(0)).alias("cuts")).collect()
    assert rows and all(r["n"] == r["budget"] and r["cuts"] <= 1 for r in rows)


def test_language_held_out(spark):
    got = language.op10(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    assert corpus_pipeline.run(spark, SF).count() > 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_brute(documents, spark):
    extra = [
        "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 12345.1.1.1 0001.2.3.4 256.1.1.1", "+1 (988) 555-2485 +49 4111 1111 1111 1111", "4111-1111 1111 1111 4111",
        "\U0001f600é a.b@c-d.e.f, \U0001f600 +123456789", None, "", "9" * 5000 + " " + "a" * 3000 + "@" + "b.c" * 500, "a@b 1..2 +1 +12 ++1234567890 @a.b a@-.- 4@4.4",
    ]
    rows = documents + [(10**9 + i, x) for i, x in enumerate(extra)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for doc, text in rows:
        want = base_spans(text or "")
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert [got[doc][f"n_{k}"] for k in PII] == [sum(x[3] == k for x in want) for k in PII]


def test_pii_validators_and_context(spark):
    texts = [(1, "IBAN DE89370400440532013000, not DE89370400440532013001"), (2, "my SSN is 078-05-1120"), (3, "part 078-05-1120"), (4, "call (555) 123-4567")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert "iban:5:27" in got[1].split(",") and got[1].count("iban") == 1
    assert (got[2], got[3], got[4]) == ("ssn:10:21", "", "local_phone:5:19")
