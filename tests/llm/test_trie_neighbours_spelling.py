"""The conversation trie, nearest neighbours and spelling variants against brute force, with odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from plinth.llm import neighbours, prefix_trie, queries, spelling

SF = "/root/testdata/sf0.001"

# The conversation trie


def brute_trie(rows):
    """Nodes by a dictionary of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = [t[2:] for t in own.get(base, [])[:h]] + [t[2:] for t in own[c][h:]]
    members, kids, ends = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, s in made.items():
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[q] for q in kids[p]) + (len(members[p]) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def nodes_of(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in columns) for r in df.collect())


def test_trie_query_is_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert nodes_of(queries.QUERIES["op11_conversation_trie"](spark, SF)) == brute_trie(rows)


def test_trie_in_rounds_with_odd_rows(spark):
    """Copies, prefixes of each other, a long shared beginning, ties, nulls, empty texts, a negative id, a column more."""
    rng, rows = random.Random(5), []
    for c in range(-25, 60):
        turns = rng.choice([["a b"] * 6, ["a b"] * 6 + ["c"], ["a b", "d e f"], ["x"], ["a b"] * rng.randint(1, 9), [rng.choice("pq r") for _ in range(5)]])
        rows += [(c, i, rng.choice(["user", None]) if i % 3 == 0 else "user", t, c) for i, t in enumerate(turns)]
    rows += [(7, None, "user", "first"), (7, None, "user", "before"), (8, 2, None, None), (8, 2, "user", ""), (None, 1, "user", "nobody"), (9, 1, "user", "a\x0bb \x0c  c é d")]
    rows = [(*r, 0)[:5] for r in rows] + [(70, 1, "user", "twice", 0)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id long")
    want = brute_trie([r[:4] for r in rows])
    convs = prefix_trie.rebuilt(prefix_trie.encoded(df))
    assert nodes_of(prefix_trie.trie(convs)) == want
    for most in (1, 4):
        assert nodes_of(prefix_trie.trie(convs, most)) == want
    assert nodes_of(prefix_trie.trie(convs, 1000, 5)) == want


def test_trie_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    convs = spark.range(100).select(F.col("id").alias("conv_id"), F.array(F.lit(5).cast("long")).alias("ids"), F.array(F.lit(3)).alias("words"))
    (r,) = prefix_trie.distinct_sequences(convs.repartition(5)).collect()
    assert (r["n"], r["least"], r["ends"]) == (100, 0, hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest())
    assert [r[:2] + r[3:7] for r in nodes_of(prefix_trie.trie(convs, 1))] == [(0, 0, 100, 1, 1, 297), (0, 1, 100, 0, 1, 297)]


def test_trie_of_nothing_and_of_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert nodes_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(empty)))) == []
    # The only turn of conversation 21 is cut off, as h is over 0 and its base isn't there.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    one = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    assert nodes_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.encoded(one)))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# Nearest neighbours


def brute_nearest(rows, k):
    """query_id, rank, vec_id, score for ids that 10 divides; rows of one dimension."""
    out = []
    for q, a in rows:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))), c) for c, b in rows if c != q)
            out += [(q, i + 1, c, d) for i, (d, c) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 2.0, 0.0]) for i in range(400, 700)]
    rows += [(i, [1e-30, -2e-30, 3e30, 0.0, 1.0]) for i in range(700, 703)]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(1000, None), (1010, []), (1020, [0.0] * 5), (1030, [1.0, None, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 5), (1050, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5), (1060, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd + rows[:50]], "vec_id long, v array<double>, mark int")
    for most in (None, 64):
        got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, 10, "vec_id", "v", most)
        assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows, 10)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    assert neighbours.nearest(few.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(few, F.col("vec_id") == 9).count() == 0


def test_neighbours_bounds_hold():
    """Quantised distances are off by the bounds at most, also in a dimension whose sums single precision can't hold."""
    rng = np.random.default_rng(4)
    for d in (3, 64, 1500):
        a, b = rng.normal(size=(40, d)), rng.normal(size=(300, d)) * rng.choice([1e-3, 1, 50], size=(300, 1))
        (qa, sa, ea), (qb, sb, eb) = neighbours.quantised(a), neighbours.quantised(b)
        about = np.linalg.norm((qa * sa[:, None])[:, None] - (qb * sb[:, None])[None], axis=2)
        true = np.linalg.norm(a[:, None] - b[None], axis=2)
        assert (np.abs(about - true) <= ea[:, None] + eb[None] + 1e-9).all()
        got = neighbours.search(a, list(range(-40, 0)), b, [[i] for i in range(300)], 5, 64)
        want = {(q, int(c)) for q in range(40) for c in np.argsort(true[q], kind="stable")[:5]}
        assert {(q, c) for q, c, _ in got} == want


# Spelling variants


def brute_variants(texts):
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    near, form = defaultdict(set), {}
    for u in words:
        for v in words:
            if len(u) == len(v) and sum(x != y for x, y in zip(u, v)) == 1 or len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v))):
                near[u].add(v)
                near[v].add(u)
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_query_is_brute_force(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    assert rows_of(queries.QUERIES["op13_spelling_variants"](spark, SF)) == brute_variants(texts)


def test_spelling_of_crowded_blocks_and_odd_rows(spark):
    """Words that differ in few places, repeated letters, letters beyond ASCII, chains of forms, null and empty texts, a very long one."""
    rng, words = random.Random(6), []
    for _ in range(600):
        words.append("abcd" + "".join(rng.choice("aé") for _ in range(4)) + "xyz"[: rng.randint(0, 3)])
    words += ["aaaaaaa"] * 200 + ["aaaaaaaa"] * 20 + ["aaaaaaaaa"] * 2 + ["Straßenbahn", "STRASSENBAHN", "straßenbah", "ÀÉÎÕÜàé×÷"] * 3 + ["a" * 200, "a" * 201] * 2
    rng.shuffle(words)
    texts = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "nobody's wordless wordless words"), (99, None), (98, ""), (97, "1234567 !!")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    want = brute_variants(texts)
    assert any(form for _, form, *_ in want)
    for most in (64, 1):
        assert rows_of(spelling.variants(spelling.word_counts(df, garbled=31), block_rows=most)) == want
    assert spelling.variants(spelling.word_counts(df.where("doc_id < 0"))).count() == 0
    long = spark.createDataFrame([("a" * 70_000, 30), ("a" * 70_001, 2), ("b" + "a" * 69_999, 2)], "word string, n long")
    assert sorted((len(r["word"]), r["n_near"], len(r["root"])) for r in spelling.variants(long).collect()) == [(70_000, 1, 70_000), (70_000, 2, 70_000), (70_001, 1, 70_000)]


def test_forms_are_followed_to_the_last(spark):
    words = spark.createDataFrame([("aaaaaaa" + "b" * i, 20**i) for i in range(7)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(words).collect()}
    names = ["aaaaaaa" + "b" * i for i in range(7)]
    assert got == {w: (names[i + 1] if i < 6 else None, names[6]) for i, w in enumerate(names)}


# Token windows by offsets


def test_token_windows_are_slices_of_the_whole(spark):
    """Windows by the blocks' offsets equal slices of all ids, past a document's end and in one without text too."""
    from plinth.llm import common, tokens

    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900) + str(i)) for i in range(60)] + [(60, None)], "doc_id long, text string")
    where = common.scratch(spark, "windows")
    tokens.write(docs, where)
    whole = {r["doc_id"]: list(r["ids"]) for r in tokens.read_ids(spark, where).collect()}
    for begin, length in ((0, 5), (100, 64), (850, 1000), (5000, 3)):
        got = {r["doc_id"]: (r["n_tokens"], list(r["ids"])) for r in tokens.read_window(spark, where, begin, length).collect()}
        assert got == {d: (len(ids), ids[begin : begin + length]) for d, ids in whole.items()}


def test_kept_pieces_are_bounded(monkeypatch):
    from plinth.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 10)
    made = []
    pieces = tokens.Pieces(lambda p: made.append(p) or p.encode())
    for i in range(100):
        assert pieces["often"] == b"often" and pieces[str(i)] == str(i).encode()
        assert len(pieces) + len(pieces.before) <= 10
    assert made.count("often") == 1


def test_likeness_follows_from_what_is_returned(spark):
    """near_edited and near_next are those of the returned lists of cells, whatever order the paragraphs have."""
    from plinth.llm import sketch

    rows = sorted(sketch.find(spark.read.parquet(f"{SF}/documents.parquet")).collect(), key=lambda r: -r["doc_id"])
    for r, after in zip(rows, rows[1:] + rows[:1]):
        assert abs(r["near_edited"] - sketch.likeness_of(r["cells"], r["edited_cells"])) < 1e-12
        assert abs(r["near_next"] - sketch.likeness_of(r["cells"], after["cells"])) < 1e-12
    assert sketch.likeness_of("", "") == 1.0 and sketch.likeness_of(rows[0]["cells"], "") == 0.0
