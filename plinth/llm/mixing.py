"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domains, languages and sources by the
weights of siblings.  No node gets more than its leaves can give in
``max_epochs`` passes; what a node can't take goes to its siblings first, by
their weights, and only what all of them can't take goes to the siblings of
their parent.  Giving each node at most the capacity below it, from the top down,
does just that.

A leaf's documents are ordered anew in each epoch by a seeded hash.  The leaf's
selection is the prefix of that endless sequence which has as many tokens as its
budget: whole epochs, then a prefix of one more, whose last document is cut.
The place of the cut is found in two steps, by sums over ``SLICES`` hash ranges
and within one range, so that no leaf needs to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm import common

LEVELS = ("domain", "lang", "source")
#: Weights of the query, by path; siblings that aren't named have weight 1.
WEIGHTS = {
    ("web",): 4.0, ("books",): 3.0, ("news",): 2.0, ("code",): 1.0,
    ("web", "en"): 3.0, ("web", "fr"): 2.0, ("web", "de"): 2.0, ("web", "es"): 1.0,
    ("books", "en"): 2.0,
}
#: Budget as a share of all tokens, passes over a leaf at most, and seed of the query.
SHARE, MAX_EPOCHS, SEED = 0.5, 2, 17
#: The pipeline keeps as many tokens as it has: what the weights ask less of is cut, what they ask more of is repeated.
KEPT_SHARE = 1.0
SLICES = 1024
#: Leaves that the driver plans for; more is an error, not a cut.
MAX_LEAVES = 2_000_000
#: Domains of the numbered sources, by the number's remainder.
DOMAINS = ("web", "books", "news", "code")


def domain_of(source: Column) -> Column:
    """The domain of a source by its number; ``other`` without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1), F.lit("other"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(total: int, capacity: list[int], weight: list[float]) -> list[int]:
    """Share ``total`` by weight, none over its capacity; shortages go to the others by weight.

    Weights are finite and not negative; those of weight 0 get what the others can't
    take, in equal parts.  No capacities give no shares.

    Whole numbers whose sum is ``total``, or all that there is; what rounding
    leaves goes to the largest remainders, the first of equal ones.
    """
    if not all(0 <= w < float("inf") for w in weight):
        raise ValueError("weights must be finite and not negative")
    given = [0] * len(capacity)
    left = min(total, sum(capacity))
    open_ = [i for i, c in enumerate(capacity) if c > 0]
    while left and open_:
        weights = sum(weight[i] for i in open_)
        if weights <= 0:
            weight, weights = [1.0] * len(weight), float(len(open_))
        full = [i for i in open_ if capacity[i] - given[i] <= left * weight[i] / weights]
        if full:
            for i in full:
                left -= capacity[i] - given[i]
                given[i] = capacity[i]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        shares = {i: left * weight[i] / weights for i in open_}
        for i, s in shares.items():
            given[i] += int(s)
        left -= sum(map(int, shares.values()))
        for i in sorted(open_, key=lambda i: (int(shares[i]) - shares[i], i)):
            if left and given[i] < capacity[i]:
                given[i] += 1
                left -= 1
    return given


def budgets(leaves: dict[tuple, int], total: int, weights: dict[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """The budget of each leaf; ``leaves``: tokens by path."""
    given: dict[tuple, int] = {}
    depth = len(next(iter(leaves))) if leaves else 0
    capacity: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, tokens in leaves.items():
        for k in range(depth + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + tokens * max_epochs
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])

    def down(node: tuple, amount: int) -> None:
        if len(node) == depth:
            given[node] = amount
            return
        below = sorted(children[node], key=lambda p: tuple(map(str, p)))
        for child, part in zip(below, fill(amount, [capacity[c] for c in below], [weights.get(c, 1.0) for c in below])):
            down(child, part)

    if leaves:
        down((), total)
    return given


def select(
    docs: DataFrame,
    levels: tuple[Column | str, Column | str, Column | str],
    tokens: Column,
    weights: dict[tuple, float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
) -> DataFrame:
    """The selected rows of ``docs``, with all their columns and a struct ``mix``.

    ``docs`` is written to the shared folder once; leave large columns out of it.

    ``mix`` has the path (level1, level2, level3), n_tokens, epochs (how often
    the document is taken whole), cut (tokens taken of it in the last, partial
    epoch), taken (tokens in all) and budget (of its leaf).  Documents of which
    nothing is taken, and those without tokens, are left out.

    Null levels are levels of their own, named ``(none)``.  Equal hashes are
    ordered by id, then by token count; rows that agree in both are alike, and
    are taken in either order.  A negative weight is an error.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    mix = common.fresh(docs, "mix")
    slot = common.fresh(docs, "slot")
    names = [f"level{i + 1}" for i in range(len(levels))]
    path = [F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("(none)")).alias(n) for x, n in zip(levels, names)]
    of = docs.withColumn(mix, F.struct(*path, tokens.alias("n_tokens"))).where(F.col(f"{mix}.n_tokens") > 0)
    leaf = [F.col(f"{mix}.{n}").alias(n) for n in names]
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(f"{mix}.n_tokens"))

    def sliced(epoch: Column) -> tuple[Column, Column]:
        h = F.xxhash64(order, epoch)
        return h, F.pmod(F.shiftrightunsigned(h, 54), F.lit(SLICES)).cast("int")

    # One row a leaf: its tokens.  The partial epoch's number follows from the budget.
    common.shared_dir(spark)
    of = of.checkpoint()
    sums = of.groupBy(*leaf).agg(F.sum(f"{mix}.n_tokens").alias("tokens"))
    rows = sums.limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    held = {tuple(r[n] for n in names): r["tokens"] for r in rows}
    given = budgets(held, int(share * sum(held.values())), weights, max_epochs)
    plan = [(*p, b, b // held[p], b % held[p]) for p, b in given.items()]
    schema = ", ".join(f"{n} string" for n in names) + ", budget long, epochs long, rest long"
    planned = spark.createDataFrame(plan, schema)
    if len(plan) <= 50_000:
        planned = F.broadcast(planned)
    on = [F.col(f"{mix}.{n}") == planned[n] for n in names]
    joined = of.join(planned, on[0] & on[1] & on[2])
    h, part = sliced(F.col("epochs"))
    joined = joined.withColumn(slot, F.struct(h.alias("h"), part.alias("part"))).drop(*names)
    # Tokens of each hash range of each leaf, and those of the ranges before it.
    parts = joined.groupBy(*leaf, F.col(f"{slot}.part").alias("part"), "rest").agg(F.sum(f"{mix}.n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = parts.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    edge = edge.select(*(F.col(n).alias(f"e_{n}") for n in names), F.col("part").alias("e_part"), "before")
    if len(plan) <= 50_000:
        edge = F.broadcast(edge)
    on = [F.col(f"{mix}.{n}") == F.col(f"e_{n}") for n in names]
    joined = joined.join(edge, on[0] & on[1] & on[2], "left")
    # Within the range where the budget ends, of few rows: how many tokens come before a document.
    at_edge = F.col(f"{slot}.part") == F.col("e_part")
    whole = F.when(F.col(f"{slot}.part") < F.col("e_part"), F.col(f"{mix}.n_tokens")).otherwise(0)
    inner = joined.where(at_edge)
    w = Window.partitionBy(*(F.col(f"{mix}.{n}") for n in names)).orderBy(f"{slot}.h", id_col, f"{mix}.n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(f"{mix}.n_tokens").over(w), F.lit(0))
    inner = inner.withColumn("cut", F.greatest(F.lit(0), F.least(F.col(f"{mix}.n_tokens"), F.col("rest") - ahead)))
    outer = joined.where(~F.coalesce(at_edge, F.lit(False))).withColumn("cut", F.coalesce(whole, F.lit(0)))
    both = outer.unionByName(inner)
    taken = F.col("epochs") * F.col(f"{mix}.n_tokens") + F.col("cut")
    out = F.struct(*leaf, F.col(f"{mix}.n_tokens").alias("n_tokens"), F.col("epochs"), F.col("cut").cast("long").alias("cut"), taken.cast("long").alias("taken"), F.col("budget"))
    return both.where(taken > 0).withColumn(mix, out).select(*docs.columns, F.col(mix).alias("mix") if mix == "mix" else F.col(mix))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, tokens, and what the mixture takes of each document."""
    docs = common.table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "lang", "source", n_words(F.col("text")).alias("n"))
    found = select(slim, (domain_of(F.col("source")), "lang", "source"), F.col("n"))
    return found.select("doc_id", *(F.col(f"mix.level{i + 1}").alias(n) for i, n in enumerate(LEVELS)), "mix.n_tokens", "mix.epochs", "mix.cut", "mix.taken", "mix.budget")


def keep_mixture(docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, share: float = KEPT_SHARE, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mixture, with all their columns: a row for each time that one is taken.

    A document that the budget cuts keeps the words that are taken of it in its last
    row, and ``n_chars`` follows.  Rows without words go.  Rows that share an id and
    a text are taken alike.  Null ids, texts, languages and sources are values of
    their own; an empty table gives no rows.
    """
    key = common.fresh(docs, "text_hash")
    id_, key_, taken_, n_ = (common.fresh(docs, n) for n in ("_id", "_key", "_taken", "_n"))
    docs = docs.withColumn(key, F.xxhash64("text", F.length("text")))
    slim = docs.select("doc_id", key, "lang", "source", n_words(F.col("text")).alias("n"))
    found = select(slim, (domain_of(F.col("source")), "lang", "source"), F.col("n"), weights, share, max_epochs, seed)
    taken = found.groupBy(F.col("doc_id").alias(id_), F.col(key).alias(key_)).agg(F.max("mix.taken").alias(taken_), F.max("mix.n_tokens").alias(n_))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(id_)) & docs[key].eqNullSafe(F.col(key_)))
    # The words taken each time: all of them in whole epochs, then what is left.
    whole = F.array_repeat(F.col(n_), F.floor(F.col(taken_) / F.col(n_)).cast("int"))
    rest = F.col(taken_) % F.col(n_)
    joined = joined.withColumn(taken_, F.explode(F.when(rest > 0, F.array_append(whole, rest)).otherwise(whole)))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(taken_) < F.col(n_), F.array_join(F.slice(words, F.lit(1), F.col(taken_).cast("int")), "")).otherwise(F.col("text"))
    cut = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(taken_) < F.col(n_), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.drop(key, id_, key_, taken_, n_)
