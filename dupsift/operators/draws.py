"""Pairs drawn at random from labelled rows, as training samples need them: same labels, different labels, hard negatives, stratified by similarity.

A draw is a number k. The MD5 of it gives label and places of two rows, uniformly, so every engine and cluster draws the same pairs. Rows get places within their
group from range partitions (see `order`), and a draw finds its rows by equi-joins on (group, place): no group is gathered, sorted by one task or paired with itself. Pairs are distinct;
they count in the order of their first draw, and drawing goes on in rounds until there are enough or the attempts are used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vectors as V
from ..storage import kept
from .clean import md5_order
from .order import order_statistics, running_sums, with_positions
from .pairs import stratified

#: Drawn pairs up to which they are broadcast to the rows.
BROADCAST_DRAWS = 200_000


def number(seed: int, kind: str, k: Column, which: int) -> Column:
    """The `which`-th 60-bit number of draw k."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{kind}"), k.cast("string"), F.lit(str(which // 2))))
    return F.conv(F.substring(digest, 1 + 15 * (which % 2), 15), 16, 10).cast("bigint")


def ordered(df: DataFrame, group: str) -> DataFrame:
    """_g, id, label, pos: the rows in order of group and id. What `members` begins with, to be shared."""
    return with_positions(df.select(F.col(group).alias("_g"), "id", "label"), "_g", "id")


def members(df: DataFrame, group: str, least: int = 1, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, pos, id, label) of the rows of groups with at least `least` rows, and (g, n) of those groups; g numbers the groups in order, pos the rows in order of id. rows: ordered(df, group), if it's there."""
    rows = ordered(df, group) if rows is None else rows
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("pos").alias("start")).where(F.col("n") >= least)
    sizes = kept(with_positions(sizes, "start", name="g"), "groups")
    placed = rows.join(sizes, "_g").select("g", (F.col("pos") - F.col("start")).alias("pos"), "id", "label")
    return kept(placed, "members"), sizes.select("g", "n")


def _rows_of(draws: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
    """draws (k, g1, i1, g2, i2) with the rows at both places: k, id_1 < id_2, label_1, label_2."""
    draws = F.broadcast(draws) if few else draws
    one = draws.join(rows.select(F.col("g").alias("g1"), F.col("pos").alias("i1"), F.struct("id", "label").alias("a")), ["g1", "i1"])
    if few:
        one = F.broadcast(one)
    both = one.join(rows.select(F.col("g").alias("g2"), F.col("pos").alias("i2"), F.struct("id", "label").alias("b")), ["g2", "i2"])
    x, y = F.least("a", "b"), F.greatest("a", "b")
    return both.select("k", x["id"].alias("id_1"), y["id"].alias("id_2"), x["label"].alias("label_1"), y["label"].alias("label_2")).where("id_1 <> id_2")


def within(groups: DataFrame, draws: DataFrame, seed: int, kind: str) -> DataFrame:
    """k, g1, i1, g2, i2 for draws (k, g): two different places of the group."""
    k, n = F.col("k"), F.col("n")
    i = number(seed, kind, k, 1) % n
    return draws.join(groups, "g").select("k", F.col("g").alias("g1"), i.alias("i1"), F.col("g").alias("g2"), ((i + 1 + number(seed, kind, k, 2) % (n - 1)) % n).alias("i2"))


def _collect(spark: SparkSession, target: int, attempts: int, draw: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """The first `target` distinct pairs of draw(numbers, few), with the k of their first draw; fewer if attempts don't give so many."""
    have, low, size = None, 0, 2 * target
    while True:
        high = min(attempts, low + size)
        new = draw(spark.range(low, high).withColumnRenamed("id", "k"), high - low <= BROADCAST_DRAWS)
        both = new if have is None else have.unionByName(new)
        keys = ["id_1", "id_2"]
        others = [c for c in new.columns if c not in (*keys, "k")]
        have = kept(both.groupBy(*keys).agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in others]).select(new.columns), "drawn")
        if high >= attempts or have.count() >= target:
            return have.orderBy("k").limit(target)
        low, size = high, 2 * size


def positives(df: DataFrame, target: int, seed: int = 42, kind: str = "pos", rows: DataFrame | None = None) -> DataFrame:
    """k, id_1, id_2, label_1, label_2: `target` distinct pairs of one label. A label is drawn uniformly, then two of its rows; labels with one row
    take no part. If 30 draws for each pair aren't enough (labels run out of pairs), the rest is drawn uniformly from all pairs; only if the table has fewer pairs, fewer come. df: id, label."""
    rows, groups = members(df, "label", 2, rows)
    spark, labels = df.sparkSession, groups.count()
    if not labels or target <= 0:
        return rows.limit(0).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("id_1"), F.col("id").alias("id_2"), F.col("label").alias("label_1"), F.col("label").alias("label_2"))

    def draw(numbers: DataFrame, few: bool) -> DataFrame:
        g = numbers.withColumn("g", number(seed, kind, F.col("k"), 0) % F.lit(labels))
        return _rows_of(within(groups, g, seed, kind), rows, few)

    found = kept(_collect(spark, target, max(30 * target, 1000), draw), "positives")
    have, there = found.count(), groups.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0]
    if have >= min(target, there):
        return found
    return found.unionByName(fill(spark, rows, groups, found, int(target - have), int(there), seed))


def fill(spark: SparkSession, rows: DataFrame, groups: DataFrame, found: DataFrame, target: int, there: int, seed: int) -> DataFrame:
    """`target` more pairs within groups, each of the `there` pairs equally likely, none of those found. An ordinal among all pairs finds its group on the
    prefix sums of the groups' numbers of pairs, by a join on cells of the sums' range. Where most pairs are wanted, all are numbered and taken in MD5 order."""
    sums = kept(running_sums(groups.withColumn("pairs", F.col("n").cast("double") * (F.col("n") - 1) / 2), "pairs", "g"), "sums")
    keys, most = ["id_1", "id_2"], found.agg(F.max("k")).first()[0] or 0
    wanted = target + found.count()
    if 3 * wanted >= there:
        firsts = groups.select("g", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 2)).alias("i1"))
        every = firsts.select(F.lit(0).cast("bigint").alias("k"), F.col("g").alias("g1"), "i1", F.col("g").alias("g2"), F.explode(F.sequence(F.col("i1") + 1, F.col("n") - 1)).alias("i2"))
        rest = _rows_of(every, rows, False).join(found.select(*keys), keys, "left_anti")
        chosen = with_positions(rest.withColumn("_o", md5_order(f"{seed}|fill", *keys)).orderBy("_o", *keys).limit(target), "_o", *keys)
        return chosen.withColumn("k", F.lit(most + 1) + F.col("pos")).drop("_o", "pos")
    cells = max(1, sums.count())
    cell = lambda x: F.least(F.lit(cells - 1), F.floor(x / F.lit(there / cells)))
    covered = sums.withColumn("cell", F.explode(F.sequence(cell(F.col("before")), cell(F.col("before") + F.col("pairs") - 1))))

    def draw(numbers: DataFrame, few: bool) -> DataFrame:
        at = F.floor(number(seed, "fill", F.col("k"), 0) / F.lit(float(1 << 60)) * F.lit(float(there)))
        placed = numbers.withColumn("at", at).withColumn("cell", cell(F.col("at")))
        inside = placed.join(covered, "cell").where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("pairs")))
        drawn = _rows_of(within(groups, inside.select("k", "g"), seed, "fill"), rows, few)
        return drawn.join(found.select(*keys), keys, "left_anti")

    more = _collect(spark, target, 40 * target + 1000, draw)
    return more.withColumn("k", F.col("k") + F.lit(most + 1))


def negatives(df: DataFrame, target: int, seed: int = 42, kind: str = "neg", chosen: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """k, id_1, id_2, label_1, label_2: `target` distinct pairs of different labels: two labels are drawn uniformly, then a row of each. Pairs in `chosen` (id_1, id_2) are left
    out. Fewer pairs if 30 draws for each aren't enough; none with one label."""
    rows, groups = members(df, "label", rows=rows)
    labels = groups.count()
    if labels < 2 or target <= 0:
        return positives(df.limit(0), 0)

    def draw(numbers: DataFrame, few: bool) -> DataFrame:
        drawn = _rows_of(_across(numbers, groups, labels, seed, kind), rows, few)
        return drawn if chosen is None else drawn.join(chosen.select("id_1", "id_2"), ["id_1", "id_2"], "left_anti")

    return _collect(df.sparkSession, target, max(30 * target, 1000), draw)


def _across(numbers: DataFrame, groups: DataFrame, labels: int, seed: int, kind: str) -> DataFrame:
    """k, g1, i1, g2, i2: places in two different groups."""
    k = F.col("k")
    g1 = number(seed, kind, k, 0) % F.lit(labels)
    g2 = (g1 + 1 + number(seed, kind, k, 1) % F.lit(labels - 1)) % F.lit(labels)
    sized = numbers.withColumns({"g1": g1, "g2": g2}).join(groups.select(F.col("g").alias("g1"), F.col("n").alias("n1")), "g1").join(groups.select(F.col("g").alias("g2"), F.col("n").alias("n2")), "g2")
    return sized.select("k", "g1", (number(seed, kind, k, 2) % F.col("n1")).alias("i1"), "g2", (number(seed, kind, k, 3) % F.col("n2")).alias("i2"))


def with_jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with token_jaccard of their token sets. sets: id, tokens (content tokens, distinct)."""
    one = pairs.join(sets.select(F.col("id").alias("id_1"), F.col("tokens").alias("_a")), "id_1")
    both = one.join(sets.select(F.col("id").alias("id_2"), F.col("tokens").alias("_b")), "id_2")
    return both.withColumn("token_jaccard", T.jaccard(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def hard_negatives(df: DataFrame, target: int, low: float = 0.3, high: float = 0.5, seed: int = 42, rows: DataFrame | None = None) -> DataFrame:
    """negatives whose content tokens have a Jaccard similarity in [low, high], with token_jaccard; fewer if 500 draws for each (10,000 at least) don't give so many. df: id, label, tokens."""
    rows, groups = members(df, "label", rows=rows)
    labels = groups.count()
    sets = kept(df.select("id", T.content_tokens(F.col("tokens")).alias("tokens")), "sets")
    if labels < 2 or target <= 0:
        return positives(df.limit(0), 0).withColumn("token_jaccard", F.lit(0.0))

    def draw(numbers: DataFrame, few: bool) -> DataFrame:
        drawn = _rows_of(_across(numbers, groups, labels, seed, "hard"), rows, few)
        return with_jaccard(drawn, sets).where(F.col("token_jaccard").between(low, high))

    return _collect(df.sparkSession, target, max(500 * target, 10_000), draw)


def training_pairs(df: DataFrame, max_pairs: int, strategy: str = "random", seed: int = 42, low: float = 0.3, high: float = 0.5) -> DataFrame:
    """place, id_1, id_2, label_1, label_2, target_similarity, token_jaccard, negative_strategy, is_duplicate: half of max_pairs same-label pairs (target: cosine01 of the
    vectors, 0 for a zero vector), the rest pairs of different labels (target 0), hard ones first and random ones, none twice, where those don't suffice. place: a shuffle by MD5. df: id, label, v, tokens."""
    if max_pairs <= 0:
        raise ValueError("max_pairs must be > 0")
    if strategy not in ("random", "hard"):
        raise ValueError(f"unknown strategy {strategy!r}")
    df = kept(df.select("id", "label", "v", "tokens"), "rows")
    slim = df.select("id", "label")
    rows = ordered(slim, "label")
    n_pos = max(1, max_pairs // 2)
    n_neg = max(1, max_pairs - n_pos)
    pos = positives(slim, n_pos, seed, rows=rows).drop("k").withColumn("negative_strategy", F.lit("positive"))
    hard = None
    if strategy == "hard":
        hard = kept(hard_negatives(df.select("id", "label", "tokens"), n_neg, low, high, seed, rows).drop("k", "token_jaccard"), "hard")
    missing = n_neg - (hard.count() if hard is not None else 0)
    parts = [pos] + ([hard.withColumn("negative_strategy", F.lit("hard"))] if hard is not None else [])
    if missing > 0:
        parts.append(negatives(slim, missing, seed, chosen=hard, rows=rows).drop("k").withColumn("negative_strategy", F.lit("random")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sets = df.select("id", T.content_tokens(F.col("tokens")).alias("tokens"))
    scored = with_jaccard(whole, sets).join(df.select(F.col("id").alias("id_1"), F.col("v").alias("_a")), "id_1").join(df.select(F.col("id").alias("id_2"), F.col("v").alias("_b")), "id_2")
    own = F.col("negative_strategy") == "positive"
    target = F.when(own, V.cosine01(F.col("_a"), F.col("_b"), 0.0)).otherwise(0.0)
    out = scored.select("id_1", "id_2", "label_1", "label_2", target.alias("target_similarity"), "token_jaccard", "negative_strategy", own.cast("int").alias("is_duplicate"))
    shuffled = with_positions(out.withColumn("_o", md5_order(f"{seed}|shuffle", "id_1", "id_2")), "_o", "id_1", "id_2", name="place").drop("_o")
    return shuffled.select("place", *out.columns)


def guided_pairs(df: DataFrame, max_pairs: int, seed: int = 42, bins: int = 10, least_bins: int = 8, draws: int = 500_000, rounds: int = 4) -> DataFrame:
    """id_1, id_2, label_1, label_2, true_sim, similarity_bin: pairs spread over bins of the Jaccard similarity of content tokens, ceil(max_pairs / bins) from each as far as found, then
    others up to max_pairs. Guides draw pairs where similar ones are likely: rows of equal token sets, of one label, with a common token; a fourth draws from all rows. A round gives each group of a
    guide at most four draws for each of its rows and a share of max_pairs. While bins are short, further rounds go only to guides that found pairs for those bins in the round before, twice
    as many each time. Fewer than least_bins bins with pairs: ValueError. df: id, label, tokens."""
    if max_pairs <= 0:
        raise ValueError("max_pairs must be > 0")
    own = kept(df.select("id", "label", T.content_tokens(F.col("tokens")).alias("tokens")), "sets")
    quota = -(-max_pairs // bins)
    keyed = {"set": own.withColumn("_k", F.concat_ws(" ", F.array_sort("tokens"))), "label": own.withColumn("_k", F.col("label").cast("string")), "token": own.withColumn("_k", F.explode("tokens")), "all": own.withColumn("_k", F.lit(""))}
    guides = {name: members(rows.select("_k", "id", "label"), "_k", 2) for name, rows in keyed.items()}
    sizes = {name: groups.count() for name, (_, groups) in guides.items()}
    cap = {"set": max(1000, max_pairs // 20), "label": max(5000, max_pairs // max(1, sizes["label"])), "token": max(1000, max_pairs // max(1, sizes["token"]))}

    def drawn(name: str, turn: int) -> DataFrame:
        rows, groups = guides[name]
        times = 0 if turn == 0 else (1 << turn) - 1  # draws of earlier rounds, in units of the first
        if name == "all":
            each = F.lit(max(8 * max_pairs, draws)).cast("bigint")
        else:
            each = F.least(F.lit(cap[name]).cast("bigint"), F.greatest(F.lit(1), F.col("n") * 4).cast("bigint"))
        numbered = groups.select("g", F.explode(F.sequence(each * times, each * (2 * times + 1) - 1)).alias("t")).select("g", F.concat_ws(":", "g", "t").alias("k"))
        # One group of many draws is one row here: its numbers are spread before anything is computed from them.
        spread = numbered.repartition(F.col("k"))
        return with_jaccard(_rows_of(within(groups, spread, seed, f"guide-{name}"), rows, False).drop("k").distinct(), own).withColumn("guide", F.lit(name))

    found, active = None, list(guides)
    for turn in range(rounds):
        new = None
        for name in active:
            new = drawn(name, turn) if new is None else new.unionByName(drawn(name, turn))
        new = kept(new.withColumn("similarity_bin", T.floor_bin(F.col("token_jaccard"), bins)), "candidates")
        both = new if found is None else found.unionByName(new)
        found = kept(both.dropDuplicates(["id_1", "id_2"]), "found")
        have = {r["similarity_bin"]: r["n"] for r in found.groupBy("similarity_bin").agg(F.count("*").alias("n")).collect()}  # a row for each bin
        short = [b for b in range(bins) if have.get(b, 0) < quota]
        useful = {r["guide"] for r in new.where(F.col("similarity_bin").isin(short)).select("guide").distinct().collect()} if short else set()
        active = [g for g in active if g in useful]
        if not active:
            break
    there = found.select("similarity_bin").distinct().count()
    if there < least_bins:
        raise ValueError(f"pairs in {there} bins, not in {least_bins}")
    chosen = stratified(found.withColumnRenamed("token_jaccard", "true_sim"), max_pairs, bins, seed)
    return chosen.select("id_1", "id_2", "label_1", "label_2", "true_sim", "similarity_bin")


def stratified_split(pairs: DataFrame, stratum: str, plot: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """pairs with part: of each stratum the share `plot` is 'plot', of the rest the share `validation` is 'validation', others 'train'; shares are exact to the row. Which rows is
    decided by their MD5, whose order statistics per stratum are the limits. A stratum that is null is one of its own."""
    order = F.conv(F.substring(md5_order(f"{seed}|split", "id_1", "id_2"), 1, 13), 16, 10).cast("double")
    placed = kept(pairs.withColumn("_o", order).withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))), "placed")
    sizes = {r["_s"]: r["n"] for r in placed.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # a row for each stratum
    cuts = {}
    for s, n in sizes.items():
        a = int(n * plot + 0.5)
        cuts[s] = (a, a + int((n - a) * validation + 0.5))
    ends = order_statistics(placed, {s: sorted({x - 1 for x in cut if x}) for s, cut in cuts.items()}, "_s", "_o")
    limits = placed.sparkSession.createDataFrame([(s, *(ends.get((s, x - 1), -1.0) for x in cut)) for s, cut in cuts.items()], "_s string, _a double, _b double")
    part = F.when(F.col("_o") <= F.col("_a"), "plot").when(F.col("_o") <= F.col("_b"), "validation").otherwise("train")
    return placed.join(F.broadcast(limits), "_s").select(*pairs.columns, part.alias("part"))
