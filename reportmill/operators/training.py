"""Training sets: alignment, trusted examples, contrastive negatives, dedup, novelty, grouped splits."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import clauses as C
from reportmill.functions import text as X
from reportmill.functions import vocabulary as V
from reportmill.operators import relational as R
from reportmill.operators.inspection import explicit_cue

#: Fragments that may have to be joined to give one clause.
MOST_FRAGMENTS = 6
ALIGNED = "array<struct<idx:int,raw:string,expected:string,observed:string,diagnostic:boolean,section:string,reason:string>>"


def _align(report) -> list[tuple]:
    """Raw text of each clause: the fewest neighbouring raw pieces whose normal form is the clause, in order."""
    if not isinstance(report, str):
        return []
    pieces = [p.strip() for p in C._BREAK.split(C.join_wraps(report)) if p.strip()]
    out, at = [], 0
    for i, clause in enumerate(C.segment(report)):
        found, seen = None, ""
        for size in range(1, MOST_FRAGMENTS + 1):
            raw = " ".join(pieces[at : at + size])
            plain = C.normalize_text(raw).strip(" -\t")
            seen = seen or plain
            if plain == clause.text:
                found = raw
                break
            if at + size >= len(pieces):
                break
        out.append((i, found, clause.text, seen, clause.diagnostic, clause.section, None if found is not None else "no_exact_span"))
        at += size if found is not None else 1
    return out


def surface_clauses(reports: DataFrame) -> DataFrame:
    """(study, idx, raw, expected, observed, diagnostic, section, reason): reason is null where aligned."""
    rows = F.pandas_udf(lambda s: pd.Series([_align(x) for x in s], dtype=object), ALIGNED)(F.col("report"))
    return reports.select("study", F.inline(rows))


def trusted(evidence: DataFrame, detectors: tuple[str, ...] = ("v3_target", "v3_morphology", "v2_exact")) -> DataFrame:
    """Evidence good enough to teach: resolved, strict views only, not collective, trusted detectors, one source clause."""
    return evidence.where(
        F.col("status").isin("positive", "negative", "uncertain") & ~F.col("collective") & (F.size("detectors") > 0) & F.forall("detectors", lambda d: d.isin(*detectors))
        & F.array_contains("view_kinds", "strict") & (F.size("source_indices") == 1) & ~F.coalesce(F.col("rationale").contains("conflict"), F.lit(False)) & F.col("official_label").isNull()
    )


def candidates(evidence: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per trusted evidence and source clause; ``failure`` says why a row cannot be used."""
    rows = trusted(evidence).withColumn("idx", F.explode("source_indices"))
    joined = rows.join(aligned.select("study", "idx", "raw", F.col("expected").alias("normalized_clause"), "diagnostic", "reason"), ["study", "idx"], "left")
    failure = F.when(F.col("diagnostic").isNull(), "missing_clause").when(~F.col("diagnostic"), "non_diagnostic_clause").when(F.col("reason").isNotNull(), F.col("reason"))
    return joined.withColumn("failure", failure)


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per local unit with merged support and the best confidence."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("detectors")))).alias("detectors"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_merged"))


def training_dedup(rows: DataFrame, target: str, text: str, label: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(one row per (target, text), rows of keys with several labels); counts of rows and studies are kept."""
    keys = rows.groupBy(target, text).agg(F.count_distinct(label).alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    joined = rows.join(keys, [target, text])
    clean = R.first_per_group(joined.where("n_labels = 1"), [target, text], F.col(order))
    return clean, joined.where("n_labels > 1")


def novelty(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Adds how often the training rows hold a test row's key, and whether it is new to them."""
    seen = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_matches"))
    return test.join(seen, keys, "left").withColumn("train_matches", F.coalesce("train_matches", F.lit(0))).withColumn("is_novel", F.col("train_matches") == 0)


def guard_keys(found: DataFrame) -> DataFrame:
    """(study, idx, target): clauses in which any detector mentions a target. Propositions cite the clauses of their mentions."""
    return found.select("study", F.explode("source_indices").alias("idx"), "target").distinct()


def safe_targets(usable: DataFrame, guards: DataFrame) -> DataFrame:
    """(study, idx, normalized_clause, clause, safe_targets) of each clause with a trusted label: targets that are not labelled, mentioned or named there."""
    clauses = usable.groupBy("study", "idx", "normalized_clause").agg(F.first("raw").alias("clause"), F.collect_set("target").alias("labelled"))
    held = guards.groupBy("study", "idx").agg(F.collect_set("target").alias("mentioned"))
    cues = F.array(*[F.when(explicit_cue(t, F.col("normalized_clause")), F.lit(t)) for t in V.TARGETS])
    taken = F.concat("labelled", F.coalesce("mentioned", F.array().cast("array<string>")), F.array_compact(cues))
    rows = clauses.join(held, ["study", "idx"], "left")
    return rows.select("study", "idx", "normalized_clause", "clause", F.array_except(F.array(*map(F.lit, V.TARGETS)), taken).alias("safe_targets"))


def contrastive(safe: DataFrame, seed: int, parts: int = 1) -> DataFrame:
    """(study, idx, clause, target, label): for each clause the least used of its safe targets so far, in hash order.

    With one part the counters are global and sequential, as the rule defines them, and rows stream through one Python
    task. With more, clauses are dealt by their hash and every part balances its own; targets are then used evenly up to
    one a part, whatever the size. Ties go by a hash of clause and target.
    """
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("study").cast("string"), F.col("idx").cast("string"), "normalized_clause"), 256)
    ordered = safe.withColumn("order_hash", order).repartition(parts, "order_hash").sortWithinPartitions("order_hash")
    tie = lambda *key: hashlib.sha256("|".join(map(str, (seed, *key))).encode()).hexdigest()

    def choose(it):
        used: dict[str, int] = defaultdict(int)
        for pdf in it:
            picked = []
            for study, idx, options in zip(pdf["study"], pdf["idx"], pdf["safe_targets"], strict=True):
                best = min(options, key=lambda t: (used[t], tie(study, idx, t)), default=None)
                if best is not None:
                    used[best] += 1
                picked.append(best)
            yield pdf[["study", "idx", "clause"]].assign(target=picked, label="no_evidence")

    kind = lambda c: safe.schema[c].dataType.simpleString()
    return ordered.mapInPandas(choose, f"study {kind('study')}, idx {kind('idx')}, clause string, target string, label string")


# --- grouped splits

SPLITS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def check_ratios(ratios: dict[str, float]) -> None:
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must be positive and sum to 1")


def split_groups(studies: DataFrame, key: str, family: str) -> DataFrame:
    """Adds the indivisible group of a study: its family where that has several members, else itself."""
    size = F.count(F.lit(1)).over(Window.partitionBy(family))
    return studies.withColumn("split_group", F.when(size > 1, F.concat(F.lit("template:"), F.col(family))).otherwise(F.concat(F.lit("study:"), F.col(key).cast("string"))))


def group_features(grouped: DataFrame, features: list[str]) -> DataFrame:
    """(split_group, feature, n): studies of the group and values of its features."""
    items = F.array(F.lit("__studies__"), *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in features])
    return grouped.select("split_group", F.explode(items).alias("feature")).groupBy("split_group", "feature").agg(F.count(F.lit(1)).alias("n"))


def rarity_order(counts: DataFrame, seed: int) -> DataFrame:
    """Groups by how much of the corpus's features they hold, then size, then hash."""
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    rows = counts.join(totals, "feature").groupBy("split_group").agg(
        F.sum(F.when(F.col("feature") != "__studies__", F.col("n") / F.col("total"))).alias("rarity"), F.sum(F.when(F.col("feature") == "__studies__", F.col("n"))).alias("studies")
    )
    return rows.withColumn("order_hash", R.hash_order(F.col("split_group"), seed))


def place_groups(
    groups: list[tuple[str, dict[str, int]]], ratios: dict[str, float], moves: int = 200, totals: dict[str, int] | None = None, held: dict[str, dict[str, int]] | None = None
) -> dict[str, str]:
    """Greedy placement: each group goes where the squared normalized deviation from the targets grows least.

    ``totals`` and ``held`` (features by split) count what is placed already besides these groups. Then at most ``moves`` groups, taken in the same order, change their split where that lowers the total,
    and a split that got nothing takes the smallest group of the fullest one.
    """
    check_ratios(ratios)
    if totals is None:
        totals = defaultdict(int)
        for _, features in groups:
            for f, n in features.items():
                totals[f] += n
    held = {s: defaultdict(int) for s in ratios} if held is None else held
    weight = lambda f: 4.0 if f == "__studies__" else 1.0

    def cost(split: str, f: str, n: int) -> float:
        want = totals[f] * ratios[split]
        off = (n - want) / max(1.0, want)
        return weight(f) * (off * off + (0.05 * off if off > 0 else 0.0))

    out = {}
    for name, features in groups:
        rise = lambda s: sum(cost(s, f, held[s][f] + n) - cost(s, f, held[s][f]) for f, n in features.items())  # noqa: E731, B023
        best = min(ratios, key=lambda s: (rise(s), hashlib.sha256(f"{name}:{s}".encode()).hexdigest()))
        out[name] = best
        for f, n in features.items():
            held[best][f] += n

    def move(name: str, features: dict[str, int], to: str) -> None:
        for f, n in features.items():
            held[out[name]][f] -= n
            held[to][f] += n
        out[name] = to

    left = moves
    for name, features in groups:
        now = out[name]
        falls = sum(cost(now, f, held[now][f]) - cost(now, f, held[now][f] - n) for f, n in features.items())
        grow = {s: sum(cost(s, f, held[s][f] + n) - cost(s, f, held[s][f]) for f, n in features.items()) for s in ratios if s != now}
        best = min(grow, key=lambda s: (grow[s], s), default=None)
        if left and best is not None and grow[best] < falls - 1e-15:
            move(name, features, best)
            left -= 1
    for empty in [s for s in ratios if s not in out.values() and not held[s].get("__studies__")]:
        fullest = max(ratios, key=lambda s: (sum(x == s for x in out.values()), s))
        mine = [(f.get("__studies__", 0), n, f) for n, f in groups if out[n] == fullest]
        if len(mine) > 1:
            _, name, features = min(mine, key=lambda x: x[:2])
            move(name, features, empty)
    return out


def assign_splits(studies: DataFrame, key: str, family: str, features: list[str], seed: int = 20260818, ratios: dict[str, float] | None = None) -> DataFrame:
    """Adds ``split_group`` and ``split``; a family never spans two splits. One rule for every size.

    Groups with equal features are interchangeable, so they are placed by class: of the m groups of a class every split
    gets the whole part of m times its ratio, in hash order, and the fewer than three that are left over are placed one
    by one by the greedy objective, given all that is placed already. Only classes (feature vectors, not groups) and
    left-over groups reach the driver.
    """
    ratios = ratios or SPLITS
    check_ratios(ratios)
    spark = studies.sparkSession
    grouped = split_groups(studies, key, family)
    counts = group_features(grouped, features)
    groups = counts.groupBy("split_group").agg(F.array_sort(F.collect_list(F.struct("feature", "n"))).alias("f"))
    groups = groups.select("split_group", "f", F.sha2(F.to_json("f"), 256).alias("class"), R.hash_order(F.col("split_group"), seed).alias("order_hash"))
    groups = groups.withColumn("bucket", F.substring("order_hash", 1, 3))  # a class is ranked by 4,096 buckets and inside them
    sizes = groups.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.first("f").alias("f"))
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("order_hash", "split_group")) - 1
    ranked = groups.drop("f").withColumn("at", inside).join(before, ["class", "bucket"]).join(classes, "class").withColumn("rank", F.col("before") + F.col("at"))
    bulk, edge = F.lit(None).cast("string"), F.lit(0)
    for s, r in ratios.items():
        share = F.floor(F.col("m") * r + 1e-9)
        bulk = bulk if s is None else F.coalesce(bulk, F.when(F.col("rank") < edge + share, F.lit(s)))
        edge = edge + share
    ranked = ranked.withColumn("bulk", bulk)
    left = ranked.where("bulk IS NULL").select("split_group", "order_hash", "f").collect()  # fewer than one a split and class
    known = classes.select("m", "f").collect()
    totals: dict[str, int] = defaultdict(int)
    held: dict[str, dict[str, int]] = {s: defaultdict(int) for s in ratios}
    for c in known:
        for feature, n in c["f"]:
            totals[feature] += n * c["m"]
            for s, r in ratios.items():
                held[s][feature] += n * math.floor(c["m"] * r + 1e-9)
    rarity = lambda f: sum(n / totals[x] for x, n in f if x != "__studies__")
    rest = [(x["split_group"], x["order_hash"], [(i["feature"], i["n"]) for i in x["f"]]) for x in left]
    rest.sort(key=lambda x: (-rarity(x[2]), -dict(x[2])["__studies__"], x[1]))
    placed = place_groups([(g, dict(f)) for g, _, f in rest], ratios, totals=totals, held=held)
    table = spark.createDataFrame(list(placed.items()) or [("", next(iter(ratios)))], "split_group string, placed string")
    of_group = ranked.select("split_group", "bulk").join(table, "split_group", "left").select("split_group", F.coalesce("bulk", "placed").alias("split"))
    return grouped.join(of_group, "split_group", "left")


def leaks(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """(check, violations): values of each column that appear in several splits."""
    one = lambda c: assigned.groupBy(c).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("violations")).select(F.lit(c).alias("check"), "violations")
    out = one(columns[0])
    for c in columns[1:]:
        out = out.unionByName(one(c))
    return out


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    return X.let(F.transform(logits, lambda x: F.exp(x - F.array_max(logits))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
