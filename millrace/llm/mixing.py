"""Mixing sources to target weights, by Pareto order sampling.

Each document has an expected number of copies; its whole part is certain, its fractional part is sampled:
documents are ranked by random odds over inclusion odds and the lowest ranks are taken, up to the tokens
that the source still lacks; one last document is chosen for its size. The cut is found on a histogram of ranks, so no source is ever sorted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.session import cut


def source_key(column: Column | str) -> Column:
    """A source's name without letter case, blanks and joining signs, which have no meaning."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.regexp_replace(c, r"[\p{IsWhite_Space}\p{Pd}\p{Pc}./+&:]+", "")), F.lit(""))


#: The most rows of settings: they and one total for each are what is broadcast or seen by the driver.
MOST_SETTINGS = 100_000


@dataclass(frozen=True)
class Quota:
    mix: str
    source: str
    share: float
    repeats: int
    available: int
    wanted: float


def plan_quotas(targets: list[tuple[str, str, float, int, int]], total: int | None = None) -> list[Quota]:
    """Tokens wanted of each (mix, source, share, max_repeats, available tokens).

    Without ``total`` a mix is as large as its shares can be met exactly: no source with documents is asked
    for more than its repeats allow, and the share of sources without documents goes to the others in
    proportion. With ``total``, sources too small give all they may and the others fill up in proportion.
    """
    out: list[Quota] = []
    for mix in sorted({t[0] for t in targets}):
        rows = [t for t in targets if t[0] == mix]
        caps = {t[1]: t[4] * max(t[3], 0) for t in rows}
        live = {t[1]: t[2] for t in rows if caps[t[1]] > 0 and t[2] > 0}
        wanted = dict.fromkeys(caps, 0.0)
        if live and total is None:
            weight = sum(live.values())
            size = min(caps[s] * weight / share for s, share in live.items())
            wanted |= {s: min(caps[s], size * share / weight) for s, share in live.items()}
        left = float(total or 0)
        while live and left > 1e-9:
            weight = sum(live.values())
            short = [s for s, share in live.items() if caps[s] <= left * share / weight]
            if not short:
                wanted |= {s: left * share / weight for s, share in live.items()}
                break
            for s in short:
                wanted[s] = float(caps[s])
                left -= caps[s]
                del live[s]
        out += [Quota(mix, s, share, repeats, available, wanted[s]) for _, s, share, repeats, available in rows]
    return out


def _uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) fixed by ``seed`` and the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def sample_mix(
    documents: DataFrame, doc: str, source: str, size: str, targets: DataFrame, *, weight: str | None = None, total: int | None = None, seed: int = 1, buckets: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """The mixes' documents (mix_name, source, ``doc``, copies, n_tokens) and the report of shares.

    ``targets`` holds mix_name, source, target_share, max_repeats: a table of settings, one row per mix and
    source; it and one total per row are all the driver sees. ``weight`` names a column of relative expected
    copies (1 if not given). ``buckets`` is the resolution of the histogram of ranks; it decides no result.

    The report has (mix_name, source, target_share, max_repeats, available_tokens, wanted_tokens,
    mixed_tokens, actual_share, documents, most_copies), also for sources without documents.

    Defined cases: source names are compared by ``source_key``; null sources, ids, sizes and sizes below 1
    are left out; sources named twice in a mix add up their shares with the larger repeats; repeated rows of
    one id are one document; null or non-positive weights are never taken; an empty table gives a report of zeros.
    """
    t = (
        targets.select("mix_name", source_key("source").alias("source"), "target_share", "max_repeats")
        .filter(F.col("source").isNotNull() & F.col("mix_name").isNotNull())
        .groupBy("mix_name", "source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    )
    named = targets.select(source_key("source").alias("source"), F.col("source").alias("__name")).groupBy("source").agg(F.min("__name").alias("__name"))
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    docs = (
        documents.select(F.col(doc).alias("__doc"), source_key(source).alias("source"), F.col(size).cast("long").alias("__n"), w.alias("__w"))
        .filter(F.col("__doc").isNotNull() & F.col("source").isNotNull() & (F.col("__n") >= 1) & (F.col("__w") > 0))
        .groupBy("__doc")
        .agg(F.min_by(F.struct("source", "__n", "__w"), F.struct("source", "__n", "__w")).alias("d"))
        .select("__doc", "d.*")
    )
    docs = cut(docs)
    per_source = docs.groupBy("source").agg(F.sum("__n").alias("available"))
    if (n := t.limit(MOST_SETTINGS + 1).count()) > MOST_SETTINGS:
        raise ValueError(f"targets has over {n - 1} rows: it is a table of settings, which is broadcast")
    settings = t.join(per_source, "source", "left").select("mix_name", "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available")).collect()
    quotas = plan_quotas([(r[0], r[1], r[2], r[3], r[4]) for r in settings], total)
    quota = documents.sparkSession.createDataFrame(
        [(q.mix, q.source, q.share, q.repeats, q.available, float(q.wanted)) for q in quotas],
        "mix_name string, source string, target_share double, max_repeats int, available_tokens long, wanted_tokens double",
    )
    # Expected copies: proportional to the weight, no more than the repeats; the factor is found on the
    # weights' histogram so that the expected tokens are those wanted.
    asked = docs.join(F.broadcast(quota.filter("wanted_tokens > 0")), "source")  # one row per mix and source of the settings
    expected = asked.join(F.broadcast(_factors(asked, weight is None)), ["mix_name", "source"]).withColumn(
        "__e", F.least(F.col("__w") * F.col("__f"), F.col("max_repeats").cast("double"))
    )
    p = F.col("__e") - F.floor("__e")
    u = _uniform(seed, "mix_name", "__doc")
    near_one = 1 - 1e-9
    drawn = (
        expected.withColumn("__whole", F.floor(F.col("__e") + 1e-9).cast("int"))
        .withColumn("__p", F.when(p > near_one, 0.0).otherwise(F.greatest(p, F.lit(0.0))))
        # Pareto's rank, mapped to (0, 1) for the histogram: q / (1 + q).
        .withColumn("__odds", F.when(F.col("__p") > 1e-9, (u / (1 - u)) / (F.col("__p") / (1 - F.col("__p")))))
        .withColumn("__q", F.col("__odds") / (1 + F.col("__odds")))
        .withColumn("__b", F.least(F.floor(F.col("__q") * buckets), F.lit(buckets - 1)).cast("int"))
        .select("mix_name", "source", "__doc", "__n", "wanted_tokens", "__whole", "__q", "__b")
    )
    drawn = cut(drawn)
    group = ["mix_name", "source"]
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sure = drawn.groupBy(*group).agg((F.first("wanted_tokens") - F.sum(F.col("__whole") * F.col("__n"))).alias("__room"))
    bins = (
        drawn.filter("__b is not null")
        .groupBy(*group, "__b")
        .agg(F.sum("__n").alias("__t"))
        .join(sure, group)
        .withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0)))
        .select(*group, "__b", "__before", F.col("__room"), (F.col("__before") + F.col("__t") <= F.col("__room")).alias("__in"), (F.col("__before") < F.col("__room")).alias("__begun"))
    )
    sampled = drawn.filter("__b is not null").join(bins, [*group, "__b"], "left")
    # Only the bucket in which the tokens run out is ordered by itself.
    edge = sampled.filter(F.col("__begun") & ~F.col("__in"))
    upto = Window.partitionBy(*group, "__b").orderBy("__q", "__doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("__sum", F.col("__before") + F.sum("__n").over(upto))
    taken = edge.filter(F.col("__sum") <= F.col("__room"))
    extra = cut(sampled.filter("__in").select(*group, "__doc", "__n").unionByName(taken.select(*group, "__doc", "__n")))
    # One last document: of those left the one whose size comes nearest to the tokens still lacking.
    lacking = sure.join(extra.groupBy(*group).agg(F.sum("__n").alias("__got")), group, "left").select(*group, (F.col("__room") - F.coalesce("__got", F.lit(0))).alias("__lack")).filter("__lack > 0")
    left = drawn.filter("__b is not null").join(extra.select(*group, "__doc"), [*group, "__doc"], "left_anti").join(lacking, group).withColumn("__miss", F.abs(F.col("__n") - F.col("__lack")))
    last = left.filter("__miss < __lack").groupBy(*group).agg(F.min(F.struct("__miss", "__q", "__doc", "__n")).alias("l")).select(*group, "l.__doc", "l.__n")
    extra = extra.unionByName(last).select(*group, "__doc").withColumn("__x", F.lit(1))
    mixed = (
        drawn.join(extra, [*group, "__doc"], "left")
        .withColumn("copies", F.col("__whole") + F.coalesce("__x", F.lit(0)))
        .filter("copies > 0")
        .join(F.broadcast(named), "source")  # names of the settings
        .select("mix_name", F.col("__name").alias("source"), F.col("__doc").alias(doc), "copies", F.col("__n").alias("n_tokens"), F.col("source").alias("__key"))
    )
    got = mixed.groupBy("mix_name", F.col("__key").alias("source")).agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    report = (
        quota.join(got, group, "left")
        .join(named, "source")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        .withColumn("__all", F.sum("mixed_tokens").over(Window.partitionBy("mix_name")))
        .select(
            "mix_name",
            F.col("__name").alias("source"),
            "target_share",
            "max_repeats",
            "available_tokens",
            F.round("wanted_tokens").cast("long").alias("wanted_tokens"),
            "mixed_tokens",
            F.round(F.coalesce(F.try_divide("mixed_tokens", "__all"), F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return mixed.drop("__key"), report


def _factors(asked: DataFrame, uniform: bool, steps: int = 400) -> DataFrame:
    """(mix_name, source, __f): the factor by which weights become expected copies of the wanted tokens.

    With equal weights it is wanted over available. Otherwise the expected tokens are summed for ``steps``
    factors at once, in steps of under 4 %, and the factor between the two nearest is interpolated. For these
    sums weights are kept to 3 digits, and the steps reach a factor of about 2e6; where weights differ by more,
    the expected copies add up to less than is wanted and the draw by rank fills the rest.
    """
    group = ["mix_name", "source"]
    if uniform:
        return asked.groupBy(*group).agg((F.first("wanted_tokens") / F.sum("__n")).alias("__f"))
    base = asked.groupBy(*group).agg((F.first("wanted_tokens") / F.sum(F.col("__n") * F.col("__w"))).alias("__f0"))
    # Documents of equal (rounded) weight are one row here: weights are kept to 3 digits for this sum.
    digits = F.pow(F.lit(10.0), F.floor(F.log10("__w")) - 2)
    rows = asked.groupBy(*group, "wanted_tokens", "max_repeats", (F.round(F.col("__w") / digits) * digits).alias("__w")).agg(F.sum("__n").alias("__n"))
    grid = rows.join(F.broadcast(base), group).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("f", F.col("__f0") * F.pow(F.lit(1.0369), F.col("k")))
    sums = grid.groupBy(*group, "k", "f").agg(F.sum(F.least(F.col("__w") * F.col("f"), F.col("max_repeats").cast("double")) * F.col("__n")).alias("s"), F.first("wanted_tokens").alias("t"))
    low = sums.filter("s <= t * 1.000001").groupBy(*group).agg(F.max(F.struct("f", "s", "t")).alias("a"))
    high = sums.filter("s > t * 1.000001").groupBy(*group).agg(F.min(F.struct("f", "s", "t")).alias("b"))
    part = (F.col("a.t") - F.col("a.s")) / (F.col("b.s") - F.col("a.s"))
    return low.join(high, group, "left").select(*group, F.coalesce(F.col("a.f") + part * (F.col("b.f") - F.col("a.f")), F.col("a.f")).alias("__f"))
