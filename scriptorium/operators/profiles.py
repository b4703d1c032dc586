"""Writing profiles: matching contexts and samples to profiles, scores, aggregates, registry upserts.

A table of up to MAX_PROFILES is broadcast, a larger one joined as any table. Where every
row is compared with every profile, the profiles come as arrays of TILE and the best of an
array is found within the row, so rows are not multiplied by profiles. Null scores count as 5, null contraction habits as true, null texts as ''.
Ties go by profile id.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import cut, ship

MAX_PROFILES = 10_000
TILE = 1000
MAX_COMBINATIONS = 20_000
SCORES = ["formality", "warmth", "authority", "directness"]
# Word groups of greetings and closings, words of formal and casual contexts.
GREETING_GROUPS = [["hi", "hey", "hello"], ["dear"], ["thanks", "thank you"], ["good morning", "good afternoon", "good evening"]]
CLOSING_GROUPS = [["best", "best regards", "kind regards"], ["thanks", "thank you"], ["cheers"], ["regards", "warm regards"]]
OPENER_GROUPS = [["hey", "hi"], ["team", "everyone", "all"], ["dear"], ["[name]", "firstname"]]
FORMAL_SUBJECT = ["meeting", "review", "report", "update", "board"]
FORMAL_SENDER = ["ceo", "chief", "director", "vp", "president"]
CASUAL_SUBJECT = ["hey", "quick", "fyi", "lunch", "drinks"]


def few(profiles: DataFrame) -> DataFrame:
    """The profiles, broadcast where they are few."""
    return F.broadcast(profiles) if profiles.limit(MAX_PROFILES + 1).count() <= MAX_PROFILES else profiles


def with_best(rows: DataFrame, id_col: str, profiles: DataFrame, score: Callable[[Column], Column], tile: int = TILE) -> DataFrame:
    """Adds best (score, persona_id): the profile with the greatest score, the first id of equal ones; null without profiles.

    `score` is of a profile as a struct. Only where there is more than one tile, ids are grouped.
    """
    tiles = max(1, math.ceil(profiles.count() / tile))
    held = profiles.groupBy(F.pmod(F.xxhash64("persona_id"), F.lit(tiles)).alias("_t")).agg(F.collect_list(F.struct(*profiles.columns)).alias("_profiles")).select("_profiles")
    held = F.broadcast(held) if tiles * tile <= MAX_PROFILES else held
    scored = F.transform("_profiles", lambda p: F.struct((-score(p)).alias("s"), p["persona_id"].alias("id")))
    out = rows.join(held, F.lit(True), "left").withColumn("_best", F.array_min(scored)).drop("_profiles")
    if tiles > 1:
        kept = [c for c in rows.columns if c != id_col]
        out = out.groupBy(id_col).agg(F.min(F.struct("_best", *kept)).alias("_m")).select(id_col, *(F.col(f"_m.{c}").alias(c) for c in kept), F.col("_m._best").alias("_best"))
    return out.withColumn("best", F.struct((-F.col("_best.s")).alias("score"), F.col("_best.id").alias("persona_id"))).drop("_best")


def _has(text: Column, words: list[str]) -> Column:
    return F.array_max(F.array(*(text.contains(w) for w in words)))


def same_group(a: Column, b: Column, groups: list[list[str]]) -> Column:
    """Whether both texts hold a word of one group."""
    out = F.lit(False)
    for words in groups:
        out = out | (_has(a, words) & _has(b, words))
    return out


def flat(personas: DataFrame) -> DataFrame:
    """Profile columns with defaults, from personas with a struct of characteristics."""
    c = lambda name: F.col(f"characteristics.{name}")
    return personas.select(
        "persona_id", F.lower(F.coalesce("description", F.lit(""))).alias("description"), *(F.coalesce(c(s), F.lit(5)).alias(s) for s in SCORES),
        F.lower(F.coalesce(c("typical_greeting"), F.lit(""))).alias("typical_greeting"), F.lower(F.coalesce(c("typical_closing"), F.lit(""))).alias("typical_closing"),
        F.coalesce(c("uses_contractions"), F.lit(True)).alias("p_contractions"),
    )


def infer(pairs: DataFrame, personas: DataFrame) -> DataFrame:
    """Adds to each pair (id, subject, quoted, sender) the profile whose words and formality fit best.

    Of equal scores the first profile counts; without any, it is taken with 0.3.
    """
    words = F.filter(F.split("description", r"\s+", -1), lambda w: F.length(w) > 4)
    p = flat(personas).select("persona_id", "formality", words.alias("words"))
    s = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "quoted", "sender")}
    rows = pairs.select("*", *(v.alias(f"_{k}") for k, v in s.items()))
    rows = rows.withColumn("_formal", F.when(_has(F.col("_subject"), FORMAL_SUBJECT), 0.3).otherwise(0.0) + F.when(_has(F.col("_sender"), FORMAL_SENDER), 0.3).otherwise(0.0))
    rows = rows.withColumn("_casual", F.when(_has(F.col("_subject"), CASUAL_SUBJECT), 0.3).otherwise(0.0))

    def fit(p: Column) -> Column:
        hits = F.size(F.filter(p["words"], lambda w: F.col("_subject").contains(w) | F.col("_quoted").contains(w) | F.col("_sender").contains(w)))
        return F.round(hits * 0.2 + F.when(p["formality"] >= 7, F.col("_formal")).when(p["formality"] <= 4, F.col("_casual")).otherwise(0.0), 6)

    out = with_best(rows, "id", p, fit)
    best = F.col("best.score")
    return out.select(*pairs.columns, F.col("best.persona_id").alias("inferred_persona"), F.when(best > 0, F.least(best, F.lit(1.0))).otherwise(0.3).alias("confidence"))


def score(pairs: DataFrame, personas: DataFrame) -> DataFrame:
    """Adds the five scores of each pair (tone_hints, greeting, closing, has_contractions) against its profile and their mean."""
    rows = pairs.join(few(flat(personas).withColumnRenamed("persona_id", "inferred_persona")), "inferred_persona")
    hints = F.coalesce("tone_hints", F.array().cast("array<string>"))
    high = lambda c: F.when(F.col(c) >= 6, 1.0).when(F.col(c) >= 4, 0.5).otherwise(0.2)
    low = F.when(F.col("formality") <= 4, 1.0).when(F.col("formality") <= 6, 0.5).otherwise(0.2)
    uses = F.coalesce("has_contractions", F.lit(False))
    g, c = F.lower(F.coalesce("greeting", F.lit(""))), F.lower(F.coalesce("closing", F.lit("")))
    fits = lambda a, b, groups: F.when((a == "") | (F.col(b) == ""), 0.7).when(same_group(a, F.col(b), groups), 1.0).otherwise(0.5)
    scored = rows.select(
        *pairs.columns,
        F.when(F.array_contains(hints, "formal"), high("formality")).when(F.array_contains(hints, "casual"), low).otherwise(0.7).alias("formality_score"),
        F.when(uses == F.col("p_contractions"), 1.0).when(uses, 0.3).otherwise(0.5).alias("contractions_score"),
        F.when(F.array_contains(hints, "warm"), high("warmth")).otherwise(0.7).alias("warmth_score"),
        fits(g, "typical_greeting", GREETING_GROUPS).alias("greeting_score"),
        fits(c, "typical_closing", CLOSING_GROUPS).alias("closing_score"),
    )
    five = ["formality_score", "contractions_score", "warmth_score", "greeting_score", "closing_score"]
    return scored.withColumn("composite", F.round(sum((F.col(x) for x in five), F.lit(0.0)) / 5, 6))


def report(scored: DataFrame) -> DataFrame:
    """Per profile the pairs, the mean of each score in per cent and whether it needs refining."""
    pct = lambda c: F.round(F.avg(c) * 100, 2).alias(c)
    five = ["formality_score", "contractions_score", "warmth_score", "greeting_score", "closing_score", "composite"]
    rows = scored.groupBy("inferred_persona").agg(F.count("*").alias("pairs"), *(pct(c) for c in five))
    return rows.withColumn("needs_refinement", F.col("composite") < 60)


def mismatches(scored: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs with the lowest mean and their two weakest scores: a report, so its limit is meant."""
    five = ["formality_score", "contractions_score", "warmth_score", "greeting_score", "closing_score"]
    ordered = F.array_sort(F.array(*(F.struct(F.col(c).alias("s"), F.lit(c).alias("c")) for c in five)))
    return scored.orderBy("composite", "id").limit(n).select("id", "composite", F.get(ordered, F.lit(0))["c"].alias("weakest"), F.get(ordered, F.lit(1))["c"].alias("second"))


def schema_checks(personas: DataFrame) -> DataFrame:
    """(persona_id, valid, errors, warnings): missing or out-of-range scores, no description, all scores equal."""
    c = lambda name: F.col(f"characteristics.{name}")
    errors = F.array_compact(F.array(
        F.when(F.coalesce("description", F.lit("")) == "", F.lit("no description")), F.when(F.col("characteristics").isNull(), F.lit("no characteristics")),
        *(F.when(F.col("characteristics").isNotNull() & c(s).isNull(), F.lit(f"no {s}")) for s in SCORES),
        *(F.when(~c(s).between(1, 10), F.lit(f"{s} out of range")) for s in SCORES),
    ))
    scores = F.array(*(c(s) for s in SCORES))
    equal = F.forall(scores, lambda x: x.isNotNull()) & (F.array_min(scores) == F.array_max(scores))
    return personas.select("persona_id", (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), F.when(equal, "all scores equal").otherwise("").alias("warnings"))


# Samples and profiles.


def match(sample: dict[str, Column], profile: dict[str, Column]) -> Column:
    """Weighted likeness of a sample and a profile over what both have.

    Tone .25, formality .2, greeting .15, closing .15, hook .15, sentence length .1, contractions .1.
    """
    levels = F.array(*(F.lit(x) for x in ("casual", "casual-professional", "semi-formal", "formal")))
    both = lambda k: F.coalesce((sample[k] != "") & (profile[k] != ""), F.lit(False))
    tones = F.coalesce((F.size(sample["tone"]) > 0) & (F.size(profile["tone"]) > 0), F.lit(False))
    tone = F.size(F.array_intersect(sample["tone"], profile["tone"])) / F.greatest(F.size(F.array_union(sample["tone"], profile["tone"])), F.lit(1))
    at = lambda x: F.array_position(levels, x)
    known = both("formality") & (at(sample["formality"]) > 0) & (at(profile["formality"]) > 0)
    near = 1 - F.abs(at(sample["formality"]) - at(profile["formality"])) / 3
    similar = lambda k: (F.lower(sample[k]) == F.lower(profile[k])) | same_group(F.lower(sample[k]), F.lower(profile[k]), OPENER_GROUPS)
    parts = [
        (tones, 0.25, tone), (known, 0.2, near), (both("greeting"), 0.15, similar("greeting").cast("double")), (both("closing"), 0.15, similar("closing").cast("double")),
        *((both(k), w, (sample[k] == profile[k]).cast("double")) for k, w in (("contractions", 0.1), ("sentence", 0.1), ("hook", 0.15)) if k in sample and k in profile),
    ]
    total = sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w, _ in parts), F.lit(0.0))
    score_ = sum((F.when(c, v * w).otherwise(0.0) for c, w, v in parts), F.lit(0.0))
    return F.round(F.when(total > 0, score_ / total).otherwise(0.0), 6)


TRAITS = ["tone", "formality", "greeting", "closing", "contractions", "sentence", "hook"]


def assign(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, persona_id, score, status): each sample's best profile: assigned from 0.7, flagged from 0.4, else unassigned.

    Both frames have the TRAITS: tone (array) and texts; sentence and hook may lack.
    """
    names = [n for n in TRAITS if n in samples.columns and n in profiles.columns]
    best = with_best(samples.select("id", *names), "id", profiles.select("persona_id", *names), lambda p: match({n: F.col(n) for n in names}, {n: p[n] for n in names}))
    score_ = F.coalesce("best.score", F.lit(0.0))
    status = F.when(score_ >= 0.7, "assigned").when(score_ >= 0.4, "flagged").otherwise("unassigned")
    return best.select("id", F.when(score_ >= 0.4, F.col("best.persona_id")).alias("persona_id"), score_.alias("score"), status.alias("status"))


def likeness(a: dict, b: dict) -> float:
    """Mean of what can be compared of two samples: shared tones, equal formality, like greetings; 0 without any."""
    checks = []
    if a["tone"] and b["tone"]:
        checks.append(len(a["tone"] & b["tone"]) / len(a["tone"] | b["tone"]))
    if a["formality"] and b["formality"]:
        checks.append(float(a["formality"] == b["formality"]))
    if a["greeting"] and b["greeting"]:
        x, y = a["greeting"].lower(), b["greeting"].lower()
        checks.append(float(x == y or any(any(w in x for w in g) and any(w in y for w in g) for g in OPENER_GROUPS)))
    return sum(checks) / len(checks) if checks else 0.0


def leaders(samples: DataFrame, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """(id, leader, size, kept): samples grouped by the first of them, by id, that they are like; kept from `least` on.

    Likeness follows from tones, formality and greeting alone, so samples are first grouped
    by these; the driver orders only the combinations that occur, up to MAX_COMBINATIONS.
    """
    key = [F.array_sort(F.array_distinct(F.coalesce("tone", F.array().cast("array<string>")))).alias("tone"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("formality", "greeting"))]
    rows = samples.select("id", *key)
    found = rows.groupBy("tone", "formality", "greeting").agg(F.min("id").alias("first")).orderBy("first").limit(MAX_COMBINATIONS + 1).collect()
    if len(found) > MAX_COMBINATIONS:
        raise ValueError(f"more than {MAX_COMBINATIONS} combinations of traits: greetings are to be labels")
    combos = [{"tone": set(r.tone), "formality": r.formality, "greeting": r.greeting, "row": r} for r in found]
    free, out = [True] * len(combos), []
    for i, c in enumerate(combos):
        if not free[i] or not likeness(c, c):  # taken, or nothing to compare: then each of them stays alone
            continue
        for k in range(i, len(combos)):
            if free[k] and likeness(c, combos[k]) >= threshold:
                free[k] = False
                out.append((sorted(combos[k]["tone"]), combos[k]["formality"], combos[k]["greeting"], c["row"].first))
    table = samples.sparkSession.createDataFrame(out, "tone array<string>, formality string, greeting string, leader string")
    led = rows.join(F.broadcast(table), ["tone", "formality", "greeting"], "left").select("id", F.coalesce("leader", F.col("id").cast("string")).alias("leader"))
    sizes = led.groupBy("leader").agg(F.count("*").alias("size"))
    return led.join(sizes, "leader").select("id", "leader", "size", (F.col("size") >= least).alias("kept"))


def traits(samples: DataFrame, group: str) -> DataFrame:
    """Per group the tones of half its samples or more, the commonest formality and contractions, greeting and closing of 0.3 or more.

    Where samples have them, also the commonest sentence length and the phrases of three samples or more.
    """
    more = [c for c in ("sentence",) if c in samples.columns]
    n = samples.groupBy(group).agg(F.count("*").alias("n"))
    tones = samples.select(group, F.explode(F.array_distinct("tone")).alias("t")).groupBy(group, "t").count().join(n, group).where("count >= 0.5 * n")
    tones = tones.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tone"))
    long = samples.unpivot([group], ["formality", "greeting", "closing", "contractions", *more], "k", "v").where("coalesce(v, '') <> ''")
    counts = long.groupBy(group, "k", "v").count()
    modes = counts.groupBy(group, "k").agg(F.max("count").alias("c"), F.min_by("v", F.struct(-F.col("count"), "v")).alias("v"))
    pick = lambda k, least: F.max(F.when((F.col("k") == k) & (F.col("c") >= least * F.col("n")), F.col("v")))
    best = modes.join(n, group).groupBy(group).agg(
        pick("formality", 0.0).alias("formality"), pick("contractions", 0.0).alias("contractions"), pick("greeting", 0.3).alias("greeting"), pick("closing", 0.3).alias("closing"),
        *(pick(c, 0.0).alias(c) for c in more),
    )
    if "phrases" in samples.columns:
        said = samples.select(group, F.explode(F.array_distinct("phrases")).alias("p")).groupBy(group, "p").count().where("count >= 3")
        best = best.join(said.groupBy(group).agg(F.array_sort(F.collect_set("p")).alias("phrases")), group, "left")
    return n.join(best, group, "left").join(tones, group, "left").withColumn("tone", F.coalesce("tone", F.lit("")))


def rules(found: DataFrame) -> DataFrame:
    """(group..., rule): what to keep to, one row a rule, from traits()."""
    made = F.array_compact(F.array(
        F.when(F.col("greeting").isNotNull(), F.concat(F.lit("Open with: "), F.col("greeting"))), F.when(F.col("closing").isNotNull(), F.concat(F.lit("Sign off with: "), F.col("closing"))),
        F.when(F.col("tone") != "", F.concat(F.lit("Maintain "), F.replace(F.col("tone"), F.lit(","), F.lit(", ")), F.lit(" tone"))), F.when(F.col("formality").isNotNull(), F.concat(F.lit("Keep "), F.col("formality"), F.lit(" register"))),
        F.when(F.col("contractions") == "frequent", F.lit("Use contractions freely")).when(F.col("contractions") == "rare", F.lit("Avoid contractions")),
    ))
    return found.select(found.columns[0], F.explode(made).alias("rule"))


def name_ratio(a: Column, b: Column) -> Column:
    """The share of characters in matching blocks of two lower-cased names; a matching no built-in expresses."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, (p or "").lower(), (q or "").lower()).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def merge(personas: DataFrame, into: dict[str, str] | DataFrame) -> DataFrame:
    """Profiles with merged ones folded into others (`into` has persona_id, target): scores are means rounded half to even, the first name stays.

    A target that is itself merged is followed by no step; give final targets.
    """
    if isinstance(into, dict):
        into = personas.sparkSession.createDataFrame(list(into.items()), "persona_id string, target string")
    rows = personas.join(few(into), "persona_id", "left").withColumn("_t", F.coalesce("target", "persona_id"))
    return rows.groupBy(F.col("_t").alias("persona_id")).agg(
        F.min_by("persona_name", F.struct(F.when(F.col("persona_id") == F.col("_t"), 0).otherwise(1), F.col("persona_id"))).alias("persona_name"),
        *(F.bround(F.avg(f"characteristics.{s}"), 0).cast("int").alias(s) for s in SCORES), F.count("*").alias("merged"),
    )


def renamed(samples: DataFrame, into: DataFrame) -> DataFrame:
    """Samples (persona) under the name that their profile was merged into (`into` has old, new)."""
    return samples.join(few(into.select(F.col("old").alias("persona"), "new")), "persona", "left").withColumn("persona", F.coalesce("new", "persona")).drop("new")


# Registry.


def upsert(registry: DataFrame, batch: DataFrame, samples: DataFrame) -> DataFrame:
    """The registry (name, description, created, updated) with a batch of the same names written over it.

    `created` stays, the rest comes from the batch; sample counts are counted anew from the
    samples, so a batch taken in twice changes nothing.
    """
    old = registry.select("name", F.col("description").alias("od"), F.col("created").alias("oc"), F.col("updated").alias("ou"))
    new = batch.groupBy("name").agg(F.max(F.struct("updated", "description")).alias("s")).select("name", F.col("s.description").alias("nd"), F.col("s.updated").alias("nu"))
    counts = samples.where("persona is not null").groupBy(F.col("persona").alias("name")).agg(F.countDistinct("id").alias("n"))
    out = old.join(new, "name", "full_outer").join(counts, "name", "left")
    return out.select(
        "name", F.coalesce("nd", "od").alias("description"), F.coalesce("oc", "nu").alias("created"), F.greatest("nu", "ou").alias("updated"), F.coalesce("n", F.lit(0)).alias("sample_count")
    )


def new_samples(samples: DataFrame, known: DataFrame) -> DataFrame:
    """(source, content_hash, seq): samples whose hash is new, once each, numbered within their spread-out source."""
    clean = samples.where("content_hash is not null").select(F.lower(F.trim("source")).alias("source"), F.lower("content_hash").alias("content_hash"))
    fresh = clean.groupBy("content_hash").agg(F.min("source").alias("source")).join(known.select(F.lower("content_hash").alias("content_hash")).distinct(), "content_hash", "left_anti")
    return numbered_within(fresh.select("source", "content_hash"), "source", "content_hash", "seq")


def numbered_within(df: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """Adds the number of each row within its group, in the order of a column without ties in the group.

    A group of any share of the rows is numbered in ranges: the rows are dealt to ranges of
    (group, by) and each range's rows of a group follow those of the ranges before.
    """
    dealt = cut(df.repartitionByRange(group, by).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p", group).orderBy(by))
    joined = dealt.withColumn("_k", own).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.select(*df.columns, (F.col("_b") + F.col("_k")).cast("int").alias(name))


def suggestions(scored: DataFrame, personas: DataFrame, least: float = 0.6) -> DataFrame:
    """(persona_id, type, current, suggestion): what to change in profiles whose mean of a score is below `least`.

    `scored` is score() of pairs with tone_hints, greeting and closing. Equal counts of
    greetings or closings go by the text.
    """
    rows = scored.withColumn("_h", F.coalesce("tone_hints", F.array().cast("array<string>")))
    has = lambda h: F.count_if(F.array_contains("_h", h))
    sums = rows.groupBy("inferred_persona").agg(
        F.count("*").alias("n"), F.avg("formality_score").alias("f"), F.avg("contractions_score").alias("c"), F.avg("greeting_score").alias("g"), F.avg("closing_score").alias("e"),
        has("formal").alias("formal"), has("casual").alias("casual"), has("uses_contractions").alias("short"),
    )
    long = rows.unpivot(["inferred_persona"], ["greeting", "closing"], "k", "v").where("coalesce(v, '') <> ''").groupBy("inferred_persona", "k", "v").count()
    modes = long.groupBy("inferred_persona").pivot("k", ["greeting", "closing"]).agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))))
    c = lambda name: F.col(f"characteristics.{name}").cast("string")
    known = few(personas.select(F.col("persona_id").alias("inferred_persona"), *(c(n).alias(f"_{n}") for n in ("formality", "uses_contractions", "typical_greeting", "typical_closing"))))
    rows = sums.join(modes, "inferred_persona", "left").join(known, "inferred_persona", "left")
    one = lambda kind, current, default, text: F.struct(F.lit(kind).alias("type"), F.coalesce(F.col(current), F.lit(default)).alias("current"), text.alias("suggestion"))
    found = F.array_compact(F.array(
        F.when((F.col("f") < least) & (F.col("formal") != F.col("casual")), one("formality", "_formality", "5", F.when(F.col("formal") > F.col("casual"), "Increase formality score").otherwise("Decrease formality score"))),
        F.when(F.col("c") < least, one("contractions", "_uses_contractions", "true", F.concat(F.lit("Set uses_contractions to "), F.when(F.col("short") > F.col("n") / 2, "true").otherwise("false")))),
        F.when((F.col("g") < least) & F.col("greeting").isNotNull(), one("greeting", "_typical_greeting", "", F.concat(F.lit("Update typical_greeting to match: '"), F.col("greeting"), F.lit("'")))),
        F.when((F.col("e") < least) & F.col("closing").isNotNull(), one("closing", "_typical_closing", "", F.concat(F.lit("Update typical_closing to match: '"), F.col("closing"), F.lit("'")))),
    ))
    return rows.select(F.col("inferred_persona").alias("persona_id"), F.explode(found).alias("x")).select("persona_id", "x.type", "x.current", "x.suggestion")


def canonical_id(*aliases: str) -> Column:
    """The first alias of an id that is not empty."""
    return F.coalesce(*(F.nullif(F.col(a), F.lit("")) for a in aliases))


def mismatch_text(subject: Column, quoted: Column, reply: Column, persona: Column, composite: Column) -> Column:
    """A mismatch for reading: context to 200 characters, reply to 500, as a report shows them."""
    short = lambda t, n: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(F.coalesce(t, F.lit("")))
    return F.concat_ws(
        "\n", F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit(""))), F.concat(F.lit("Context: "), short(quoted, 200)), F.concat(F.lit("Actual: "), short(reply, 500)),
        F.concat(F.lit("Persona: "), persona, F.lit(" ("), F.format_number(composite * 100, 0), F.lit("%)")),
    )


def feedback(log: DataFrame) -> DataFrame:
    """Per profile the votes (persona, good): a suggestion where bad outnumber good, well calibrated from three good and no bad."""
    rows = log.where("good is not null").groupBy("persona").agg(F.count_if("good").alias("pos"), F.count_if(~F.col("good")).alias("neg"))
    kind = F.when(F.col("neg") > F.col("pos"), "needs_refinement").when((F.col("pos") >= 3) & (F.col("neg") == 0), "well_calibrated").otherwise("mixed")
    return rows.withColumn("status", kind).withColumn("confidence", F.round(F.greatest("pos", "neg") / (F.col("pos") + F.col("neg")), 6))
