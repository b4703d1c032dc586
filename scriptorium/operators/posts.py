"""Social posts: quality, ownership, engagement, and style measures of groups of posts.

Posts have group, post_id, text, likes, comments. Null texts count as empty, null counts as
0. As with mails, measures of a post are expressions and only sums are grouped; ties among
labels go by the label, ties among posts by post_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# Thresholds, words and character ranges of the post measures.
MIN_CHARS = 200
TECH = ["ai", "strategy", "product", "future", "scale", "model"]
DOMAIN = ["product", "ai", "team", "model", "agent", "discovery", "scale", "context", "workflow"]
CALLS = ["join", "apply", "check out", "looking for", "hiring"]
ASKS = ["tag", "share", "comment", "join", "apply"]
SMILEYS = r"[\x{1F600}-\x{1F64F}]"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}]"
)


def weight(likes: Column, comments: Column) -> Column:
    """Engagement on a log scale, at least 1; a comment counts twice."""
    return F.greatest(F.lit(1.0), F.log1p(F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0)) * 2))


def post_quality(text: Column) -> Column:
    """The reason to reject a post, '' for none."""
    text = F.coalesce(text, F.lit(""))
    bare, n = T.strip(text), F.length(text)
    cut = bare.endswith("... [Read more]") | bare.endswith("See more")
    return F.when(n < MIN_CHARS, "too_short").when(cut & (n < 500), "truncated").when(text.startswith("Reposted") & (n < 300), "repost").otherwise("")


def owned(user_id: Column, url: Column, owner_id: Column, username: Column) -> Column:
    """Whether a post is its profile's own: the user is the owner and the address holds the name."""
    return F.coalesce((user_id == owner_id) & url.contains(username), F.lit(False))


def url_key(url: Column) -> Column:
    """An address for comparison: lower case, https, without the closing slash, then without the query."""
    low = F.regexp_replace(F.lower(T.strip(url)), "^http://", "https://")
    return F.regexp_replace(F.regexp_replace(low, "/+$", ""), r"\?.*$", "")


def profile_url(text: Column) -> Column:
    """A profile's full address from a name or a partial address."""
    bare = F.regexp_replace(T.strip(text), "/+$", "")
    return F.when(bare.rlike("^https?://"), bare).when(bare.contains("/in/"), F.concat(F.lit("https://"), bare)).otherwise(F.concat(F.lit("https://www.linkedin.com/in/"), bare))


def first_union(first: DataFrame, second: DataFrame, url_col: str) -> DataFrame:
    """(url, key): the addresses of both frames once, those of the first before those of the second."""
    both = first.select(F.col(url_col).alias("url"), F.lit(0).alias("o")).unionByName(second.select(F.col(url_col).alias("url"), F.lit(1).alias("o")))
    return both.withColumn("key", url_key(F.col("url"))).groupBy("key").agg(F.min(F.struct("o", "url")).alias("m")).select("key", "m.url", F.col("m.o").alias("source"))


def _posts(df: DataFrame) -> DataFrame:
    return df.select(
        "group", "post_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("t"),
        F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("comments", F.lit(0)).alias("comments"),
    ).withColumn("w", weight(F.col("likes"), F.col("comments")))


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), value.cast("int")))


def _tone(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    tech = sum((T.occurrences(F.lower("t"), t) for t in TECH), F.lit(0))
    sums = rows.groupBy("group").agg(
        mean(F.length("t")).alias("len"), mean(F.regexp_count("t", F.lit(SMILEYS))).alias("emo"), mean(F.col("t").contains("?").cast("int")).alias("que"), F.avg(tech).alias("tech"),
    )
    step = lambda c, by: F.when(c, by).otherwise(0)
    return sums.select(
        "group",
        _clamped(7 - step(F.col("emo") > 2, 2) - step(F.col("len") < 200, 1) + step(F.col("len") > 1000, 1)).alias("formality"),
        _clamped(5 + step(F.col("emo") > 0.5, 2) + step(F.col("que") > 0.3, 1)).alias("warmth"),
        _clamped(6 + step(F.col("tech") > 2, 2) + step(F.col("len") > 800, 1)).alias("authority"),
        F.lit(7).alias("directness"),
        F.round("len", 4).alias("weighted_length"),
    )


def tone(df: DataFrame) -> DataFrame:
    """Formality, warmth, authority and directness from engagement-weighted means."""
    return _tone(_posts(df))


def structure(df: DataFrame) -> DataFrame:
    """Whether openings hook, closings call, and bullets and hashtags occur."""
    lines, last = F.split("t", "\n", -1), F.split(T.strip(F.col("t")), "\n", -1)
    return _posts(df).groupBy("group").agg(
        F.bool_or(F.substring(F.get(lines, F.lit(0)), 1, 50).rlike("[?!]")).alias("has_hook"),
        F.bool_or(F.substring(F.element_at(last, -1), 1, 50).contains("?")).alias("has_call"),
        F.bool_or(F.col("t").rlike("[•-]")).alias("has_bullets"),
        F.bool_or(F.col("t").contains("#")).alias("has_hashtags"),
    )


def keywords(df: DataFrame, top: int = 20) -> DataFrame:
    """(group, word, n): the domain's words among each group's most used words of four letters or more."""
    words = _posts(df).select("group", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).where("length(word) >= 4")
    counts = words.groupBy("group", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("k") <= top).where(F.col("word").isin(DOMAIN)).select("group", "word", "n")


def top_words(df: DataFrame, top: int = 5) -> DataFrame:
    """(group, rank, word, n): each group's most used words of four letters or more."""
    words = _posts(df).select("group", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).where("length(word) >= 4")
    counts = words.groupBy("group", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "word")))
    return ranked.where(F.col("rank") <= top).select("group", "rank", "word", "n")


def linguistic(df: DataFrame) -> DataFrame:
    """Sentence lengths, share of short sentences, contractions, dashes, parentheses and marks a post."""
    sents = T.filled(F.split("t", "[.!?]+", -1))
    rows = _posts(df).withColumn("s", F.transform(sents, lambda s: F.size(F.split(s, r"[ \t\n\f\r]+", -1))))
    has = lambda p: F.bool_or(F.col("t").rlike(p))
    from scriptorium.operators.mail import CONTRACTIONS

    plain = "|".join(c for c in CONTRACTIONS if c != "let's")
    return rows.groupBy("group").agg(
        F.coalesce(F.round(F.sum(F.aggregate("s", F.lit(0), lambda a, x: a + x)) / F.nullif(F.sum(F.size("s")), F.lit(0)), 1), F.lit(0.0)).alias("sentence_length_avg_words"),
        F.coalesce(F.round(F.sum(F.size(F.filter("s", lambda x: x < 8))) / F.nullif(F.sum(F.size("s")), F.lit(0)), 2), F.lit(0.0)).alias("short_punchy_ratio"),
        has(rf"(?i)\b(?:{plain})\b").alias("uses_contractions"), has("—|--").alias("uses_em_dash"),
        F.bool_or(F.col("t").contains("(") & F.col("t").contains(")")).alias("uses_parentheticals"),
        F.round(F.avg(T.occurrences(F.col("t"), "!")), 1).alias("exclamations_per_post"), F.round(F.avg(T.occurrences(F.col("t"), "?")), 1).alias("questions_per_post"),
    )


def emoji(df: DataFrame) -> DataFrame:
    """Most used emoji, their range a post, and where runs of them stand: in the first or last fifth or between."""
    rows = _posts(df).select("group", "t", F.regexp_extract_all("t", F.lit(EMOJI), F.lit(0)).alias("e"))
    ranges = rows.groupBy("group").agg(F.min(F.size("e")).alias("min_emoji"), F.max(F.size("e")).alias("max_emoji"))
    counts = rows.select("group", F.explode("e").alias("e")).groupBy("group", "e").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("count"), "e"))).where("k <= 5")
    top = top.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]), "").alias("signature_emojis"))
    # The text before each run is the split's prefix up to it.
    parts, runs = F.split("t", f"{EMOJI}+", -1), F.regexp_extract_all("t", F.lit(f"{EMOJI}+"), F.lit(0))
    starts = F.transform(
        F.sequence(F.lit(1), F.size("r")),
        lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("r", F.lit(1), i - 1), F.lit(0), lambda a, x: a + F.length(x)),
    )
    placed = rows.withColumn("p", parts).withColumn("r", runs).where("size(r) > 0").select("group", F.length("t").alias("n"), F.explode(starts).alias("at"))
    where = F.when(F.col("at") < F.col("n") * 0.2, "beginning").when(F.col("at") > F.col("n") * 0.8, "end").otherwise("middle")
    placed = placed.groupBy("group", where.alias("place")).count()
    best = placed.groupBy("group").agg(F.max("count").alias("m"), F.sum("count").alias("all"), F.min_by("place", F.struct(-F.col("count"), "place")).alias("place"))
    best = best.select("group", F.when(F.col("m") < F.col("all") * 0.5, "emphasis_points").otherwise(F.col("place")).alias("placement"))
    out = ranges.join(top, "group", "left").join(best, "group", "left")
    return out.withColumn("signature_emojis", F.coalesce("signature_emojis", F.lit(""))).withColumn("placement", F.coalesce("placement", F.lit("none")))


def platform(df: DataFrame) -> DataFrame:
    """Line breaks, paragraphs, hashtags, hooks, asks and lengths, the lengths by linear interpolation."""
    t = F.col("t")
    n = F.length("t")
    breaks = F.when(n > 0, T.occurrences(t, "\n\n") / (n / 100)).otherwise(0.0)
    tags = F.size(F.regexp_extract_all("t", F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0)))
    last_tag = n - F.locate("#", F.reverse("t"))
    paras = T.filled(F.split("t", "\n\n", -1))
    single = F.size(F.filter(paras, lambda p: F.regexp_count(p, F.lit("[.!?]+")) <= 1))
    first = T.strip(F.get(F.split("t", "[.!?\n]", -1), F.lit(0)))
    call = F.lower(first).rlike("|".join(CALLS))
    hook = F.when(call, "call_to_action").otherwise("observation")
    end = F.element_at(F.split(T.strip(t), "\n", -1), -1)
    ask = end.contains("?") | F.lower(end).rlike("|".join(ASKS))
    link = F.when(t.rlike(r"https?://\S"), F.regexp_instr("t", F.lit(r"https?://\S+")) - 1)
    place = F.when(link < n * 0.33, "beginning").when(link < n * 0.66, "middle").when(link.isNotNull(), "end")
    rows = _posts(df).select(
        "group", n.alias("n"), breaks.alias("br"), t.rlike(r"(?m)^\s*[•*-]").alias("bul"), tags.alias("tags"), ((tags > 0) & (last_tag > n * 0.8)).alias("tag_end"),
        F.size(paras).alias("paras"), single.alias("single"), hook.alias("hook"), ask.alias("ask"), place.alias("place"),
    )
    mode = lambda c, kinds: F.array_max(F.array(*(F.struct(F.count_if(F.col(c) == k).alias("c"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds))))
    mean = F.avg("br")
    q = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy("group").agg(
        F.when(mean > 1.5, "high").when(mean > 0.5, "medium").otherwise("low").alias("line_break_frequency"),
        (F.coalesce(F.sum("single") / F.nullif(F.sum("paras"), F.lit(0)), F.lit(0.0)) > 0.5).alias("single_sentence_paragraphs"),
        F.bool_or("bul").alias("uses_bullets"), F.bool_or(F.col("tags") > 0).alias("uses_hashtags"),
        F.coalesce(F.min(F.when(F.col("tags") > 0, F.col("tags"))), F.lit(0)).alias("min_tags"), F.max("tags").alias("max_tags"),
        F.when(F.count_if("tag_end") > F.count("*") * 0.5, "end").otherwise("inline").alias("hashtag_placement"),
        mode("hook", ["call_to_action", "observation"])["k"].alias("primary_hook"),
        F.when(F.count_if("ask") > F.count("*") * 0.3, "invitation").otherwise("statement").alias("closing_style"),
        F.round(F.count_if("ask") / F.count("*"), 2).alias("engagement_ask_frequency"),
        mode("place", ["beginning", "end", "middle"]).alias("p"), q.alias("q"),
    )
    return out.select(
        *(c for c in out.columns if c not in ("p", "q")), F.when(F.col("p.c") > 0, F.col("p.k")).otherwise("none").alias("link_placement"),
        *(F.get("q", F.lit(i)).cast("int").alias(name) for i, name in enumerate(("min_chars", "target_chars", "max_chars"))),
    )


def persona(df: DataFrame, best: int = 3) -> DataFrame:
    """A group's tone with its post count, confidence in the sample, enthusiasm and best posts by likes, then length."""
    rows = _posts(df)
    n = F.count("*")
    sure = F.when(n < 3, 0.3).when(n < 5, 0.5).when(n < 10, 0.6).when(n < 15, 0.7).when(n < 20, 0.8).when(n < 30, 0.9).otherwise(0.95)
    emo = F.regexp_count("t", F.lit(EMOJI))
    spirit = 5 + (2 * F.avg(T.occurrences(F.col("t"), "!")) + F.avg(T.occurrences(F.col("t"), "?")) + (F.min(emo) + F.max(emo)) / 2) / 2
    sums = rows.groupBy("group").agg(n.alias("posts"), sure.alias("confidence"), _clamped(spirit).alias("enthusiasm"), F.round(F.avg("w"), 6).alias("mean_weight"))
    order = Window.partitionBy("group").orderBy(F.desc("likes"), F.desc(F.length("t")), "post_id")
    top = rows.select("group", "post_id", F.row_number().over(order).alias("k")).where(F.col("k") <= best)
    top = top.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "post_id"))), lambda x: x["post_id"].cast("string")), ",").alias("examples"))
    return _tone(rows).drop("weighted_length").join(sums, "group").join(top, "group")


def formatting(df: DataFrame) -> DataFrame:
    """Whether bullets and hashtags occur, and how often emoji do: frequent from one a post, moderate from one in two, else rare or none."""
    emo = F.sum(F.regexp_count("t", F.lit(EMOJI)))
    return _posts(df).groupBy("group").agg(
        F.bool_or(F.col("t").rlike("[•-]")).alias("uses_bullets"), F.bool_or(F.col("t").contains("#")).alias("uses_hashtags"),
        F.when(emo == 0, "none").when(emo >= F.count("*"), "frequent").when(emo * 2 >= F.count("*"), "moderate").otherwise("rare").alias("emoji_frequency"),
    )


def variation(df: DataFrame) -> DataFrame:
    """The ranges of emoji a post and of questions a sentence, and how hooks are spread."""
    sents = F.size(T.filled(F.split("t", "[.!?]+", -1)))
    asked = F.when(sents > 0, T.occurrences(F.col("t"), "?") / sents).otherwise(0.0)
    opening = T.strip(F.get(F.split("t", "[.!\n]", -1), F.lit(0)))  # the question mark stays, so that a question is one
    hook = F.when(opening.contains("?"), "question").when(F.lower(opening).rlike("|".join(CALLS)), "call_to_action").otherwise("observation")
    rows = _posts(df).select("group", F.regexp_count("t", F.lit(EMOJI)).alias("e"), asked.alias("q"), hook.alias("h"))
    share = lambda k: F.round(F.count_if(F.col("h") == k) / F.count("*"), 2).alias(k)
    return rows.groupBy("group").agg(
        F.min("e").alias("min_emoji"), F.max("e").alias("max_emoji"), F.round(F.min("q"), 2).alias("min_questions"), F.round(F.max("q"), 2).alias("max_questions"),
        share("question"), share("call_to_action"), share("observation"),
    )


def best_post(df: DataFrame) -> DataFrame:
    """(group, post_id, text): each group's post with the most likes, then the longest, then the lowest id."""
    rows = _posts(df).groupBy("group").agg(F.min_by(F.struct("post_id", "t"), F.struct(-F.col("likes"), -F.length("t"), F.col("post_id"))).alias("b"))
    return rows.select("group", "b.post_id", F.col("b.t").alias("text"))


def batch_totals(df: DataFrame, held: float = 0.0, seed: int = 42) -> DataFrame:
    """One row: posts, likes, comments and the posts held out, a share chosen by hash."""
    chosen = F.pmod(F.xxhash64("post_id", F.lit(seed)), F.lit(10_000)) < int(held * 10_000)
    return _posts(df).agg(F.count("*").alias("posts"), F.sum("likes").alias("likes"), F.sum("comments").alias("comments"), F.count_if(chosen).alias("held"))


def sample_quality(n: Column) -> Column:
    """What a profile of so many posts is good for."""
    return F.when(n < 5, "insufficient").when(n < 10, "minimal").when(n < 15, "fair").when(n < 20, "good").otherwise("excellent")


def ownership(post: dict[str, Column], owner: dict[str, Column]) -> Column:
    """Whether a post is its owner's by any of four signs: the user id, the name in the address, the name in the author's address, the author's name."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    user = low(owner["username"])
    signs = [
        (low(post["user_id"]) == user), low(post["url"]).contains(user), low(post["author_url"]).contains(user), (low(owner["name"]) != "") & (low(post["author"]) == low(owner["name"])),
    ]
    return F.coalesce((user != "") & (signs[0] | signs[1] | signs[2]) | signs[3], F.lit(False))


# The fields of a post's record with their types, in their order.
RECORD = [
    ("url", "string"), ("text", "string"), ("likes", "int"), ("comments", "int"), ("date_posted", "string"), ("user_id", "string"), ("validation_status", "string"), ("top_comments", "array<string>"),
    ("headline", "string"), ("post_type", "string"), ("embedded_links", "array<string>"), ("images", "array<string>"), ("external_links", "array<string>"), ("tagged_people", "array<string>"),
    ("tagged_companies", "array<string>"), ("is_repost", "boolean"), ("repost_data", "string"), ("original_commentary", "string"), ("author_followers", "int"), ("author_total_posts", "int"),
    ("author_articles", "int"), ("account_type", "string"), ("post_html", "string"), ("content_type", "string"),
]


def record(df: DataFrame) -> DataFrame:
    """Posts with all fields of a record: counts default to 0, lists to empty ones, the repost flag to false, texts to null."""
    default = {"int": F.lit(0), "boolean": F.lit(False)}
    out = []
    for name, kind in RECORD:
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        empty = F.array().cast(kind) if kind.startswith("array") else default.get(kind)
        out.append((value if empty is None else F.coalesce(value, empty.cast(kind))).alias(name))
    return df.select(*out)
