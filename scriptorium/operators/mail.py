"""Mail records: original text, acceptance with a reason, recipients, thread and time, structure.

All functions take a frame with the columns subject, body, from_addr, to_addr, internal_date
and add columns in one narrow plan. Nulls count as empty texts; a missing or unreadable
time gives the label unknown; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# Thresholds and patterns of the acceptance rules, in their order.
MIN_BODY = 100
MAX_RECIPIENTS = 20
MIN_QUALITY = 0.3
FORWARD = [r"^-{5,}\s*Forwarded", "^Begin forwarded message", "^Fwd:", "^FW:"]
AUTO_REPLY = [
    "Out of Office", "Automatic reply", "Auto-Reply", "I am currently out", "Thank you for your email. I am away",
    "This is an automated response", "I'm out of the office", "will respond when I return",
]
CALENDAR = ["^Accepted:", "^Declined:", "^Tentative:", "^Invitation:", "has accepted your meeting", "has declined your meeting", "Calendar:"]


def original_text(df: DataFrame, name: str = "original") -> DataFrame:
    """Adds the body up to the first line that opens a quoted message, without lines that begin with >.

    Mail header lines at the very start are dropped, as in forwarded messages. Each step is
    a column of its own, so that no step is computed twice.
    """
    opens = F.array_position(F.transform("_lines", lambda x: x.rlike(r"(?i)^On .+ wrote:$|^-{3,}\s*Original Message\s*-{3,}")), True)
    start = F.array_position(F.transform("_kept", lambda x: ~x.startswith("From:")), True)
    kept = F.when(F.col("_opens") > 0, F.slice("_lines", F.lit(1), (F.col("_opens") - 1).cast("int"))).otherwise(F.col("_lines"))
    tail = F.when(F.col("_start") > 0, F.slice("_kept", F.col("_start").cast("int"), F.greatest(F.size("_kept"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_lines", T.lines(F.coalesce("body", F.lit("")))).withColumn("_opens", opens)
    df = df.withColumn("_kept", F.filter(kept, lambda x: ~x.startswith(">"))).withColumn("_start", start)
    return df.withColumn(name, F.array_join(tail, "\n")).drop("_lines", "_opens", "_kept", "_start")


def addresses(column: Column) -> Column:
    """The mail addresses of a header, in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(T.ADDRESS), F.lit(0)))


def quality(body: Column, original: Column, words: Column) -> Column:
    """0.4 of a length step, 0.3 of the original's share, 0.3 of distinct among all words."""
    n = F.length(original)
    step = F.when(n < 50, 0.1).when(n < 100, 0.3).when(n < 200, 0.6).when(n < 500, 0.8).otherwise(1.0)
    share = F.when(F.length(body) > 0, n / F.length(body)).otherwise(0.0)
    variety = F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)
    return step * 0.4 + share * 0.3 + variety * 0.3


def accept(df: DataFrame) -> DataFrame:
    """Adds body_length, recipient_count, original_length, quality_score and reason: the first rule that rejects, else ''."""
    body, subject = F.coalesce("body", F.lit("")), F.coalesce("subject", F.lit(""))
    df = original_text(df).withColumn("recipient_count", F.size(addresses(F.col("to_addr"))))
    df = df.withColumn("_words", F.regexp_extract_all(F.lower("original"), F.lit(T.WORD), F.lit(0)))
    df = df.withColumn("score", quality(body, F.col("original"), F.col("_words"))).drop("_words")
    reason = (
        F.when(T.strip(body) == "", "empty_body")
        .when(F.length(T.strip(F.col("original"))) < MIN_BODY, "too_short")
        .when(T.matches(body, FORWARD) | T.matches(subject, ["^Fwd:", "^FW:"]), "forward")
        .when(T.matches(body, AUTO_REPLY) | T.matches(subject, AUTO_REPLY), "auto_reply")
        .when(T.matches(subject, CALENDAR) | T.matches(body, CALENDAR), "calendar_response")
        .when(F.col("recipient_count") > MAX_RECIPIENTS, "mass_email")
        .when(F.col("score") < MIN_QUALITY, "low_quality")
        .otherwise("")
    )
    return (
        df.withColumn("body_length", F.length(body))
        .withColumn("original_length", F.length("original"))
        .withColumn("reason", reason)
        .withColumn("quality_score", F.when(F.col("reason").isin("", "low_quality"), F.round("score", 3)).otherwise(0.0))
        .drop("score")
    )


def recipient_type(n: Column) -> Column:
    return F.when(n == 1, "individual").when(n <= 5, "small_group").when(n <= 15, "team").otherwise("broadcast")


def audience(domains: Column, own: Column) -> Column:
    inside = F.size(F.filter(domains, lambda d: d == own))
    return F.when(F.size(domains) == 0, "unknown").when(inside == F.size(domains), "internal").when(inside == 0, "external").otherwise("mixed")


def thread_position(subject: Column) -> tuple[Column, Column]:
    """Position in the thread by the subject's prefix, and its depth."""
    low = F.lower(T.strip(F.coalesce(subject, F.lit(""))))
    forward, reply = low.rlike("^(fwd:|fw:)"), low.rlike("^re:")
    return F.when(forward, "forward").when(reply, "reply").otherwise("initiating"), F.when(forward | reply, 1).otherwise(0)


def time_context(ms: Column) -> tuple[Column, Column, Column]:
    """Time of day, weekday and weekend of epoch milliseconds held as text, in the session's time zone."""
    value = ms.try_cast("bigint")
    at = F.when(value.between(1, 253402300799999), F.timestamp_millis(value))
    hour = F.hour(at)
    part = F.when(at.isNull(), "unknown").when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon")
    part = part.when(hour.between(17, 20), "evening").otherwise("night")
    day = F.coalesce(F.lower(F.date_format(at, "EEEE")), F.lit("unknown"))
    return part, day, F.weekday(at) >= 5


def enrich(df: DataFrame) -> DataFrame:
    """Adds recipient, audience, thread and time columns."""
    position, depth = thread_position(F.col("subject"))
    part, day, weekend = time_context(F.col("internal_date"))
    own = F.split_part(F.get(addresses(F.col("from_addr")), F.lit(0)), F.lit("@"), F.lit(2))
    return (
        df.withColumn("recipients", addresses(F.col("to_addr")))
        .withColumn("recipient_count", F.size("recipients"))
        .withColumn("recipient_type", recipient_type(F.col("recipient_count")))
        .withColumn("recipient_domains", F.array_sort(F.array_distinct(F.transform("recipients", lambda a: F.split_part(a, F.lit("@"), F.lit(2))))))
        .withColumn("audience", audience(F.col("recipient_domains"), own))
        .withColumn("thread_position", position)
        .withColumn("thread_depth", depth)
        .withColumn("time_of_day", part)
        .withColumn("day_of_week", day)
        .withColumn("is_weekend", weekend)
    )


# Greeting and closing patterns of the structure measures.
GREETING = r"(?i)^(?:(?:Hey|Hi|Hello|Dear|Good morning|Good afternoon)\b|[\p{L}\p{N}_]+,?$)"
CLOSING = r"(?i)^(?:Best|Thanks|Cheers|Regards|Sincerely|Talk soon|-\s*[\p{L}\p{N}_]+$|[\p{L}\p{N}_]{1,3}$)"


def structure(df: DataFrame) -> DataFrame:
    """Adds counts of characters, lines, paragraphs and bullets, greeting, closing and the mean paragraph length."""
    bare = F.transform("_lines", lambda x: F.when(T.strip(x) == "", "").otherwise(x))
    blocks = F.filter(F.split(F.array_join(bare, "\n"), r"\n\n+", -1), lambda p: F.regexp_replace(p, "\n", "") != "")
    last = F.reverse(F.slice("_filled", -F.least(F.size("_filled"), F.lit(5)), F.lit(5)))
    rows = df.withColumn("_body", F.replace(F.coalesce("body", F.lit("")), F.lit("\r"), F.lit(""))).withColumn("_lines", T.lines(F.col("_body")))
    rows = rows.withColumn("_filled", T.filled(F.col("_lines"))).withColumn("_blocks", F.transform(blocks, lambda p: F.regexp_replace(p, "^\n+|\n+$", "")))
    return rows.withColumn("_last", F.when(F.size("_filled") > 0, last).otherwise(F.array().cast("array<string>"))).select(
        *df.columns,
        F.length("_body").alias("char_count"),
        F.size("_lines").alias("line_count"),
        F.size("_blocks").alias("paragraph_count"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[ \t\n\f\r]*(?:[•*-]|\d+[.)-])[ \t\n\f\r]+"))).alias("bullet_count"),
        F.get(F.filter(F.slice("_filled", 1, 3), lambda x: x.rlike(GREETING)), F.lit(0)).alias("greeting"),
        F.get(F.filter("_last", lambda x: x.rlike(CLOSING)), F.lit(0)).alias("closing"),
        (F.aggregate("_blocks", F.lit(0), lambda a, p: a + F.length(p)) / F.greatest(F.size("_blocks"), F.lit(1))).alias("avg_paragraph_length"),
    )


def split_reply(df: DataFrame) -> DataFrame:
    """Adds quoted_text and reply_text.

    Lines that begin with > or | and lines after them, or after a line `On ... wrote`, are
    quoted until a blank line that no such line follows. Lines are letters of a text of
    kinds, in which patterns find the quoted runs, so a mail's cost is linear in its lines.
    """
    body = F.replace(F.coalesce("body", F.lit("")), F.lit("\r"), F.lit(""))
    kind = lambda x: F.when(x.rlike("^[>|]"), "q").when(x.rlike(r"(?i)^On .+wrote:?$"), "w").when(x == "", "b").otherwise("o")
    # B: a blank line before a quoted one. In a quoted run other lines become O and the blank line that ends it c, or e at the mail's end.
    kinds = F.regexp_replace(F.array_join(F.transform("_bare", kind), ""), "b(?=q)", "B")
    runs = F.regexp_extract_all("_kinds", F.lit("[qw][qwoB]*b?|[^qw]+"), F.lit(0))
    run = lambda s: F.when(s.rlike("^[qw]"), F.translate(F.regexp_replace(s, "b$", "c"), "o", "O")).otherwise(F.translate(s, "B", "b"))
    done = df.withColumn("_raw", F.split(body, "\n", -1)).withColumn("_bare", F.transform("_raw", T.strip)).withColumn("_kinds", kinds)
    done = done.withColumn("_marks", F.regexp_extract_all(F.regexp_replace(F.array_join(F.transform(runs, run), ""), "c$", "e"), F.lit("."), F.lit(0)))
    lines = F.arrays_zip(F.col("_raw").alias("x"), F.col("_bare").alias("s"), F.col("_marks").alias("m"))
    quoted = F.transform(F.filter(lines, lambda y: y["m"].isin("q", "O", "B")), lambda y: F.when(y["m"] == "q", T.strip(F.regexp_replace(y["s"], "^[>|]+", ""))).otherwise(y["s"]))
    reply = F.transform(F.filter(lines, lambda y: y["m"].isin("o", "b", "c")), lambda y: y["x"])
    return done.select(*df.columns, T.strip(F.array_join(quoted, "\n")).alias("quoted_text"), T.strip(F.array_join(reply, "\n")).alias("reply_text"))


# Phrases of the tone hints, contractions.
FORMAL = ["dear ", "sincerely", "kind regards", "respectfully"]
CASUAL = ["hey ", "lol", "haha", "!!"]
WARM = ["hope you", "thank you so much", "really appreciate", "wonderful"]
CONTRACTIONS = (
    "I'm I'll I've I'd we're we'll we've we'd you're you'll you've you'd they're they'll they've they'd he's she's it's that's there's here's"
    " don't doesn't didn't can't couldn't wouldn't shouldn't won't isn't aren't wasn't weren't haven't hasn't hadn't let's what's who's"
).split()


def tone_hints(reply: Column) -> Column:
    """Hints of tone: formal, casual, warm, inquisitive, concise, detailed, uses_contractions; none for an empty text."""
    low = F.lower(reply)
    some = lambda words: F.array_max(F.array(*(low.contains(w) for w in words)))
    straight = F.translate(reply, "’‘", "''")
    short = [c for c in CONTRACTIONS if c != "let's"]
    found = [
        (some(FORMAL), "formal"), (some(CASUAL), "casual"), (some(WARM), "warm"), (T.occurrences(reply, "?") > 2, "inquisitive"),
        (F.length(reply) < 100, "concise"), (F.length(reply) > 500, "detailed"), (T.matches(straight, [rf"\b(?:{'|'.join(short)})\b"]), "uses_contractions"),
    ]
    hints = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in found)))
    return F.when(F.coalesce(reply, F.lit("")) == "", F.array().cast("array<string>")).otherwise(hints)


def signature(body: Column) -> Column:
    """The lines below a mail's last closing line, '' without one."""
    lines = F.reverse(T.filled(T.lines(F.coalesce(body, F.lit("")))))
    at = F.array_position(F.transform(lines, lambda x: x.rlike(CLOSING)), True)
    return F.when(at > 1, F.array_join(F.reverse(F.slice(lines, F.lit(1), (at - 1).cast("int"))), "\n")).otherwise("")


# Words of the recipients' seniority.
EXECUTIVE = (
    r"\bCEO\b|\bCFO\b|\bCTO\b|\bCOO\b|\bCMO\b|\bCIO\b|\bChief\s+\w+\s+Officer\b|\bVP\b|\bVice\s+President\b|\bPresident\b|\bDirector\b|\bSVP\b|\bEVP\b"
    r"|\bGeneral\s+Manager\b|\bManaging\s+Director\b|\bHead\s+of\b|\bSenior\s+Director\b"
)
JUNIOR = r"\bIntern\b|\bJunior\b|\bAssociate\b|\bEntry[-\s]?Level\b|\bCoordinator\b|\bAssistant\b"
RECRUITING = r"\binterview\b|\bcandidate\b|\bapplicant\b|\bposition\b|\bjob\b|\brole\b|\bopening\b|\bhiring\b|\brecruit\b"


def seniority(to: Column, signatures: Column, sender: Column, body: Column, audience_: Column) -> Column:
    """Whom a mail addresses: the first that fits of executive, external_client, candidate, report, peer, unknown."""
    to, sender, body = (F.coalesce(c, F.lit("")) for c in (to, sender, body))
    text = F.concat_ws(" ", to, F.coalesce(signatures, F.lit("")))
    there, here = (F.lower(F.regexp_extract(c, r"@([\p{L}\p{N}_.-]+)", 1)) for c in (to, sender))
    known = F.coalesce(audience_, F.lit(""))
    return (
        F.when(text.rlike(f"(?i){EXECUTIVE}"), "executive")
        .when((known == "external") | ((there != "") & (here != "") & (there != here)), "external_client")
        .when(body.rlike(f"(?i){RECRUITING}"), "candidate")
        .when(text.rlike(f"(?i){JUNIOR}"), "report")
        .when((known == "internal") | ((known == "") & (to == "")), "peer")
        .otherwise("unknown")
    )
