"""Text scraped from pages: page furniture out, engagement and tags read, keywords and addresses.

Rows are independent; everything is an expression. Null texts give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T

# Furniture of scraped pages.
FURNITURE = [
    "Report this post", "Like Comment Share", "To view or add a comment", "Welcome back", "Sign in", "Join for free", "New to LinkedIn", "Email or phone", "Password",
    "Forgot password", "LinkedIn ©", "About Accessibility", "User Agreement", "Privacy Policy", "Cookie Policy", "Copyright Policy", "Brand Policy",
]
# Words that are no keywords.
STOPWORDS = (
    "the and or at in for to a an is are was were be been being have has had do does did will would could should may might must shall can of on with as by from about into through"
    " during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than"
    " too very just but if this that these those am i me my myself we our ours ourselves you your yours he him his she her hers it its they them their theirs what which who whom"
    " best world experienced years work working company"
).split()


def clean(text: Column, furniture: list[str] = FURNITURE) -> Column:
    """The text without furniture, white space made single spaces."""
    out = F.coalesce(text, F.lit(""))
    for phrase in furniture:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return T.strip(F.regexp_replace(out, r"\s+", " "))


def engagement(text: Column) -> tuple[Column, Column]:
    """Likes, from [N] or else N reactions, and N comments; 0 where there are none."""
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")).try_cast("int"), F.lit(0))
    first = number(r"\[(\d+)\]")
    return F.when(first > 0, first).otherwise(number(r"(?i)(\d+)\s+reactions?")), number(r"(?i)(\d+)\s+comments?")


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0))


def activity(url: Column) -> Column:
    """The number of a post in its address, else null."""
    return F.nullif(F.regexp_extract(url, r"activity-(\d+)", 1), F.lit(""))


def username(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/in/([^/?]+)", 1), F.lit(""))


def article_is(url: Column, name: Column, user: Column) -> Column:
    """Whether an article's address holds the user name, or the name with hyphens or without spaces."""
    low = F.lower(url)
    n = F.lower(F.coalesce(name, F.lit("")))
    held = (n != "") & (low.contains(F.replace(n, F.lit(" "), F.lit("-"))) | low.contains(F.replace(n, F.lit(" "), F.lit(""))))
    return F.coalesce(low.contains(F.lower(user)) | held, F.lit(False))


def keywords(headline: Column, company: Column, bio: Column, most: int = 5) -> Column:
    """The first distinct words of headline (three letters), company and bio (four letters) that are no stopwords."""
    low = lambda c: F.coalesce(c, F.lit(""))
    stop = F.array(*map(F.lit, STOPWORDS))
    useful = lambda words: F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)))
    parts = F.regexp_replace(low(headline), r"(?i)[|@-]|\bat\b", " ")
    firm = T.strip(F.regexp_replace(low(company), r"[^\p{L}\p{N}_\s]", ""))
    firm = F.when((firm != "") & (F.lower(low(company)) != "unknown"), F.array(firm)).otherwise(F.array().cast("array<string>"))
    life = F.when(F.lower(low(bio)) != "unknown", low(bio)).otherwise("")
    words = F.concat(useful(F.regexp_extract_all(parts, F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0))), useful(firm), useful(F.regexp_extract_all(life, F.lit(r"\b[A-Za-z]{4,}\b"), F.lit(0))))
    lowered = F.transform(words, lambda w: F.lower(w))
    first = F.filter(F.transform(words, lambda w, i: F.when(F.array_position(lowered, F.lower(w)) == i + 1, w)), lambda w: w.isNotNull())
    return F.slice(first, 1, most)


def queries(site: str, name: Column, words: Column, year: int, span: int = 3) -> Column:
    """Search texts: the name with each of the last years, then with each keyword."""
    years = F.transform(F.sequence(F.lit(year), F.lit(year - span + 1), F.lit(-1)), lambda y: F.concat(F.lit(f"site:{site} \""), name, F.lit("\" "), y.cast("string")))
    return F.array_distinct(F.concat(years, F.transform(words, lambda w: F.concat(F.lit(f"site:{site} \""), name, F.lit("\" "), w))))


def profile_facts(text: Column) -> Column:
    """Followers, connections and the about text of a scraped profile; null where the page has none."""
    number = lambda p: F.replace(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("long")
    about = F.nullif(T.strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)About[ \t]*\n(\S.*?)(?:\n\n|$)", 1)), F.lit(""))
    return F.struct(number(r"(?i)([\d,]+)\s+followers").alias("followers"), number(r"(?i)([\d,]+)\+?\s+connections").alias("connections"), about.alias("about"))


# Words of titles that make a search.
TITLES = ["CEO", "founder", "director", "VP", "manager", "engineer", "consultant"]


def smart_queries(company: Column, title: Column, past: Column, industry: Column, most: int = 6) -> Column:
    """Search words of a profile: the company, the words of its title, up to three past companies, the industry; each once, longer than two letters."""
    low = F.lower(F.coalesce(title, F.lit("")))
    titles = F.filter(F.array(*map(F.lit, TITLES)), lambda t: low.contains(F.lower(t)))
    every = F.concat(F.array(company), titles, F.slice(F.coalesce(past, F.array().cast("array<string>")), 1, 3), F.array(industry))
    return F.slice(F.array_distinct(F.filter(F.transform(every, T.strip), lambda q: q.isNotNull() & (F.length(q) > 2))), 1, most)


def own_urls(items: DataFrame, owner: str, url: str, username: str, order: str, most: int | None = None) -> DataFrame:
    """(owner, url, place): each owner's addresses that hold the user name, once each by url_key, in the order given.

    `most` limits an owner's list, as a search does; ranks are within owners.
    """
    from scriptorium.operators.posts import url_key

    rows = items.where(F.lower(url).contains(F.lower(username)) & F.col(url).rlike("(?i)/posts/|activity|/pulse/"))
    first = rows.withColumn("_k", url_key(F.col(url))).groupBy(owner, "_k").agg(F.min(F.struct(order, url)).alias("m")).select(owner, f"m.{url}", f"m.{order}")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(order, url)))
    return (ranked if most is None else ranked.where(F.col("place") <= most)).select(owner, url, "place")


def search_results(results: DataFrame, owner: str) -> DataFrame:
    """Results of searches (link, url): the address, from link or else url, of all queries and engines together."""
    return results.select(owner, F.coalesce(F.nullif("link", F.lit("")), "url").alias("url"), "rank").where("url is not null")
