from pyspark.sql import functions as F

from scriptorium.operators import posts, scraped

SCHEMA = "`group` string, post_id int, text string, likes int, comments int, w string"


def test_weights_and_quality(spark):
    df = spark.createDataFrame([("g", i, None, a, b, None) for i, (a, b) in enumerate([(500, 50), (50, 5), (2, 0), (0, 0), (1000, 100), (None, None)])], SCHEMA)
    got = [round(r[0], 3) for r in df.orderBy("post_id").select(posts.weight(F.col("likes"), F.col("comments"))).collect()]
    assert got == [6.399, 4.111, 1.099, 1.0, 7.091, 1.0]
    texts = ["x" * 200, "x" * 199, None, "x" * 300 + "See more", "x" * 600 + "See more", "Reposted " + "x" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(posts.post_quality(F.col("t"))).collect()] == ["", "too_short", "too_short", "truncated", "", "repost"]


def test_groups_with_nulls_and_none(spark):
    df = spark.createDataFrame([("a", 1, None, None, None, None), ("a", 2, "Why not? \U0001F600\n\nJoin us!", 3, 1, "x"), ("a", 3, "Same", 3, 1, "x")], SCHEMA)
    for f in (posts.tone, posts.structure, posts.linguistic, posts.emoji, posts.platform, posts.persona):
        assert len(f(df).collect()) == 1 and f(df.limit(0)).collect() == []
    assert posts.persona(df).first().examples == "2,3,1"
    e = posts.emoji(df).first()
    assert (e.min_emoji, e.max_emoji, e.signature_emojis, e.placement) == (0, 1, "\U0001F600", "middle")


def test_addresses(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(posts.url_key(F.lit("HTTP://A.test/x/?q=1"))) == "https://a.test/x/"
    assert one(posts.url_key(F.lit("https://a.test/x/"))) == "https://a.test/x"
    assert one(posts.profile_url(F.lit("jane"))) == "https://www.linkedin.com/in/jane"
    likes, comments = scraped.engagement(F.lit("[512] 45 Comments"))
    assert (one(likes), one(comments)) == (512, 45)
    assert one(scraped.clean(F.lit("Sign in  a \n b Report this post"))) == "a b"
    assert one(scraped.keywords(F.lit("Head of Data | Big Data at ACME"), F.lit("Unknown"), F.lit(None))) == ["Head", "Data", "Big", "ACME"]


def test_facts_of_large_numbers(spark, tmp_path):
    from scriptorium.plans.scraped import prj_facts

    ids = [3, 58_040_098, 58_040_099, 9_000_000_001_000]
    df = spark.createDataFrame([("linkedin_post", "a", i, "t") for i in ids], "source string, author_id string, doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.post_id: (r.followers, r.connections, r.about) for r in prj_facts(spark, str(tmp_path)).collect()}
    assert got == {i: (i * 37, None if i % 2 else 500, "Writes mails." if i % 3 else None) for i in ids}
