"""Answers of public services as items.  Fetching is left out: each function takes the answer's rows as a DataFrame and is plain column work."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

TOP_COMMENTS = 5


def _item(source: str, kind: str, native: Column, title: Column, url: Column, content: Column, author: Column, at: Column, *more: Column) -> list[Column]:
    return [F.concat_ws(":", F.lit(source), F.lit(kind), native.cast("string")).alias("id"), F.lit(source).alias("source_type"), title.alias("title"), url.alias("url"), content.alias("content"), author.alias("author"), at.alias("published_at"), *more]


def code_events(events: DataFrame, since: str) -> DataFrame:
    """Events of a code host (id, type, actor, repo, created_at, payload as JSON): five kinds, each with its own title and content."""
    p = lambda path: F.get_json_object("payload", path)
    who, repo = F.col("actor"), F.col("repo")
    messages = F.from_json(p("$.commits"), "array<struct<message:string>>")
    kinds = {
        "PushEvent": (F.concat(who, F.lit(" pushed "), F.coalesce(F.size(messages), F.lit(0)), F.lit(" commit(s) to "), repo), F.array_join(F.transform(F.slice(messages, 1, 3), lambda m: F.coalesce(m["message"], F.lit(""))), "\n")),
        "CreateEvent": (F.concat(who, F.lit(" created "), F.coalesce(p("$.ref_type"), F.lit("repository")), F.lit(" in "), repo), p("$.description")),
        "ReleaseEvent": (F.concat(who, F.lit(" released "), F.coalesce(p("$.release.tag_name"), F.lit("")), F.lit(" in "), repo), p("$.release.body")),
        "PublicEvent": (F.concat(who, F.lit(" made "), repo, F.lit(" public")), F.lit("")),
        "WatchEvent": (F.concat(who, F.lit(" starred "), repo), F.lit("")),
    }
    title = content = F.lit(None).cast("string")
    for k, (t, c) in kinds.items():
        title, content = F.when(F.col("type") == k, t).otherwise(title), F.when(F.col("type") == k, F.coalesce(c, F.lit(""))).otherwise(content)
    home = F.concat(F.lit("https://github.com/"), repo)
    url = F.when(F.col("type") == "ReleaseEvent", F.coalesce(p("$.release.html_url"), home)).otherwise(home)
    at = F.to_timestamp("created_at")
    return events.where(F.col("type").isin(*kinds) & (at >= F.lit(since).cast("timestamp"))).select(*_item("github", "event", F.col("id"), title, url, content, who, at))


def code_releases(releases: DataFrame, since: str) -> DataFrame:
    """Releases (id, repo, tag_name, name, body, html_url, author, published_at)."""
    at = F.to_timestamp("published_at")
    title = F.concat("repo", F.lit(" "), text.first_filled(F.col("name"), F.col("tag_name")))
    return releases.where(at >= F.lit(since).cast("timestamp")).select(*_item("github", "release", F.col("id"), title, F.col("html_url"), F.coalesce("body", F.lit("")), F.col("author"), at))


def _comments(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array("_mark"), lines)).otherwise(F.array().cast("array<string>"))


def _cut(t: Column, limit: int) -> Column:
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def stories(rows: DataFrame, comments: DataFrame, since: str, min_score: int, top: int) -> DataFrame:
    """Stories (id, place, title, url, text, by, score, time, kids) with their first live comments (id, by, text, deleted, dead), in the order of kids.

    Only the first ids of the ranking count; a story's comments are at most TOP_COMMENTS, so what is gathered is bounded.
    """
    kept = rows.where((F.col("place") < top) & (F.col("score") >= min_score) & (F.timestamp_seconds("time") >= F.lit(since).cast("timestamp")))
    asked = kept.select(F.col("id").alias("story"), F.posexplode_outer(F.slice("kids", 1, TOP_COMMENTS)).alias("pos", "kid"))
    live = comments.where("text is not null and text <> '' and not coalesce(deleted, false) and not coalesce(dead, false)")
    line = F.concat(F.lit("["), F.coalesce("by", F.lit("anon")), F.lit("]: "), _cut(F.trim(F.regexp_replace("text", "<[^>]+>", " ")), 500))
    got = asked.join(live.select(F.col("id").alias("kid"), line.alias("line")), "kid").groupBy("story").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    j = kept.join(got.withColumnRenamed("story", "id"), "id", "left").withColumn("_mark", F.lit("\n--- Top Comments ---"))
    lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    own = F.when(F.coalesce("text", F.lit("")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    url = F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), "id"))
    return j.select(*_item("hackernews", "story", F.col("id"), F.col("title"), url, F.array_join(F.concat(own, _comments(lines)), "\n\n"), F.coalesce("by", F.lit("unknown")), F.timestamp_seconds("time"), F.col("score")))


def posts(rows: DataFrame, comments: DataFrame, since: str, min_score: int, per_post: int) -> DataFrame:
    """Posts (id, subreddit, title, url, permalink, is_self, selftext, author, score, created_utc) with their best comments (post_id, id, author, body, score, distinguished)."""
    kept = rows.where((F.col("score") >= min_score) & (F.timestamp_seconds("created_utc") >= F.lit(since).cast("timestamp")))
    rank = F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("score"), "id"))
    best = comments.where("body <> '' and coalesce(distinguished, '') <> 'moderator'").withColumn("n", rank).where(F.col("n") <= per_post)
    line = F.concat(F.lit("["), F.coalesce("author", F.lit("anon")), F.lit(" ("), F.col("score"), F.lit(" pts)]: "), _cut(F.trim("body"), 500))
    got = best.select("post_id", "n", line.alias("line")).groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    j = kept.join(got.withColumnRenamed("post_id", "id"), "id", "left").withColumn("_mark", F.lit("\n--- Top Comments ---"))
    lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    own = F.when(F.coalesce("selftext", F.lit("")) != "", F.array(_cut(F.col("selftext"), 1500))).otherwise(F.array().cast("array<string>"))
    talk = F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit("")))
    url = F.when(F.col("is_self"), talk).otherwise(F.coalesce("url", talk))
    return j.select(*_item("reddit", "post", F.col("id"), F.col("title"), url, F.array_join(F.concat(own, _comments(lines)), "\n\n"), F.coalesce("author", F.lit("unknown")), F.timestamp_seconds("created_utc"), F.col("subreddit"), F.col("score"), talk.alias("discussion_url")))


def channel_messages(rows: DataFrame, since: str, most: int) -> DataFrame:
    """Messages (channel, message_id, at, text, links): the last ``most`` of each channel; the first link outside is the address."""
    n = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("message_id")))
    own = F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("message_id"))
    outside = F.filter("links", lambda u: ~u.rlike(r"^https?://(t\.me|telegram\.(me|org|dog))(/|$)"))
    kept = rows.where(F.col("at") >= F.lit(since).cast("timestamp")).withColumn("n", n).where(F.col("n") <= most)
    return kept.select(*_item("telegram", "message", F.concat_ws("/", "channel", F.col("message_id")), text.title_from(F.col("text")), F.coalesce(F.get(outside, F.lit(0)), own), F.col("text"), F.col("channel"), F.col("at")))


def tweets(rows: DataFrame, since: str) -> DataFrame:
    """Short messages (tweet_id, screen_name, name, text, url, created_at, favorite_count, reply_count); one row for each id."""
    kept = rows.where((F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.coalesce("text", F.lit("")) != "")).dropDuplicates(["tweet_id"])
    body = F.trim(F.replace(F.substring("text", 1, 50), F.lit("\n"), F.lit(" ")))
    title = F.concat(F.lit("@"), "screen_name", F.lit(": "), body, F.when(F.length("text") > 50, "...").otherwise(""))
    url = F.coalesce("url", F.concat(F.lit("https://twitter.com/"), "screen_name", F.lit("/status/"), "tweet_id"))
    return kept.select(*_item("twitter", "tweet", F.col("tweet_id"), title, url, F.col("text"), F.coalesce("name", "screen_name"), F.col("created_at"), F.col("favorite_count"), F.col("reply_count")))


def top_replies(rows: DataFrame, most: int, min_likes: int) -> DataFrame:
    """(tweet_id, replies): the best replies (tweet_id, author, reply_id, handle, text, likes, replies) by 2 * likes + replies, without the author's own and the root."""
    ok = rows.where((F.col("reply_id") != F.col("tweet_id")) & (F.lower("handle") != F.lower(F.ltrim("author", F.lit("@")))) & (F.trim("text") != "") & (F.col("likes") >= max(0, min_likes)))
    rank = F.row_number().over(Window.partitionBy("tweet_id").orderBy(F.desc(F.col("likes") * 2 + F.col("replies")), "reply_id"))
    line = F.concat(F.lit("[@"), "handle", F.lit(" | "), F.col("likes"), F.lit(" | "), F.col("replies"), F.lit("] "), F.substring(F.trim("text"), 1, 280))
    return ok.withColumn("n", rank).where(F.col("n") <= most).select("tweet_id", "n", line.alias("line")).groupBy("tweet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("replies"))


def rescored(items: DataFrame, subset: DataFrame) -> DataFrame:
    """Items with the scores that a second pass gave to a subset (id, ai_score, ai_reason)."""
    s = subset.select("id", F.col("ai_score").alias("_score"), F.col("ai_reason").alias("_reason"))
    return items.join(s, "id", "left").withColumn("ai_score", F.coalesce("_score", "ai_score")).withColumn("ai_reason", F.coalesce("_reason", "ai_reason")).drop("_score", "_reason")


def company_news(rows: DataFrame, since: str) -> DataFrame:
    """News of watch lists (seq, watchlist, url, title, body, author, symbols, date): strictly after ``since``, the first of each address."""
    at = F.to_timestamp("date")
    symbols = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("symbols", F.lit("")), ","), lambda s: F.upper(F.trim(s))), lambda s: s != ""))
    kept = rows.where(F.coalesce("url", F.lit("")).rlike("^https?://") & (at > F.lit(since).cast("timestamp")) & (F.trim("title") != ""))
    first = kept.groupBy("url").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "url"]), "seq").alias("r")).select("url", "r.*").withColumn("symbols", symbols)
    return first.select(*_item("openbb", "news", text.native_id(F.col("url")), F.trim("title"), F.col("url"), F.col("body"), F.coalesce("author", F.get("symbols", F.lit(0))), F.to_timestamp("date"), F.col("symbols"), F.col("watchlist")))


def trending(rows: DataFrame, min_stars: int, keywords: list[str], most: int, period: str, now: str) -> DataFrame:
    """Trending repositories (seq, repo_id, repo_name, description, stars, primary_language, collection_names): the first of each id that fits, by stars."""
    stars = F.coalesce(F.expr("try_cast(stars as int)"), F.lit(0))
    hay = F.lower(F.concat_ws(" ", "description", "collection_names", "repo_name"))
    fits = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(hay, F.lower(k))) if keywords else F.lit(True)
    kept = rows.where("repo_id is not null and repo_name <> ''").withColumn("stars", stars).where((F.col("stars") >= min_stars) & fits)
    first = kept.groupBy("repo_id").agg(F.min_by(F.struct("seq", "repo_name", "description", "stars"), "seq").alias("r")).select("repo_id", "r.*").orderBy(F.desc("stars"), "seq").limit(most)
    title = F.concat("repo_name", F.lit(" (+"), F.col("stars"), F.lit(f"⭐ {period})"))
    return first.select(*_item("ossinsight", "trending", F.col("repo_id"), title, F.concat(F.lit("https://github.com/"), "repo_name"), F.trim(F.coalesce("description", F.lit(""))), F.split_part("repo_name", F.lit("/"), F.lit(1)), F.lit(now).cast("timestamp"), F.col("stars")))


def monitored_news(rows: DataFrame, since: str, until: str | None = None) -> DataFrame:
    """Articles of a news monitor (url, title, seendate, domain, language); rows without address, title or a readable date are left out."""
    at = F.try_to_timestamp(F.trim("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    kept = rows.where((F.trim("url") != "") & (F.trim("title") != "") & at.isNotNull() & (at >= F.lit(since).cast("timestamp")))
    if until is not None:
        kept = kept.where(at <= F.lit(until).cast("timestamp"))
    native = text.native_id(F.concat(F.trim("seendate"), F.lit("::"), F.trim("url")))
    return kept.select(*_item("gdelt", "article", native, F.trim("title"), F.trim("url"), F.lit(None).cast("string"), F.col("domain"), at, F.col("language")))


def news_search_time(since: datetime, now: datetime, until: datetime | None = None) -> str:
    """The time part of a news search: a relative one up to 100 hours, else dates; with an end, both dates, the later a day on."""
    if until is not None:
        return f"after:{since.date().isoformat()} before:{(until.date() + timedelta(days=1)).isoformat()}"
    hours = max(1, -int(-(now - since).total_seconds() // 3600))
    return f"when:{hours}h" if hours <= 100 else f"after:{since.date().isoformat()}"


def clues(rows: DataFrame, most: int = 500) -> DataFrame:
    """Posts of an official account, kept as clues: metadata and at most ``most`` characters (never over 500)."""
    return rows.select("id", "author", "published_at", F.substring(text.collapsed(F.col("text")), 1, min(most, 500)).alias("clue"))


def subscriptions(messages: DataFrame, subscribers: DataFrame, keyword: str, leave: str) -> DataFrame:
    """The subscriber list after an inbox (sender, subject, seq): the last word of each sender counts, automatic senders never."""
    asked = messages.where(F.trim("subject").isin(keyword, leave) & ~F.lower("sender").rlike("no-?reply|mailer-daemon"))
    last = asked.groupBy(F.lower("sender").alias("email")).agg(F.max_by(F.trim("subject"), "seq").alias("subject"))
    stay = subscribers.select(F.lower("email").alias("email")).distinct().join(last.where(F.col("subject") == leave), "email", "left_anti")
    return stay.union(last.where(F.col("subject") == keyword).select("email")).distinct()
