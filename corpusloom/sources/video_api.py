"""A data source over a comment API: one partition for each video, paged on the executors.

Network access is a function that the caller gives, ``request(method, params) -> dict``; it is
pickled to the executors.  A failing request ends a video's pages and keeps those before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .schemas import RAW_COMMENTS

Request = Callable[[str, dict], dict]
COMMENT_PAGE, VIDEO_PAGE = 100, 50


def pages(request: Request, method: str, params: dict, most: int, page: int) -> Iterator[dict]:
    """Items of all pages of a listing, ``most`` at most."""
    got, token = 0, None
    while got < most:
        try:
            reply = request(method, params | {"maxResults": min(page, most - got)} | ({"pageToken": token} if token else {}))
        except OSError:  # comments disabled, video gone, quota spent
            return
        items = reply.get("items", [])[: most - got]
        yield from items
        got += len(items)
        token = reply.get("nextPageToken")
        if not token:
            return


def comments_of(request: Request, video_id: str, most: int, order: str = "relevance") -> Iterator[dict]:
    """Top-level comments of one video as raw rows."""
    for item in pages(request, "commentThreads", {"part": "snippet", "videoId": video_id, "textFormat": "plainText", "order": order}, most, COMMENT_PAGE):
        top = item["snippet"]["topLevelComment"]
        s = top["snippet"]
        yield {
            "comment_id": top["id"],
            "video_id": video_id,
            "channel_id": s.get("authorChannelId", {}).get("value"),
            "author": s.get("authorDisplayName"),
            "text": s.get("textOriginal", ""),
            "like_count": s.get("likeCount", 0),
            "published_at": s.get("publishedAt"),
            "pulled_at": datetime.now(timezone.utc).isoformat(),
        }


def channel_videos(request: Request, channel_id: str, n: int) -> list[str]:
    """The newest ``n`` videos of a channel, by its list of uploads; none for an unknown channel."""
    found = request("channels", {"part": "contentDetails", "id": channel_id}).get("items", [])
    if not found:
        return []
    uploads = found[0]["contentDetails"]["relatedPlaylists"]["uploads"]
    return [i["contentDetails"]["videoId"] for i in pages(request, "playlistItems", {"part": "contentDetails", "playlistId": uploads}, n, VIDEO_PAGE)]


def search_videos(request: Request, query: str, n: int, channel_id: str | None = None, language: str = "kk") -> list[dict]:
    """Long videos for a query, the most viewed first."""
    params = {"part": "snippet", "q": query, "type": "video", "videoDuration": "long", "order": "viewCount", "maxResults": min(VIDEO_PAGE, n), "relevanceLanguage": language}
    reply = request("search", params | ({"channelId": channel_id} if channel_id else {}))
    return [{"video_id": i["id"]["videoId"], "title": i["snippet"]["title"], "channel_title": i["snippet"]["channelTitle"], "published_at": i["snippet"]["publishedAt"]} for i in reply.get("items", [])]


def resolve_channel(request: Request, query: str) -> str | None:
    """The channel of the best match of three."""
    found = request("search", {"part": "snippet", "q": query, "type": "channel", "maxResults": 3}).get("items", [])
    return found[0]["snippet"]["channelId"] if found else None


def video_statistics(request: Request, ids: list[str]) -> list[dict]:
    """``video_id, comment_count, view_count`` in requests of fifty; what the API leaves out is missing here."""
    out = []
    for i in range(0, len(ids), VIDEO_PAGE):
        for item in request("videos", {"part": "statistics", "id": ",".join(ids[i : i + VIDEO_PAGE])}).get("items", []):
            s = item.get("statistics", {})
            out.append({"video_id": item["id"], "comment_count": int(s.get("commentCount", 0)), "view_count": int(s.get("viewCount", 0))})
    return out


def with_statistics(videos: DataFrame, statistics: DataFrame, min_comments: int = 200) -> DataFrame:
    """Videos with their counts, 0 where there are none, those of ``min_comments`` or more; of rows that share an id, the least by value."""
    columns = [c for c in videos.columns if c != "video_id"]
    once = videos.groupBy("video_id").agg(F.min(F.struct(*columns)).alias("_v")).select("video_id", *(F.col(f"_v.{c}").alias(c) for c in columns)) if columns else videos.distinct()
    joined = once.join(statistics.select("video_id", "comment_count", "view_count"), "video_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("comment_count", "view_count")}).where(F.col("comment_count") >= min_comments)


def comments_available(videos: DataFrame) -> DataFrame:
    """One row: the number of comments that the videos have."""
    return videos.agg(F.coalesce(F.sum("comment_count"), F.lit(0)).alias("comments"))


class _Video(InputPartition):
    def __init__(self, video_id: str):
        self.video_id = video_id


def comment_source(request: Request, videos: list[str], most: int = 300, order: str = "relevance") -> type[DataSource]:
    """A data source class to register with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Video(v) for v in videos]

        def read(self, partition):
            names = [c.split()[0] for c in RAW_COMMENTS.split(", ")]
            for comment in comments_of(request, partition.video_id, most, order):
                yield Row(**{n: comment[n] for n in names})

    class Comments(DataSource):
        @classmethod
        def name(cls):
            return "video_comments"

        def schema(self):
            return RAW_COMMENTS

        def reader(self, schema):
            return Reader()

    return Comments


def read_comments(spark: SparkSession, request: Request, videos: list[str], most: int = 300, order: str = "relevance") -> DataFrame:
    """Raw comments of the videos, straight from the API."""
    spark.dataSource.register(comment_source(request, videos, most, order))
    return spark.read.format("video_comments").load()
