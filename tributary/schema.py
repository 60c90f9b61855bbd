"""Declared schemas, roles of columns and the catalog of relations.

Fixed values of the file format: the names of columns, flags and relations.
"""

from __future__ import annotations

from pyspark.sql import types as T

FLAGS = ("is_click", "is_like", "is_follow", "is_comment", "is_forward", "is_hate", "long_view", "is_profile_enter")

#: Columns of an interaction log that are read, with their types; absent ones are skipped.
LOG = T.StructType(
    [T.StructField("user_id", T.IntegerType()), T.StructField("video_id", T.IntegerType()), T.StructField("time_ms", T.LongType())]
    + [T.StructField(c, T.ByteType()) for c in FLAGS]
    + [T.StructField("play_time_ms", T.FloatType()), T.StructField("duration_ms", T.FloatType()), T.StructField("tab", T.ByteType())]
)

USER_COUNTS = ("follow_user_num", "fans_user_num", "friend_user_num", "register_days")
USER_FLAGS = ("is_lowactive_period", "is_live_streamer", "is_video_author")
ENCRYPTED = tuple(f"onehot_feat{i}" for i in range(18))
VIDEO_COUNTS = ("show_cnt", "play_cnt", "like_cnt", "follow_cnt", "share_cnt", "collect_cnt", "comment_cnt")
VIDEO_STATISTICS = ("video_id", "show_cnt", "valid_play_cnt", *VIDEO_COUNTS[1:])

#: Columns of the edge table.
EDGES = "src_type string, rel string, dst_type string, src long, dst long, attr array<double>, is_rand boolean, session_id long, seq long"

#: relation -> (source type, target type, in the structural view, in the merged seven, flag of the log it stands for)
RELATIONS: dict[str, tuple[str, str, bool, bool, str | None]] = {
    "interacted": ("user", "video", True, False, None),
    "clicked": ("user", "video", True, True, "is_click"),
    "liked": ("user", "video", True, True, "is_like"),
    "followed": ("user", "video", False, False, "is_follow"),
    "commented": ("user", "video", True, True, "is_comment"),
    "forwarded": ("user", "video", True, True, "is_forward"),
    "hated": ("user", "video", True, True, "is_hate"),
    "follows": ("user", "author", True, False, None),
    "made_by": ("video", "author", True, True, None),
    "tagged_as": ("video", "category", True, True, None),
    "next_in_session": ("video", "video", False, False, None),
}
#: The relations of the whole merged graph, in the order of their numbers.
MERGED_ALL = ("interacted", "clicked", "liked", "commented", "forwarded", "hated", "follows", "made_by", "tagged_as", "next_in_session")
#: Columns that rows of the sequence model keep, as far as they are there.
KEEP = ("user_id", "video_id", "is_click", "hist_video_ids", "timestamp_norm", "user_active_degree", "follow_user_num_range", "fans_user_num_range", "friend_user_num_range", "register_days_range", "author_id", "music_id", "upload_type", "duration_ms")
NODE_TYPES = ("user", "video", "author", "category", "session")
