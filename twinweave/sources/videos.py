"""Video properties as columns: the schema, and what is derived from raw values. No decoder is bundled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions import display

RAW = (
    "file_path string, duration_seconds double, frame_rate_raw long, width int, height int, video_bitrate long, audio_bitrate long, "
    "total_bitrate long, video_codec string, audio_codec string, container string, audio_sample_rate long, audio_channels int"
)


def derive(raw: DataFrame) -> DataFrame:
    """Frame rate from thousandths, whether there is sound, number of frames, and display texts."""
    rate = F.coalesce(F.col("frame_rate_raw"), F.lit(0)) / 1000
    return raw.withColumns(
        {
            "frame_rate": rate,
            "has_audio": F.coalesce(F.col("audio_bitrate") > 0, F.lit(False)),
            "total_frames": display.total_frames("duration_seconds", rate),
            "duration_text": display.duration_text("duration_seconds"),
            "bitrate_text": display.bitrate_text("video_bitrate"),
            "channels_text": display.channels_text("audio_channels"),
        }
    )
