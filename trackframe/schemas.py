"""Schemas of the tables the library reads and writes."""

from pyspark.sql import DataFrame

# Column names and order of the files this library has to read.
SITES = "site_id int, site_name string, location string"
VIDEOS = (
    "video_id string, site_id int, time_stamp timestamp_ntz, temperature float, humidity float, LUX float"
)
COUNTS = (
    "video_id string, blob_detection_only_csv string, blob_tracking_with_direction_csv string, "
    "yolo_detection_only_csv string, yolo_tracking_with_direction_csv string, "
    "herdnet_detection_only_csv string, "
    "herdnet_tracking_with_direction_closest_boundary_method_csv string"
)
DETECTIONS = (
    "frame_number int, x1 double, y1 double, x2 double, y2 double, confidence double"
)
TRACKS = (
    "frame_number int, ant_id double, x1 int, y1 int, x2 int, y2 int, direction string, angle double"
)
CLIP_METADATA = (
    "temperature double, humidity double, light struct<lux: double>"
)
BEHAVIOUR_LABELS = "video_id string, ant_id int, excavating string"
TRAJECTORY_FEATURES = (
    "trajectory_index long, ant_id long, video_id string, hour int, day int, date date, "
    "trajectory_length long, cluster_label int, efficiency double, straight_distance double, "
    "avg_angle_change double, total_length double, nest_proximity double"
)
ID_LIST = "ant_id long, nest_proximity double"

FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080
FRAMES_PER_SECOND = 20
DIRECTIONS = ("away", "toward", "unknown")


def require_columns(df: DataFrame, *required: str) -> DataFrame:
    """Fail at plan time when a table lacks a column an operator needs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
