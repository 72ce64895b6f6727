"""Tables and constants of the survey data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, thresholds and gaps that decide results.
POSITIVE_LABEL = "moth"
NEGATIVE_LABEL = "nonmoth"
NULL_LABELS = (NEGATIVE_LABEL,)
TRACKING_COST_THRESHOLD = 1.0
SESSION_GAP_MINUTES = 360
CLASSIFICATION_THRESHOLD = 0.6
IMAGE_EXTENSIONS = r"(?i)\.(jpg|jpeg)$"
DETECTOR_THRESHOLDS = {"fasterrcnn_2021": 0.99, "fasterrcnn_2023": 0.80, "fasterrcnn_mobilenet_2023": 0.50}
MAX_BOXES = 500


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_BOX = T.ArrayType(T.DoubleType())

SESSIONS = _struct(id=T.LongType(), day=T.DateType(), base_directory=T.StringType(), start_time=T.TimestampNTZType(), end_time=T.TimestampNTZType(), notes=T.StringType(), num_images=T.IntegerType(), num_detected_objects=T.IntegerType())
IMAGES = _struct(id=T.LongType(), monitoring_session_id=T.LongType(), base_path=T.StringType(), path=T.StringType(), timestamp=T.TimestampNTZType(), filesize=T.IntegerType(), last_read=T.TimestampType(), last_processed=T.TimestampType(), in_queue=T.BooleanType(), notes=T.StringType(), width=T.IntegerType(), height=T.IntegerType(), num_detected_objects=T.IntegerType())
DETECTIONS = _struct(
    id=T.LongType(), image_id=T.LongType(), monitoring_session_id=T.LongType(), bbox=_BOX, area_pixels=T.IntegerType(), path=T.StringType(), timestamp=T.TimestampNTZType(),
    source_image_width=T.IntegerType(), source_image_height=T.IntegerType(), source_image_previous_frame=T.LongType(),
    specific_label=T.StringType(), specific_label_score=T.DoubleType(), binary_label=T.StringType(), binary_label_score=T.DoubleType(),
    last_detected=T.TimestampType(), model_name=T.StringType(), in_queue=T.BooleanType(), notes=T.StringType(),
    sequence_id=T.StringType(), sequence_frame=T.IntegerType(), sequence_previous_id=T.LongType(), sequence_previous_cost=T.DoubleType(), cnn_features=T.ArrayType(T.DoubleType()),
)
#: The columns that came with tracking; older tables lack them.
TRACKING_COLUMNS = ("timestamp", "source_image_width", "source_image_height", "source_image_previous_frame", "sequence_id", "sequence_frame", "sequence_previous_id", "sequence_previous_cost", "cnn_features", "area_pixels", "last_detected")
TASK = _struct(id=T.StringType(), image_id=T.StringType(), image_url=T.StringType(), reply_subject=T.StringType())
TRACK_FILE_ROW = _struct(event=T.StringType(), sequence=T.StringType(), frame=T.IntegerType(), image=T.LongType(), id=T.LongType(), path=T.StringType(), binary_label=T.StringType(), specific_label=T.StringType(), specific_label_score=T.DoubleType(), cost=T.DoubleType())
ALGORITHM = _struct(name=T.StringType(), key=T.StringType())
CLASSIFICATION = _struct(classification=T.StringType(), labels=T.ArrayType(T.StringType()), scores=T.ArrayType(T.DoubleType()), logits=T.ArrayType(T.DoubleType()), algorithm=ALGORITHM, terminal=T.BooleanType())


def conform(df, schema: T.StructType):
    """Columns of `schema`, in order and type; those that `df` lacks are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def drop_tracking(df):
    """The table as it was before tracking."""
    return df.drop(*TRACKING_COLUMNS)
