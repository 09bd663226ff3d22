"""Schemas of the catalogue. Timestamps are ISO-8601 UTC text of fixed width at the edge, so that text order is time order."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("box", T.ArrayType(T.DoubleType())), T.StructField("font_size", T.DoubleType())]))


def _of(text: str = "", required: str = "", whole: str = "", **more: T.DataType) -> T.StructType:
    fields = [T.StructField(n, T.StringType(), False) for n in required.split()]
    fields += [T.StructField(n, T.StringType()) for n in text.split()] + [T.StructField(n, T.LongType()) for n in whole.split()]
    return T.StructType(fields + [T.StructField(n, t) for n, t in more.items()])


# The stored field names, in groups.
CONTACT = "person_name person_name_kana company_name department title postal_code address tel mobile fax email website tags memo".split()
SEARCHED = [*CONTACT, "ocr_text", "back_ocr_text"]
HEAVY = "ocr_text ocr_blocks_json back_ocr_text back_ocr_blocks_json extracted_json".split()
OVERLAID = "original_image_path original_sha256 processed_image_path thumbnail_path ocr_text ocr_direction ocr_blocks_json ocr_duration_ms".split()
EXTRACTED = "person_name person_name_kana company_name department title postal_code address tel mobile fax email website".split()

CARDS = _of(
    f"original_sha256 processed_image_path thumbnail_path ocr_text ocr_blocks_json back_original_sha256 back_original_image_path back_processed_image_path back_thumbnail_path back_ocr_text back_ocr_blocks_json extracted_json {' '.join(CONTACT)} error_message source_system source_id source_filename import_batch_id owner_line_user_id",
    "id status original_image_path ocr_direction back_ocr_direction created_at updated_at",
    "ocr_duration_ms back_ocr_duration_ms extraction_duration_ms",
)
CARD_IMAGES = _of("original_sha256 processed_image_path thumbnail_path ocr_text ocr_blocks_json", "id card_id side original_image_path ocr_direction created_at updated_at", "ocr_duration_ms width height file_size")
JOBS = _of("error_message started_at finished_at", "id card_id type status created_at", "attempts")
LINE_EVENTS = _of("event_type line_user_id message_id card_id error_message", "id status created_at updated_at")
LINE_USERS = _of("display_name picture_url last_seen_at", "line_user_id status role created_at updated_at")
LINE_SESSIONS = _of("", "token_hash line_user_id expires_at created_at last_seen_at")
WEBHOOK = T.StructType([T.StructField("events", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("webhookEventId", T.StringType()), T.StructField("replyToken", T.StringType()), T.StructField("source", _of("userId")), T.StructField("message", _of("id type text"))])))])
EXTRACTION = _of(" ".join(EXTRACTED))
