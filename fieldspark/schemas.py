"""Explicit schemas of the JSON inputs and of the tables written by the library."""

DETECTION = (
    "img string, prediction int, label string, latency double, confidence double, bounding_box array<double>"
)
CLASSIFIED = DETECTION + ", classifier_confidence double"
ANNOTATION = "image_path string, bounding_box array<double>, class string, score double, iou double"
DETECTOR_CONFIG = "class_name string, search_terms array<string>, prediction_value int"
CLASSIFIER_CONFIG = "class_name string, source_image_path string, crop_coordinates array<double>"
COCO = (
    "images array<struct<id:bigint,file_name:string>>, "
    "annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:bigint,name:string>>"
)
RUN_METRICS = "task string, framework string, metrics map<string,double>, metadata map<string,string>, ts timestamp"
REQUEST = (
    "image_id string, pipe_id string, system_id string, image_path string, text_prompts array<string>, "
    "x int, y int, patch_size int, crop_size int, overlap_ratio double, threshold double, mask_threshold double"
)


def struct_of(fields: str) -> str:
    """``a int, b string`` -> ``struct<a int, b string>`` (DDL accepts it without colons)."""
    return f"struct<{fields}>"
